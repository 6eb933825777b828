import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from weirflow.llm import components as parts
from weirflow.llm import simhash, wordpiece
from weirflow.llm.components import components


def groups(pairs):
    out = defaultdict(set)
    for node, root in pairs:
        out[root].add(node)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("one_task", [1 << 14, 40, 0])
def test_components(spark, monkeypatch, one_task):
    """All links in one task, some rounds of contraction before it, contraction to the end."""
    monkeypatch.setattr(parts, "ONE_TASK", one_task)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 470)] + [(999, i) for i in range(600, 680)] + [(5, 5)]
    group = {x: x for e in edges for x in e if e[0] != e[1]}
    for a, b in edges * 80:
        if a != b:
            group[a] = group[b] = min(group[a], group[b])
    found = components(spark.createDataFrame(edges, "u long, v long"))
    assert groups((r.node, r.root) for r in found.collect()) == groups(group.items())
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def jaccard(a, b):
    a, b = (set(simhash.shingles(x.encode(), 5)) for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_verified_near_copies(spark, monkeypatch):
    """Near copies by exact similarity, in tiles smaller than the groups."""
    monkeypatch.setattr(simhash, "SETS", 6)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.randint(40, 160))) for _ in range(12)]
    for t in texts[:8]:
        for _ in range(8):
            cut = t.split()
            for _ in range(rng.randint(0, 4)):
                cut[rng.randrange(len(cut))] = rng.choice(words)
            texts.append(" ".join(cut))
    texts += ["", None, "", "one two", "one two", "ONE two"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = simhash.near_duplicates(docs, 5, 32, 128, repeats=False, similarity=0.8).collect()
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i] or "", texts[j] or "") >= 0.8 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(group))


def greedy(text, pieces):
    total = 0
    for word in text.split():
        word, at = "▁" + word, 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
            total += 1 if end else len(word[at].encode())
            at = end or at + 1
    return total


def test_counts_match_greedy_segmentation(docs, none):
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    counts = wordpiece.count_tokens(docs, path).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in counts) == sorted((str(r.doc_id), len((r.text or "").split()), greedy(r.text or "", pieces)) for r in docs.collect())
    assert wordpiece.count_tokens(none, path).collect() == []


def test_failure_links_on_small_vocabularies():
    rng = random.Random(9)
    for _ in range(60):
        pieces = {"".join(rng.choices("ab▁c", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 14))}
        walk = wordpiece.Automaton(sorted(pieces))
        for _ in range(40):
            word = "".join(rng.choices("abcdé", k=rng.randint(0, 14)))
            assert walk.length("▁" + word) == greedy(word or "", pieces) if word else True


def test_short_near_copies_are_proposed():
    """The worst case of few shingles: of five, one is in one text only. Exact binomial of the bits that differ."""
    from math import comb

    import corpus_pipeline as cp

    # A majority of four and one of five shingles differ where two of the four and the fifth are ones.
    p = comb(4, 2) / 2**5
    missed = sum(comb(cp.BITS, k) * p**k * (1 - p) ** (cp.BITS - k) for k in range(cp.RADIUS + 1, cp.BITS + 1))
    assert missed < 1e-5


def test_every_text_of_a_fingerprint_is_verified(spark, monkeypatch):
    """All fingerprints equal: what counts are the sets, not the smallest id of the fingerprint."""
    words = [f"w{i}" for i in range(60)]
    texts = ["other words that are like none of the rest here at all", " ".join(words[:30]), " ".join(words[:31]), " ".join(words[30:]), "a b c", "a b d", "", None]
    monkeypatch.setattr(simhash, "set_fingerprint", lambda held, bits: bytes(bits // 8))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = simhash.near_duplicates(docs, 5, 32, 128, repeats=False, similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}


def test_buckets_find_what_is_similar():
    """Sets at the threshold share a bucket but for 4 in 10 million; unlike ones, with a passage in common, hardly ever."""
    rng = np.random.default_rng(2)
    for n in (5, 12, 60, 400):
        for _ in range(200):
            both, one = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n // 4, np.uint64)
            assert (simhash.buckets(both) == simhash.buckets(np.concatenate((both, one)))).any()
    shared = rng.integers(0, 1 << 63, 50, np.uint64)
    met = [simhash.buckets(np.concatenate((shared, rng.integers(0, 1 << 63, 450, np.uint64)))) for _ in range(150)]
    assert sum((a == b).any() for i, a in enumerate(met) for b in met[:i]) < 150


def test_several_texts_of_an_id_and_groups_that_a_pivot_does_not_connect(spark):
    """A chain of near copies whose ends are unlike; repeated ids with other texts; long and short members."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 120])) for i in range(12)] + [(3, "another text that has the id of a link of the chain"), (30, " ".join(words[200:320]) + " end"), (31, " ".join(words[200:320]))]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 76, 256, repeats=False, similarity=0.8).collect()
    marks = {hashlib.md5(t.encode()).hexdigest(): t for _, t in rows}
    got = {(r.doc_id, marks[r.mark]): r.component_id for r in found}
    assert got == {(i, t): 3 if "another" in t else 30 if i >= 30 else 0 for i, t in rows}
