import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weirflow.llm import fingerprint as fp
from weirflow.llm import packing, queries


def brute_scale(text, ranks, w, run, popular):
    """Windows of one scale that are features, one by one."""
    cost = lambda window: sum(round(65536 * c * np.log2(c)) for c in Counter(window).values())
    top = cost(text[:1] * w)
    rank = [ranks[(top - cost(text[i : i + w])) * 1023 // top] for i in range(len(text) - w + 1)]
    times = Counter(min(range(i, i + run), key=lambda j: (rank[j], j)) for i in range(len(rank) - run + 1))
    return rank, [text[i : i + w] for i in sorted(times) if times[i] >= popular]


def brute_features(text, ranks):
    coarse = brute_scale(text, ranks[0], 64, 64, 16)[1] if text else []
    if len(coarse) >= 12 or not text:
        return coarse
    rank, fine = brute_scale(text, ranks[1], 8, 4, 1)
    if coarse or fine:
        return coarse + fine
    i = min(range(len(rank)), key=lambda j: (rank[j], j)) if rank else 0
    return [text[i : i + 8]]


def brute_hash(window):
    if len(window) in (8, 64):
        return int(fp._hashes(np.frombuffer(window, np.uint8), np.zeros(1, np.int64), len(window))[0])
    return int.from_bytes(hashlib.blake2b(window, digest_size=8).digest())


def test_features_match_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"abcd efgh the of\n"), n)) for n in (0, 1, 7, 8, 10, 11, 40, 64, 65, 126, 127, 128, 500, 0, 3000)] + [b"a" * 700]
    ranks = np.stack((rng.permutation(1024), rng.permutation(1024)))
    monkeypatch.setattr(fp, "CHUNK", 97)
    for i, t in enumerate(texts):
        alone = fp.digests([t], ranks)[0]
        assert np.array_equal(fp.digests(texts, ranks)[i], alone)
        want = brute_features(t, ranks)
        bits = np.zeros(-(-len(want) // 160) * 2048, np.uint8)
        for k, h in enumerate(map(brute_hash, want)):
            for j in range(5):
                bits[k // 160 * 2048 + (h >> 11 * j) % 2048] = 1
        assert np.array_equal(np.packbits(bits), alone.ravel())


def test_rarity_counts_every_text(spark):
    """Both scales are ranked by the windows of all texts, long ones too."""
    texts = ["abcdefgh" * 20, "aaaaaaab" * 3, "aabbccdd" * 400, "aaaaaaaa" * 900 + "abcabcab" * 50, None, "", "abc"]
    ranks = fp.rarity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for found, w in zip(ranks, (64, 8), strict=True):
        cost = lambda window: sum(round(65536 * c * np.log2(c)) for c in Counter(window).values())
        counts = Counter()
        for t in texts:
            t, top = (t or "").encode(), cost("a" * w)
            counts.update((top - cost(t[i : i + w])) * 1023 // top for i in range(len(t) - w + 1))
        want = sorted(range(1024), key=lambda level: (counts[level], level))
        assert sorted(range(1024), key=found.__getitem__) == want


def test_compare_edits(docs, none):
    rows, source = fp.compare_edits(docs, fp.rarity(docs)).collect(), docs.collect()
    order = sorted(((r.doc_id is None, -(r.doc_id or 0), r.text or "") for r in source))
    texts = [t for _, _, t in order]
    want = Counter()
    for i, (absent, key, text) in enumerate(order):
        changed = fp.edited(text, texts[(i + 1) % len(texts)])
        want[None if absent else -key, len(text), hashlib.sha256(changed.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    digest = Counter((r.doc_id, r.fingerprint) for r in rows)
    assert digest == Counter((r.doc_id, r.fingerprint) for r in fp.fingerprint(docs, fp.rarity(docs)).collect())
    assert digest[100, "0:"] == digest[101, "0:"] == 1
    assert fp.compare_edits(none, fp.rarity(none)).collect() == []


def test_edited_texts_are_closer_than_others(spark):
    rows = queries.op1_improbable_features(spark, "/root/testdata/sf0.001").collect()
    assert np.mean([r.near_edited > r.near_next for r in rows if r.n_chars > 60]) > 0.97
    long = [r for r in rows if r.n_chars > 600]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97
    assert np.mean([r.near_edited for r in long]) > 0.3 > 0.1 > np.mean([r.near_next for r in long])


def test_pack_round_trip(docs, none):
    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    docs = docs.unionByName(docs.where("doc_id = 103").withColumn("text", F.lit("a<|endoftext|> b <|endoftext|><|endoftext|>\n<|endof")).withColumn("doc_id", F.lit(200).cast("long")))
    rows, source = packing.pack(docs, path, public_tokenizers.PATTERN, items=40).collect(), docs.collect()
    pieces, windows, by_id = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in source:
        by_id[r.doc_id].append(np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    for r in rows:
        assert len(r.tokens) == 4 * r.length
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert set(pieces) == set(by_id)
    for k, wanted in by_id.items():
        if len(set(wanted)) == 1:
            starts = Counter(r.start for r in pieces[k])
            assert set(starts.values()) == {len(wanted)}
            text = b"".join(next(r.tokens for r in pieces[k] if r.start == s) for s in sorted(starts))
            assert text == wanted[0] and {r.doc_tokens for r in pieces[k]} == {len(text) // 4}
    assert packing.pack(none, path, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_windows_are_near_equal(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 513, 300).tolist()
    found = packing.windows(sizes)
    sums = [sum(sizes[i] for i in w) for w in found]
    assert sorted(i for w in found for i in w) == list(range(300))
    assert max(sums) <= 2048 and max(sums) - min(sums) <= 200 and len(found) <= -(-sum(sizes) // 2048) + 1
    assert packing.windows([2048, 2048, 1]) and packing.windows([]) == []


def test_padding_and_checksums(spark):
    rows = queries.op4_karmarkar_karp(spark, "/root/testdata/sf0.01").collect()
    used = sum(r.length for r in rows)
    assert used / (2048 * len({r.sequence_id for r in rows})) > 0.97
    assert all(0 <= r.ids_crc32 < 2**32 for r in rows) and zlib.crc32(b"") == 0
