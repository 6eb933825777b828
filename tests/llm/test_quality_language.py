import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weirflow.llm import langid, quality, queries

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
SF = "/root/testdata/sf0.01"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 4, 2, 6])
    score, link = rng.normal(size=lengths.sum()) * 2, rng.normal(size=(2, 2))
    p, pairs = quality.marginals(score, link, lengths)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in lengths:
        total, ones = 0.0, np.zeros(n)
        counts = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(score[at + i] for i in range(n) if y[i]) + sum(link[a, b] for a, b in itertools.pairwise(y)))
            total += w
            ones += w * np.array(y)
            for a, b in itertools.pairwise(y):
                counts[a, b] += w
        assert np.allclose(p[at : at + n], ones / total)
        want_pairs += counts / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_features_see_neighbours():
    x, sizes, n = quality.line_features([b"One two.\nTHREE 4\n\nOne two.", b"", b"x"])
    assert n.tolist() == [4, 1, 1] and sizes.tolist() == [8, 7, 0, 8, 0, 1]
    names = quality.NAMES
    assert x[1, names.index("upper")] == pytest.approx(5 / 6) and x[3, names.index("again")] == 1 and x[0, names.index("again")] == 0
    z = quality.with_neighbours(x, n)
    k = x.shape[1]
    assert np.array_equal(z[1, k : 2 * k], x[0]) and np.array_equal(z[1, 2 * k : 3 * k], x[2]) and not z[0, k : 2 * k].any() and not z[4, k : 3 * k].any()


def test_quality_of_held_out_documents(spark):
    rows = queries.op3_line_crf(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (50, None, 0), (51, 7, 0), (100, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    rows = quality.classify(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert Counter(rows) == Counter(quality.classify(docs.repartition(7), model).collect())
    assert {r.score for r in quality.classify(docs, quality.learn(docs, labels.where("quality = 1"))).collect()} == {0.5}
    assert quality.learn(none, labels) is None and quality.classify(none, model).collect() == []
    assert quality.classify(docs, model, keep=("text", "size", "fp")).columns == ["doc_id", "text", "size", "fp", "score"]


def test_lines_of_one_document_get_different_labels(spark):
    """Junk lines of bad documents spliced into good texts, at the front, in the middle and at the end: they are bad, the others good."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels)
    known = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    junk = [x for i, t in texts.items() if known.get(i) == 0 for x in t.split("\n") if x.count("$$$") > 3 or x.count(" | ") > 3][:40]
    good = [t for i, t in texts.items() if known.get(i) == 1 and t.count("\n") > 8][:30]
    rows, where = [], {}
    for i, t in enumerate(good):
        lines, at = t.split("\n"), (0, t.count("\n") // 2, t.count("\n") + 1)[i % 3]
        rows.append((i, "\n".join(lines[:at] + junk[i : i + 4] + lines[at:])))
        where[i] = range(at, at + 4)
    found = quality.label_lines(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(found) == sum(t.count("\n") + 1 for _, t in rows)
    assert np.mean([r.good < 0.5 for r in found if r.line in where[r.doc_id]]) > 0.95
    assert np.mean([r.good > 0.5 for r in found if r.line not in where[r.doc_id]]) > 0.95
    twice = labels.unionByName(labels.where("quality = 0").withColumn("quality", 1 - F.col("quality")))
    again = quality.learn(docs, twice)
    assert np.allclose(again["w"], model["w"], atol=1e-6) and quality.label_lines(docs.limit(3), None).where("good <> 0.5").count() == 0


def test_very_many_lines():
    """Doubling over a long text gives what enumeration gives for short ones, and no number vanishes."""
    rng = np.random.default_rng(8)
    score, link = rng.normal(size=30_000) * 40, rng.normal(size=(2, 2)) * 3
    p, pairs = quality.marginals(score, link, np.array([1, 29_990, 9]))
    assert np.isfinite(p).all() and pairs.sum() == pytest.approx(29_989 + 8)
    ahead = np.zeros(2)
    for i in range(1, 29_991):  # the filter's own recursion, in logs
        own = np.array([-score[i], score[i]]) / 2
        ahead = own + (np.logaddexp.reduce(ahead[:, None] + link, axis=0) if i > 1 else 0)
        ahead -= np.logaddexp.reduce(ahead)
    assert p[29_990] == pytest.approx(np.exp(ahead[1]))


def brute_likelihood(word, pieces, p, floor):
    if not word:
        return 1.0
    total = sum(p[word[:n]] * brute_likelihood(word[n:], pieces, p, floor) for n in range(1, min(langid.LONGEST, len(word)) + 1) if word[:n] in pieces)
    return total if word[0] in pieces else total + floor * brute_likelihood(word[1:], pieces, p, floor)


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "aba", "▁", "▁a", "ba", "bab", "▁ab"]
    trie = langid.Trie(pieces)
    rng = np.random.default_rng(4)
    p = rng.random((len(pieces) + 1, 2))
    words = ["▁ab", "▁", "▁abab", "▁axb", "▁aé", "babab", "▁b" * 5]
    got = langid.Lattice(words, trie).log_likelihood(p)
    for k in range(2):
        for i, w in enumerate(words):
            assert got[i, k] == pytest.approx(np.log(brute_likelihood(w, set(pieces), dict(zip(pieces, p[:, k], strict=False)), p[-1, k])))


def brute_log(word, p, floor):
    """Log likelihood by dynamic programming over the places of a word."""
    at = [0.0]
    for e in range(1, len(word) + 1):
        flows = [at[e - n] + np.log(p[word[e - n : e]]) for n in range(1, min(langid.LONGEST, e) + 1) if word[e - n : e] in p]
        if word[e - 1] not in p:
            flows.append(at[e - 1] + np.log(floor))
        at.append(np.logaddexp.reduce(flows))
    return at[-1]


def test_words_of_any_length():
    """A word of 500 characters and one of 20,000, among short ones: nothing is cut and nothing vanishes."""
    pieces = ["a", "b", "ab", "aba", "▁", "▁a", "ba", "bab", "▁ab"]
    trie, rng = langid.Trie(pieces), np.random.default_rng(4)
    p = rng.random((len(pieces) + 1, 2)) * 1e-4
    words = ["▁ab", "▁" + "".join(rng.choice(list("abx"), 499)), "▁" + "ab" * 10_000, "▁b"]
    got = langid.Lattice(words, trie).log_likelihood(p)
    for k in range(2):
        table = dict(zip(pieces, p[:, k], strict=False))
        assert np.allclose(got[:, k], [brute_log(w, table, p[-1, k]) for w in words], rtol=1e-9)
    seen = langid.Lattice(words[1:2], trie).expected(p[:, :1], np.ones(1))
    assert sum(n * len(x) for n, x in zip(seen, [*pieces, "x"], strict=True)) == pytest.approx(500)
    assert langid.parts("a" * 70 + " b") == ["▁" + "a" * 70, "▁b"]


def test_expected_counts_are_gradients():
    """Expected piece counts equal the derivative of the likelihood by the log of each probability."""
    pieces = ["a", "b", "ab", "▁", "▁a", "ba"]
    trie, p = langid.Trie(pieces), np.random.default_rng(5).random((7, 1))
    words, counts = ["▁abab", "▁ba", "▁é"], np.array([2.0, 1.0, 3.0])
    lattice = langid.Lattice(words, trie)
    got = lattice.expected(p, counts)
    for i in range(7):
        up, down = p.copy(), p.copy()
        up[i] *= np.exp(1e-5)
        down[i] *= np.exp(-1e-5)
        slope = (counts * (lattice.log_likelihood(up) - lattice.log_likelihood(down))[:, 0]).sum() / 2e-5
        assert got[i] == pytest.approx(slope, abs=1e-6)


def test_language_of_held_out_documents(spark):
    rows = queries.op10_segmentation_unigrams(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]) > 0.97


def test_language_edges(docs, none):
    names, p = langid.learn(docs, F.lit(True), PATH)
    assert names == ["de", "en"]
    rows = langid.identify(docs, (names, p), PATH).collect()
    assert len(rows) == docs.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (100, 101, 102, 105))
    assert all(r.lang_pred in names and r.score >= 0.5 for r in rows if r.doc_id in (103, 104))
    assert Counter(rows) == Counter(langid.identify(docs.repartition(7), (names, p), PATH).collect())
    model = langid.learn(none, F.lit(True), PATH)
    assert model[0] == [] and {(r.lang_pred, r.score) for r in langid.identify(docs, model, PATH).collect()} == {("und", 0.0)}
    assert langid.identify(none, (names, p), PATH).collect() == []
