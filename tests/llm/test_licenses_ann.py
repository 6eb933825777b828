import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import ann, licenses, queries
from weirflow.llm.common import table


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_places(text):
    words, phrases = words_of(text), {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    return [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]


def brute_templates(text, templates, threshold):
    """Every block against every template, without an index."""
    out = {}
    for part in re.split(r"\n[ \t\r\x0b\x0c]*\n", text or ""):
        lines = part.split("\n")
        for block, line in [(x, True) for x in lines] + ([(part, False)] if len(lines) > 1 else []):
            have = set(words_of(block))
            for t, (_, template) in enumerate(templates):
                need = set(words_of(template))
                share = len(need & have) / len(need)
                if share >= threshold - 1e-9 and (line or len(need) >= licenses.LONG):
                    out[t] = max(share, out.get(t, 0))
    return out


def check(docs, templates, threshold):
    rows, source = licenses.scan(docs, templates, threshold=threshold).collect(), docs.collect()
    want = Counter()
    for r in source:
        at, met = brute_places(r.text), brute_templates(r.text, templates, threshold)
        starts, base = [i for i, _ in at], {label for _, label in at}
        labels = base | {templates[t][0] for t in met}
        score = 1.0 if base else max(met.values(), default=0.0)
        want[r.doc_id, len(words_of(r.text)), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9), tuple(sorted(met))] += 1
    assert Counter((*r[:7], round(r.score, 9), tuple(r.templates)) for r in rows) == want
    return want


def test_scan_matches_brute_force(docs, none):
    check(docs, licenses.TEMPLATES, 0.8)
    assert licenses.scan(none).collect() == []


def test_blocks_near_templates(spark):
    """Template texts with words lost and added, split over lines, doubled phrases."""
    rng, rows = np.random.default_rng(2), []
    for _, template in licenses.TEMPLATES:
        for lost in (0, 0.1, 0.2, 0.3):
            words = [w for w in template.split() if rng.random() >= lost] + ["more", "words"]
            rows += [" ".join(words), "\n".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6)), "\n \n".join(words)]
    rows += ["MIT License mit license. Apache-License", "general public\nlicense", "the mit", "license " * 3, "mitlicense", "é mit license é"]
    want = check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), licenses.TEMPLATES, 0.8)
    assert sum(bool(k[-1]) for k in want) > 20
    check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), licenses.TEMPLATES, 0.5)


def test_wrapped_short_notices(spark, tmp_path):
    """Short notices broken over lines, against every run of words of every paragraph, through the registered query."""
    texts = ["\n".join(t.split()[i] for i in range(len(t.split()))) for _, t in licenses.TEMPLATES]
    texts += ["This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.", "Released under\n\nthe MIT License.", "This is free\n" + "and more words in between " * 9 + "\nunencumbered software released into the public domain.", "# Licensed under\n# CC BY-NC 4.0."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op7_license_join(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        met = brute_templates(text, licenses.TEMPLATES, 0.8)
        for part in re.split(r"\n[ \t\r\x0b\x0c]*\n", text):
            words = words_of(part)
            for t, (_, template) in enumerate(licenses.TEMPLATES):
                need, length = set(words_of(template)), len(words_of(template))
                share = max(len(need & set(words[k : k + length])) / len(need) for k in range(len(words)))
                if len(need) < licenses.LONG and share >= 0.8 - 1e-9:
                    met[t] = max(share, met.get(t, 0))
        assert found[i].templates == ",".join(map(str, sorted(met)))
    n = len(licenses.TEMPLATES)
    assert "cc-by-nc" in found[n].labels.split(",") and found[n].score == 1.0 and found[n + 3].labels == "cc-by-nc"


def brute_search(rows, step, top):
    """rows: (id, vector) of those that take part."""
    out = {}
    for q, v in rows:
        if q % step == 0:
            scored = sorted((-float(np.dot(np.float64(v), np.float64(x))), i) for i, x in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:top]]
    return out


def test_recall_on_a_whole_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    want = brute_search([(r.vec_id, r.embedding) for r in df.collect()], 20, 20)
    got = {}
    for r in queries.op8_additive_quantisation(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    assert all([x[0] for x in rows] == list(range(1, 21)) for rows in got.values())
    assert np.mean([len({x[1] for x in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    exact = {q: dict(rows) for q, rows in want.items()}
    assert all(abs(s - exact[q][i]) < 1e-12 for q, rows in got.items() for _, i, s in rows if i in exact[q])


@pytest.mark.parametrize("block", [10_000, 17])
def test_search_edges(spark, monkeypatch, block):
    """Vectors that take no part, ties, repeated vectors, small tables, several blocks; clashing columns."""
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "QUERIES", 2)
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(60)]
    good = [(i, v) for i, v in good if any(v)] + [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(60, 90)]
    bad = [(100, None), (120, [0.0] * 6), (140, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (160, [float("nan")] * 6), (180, [float("inf")] * 6), (200, [1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<float>, code string, score int")
    found = ann.search(df, lambda c: F.pmod(c, F.lit(20)) == 0, top=7)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_search(good, 20, 7)
    few = df.where("vec_id in (20, 21, 22)")
    assert len(ann.search(few, lambda c: F.pmod(c, F.lit(20)) == 0).collect()) == 2
    for nobody in (df.where("false"), df.where("vec_id >= 100"), df.where("vec_id = 20")):
        assert ann.search(nobody, lambda c: F.pmod(c, F.lit(20)) == 0).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_are_found_where_codes_cannot_tell(spark, seed):
    """Crowds of near copies with one code, lengths over many orders and hardly any books: still every nearest one."""
    rng = np.random.default_rng(seed)
    wide = rng.normal(size=(1500, 24)) * np.exp(rng.normal(size=(1500, 1)) * 3)
    crowd = rng.normal(size=(3, 1, 24)) + 1e-3 * rng.normal(size=(3, 300, 24))
    x = np.concatenate((wide, crowd.reshape(-1, 24), np.full((100, 24), 2.0)))[rng.permutation(2500)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: F.pmod(c, F.lit(20)) == 0, books=2, sample=600)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [i for i, _ in w] for q, w in brute_search(rows, 20, 20).items()}
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) == 1.0


def test_codes_come_near():
    x = np.random.default_rng(0).normal(size=(600, 16))
    books = ann.train(x, books=4, words=32)
    near = lambda beam: ((x - ann.decode(ann.encode(x, books, beam), books)) ** 2).sum()
    assert near(8) <= near(1) < 0.6 * (x**2).sum()


def test_recall_where_codes_decide():
    """20,000 vectors without structure: under 5 % of them reranked, and for every twentieth as a query."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 64))
    ids, most = np.arange(len(x)), ann.reranked(len(x))
    assert most < 0.05 * len(x) and ann.reranked(500) < 0.15 * 500
    books = ann.train(x[:4000], words=256)
    codes = ann.encode(x, books)
    scale = np.linalg.norm(x, axis=1) / np.linalg.norm(ann.decode(codes, books), axis=1)
    queries = ids[::200]
    q, r, _ = ann.best_codes(x[queries], queries, ids, codes, scale, books, most)
    exact = x[queries] @ x.T
    exact[np.arange(len(queries)), queries] = -np.inf
    want = np.argsort(-exact, axis=1)[:, :20]
    assert np.mean([np.isin(want[i], r[q == i]).mean() for i in range(len(queries))]) >= 0.9


def test_ids_that_repeat_count_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(1, 50)]
    rows = [(i, v if any(v) else [1.0] * 6) for i, v in rows]
    twice = [*rows, *rows, (20, [9.0] * 6), (7, [9.0] * 6)]
    found = ann.search(spark.createDataFrame(twice, "vec_id long, embedding array<float>"), lambda c: F.pmod(c, F.lit(20)) == 0, top=7)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_search(rows, 20, 7)
