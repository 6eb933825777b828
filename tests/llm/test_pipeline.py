import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from weirflow.llm import simhash

SF = "/root/testdata/sf0.001"
STAGES = dict(cp.STAGES)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """A table folder over the awkward documents."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)] + [(None, 1, 0), (100, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, docs, none, folder, name):
    df = STAGES[name](spark, docs, folder)
    if name != cp.STAGES[-1][0]:
        assert df.columns == docs.columns
    rows = df.collect()
    assert rows and Counter(map(str, rows)) == Counter(map(str, STAGES[name](spark, docs.repartition(5), folder).collect())) or name == "packing"
    assert STAGES[name](spark, none, folder).collect() == []


def test_rejected_documents_go_and_clean_ones_stay(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in STAGES["quality classifier"](spark, docs, SF).collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)
    assert STAGES["language ID"](spark, docs, SF).count() >= 0.99 * docs.where("text rlike '\\\\p{L}'").count()


def test_one_of_each_group_of_near_copies_stays(spark, docs):
    rng = random.Random(8)
    base = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.randint(30, 200))) for _ in range(15)]
    texts = list(base)
    for t in base[:10]:
        for _ in range(6):
            words = t.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "new"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert sorted(r.doc_id for r in STAGES["SimHash near-dedup"](spark, df, SF).collect()) == sorted(set(group))


def test_the_mix_holds_whole_copies_and_a_cut_one(spark, docs, folder):
    source = defaultdict(list)
    for r in docs.collect():
        source[r.source].append(r)
    want, got = defaultdict(int), defaultdict(int)
    from weirflow.llm.mixing import mix

    for r in mix(docs).collect():
        want[r.source] += r.taken
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in STAGES["mixing sources to target weights"](spark, docs, folder).collect():
        got[r.source] += count(r.text)
        assert any((x.text or "").lstrip(" \t\n").startswith((r.text or "").strip(" \t\n")[:200]) for x in source[r.source])
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_run(spark):
    rows = cp.run(spark, SF).collect()
    assert rows and [n for n, _ in cp.STAGES] == ["quality classifier", "language ID", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing_returns_the_tokens(spark, docs, folder):
    rows = STAGES["packing"](spark, docs, folder).collect()
    assert rows and all(len(r.tokens) == 4 * r.length and zlib.crc32(r.tokens) == r.ids_crc32 for r in rows)


def test_columns_of_a_users_table_pass_through(spark, folder):
    """Columns that stages use themselves keep their values; all values of a row stay together."""
    names = ["score", "lang_pred", "size", "taken", "_h", "_kept", "_src", "_words", "_copy", "copy", "cut", "rest", "mark", "target", "a.b"]
    texts = [("the house of the river and the stone of the house " * (3 + i % 5) + f"number {i} of them.") for i in range(24)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        found = out.collect()
        assert found or name == "quality classifier"
        assert all(r[5:] == tuple(f"{n}{r.doc_id}" for n in names) and r.n_chars == len(r.text) for r in found), name
