"""Every core query against its SQL on the smallest tables, and properties that hold for any data."""

import functools
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from weirflow import oracles, queries
from weirflow.functions.text import tokens
from weirflow.operators import recommend as rec
from weirflow.operators import relational as rel

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def table(rows, columns):
    by = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in by) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, duck, name):
    found, want = queries.queries()[name](spark, SF), duck.sql(oracles.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert table(found.collect(), found.columns) == table(want.fetchall(), want.columns)


def test_word_count_golden(spark):
    df = spark.createDataFrame([("The quick brown fox jumps over the lazy dog",), ("the dog is quick, but the fox is lazy",)], "text string")
    counts = df.select(F.explode(tokens(F.col("text"))).alias("w")).groupBy("w").count().orderBy(F.col("count").desc(), "w").collect()
    assert [(r.w, r["count"]) for r in counts] == [("the", 4), ("dog", 2), ("fox", 2), ("is", 2), ("lazy", 2), ("quick", 2), ("brown", 1), ("but", 1), ("jumps", 1), ("over", 1)]


def test_token_edges(spark):
    rows = [("x" * 300,), ("aKb",), ("Étude",), ("",), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "s string").select(tokens(F.col("s")).alias("t")).collect()]
    assert got[0] == ["x" * 255] and got[1] == ["a", "b"] and got[2] == ["tude"] and not got[3] and not got[4]


@pytest.fixture
def toy(spark):
    rows = [("u1", "x"), ("u1", "y"), ("u1", "z"), ("u2", "x"), ("u2", "y"), ("u3", "x"), ("u3", "y"), ("u3", "z"), ("u4", "z")]
    return spark.createDataFrame(rows, "a string, b string")


def test_toy_sessions(toy):
    assert {(r.b, r.n) for r in rec.item_counts(toy).collect()} == {("x", 3), ("y", 3), ("z", 3)}
    w = {(r.a, r.b): r.w for r in rec.cofrequency(toy).collect()}
    assert w == {("x", "y"): 3, ("y", "x"): 3, ("x", "z"): 2, ("z", "x"): 2, ("y", "z"): 2, ("z", "y"): 2}
    cosines = {(r.a, r.b): round(r.w, 4) for r in rec.complements(toy, least=1).collect()}
    assert cosines["x", "y"] == 1.0 and cosines["x", "z"] == 0.6667
    assert {(r.a, r.b) for r in rec.complements(toy).collect()} == {("x", "y"), ("y", "x")}


def test_hot_keys_meet_in_cells(spark):
    """A key of a third of all rows and more, dealt to many cells, gives every pair of its rows once."""
    rows = [("hot", i, i / 2) for i in range(40)] + [(f"u{i % 8}", i, float(i)) for i in range(50)] + [(None, 1, 1.0), (None, 2, 2.0), ("hot", None, 0.0)]
    df = spark.createDataFrame(rows, "k string, x int, w double")
    held = [r for r in rows if r[0] is not None and r[1] is not None]
    want = sorted((x, y, v, w) for k, x, v in held for j, y, w in held if k == j and x < y)
    for cell in (1, 7, 1000):
        got = sorted((r.x, r.y, r.wx, r.wy) for r in rec.meeting(df, "k", "x", "w", cell).collect())
        assert got == want
    assert rec.meeting(df.where("false"), "k", "x").columns == ["x", "y"] and rec.meeting(df.where("false"), "k", "x").count() == 0


def test_empty_sessions(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert rec.complements(none).count() == 0
    assert rec.substitutes(rec.tfidf(rec.cofrequency(none, 2), rec.item_counts(none))).count() == 0


def test_symmetry_and_bounds(spark):
    df = rec.complements(queries.sessions(spark, SF), least=2).cache()
    assert df.where("w <= 0 or w > 1 + 1e-12").count() == 0
    assert df.select("a", "b", "w").exceptAll(df.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).count() == 0


def test_dense_ids_are_dense(spark):
    for parts in (1, 4, 16):
        ids = rel.dense_ids(spark.range(100).withColumn("k", F.col("id") % 37), "k", F.pmod("k", F.lit(parts)).cast("int"), parts)
        assert ids.select("id").distinct().count() == 37 and ids.where(F.pmod("id", F.lit(parts)) != F.col("p")).count() == 0


def test_large_sides_are_not_broadcast(spark):
    assert "BroadcastNestedLoop" not in rel.broadcast_checked(spark.range(10), 5)._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        rel.every_pair(spark.range(3), spark.range(10), 5)


def test_plans_prune_and_push(spark):
    plan = queries.scan_parquet(spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan and "o_orderdate" not in plan.split("ReadSchema")[1]


def test_pairs_meet_in_tasks_of_bounded_size(spark):
    """Lists for keys and items of any heat: every pair once, no aggregate over fewer tasks than its pairs ask for, no exchange of pairs."""
    rows = [(u, i, float(i % 5)) for u in range(30) for i in range(60) if (u * i) % 4 != 1 or i == 0] + [(None, 1, 1.0), (1, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, x int, w double")
    held = [r for r in rows if r[0] is not None and r[1] is not None]
    want = {}
    for k, x, v in held:
        for j, y, w in held:
            if k == j and x < y:
                n, s = want.get((x, y), (0, 0.0))
                want[x, y] = (n + 1, s + v * w)
    pairs = sum(n for n, _ in want.values())
    for cell, most in ((1000, 10**6), (1000, 500), (7, 500), (7, 40)):
        counts = rec.summed(df, "k", "x", F.count("*"), cell=cell, task_pairs=most)
        assert sorted((r.x, r.y, r.w) for r in counts.collect()) == sorted((x, y, n) for (x, y), (n, _) in want.items())
        sums = rec.summed(df, "k", "x", F.sum(F.col("wx") * F.col("wy")), "w", cell, most)
        assert sorted((r.x, r.y, r.w) for r in sums.collect()) == sorted((x, y, s) for (x, y), (_, s) in want.items())
        lists, by = rec.partners(df, "k", "x", cell=cell, task_pairs=most)
        assert lists.rdd.getNumPartitions() >= pairs / most
        moved = lists.groupBy(F.spark_partition_id()).agg(F.sum(F.size("ys")).alias("n")).agg(F.max("n"), F.sum("n")).first()
        assert moved[1] == pairs and moved[0] < 10 * most
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan.split("Exchange")[1]


def test_violations_within_and_between_tasks(spark, monkeypatch):
    """Rows before their predecessor are counted within batches, across them and across tasks; a sort by ranges leaves none and no large task."""
    rng = __import__("random").Random(4)
    rows = [(rng.randrange(3), rng.choice([None, 1, 2, 3]), rng.choice([None, 0.5, float("nan"), 1.5])) for _ in range(300)]
    df = spark.createDataFrame(rows, "p int, a long, b double").repartition(5).cache()
    place = lambda x: (x is not None, x != x, x if x is not None and x == x else 0)
    want, last = 0, {}
    for r in df.collect():
        key = (place(r.a), place(r.b))
        want += r.p in last and last[r.p] > key
        last[r.p] = key
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert rel.sorted_violations(df, "p", ["a", "b"]).first().violations == want > 0
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(rel, "RANGE_ROWS", 20)
    ranged = rel.by_ranges(df, ["p", "a", "b"], 300)
    assert rel.sorted_violations(ranged, "p", ["a", "b"]).first().violations == 0
    assert ranged.rdd.getNumPartitions() > 5 and rel.sorted_violations(df.where("false"), "p", ["a"]).first().violations == 0


def test_buckets_are_taken_of_combined_records(spark):
    """The string hash of a word is computed once for each producer and word, not for each occurrence: it stands above the first aggregate."""
    plan = queries.word_count_graph(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.rpartition("Aggregate [")[2].split("\n", 1)[1]  # without what the aggregate gives out
    assert "conv(" in plan and "conv(" not in below


def test_lists_are_made_in_tasks_of_bounded_size(spark):
    """Tasks that make lists grow in number with the pairs, are never merged by the planner, and give every pair once, of hot keys too."""
    rows = [(u, i) for u in range(40) for i in range(50) if (u * i) % 3 != 1]
    df = spark.createDataFrame(rows, "k int, x int")
    users = {}
    for k, x in rows:
        users.setdefault(k, set()).add(x)
    want = sorted((x, y) for xs in users.values() for x in xs for y in xs if x < y)
    for cell, least in ((1000, 1), (7, 3)):
        lists, by = rec.partners(df, "k", "x", cell=cell, task_pairs=200)
        plan = lists._jdf.queryExecution().executedPlan().toString()
        made = [int(n) for n in re.findall(r"hashpartitioning\(_[uv]#.*?, (\d+)\), REPARTITION_BY_NUM", plan)]
        assert len(made) >= least and min(made) >= len(want) / 200 / rec.TASKS_FED > 4
        assert sorted((r.x, r.y) for r in lists.select("x", F.explode("ys").alias("y")).collect()) == want


def test_parts_of_hot_keys_meet_lists_in_places_of_their_own(spark):
    """No place of the join takes all rows of a hot key: each takes a part and one list."""
    df = spark.createDataFrame([("hot", i) for i in range(300)], "k string, x int")
    lists, _ = rec.partners(df, "k", "x", cell=20, task_pairs=500)
    join = next(line for line in lists._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)
    assert join.count(" = ") == 3
    assert rec.meeting(df, "k", "x", cell=20, task_pairs=500).count() == 300 * 299 // 2


def test_sessions_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    """Orders meet lines, and repeats go, in tasks whose number grows with the rows; small tables are left to the planner."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = queries.sessions(spark, SF)
    assert "REPARTITION_BY_NUM" not in plan(few)
    monkeypatch.setattr(rel, "TASK_ROWS", 500)
    many = queries.sessions(spark, SF)
    made = [int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", plan(many))]
    assert len(made) >= 2 and min(made) >= queries.table(spark, SF, "lineitem").count() / 500
    assert many.exceptAll(few).count() == 0 and many.count() == few.count() == few.distinct().count()


def test_best_neighbours_are_found_before_they_meet_counts(spark):
    """Ties go to the smaller item, and the join with counts stands above the choice, which is an aggregate."""
    pairs = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.5), (2, 1, 0.5), (2, 3, 0.7), (3, 1, 0.5), (3, 2, 0.7), (4, 1, 0.1)], "a long, b long, w double")
    counts = spark.createDataFrame([(1, 30), (2, 25), (3, 20), (4, 90)], "b long, n long")
    best = rec.best_neighbour(pairs, counts, 20, 0.2)
    assert sorted(map(tuple, best.collect())) == [(1, 2, 0.5, 30.0, 25.0), (2, 3, 0.7, 25.0, 20.0), (2, 3, 0.7, 25.0, 20.0)]
    assert [tuple(r) for r in rec.reciprocal(best).collect()] == [(2, 3, 0.7, 25.0, 20.0)]
    assert rec.best_neighbour(pairs, counts, 21, 0.2).collect() == rec.best_neighbour(pairs.where("a = 1"), counts, 21, 0.2).collect()
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.rindex("Join") < plan.index("Aggregate")


def _dealt(df, *names):
    """Tasks of the planned exchanges by a number, by the column they deal by; and the columns that the planner deals rows by on its own."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\), (\w+)", plan)
    return [(c, int(n)) for c, n, how in found if how == "REPARTITION_BY_NUM" and c in names], [c for c, _, how in found if how != "REPARTITION_BY_NUM" and c in names]


@pytest.mark.parametrize("name, columns", [("tfidf_norm", "bba"), ("feature_lists", ["b", "b", "a", "feature"]), ("complements_topk", "bbaa")])
def test_what_follows_pairs_runs_in_tasks_of_bounded_size(spark, monkeypatch, name, columns):
    """Sorts and windows over rows of pairs: their tasks follow the pairs counted, and the planner, which would merge them, deals none again."""
    query = queries.queries()[name]
    want = query(spark, SF)
    pairs = rec.counted_pairs(queries.sessions(spark, SF), "a", "b").pairs
    monkeypatch.setattr(rel, "TASK_ROWS", 2000)
    broadcasts = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = query(spark, SF)
        dealt, left = _dealt(df, "a", "b", "feature", "_key")
        dealt = [(c, n) for c, n in dealt if n == -(-int(pairs / rec.TASKS_FED) // 2000)]
        assert sorted(c for c, _ in dealt) == sorted(columns) and dealt[0][1] > 4
        # counts of items are combined by the planner; what is joined or ranked is not dealt by it
        assert set(left) <= {"b"}
        assert table(df.collect(), df.columns) == table(want.collect(), want.columns)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)


def test_pairs_meet_titles_in_tasks_of_bounded_size(spark, monkeypatch):
    """A dictionary that isn't small meets pairs in tasks that follow the pairs counted; a small one goes to every task."""
    want = queries.enrich_left_join(spark, SF)
    pairs = rec.counted_pairs(queries.sessions(spark, SF), "a", "b").pairs
    monkeypatch.setattr(rel, "TASK_ROWS", 2000)
    small = queries.enrich_left_join(spark, SF)
    assert "Broadcast" in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rel, "BROADCAST_ROWS", 10)
    broadcasts = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries.enrich_left_join(spark, SF)
        dealt, left = _dealt(df, "a", "b", "_key")
        tasks = -(-int(pairs / rec.TASKS_FED) // 2000)
        assert sorted(d for d in dealt if d[1] == tasks) == [("_key", tasks), ("_key", tasks), ("a", tasks), ("b", tasks)] and tasks > 4 and not left
        assert table(df.collect(), df.columns) == table(small.collect(), df.columns) == table(want.collect(), df.columns)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)


def test_routed_pairs_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    """filter_route: the number of tasks of every exchange follows rows or pairs, none is left to the planner, and pairs don't move once they are counted."""
    want = queries.filter_route(spark, SF)
    counted = rec.counted_pairs(queries.sessions(spark, SF), "a", "b")
    for module in (rel, rec):
        monkeypatch.setattr(module, "TASK_ROWS", 500)
    monkeypatch.setattr(rec, "summed", functools.partial(rec.summed, task_pairs=2000))
    broadcasts = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries.filter_route(spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        moved = re.findall(r"Exchange (\w+)\(.*?(\d+)\), (\w+)", plan)
        assert len(moved) >= 5 and {how for *_, how in moved} == {"REPARTITION_BY_NUM"}
        (first, n, _), *below = moved  # from the last exchange to the first
        assert first == "rangepartitioning" and int(n) >= counted.pairs / 2000 > 20
        assert min(int(n) for _, n, _ in below) >= counted.rows / 500 > 4
        assert "Aggregate" in plan.split("Exchange")[0] and "Join" not in plan.split("Exchange")[0]
        assert table(df.collect(), df.columns) == table(want.collect(), want.columns)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)
