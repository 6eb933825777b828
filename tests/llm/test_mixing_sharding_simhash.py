import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from weirflow.llm import hilbert, mixing, simhash


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        out = {s: 2.0 * sizes[s] for s in full} | {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over


def brute_seats(votes, seats):
    won = Counter()
    for _ in range(seats):
        won[max(votes, key=lambda k: (votes[k] / (2 * won[k] + 1), [-x for x in k.encode()]))] += 1
    return won


def test_targets_and_taken(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]) for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


def test_apportionment_is_sainte_lague(spark):
    for votes, seats in (({"a": 53.0, "b": 24.0, "c": 23.0}, 7), ({"a": 1000.0, "b": 1.0, "c": 0.0, "d": 17.5}, 91), ({"a": 5.0, "b": 5.0, "c": 5.0}, 4), ({"a": 1.0, "b": 3.0}, 0)):
        df = spark.createDataFrame([("g", k, v, seats) for k, v in votes.items()], "g string, k string, v double, n long")
        got = {r.k: r.won for r in mixing.apportion(df, ["g"], ["k"], "v", "n", "won").collect()}
        assert got == {k: brute_seats(votes, seats)[k] for k in votes}


def test_mix_of_nothing(none, docs):
    assert mixing.mix(none).collect() == []
    assert mixing.mix(docs, keep=("text", "size")).columns == ["doc_id", "source", "text", "size", "source_size", "target", "taken"]


def test_ranges_and_blank_texts_do_not_change_the_mix(spark, monkeypatch):
    """Many shards, one range or many, sources joined by broadcast or by shuffle: the same documents are taken."""
    texts = ["", " \n", None] * 40 + [" ".join(["w"] * (1 + i % 9)) for i in range(400)]
    rows = [(i if i % 50 else 7, t, None if i % 11 == 0 else f"s{i * i % 3}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "SHARD_WORDS", 300)
    found = []
    for bits, most in ((0, 100), (6, 100), (9, 0)):
        monkeypatch.setattr(mixing, "RANGE_BITS", bits)
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        out = mixing.mix(df, keep=("text",))
        assert len(out.collect()) == len(rows)
        found.append(sorted(map(str, out.drop("text").collect())))
    assert found[0] == found[1] == found[2]
    assert all(r.taken == 0 for r in out.collect() if not (r.text or "").strip())


def test_curve_is_hilbert(spark):
    cells = spark.range(1 << 15).selectExpr("cast(id % 32 as int) a", "cast(id div 32 % 32 as int) b", "cast(id div 1024 as int) c")
    at = {r.i: (r.a, r.b, r.c) for r in cells.withColumn("i", hilbert.curve_index("a", "b", "c")).collect()}
    assert sorted(at) == list(range(1 << 15))
    assert all(sum(abs(x - y) for x, y in zip(at[i], at[i + 1], strict=True)) == 1 for i in range((1 << 15) - 1))


def test_shards(docs, none):
    rows = hilbert.shard(docs, 7).collect()
    source = docs.collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in source)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(7))
    last = -1
    for k in sorted(by):
        assert sorted(r.slot for r in by[k]) == list(range(len(by[k])))
        curve = [r.curve for r in sorted(by[k], key=lambda r: r.slot)]
        assert curve == sorted(curve) and curve[0] >= last
        last = curve[-1]
    assert hilbert.shard(none, 7).collect() == []


def brute_fingerprint(text, n):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((x for x, y in zip(ids, group, strict=True) if y == g and x is not None), default=None) for g in group}
    return [least[g] for g in group]


def test_near_duplicates_match_brute_force(docs, none):
    rows, source = simhash.near_duplicates(docs, 4, 4).collect(), docs.collect()
    fps = [brute_fingerprint(r.text, 4) for r in source]
    ids = [r.doc_id for r in source]
    want = Counter((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(ids, fps, 4), strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want
    assert simhash.near_duplicates(none).collect() == []


def test_links_in_many_tiles(spark, monkeypatch):
    """Chains of near fingerprints over many small tiles, for one and two words a fingerprint."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(simhash, "TILE", 7)
    monkeypatch.setattr(simhash, "GROUP", 2)
    for bits in (64, 128):
        values = [int.from_bytes(rng.bytes(bits // 8)) for _ in range(40)]
        for _ in range(160):
            x = values[rng.integers(len(values))]
            for b in rng.choice(bits, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            values.append(x)
        values = sorted(set(values))
        half = (1 << bits // 2) - 1
        rows = [(x.to_bytes(bits // 8), (x >> bits // 2).bit_count(), (x & half).bit_count()) for x in values]
        found = simhash.links(spark.createDataFrame(rows, "fp binary, pa int, pb int"), 3, bits)
        roots = {r.node: r.root for r in simhash.components(found).collect()}
        got, want = defaultdict(set), defaultdict(set)
        for i, c in enumerate(brute_components(list(range(len(values))), values, 3)):
            raw = values[i].to_bytes(bits // 8)
            want[c].add(raw)
            got[bytes(roots.get(raw, raw))].add(raw)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
