"""SimHash near-duplicates: tiled exact comparison of fingerprints.

A fingerprint has a 1 where over half of the text's shingle hashes have one. All different
fingerprints are laid out in tiles by the population counts of their two halves. Two fingerprints
whose half counts differ by more than the radius in sum differ in more bits than the radius, so such
tile pairs are never formed; all others are compared exactly with numpy exclusive-or and bit counts.
Each tile pair reports a spanning forest of its links, never all pairs of a group.

With `similarity`, links are pairs of that exact Jaccard similarity of their sets of shingles (as 64-bit
hashes), and SimHash only proposes. Different sets meet in BANDS buckets, by minima of ROWS hash orders
each; so no fingerprint is compared with all others. In a bucket all fingerprints are held against the
smallest id's; buckets that this doesn't connect are compared in tiles as above. What is proposed becomes
groups, in which every set is held against one pivot, and those that aren't similar to it against the
whole group, tile by tile. A pair at the threshold is missed by all buckets with a chance of
(1 - similarity ** ROWS) ** BANDS, 4 in 10 million at 0.8; more similar ones far more rarely. Sets too small
to reach the similarity with any other propose nothing.

Null and empty texts have no shingle: fingerprint zero, linked like any other. Equal rows get equal
results. An empty table gives no rows. Only the id and text columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import map_steps, saved, texts_of, utf8
from weirflow.llm.components import components, forest

#: Buckets of a set in `similarity` mode and the hash orders whose minima name each.
BANDS, ROWS = 28, 4
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Fingerprints in one tile; tiles of one group meet a left tile in one task.
TILE, GROUP = 8192, 16
SEED = 42


def shingles(text: bytes, shingle: int) -> list[bytes]:
    """The word shingles of one UTF-8 text; words are runs of non-white-space, A-Z lower-cased."""
    words = text.translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[len(words) - n :].tolist()
    return [joined[s:e] for s, e in zip(starts, ends, strict=True)]


def fingerprint(text: bytes, shingle: int, bits: int, repeats: bool = True) -> bytes:
    """The fingerprint of one UTF-8 text, from all its shingles or (without repeats) from the different ones."""
    found = shingles(text, shingle)
    if not found:
        return bytes(bits // 8)
    if not repeats:
        found = list(set(found))
    n, out = len(found), []
    for word in range(bits // 64):
        ones, seed, digest = np.zeros(64, np.int64), SEED + word, xxhash.xxh64_digest
        for at in range(0, n, 1 << 15):
            raw = b"".join([digest(x, seed) for x in found[at : at + (1 << 15)]])
            ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > n).tobytes())
    return b"".join(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The different hashes of a text's word shingles, sorted: made of the hashes of their words in order."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    n = max(1, len(words) - shingle + 1)
    h = np.full(n, min(len(words), shingle), np.uint64)
    for k in range(min(len(words), shingle)):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n])
    return np.unique(h)


def set_fingerprint(held: np.ndarray, bits: int) -> bytes:
    """The fingerprint of a set of shingle hashes; words after the first come from the same hashes, mixed anew."""
    ones, words = np.zeros(bits, np.int64), bits // 64
    for at in range(0, len(held), 1 << 14):
        part = held[at : at + (1 << 14)]
        wide = np.stack([part, *[_mixed(part + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(1, words)]], axis=1)
        spread = np.unpackbits(wide.view(np.uint8), axis=1)
        for i in range(0, len(spread), 255):  # as many ones as a byte counts
            ones += np.add.reduce(spread[i : i + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(held)).tobytes()


_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def buckets(held: np.ndarray) -> np.ndarray:
    """The BANDS buckets (int64) of a set of shingle hashes: minima of the multiples of their upper halves."""
    least, high = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32), (held >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 2048):
        np.minimum(least, (_ORDERS * high[at : at + 2048]).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key ^ least[k::ROWS])
    return key.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4, bits: int = 64, repeats: bool = True, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """doc_id, fp (binary), pa and pb (ones in its first and second half): a narrow map over the texts.

    sets: from the different shingles, with key (binary digest) and n (size) of the set, its buckets and mark() of the text.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, more, names = utf8(batch.column("text")), [], []
        if sets:
            fps, keys, sizes, bands = [], [], [], []
            for t in texts:
                held = shingle_set(t, shingle)
                fps.append(set_fingerprint(held, bits))
                keys.append(xxhash.xxh128_digest(held.tobytes()))
                sizes.append(len(held))
                bands.append(buckets(held))
            marks = [hashlib.md5(t, usedforsecurity=False).hexdigest() for t in texts]
            more = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks)]
            names = ["key", "n", "bands", "mark"]
        else:
            fps = [fingerprint(t, shingle, bits, repeats) for t in texts]
        ones = np.bitwise_count(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), 2, -1)).sum(axis=2, dtype=np.int32)
        return pa.record_batch([batch.column("doc_id"), pa.array(fps, pa.binary()), pa.array(ones[:, 0]), pa.array(ones[:, 1]), *more], ["doc_id", "fp", "pa", "pb", *names])

    df = texts_of(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    return map_steps(df, step, f"doc_id {kind}, fp binary, pa int, pb int" + (", key binary, n long, bands array<long>, mark string" if sets else ""))


def mark(text: str) -> Column:
    """A digest of a text (null: empty) that tells equal texts under one id, or under none, from others."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def near(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest between rows of a and of b (n x words, uint64); b counts on from len(a)."""
    us, vs, held, n = [], [], 0, len(a) + len(b)
    for i in range(0, len(a), 32):
        left = a[i : i + 32]
        for j in range(i if same else 0, len(b), 4096):
            right = b[j : j + 4096]
            apart = np.bitwise_count(left[:, None, 0] ^ right[None, :, 0])
            for w in range(1, a.shape[1]):
                apart += np.bitwise_count(left[:, None, w] ^ right[None, :, w])
            hit = np.flatnonzero(apart <= radius)
            if len(hit):
                u, v = hit // len(right) + i, hit % len(right) + j
                if same:
                    u, v = u[u < v], v[u < v]
                us.append(u)
                vs.append(v if same else v + len(a))
                held += len(u)
                if held > 1 << 20:
                    u, v = forest(np.concatenate(us), np.concatenate(vs), n)
                    us, vs, held = [u], [v], len(u)
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(us), np.concatenate(vs), n)


def links(fps: DataFrame, radius: int, bits: int = 64, by: str | None = None) -> DataFrame:
    """(u, v): links of different fingerprints that connect all within the radius. fps: fp, pa, pb, one row each.

    by: only fingerprints equal in this column are compared; then a row for each of its values.
    """
    # Cells of one count each prune where the radius is small; for larger ones cells as wide as the radius
    # do: counts of cells apart by over one differ beyond it.
    wide = 1 if radius <= 8 else radius + 1
    reach = radius if wide == 1 else 2
    own = [by] if by else []
    cell = [*own, "pa", "pb"]
    fps = fps.select(*own, "fp", F.expr(f"pa div {wide}").cast("int").alias("pa"), F.expr(f"pb div {wide}").cast("int").alias("pb"))
    cells = saved(fps.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias("subs")))
    if not by:  # one row for each pair of half counts: at most (bits / 2 + 1) ** 2 of them, whatever the input
        cells = F.broadcast(cells)
    tiles = (
        fps.join(cells, cell)
        .withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
        .groupBy(*cell, "sub")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = saved(tiles)
    # Half of the offsets suffice: the other half are the same pairs the other way round.
    near_by = (lambda x, y: x + abs(y) <= reach) if wide == 1 else (lambda x, y: max(x, abs(y)) <= 1)
    offsets = [(x, y) for x in range(reach + 1) for y in range(-reach, reach + 1) if near_by(x, y) and (x > 0 or y >= 0)]
    offset = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in offsets]))
    left = tiles.select(*own, F.col("fps").alias("a"), "pa", "pb", F.col("sub").alias("sub_a"), offset.alias("o"))
    shifted = [(F.col("pa") + F.col("o.x")).alias("pa"), (F.col("pb") + F.col("o.y")).alias("pb")]
    left = left.select(*own, "a", "sub_a", *shifted, (F.expr("o.x = 0 AND o.y = 0")).alias("same"))
    several = F.explode(F.sequence(F.lit(0), F.floor((F.col("subs") - 1) / GROUP).cast("int")))
    left = left.join(cells.select(*cell, several.alias("g")), cell)
    right = tiles.select(*cell, F.floor(F.col("sub") / GROUP).cast("int").alias("g"), F.col("sub").alias("sub_b"), F.col("fps").alias("b"))
    pairs = left.join(right, [*cell, "g"]).where("NOT same OR sub_a <= sub_b").select("a", "b", F.expr("same AND sub_a = sub_b").alias("same"))
    width = bits // 64

    def compare(batches):
        for batch in batches:
            for a, b, same in zip(batch.column("a"), batch.column("b"), batch.column("same").to_pylist(), strict=True):
                a, b = a.values.to_pylist(), b.values.to_pylist()
                raw = [np.frombuffer(b"".join(x), np.uint64).reshape(-1, width) for x in (a, b)]
                u, v = near(*raw, radius, same)
                names = a + ([] if same else b)
                if len(u):
                    yield pa.record_batch([pa.array([names[i] for i in u], pa.binary()), pa.array([names[i] for i in v], pa.binary())], ["u", "v"])

    return pairs.mapInArrow(compare, "u binary, v binary")


def alike(a: list[bytes], b: list[bytes], similarity: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """As near(), of sets of shingle hashes (sorted, packed) whose Jaccard similarity reaches the threshold."""
    sets = [np.frombuffer(x, np.uint64) for x in (a if same else a + b)]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Shingles of one set alone are in no intersection.
    shared = counts > 1
    place = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], place[column[kept]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    cut = 0 if same else len(a)
    common = np.zeros((len(a), len(sets) - cut), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        common += part[: len(a)] @ part[cut:].T
    whole = sizes[: len(a), None] + sizes[None, cut:] - common
    u, v = np.nonzero(common >= similarity * whole - 1e-6)
    v = v + cut
    u, v = u[u < v], v[u < v]
    return forest(u, v, len(sets)) if len(u) else (u, v)


#: Sets and shingle hashes in one tile of the exact comparison.
SETS, HASHES = 1024, 1 << 20


def proposed(unique: DataFrame, radius: int, bits: int) -> DataFrame:
    """(node, root): groups of sets that buckets and fingerprints propose. unique: id (long), fp, pa, pb, bands.

    Nothing moves but ids, buckets and fingerprints. Ids are 64 bits of the sets' digests: two that fall
    together would only be proposed to each other.
    """
    members = unique.select("id", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("m"))
    # Stored, so that the join is between two plain exchanges, of which skewed partitions can be split.
    shared = saved(shared.where("low <> high").select("band", "low", "m"))
    met = saved(members.join(shared, "band"))
    fps = unique.select("id", "fp", "pa", "pb").dropDuplicates(["id"])
    word = lambda c, k: F.conv(F.substring(F.hex(c), 16 * k + 1, 16), 16, -10).cast("long")
    words = [word("fp", k) for k in range(bits // 64)]
    one = fps.select("id", *[w.alias(f"w{k}") for k, w in enumerate(words)])
    low = one.select(F.col("id").alias("low"), *[F.col(f"w{k}").alias(f"v{k}") for k in range(bits // 64)])
    pairs = saved(met.where("id <> low").select("id", "low").distinct()).join(one, "id").join(low, "low")
    apart = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"v{k}"))) for k in range(1, bits // 64)), F.bit_count(F.col("w0").bitwiseXOR(F.col("v0"))))
    stars = saved(pairs.where(apart <= radius).select(F.col("low").alias("u"), F.col("id").alias("v")))
    roots = components(stars)
    # Buckets of at least three that are still in several groups: all against all, in tiles.
    at = met.where("m > 2").select("band", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    at = saved(at)
    open_ = saved(at.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("band"))
    if open_.isEmpty():
        return roots
    rows = saved(at.join(open_, "band").select("band", "id").join(fps, "id"))
    found = links(rows.select("band", "fp", "pa", "pb").distinct(), radius, bits, by="band")
    # One id stands for all of a fingerprint; the others link to it.
    of = saved(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = found.join(of.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(of.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v")
    same = rows.select("id", "fp").distinct().join(of, "fp").select(F.col("least").alias("u"), F.col("id").alias("v"))
    return components(stars.unionByName(found.select(F.col("a").alias("u"), F.col("b").alias("v"))).unionByName(same))


def verified(docs: DataFrame, unique: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): links, of keys, that connect all sets of a proposed group that reach the similarity. docs: doc_id and text.

    In each group the set of the smallest doc_id is the pivot: what is similar to it is connected by that,
    and only the others are compared with the whole group.
    """
    chosen = unique.select(F.col("id").alias("node"), "key", "rep", "mark").join(roots.select("node", "root"), "node")
    chosen = chosen.select("root", F.col("key").alias("node"), F.col("rep").alias("doc_id"), "mark")
    pivots = saved(chosen.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("p")).select("root", F.col("p.node").alias("pivot")))
    chosen = chosen.join(pivots, "root")
    # An id may stand for several texts, which their marks tell apart.
    texts = docs.withColumn("mark", mark("text")).join(chosen, ["doc_id", "mark"]).dropDuplicates(["node"])

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [shingle_set(t, shingle).tobytes() for t in utf8(batch.column("text"))]
        return pa.record_batch([*[batch.column(c) for c in ("root", "node", "pivot")], pa.array(raw, pa.binary()), pa.array([len(x) // 8 for x in raw], pa.int64())], ["root", "node", "pivot", "hashes", "n"])

    sets = saved(map_steps(texts.select("root", "node", "pivot", "text"), hashes, "root long, node binary, pivot binary, hashes binary, n long"))
    pivots = sets.where("node = pivot").select("root", F.col("hashes").alias("with"))

    def against(batch: pa.RecordBatch) -> pa.RecordBatch:
        near_ = []
        for a, b in zip(batch.column("hashes").to_pylist(), batch.column("with").to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            near_.append(common >= similarity * (len(a) + len(b) - common) - 1e-6)
        return pa.record_batch([*[batch.column(c) for c in ("root", "node", "pivot")], pa.array(near_, pa.bool_())], ["root", "node", "pivot", "near"])

    scored = saved(map_steps(sets.join(pivots, "root").select("root", "node", "pivot", "hashes", "with"), against, "root long, node binary, pivot binary, near boolean", "hashes"))
    stars = scored.where("near and node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v"))
    far = saved(scored.where("not near").select("root", "node"))
    if far.isEmpty():
        return stars
    whole = saved(sets.join(far.select("root").distinct(), "root", "left_semi"))
    left = tiles_of(whole.join(far.select("node"), "node", "left_semi"))
    right = tiles_of(whole)
    counts = right.groupBy("root").agg(F.max("parts").alias("parts"))
    left = left.select("root", F.col("rows").alias("a")).join(counts, "root").select("root", "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sub"))
    pairs = left.join(right.select("root", "sub", F.col("rows").alias("b")), ["root", "sub"]).select("a", "b")

    def compare(batches):
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                names, held = ([x.values.field(k).to_pylist() for x in (a, b)] for k in ("node", "hashes"))
                u, v = alike(held[0], held[1], similarity, False)
                names = names[0] + names[1]
                if len(u):
                    yield pa.record_batch([pa.array([names[i] for i in u], pa.binary()), pa.array([names[i] for i in v], pa.binary())], ["u", "v"])

    return stars.unionByName(pairs.mapInArrow(compare, "u binary, v binary").where("u <> v"))


def tiles_of(sets: DataFrame) -> DataFrame:
    """root, sub, parts, rows (node, hashes): a root's sets in tiles of about SETS sets and HASHES hashes."""
    parts = sets.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum("n") / HASHES)).cast("int").alias("parts"))
    # Dealt by tile: else a group of a third of all rows, together for its join, would stay together.
    sets = sets.join(saved(parts), "root").withColumn("sub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).repartition("root", "sub")
    return saved(sets.groupBy("root", "sub", "parts").agg(F.collect_list(F.struct("node", "hashes")).alias("rows")))


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 4, bits: int = 64, repeats: bool = True, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable by links).

    With similarity also mark(), which tells the texts of one id apart.
    similarity: links must reach this Jaccard similarity of shingle sets too; documents of equal
    sets count as one there, and those without an id propose no links.
    """
    exact = similarity is not None
    fps = saved(fingerprints(docs, shingle, bits, repeats, id_col, text_col, sets=exact))
    node = "key" if exact else "fp"
    if exact:
        of = [F.first(c).alias(c) for c in ("fp", "pa", "pb", "n", "bands")]  # equal for equal keys
        least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("least")
        unique = fps.groupBy("key").agg(least, *of).select("key", F.col("least.doc_id").alias("rep"), F.col("least.mark").alias("mark"), "fp", "pa", "pb", "n", "bands")
        # Of n shingles, n / (n + 1) is the most that any other set reaches.
        able = unique.where((F.col("n") + 1e-9 >= similarity * (F.col("n") + 1)) & F.col("rep").isNotNull())
        able = saved(able.withColumn("id", F.conv(F.substring(F.hex("key"), 1, 16), 16, -10).cast("long")))
        roots = components(verified(texts_of(docs, id_col, text_col), able, proposed(able, radius, bits), shingle, similarity))
    else:
        unique = fps.groupBy("fp", "pa", "pb").agg(F.min("doc_id").alias("rep"))
        roots = components(links(unique, radius, bits))
    linked = unique.select(F.col(node).alias("node"), "rep").join(roots, "node")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    moved = roots.join(least, "root").select(F.col("node").alias(node), "least")
    # Stored, so that the last join is between two plain exchanges, of which skewed partitions can be split.
    ids = saved(unique.select(node, "rep").join(moved, node, "left").select(node, F.coalesce("least", "rep").alias("component_id")))
    more = ["mark"] if exact else []
    found = fps.select("doc_id", "fp", *(["key", "mark"] if exact else [])).join(ids, node)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id", *more)
