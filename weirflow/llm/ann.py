"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one from each of BOOKS codebooks: books are
k-means of the residuals the books before left, trained on a bounded sample (SAMPLE vectors), and codes
are found by beam search over all books. Vectors are coded at unit length, so their lengths play no part.
A code keeps its vector's length and how far its sum, brought to that length, lies from the vector. A query's
inner products with all codewords form a lookup table; codes are scored by adding table entries, scaled
by the stored lengths. The best scores of a block (see `reranked`; ties at the edge by smaller id) are
computed exactly in double precision on the original vectors. They give the score to beat: every other row
whose score by code plus its stored distance times the query's length reaches it is computed exactly too
(Cauchy-Schwarz), so none of the `top` is missed, however badly codes fit the rows; then more is computed.

Codes and queries meet in blocks of bounded size, at most BLOCK rows by QUERIES queries; every row is scored.
Each block gives its best `top` for each query, and the best of those are the result.
Vectors that are null, zero, of another length than most, or that hold null or non-finite components take
no part. Ids that tie in score go by smaller id; a query's own id is never its neighbour. Rows of one id
count once, as a query and as a candidate: as the least of their vectors. An empty table gives no rows.
Null ids take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.llm.common import saved, ship

BOOKS, WORDS, SAMPLE, ROUNDS, BEAM = 24, 256, 20_000, 8, 8
BLOCK, QUERIES, TOP = 1 << 16, 1 << 13, 20
#: Numbers of vectors that a block holds.
BLOCK_NUMBERS = 1 << 23
#: Share of a vector's length by which single-precision sums of table entries may be off.
ROUNDING = 1e-5


def reranked(rows: int, top: int = TOP) -> int:
    """Candidates computed exactly for each query: 60 of 2,000 rows, and more as the cube root of the rows."""
    return max(3 * top, int(np.ceil(60 * (rows / 2000) ** (1 / 3))))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    if len(centres) < k:
        centres = np.concatenate((centres, np.zeros((k - len(centres), x.shape[1]), x.dtype)))
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        held = counts > 0
        centres[held] = sums[held] / counts[held, None]
    return centres


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 5) -> np.ndarray:
    """Codebooks (books, words, dimensions) from residuals."""
    rng = np.random.default_rng(seed)
    out, rest = [], x.astype(np.float32)
    for _ in range(books):
        centres = kmeans(rest, words, rng)
        out.append(centres)
        rest = rest - centres[np.argmin((centres**2).sum(1) - 2 * rest @ centres.T, axis=1)]
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books) by beam search: at each book the `beam` sums of least residual go on."""
    m, k, d = books.shape
    out = np.empty((len(x), m), np.uint8)
    norms = (books**2).sum(axis=2)
    for at in range(0, len(x), 512):
        part = x[at : at + 512].astype(np.float32)
        n = len(part)
        rest, cost, codes = part[:, None, :], np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.uint8)
        for j in range(m):
            # cost of a partial sum, less the vector's own square: falls by 2 r.c - c.c with the codeword c at residual r
            total = cost[:, :, None] + norms[j] - 2 * (rest.reshape(-1, d) @ books[j].T).reshape(n, -1, k)
            width = min(beam if j < m - 1 else 1, total.shape[1] * k)
            total = total.reshape(n, -1)
            best = np.argpartition(total, width - 1, axis=1)[:, :width]
            cost = np.take_along_axis(total, best, 1)
            held, word = best // k, best % k
            codes = np.concatenate((np.take_along_axis(codes, held[:, :, None], 1), word[:, :, None].astype(np.uint8)), axis=2)
            rest = np.take_along_axis(rest, held[:, :, None], 1) - books[j][word]
        out[at : at + n] = codes[np.arange(n), np.argmin(cost, axis=1)]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of vectors that take part, one of each id; floats stay floats, other numbers become doubles."""
    kind = vectors.schema[vec_col].dataType.simpleString()
    v = F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")
    df = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    df = df.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    size = df.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    df = df.where(F.size("v") == (size.n if size else 0))
    if df.groupBy("vec_id").count().where("count > 1").isEmpty():
        return df
    return df.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.array(column.flatten()).reshape(n, -1)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length 1 and their lengths, in double precision; squares of large and small numbers don't overflow."""
    most = np.abs(x).max(axis=1)
    x = x / most[:, None]
    length = np.linalg.norm(x, axis=1)
    return x / length[:, None], most * length


def best_codes(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, codes: np.ndarray, scale: np.ndarray, books: np.ndarray, most: int):
    """(query place, row place, score) of each query's best `most` codes; rows are in order of id."""
    m, k, _ = books.shape
    codes = np.ascontiguousarray(codes.T).astype(np.int64)
    out = []
    for i in range(len(queries)):
        table = (books.reshape(m * k, -1) @ queries[i].astype(np.float32)).reshape(m, k)
        near = table[0][codes[0]]
        for j in range(1, m):
            near += table[j][codes[j]]
        near = near * scale
        near[ids == query_ids[i]] = -np.inf
        n = min(most, len(near))
        edge = np.partition(near, len(near) - n)[len(near) - n]
        above = np.flatnonzero(near > edge)
        pick = np.concatenate((above, np.flatnonzero(near == edge)[: n - len(above)]))
        pick = pick[ids[pick] != query_ids[i]]
        out.append((np.full(len(pick), i), pick, near[pick]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def nearest(q: np.ndarray, own: np.ndarray, near: np.ndarray, slack: np.ndarray, x: np.ndarray, most: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row places, scores) of the `top` rows of largest inner product with q, ties by place; `own` rows don't count.

    `near` is within `slack` of each row's product with q at length 1. The best `most` by `near` give a score that the
    result reaches at least; every row that may reach it is computed.
    """
    near[own] = -np.inf
    held = len(near) - int(own.sum())
    if not held:
        return np.zeros(0, np.int64), np.zeros(0)
    direction, length = unit(q[None])
    direction = direction[0]
    n = min(max(most, top), held)
    first = np.argpartition(near, len(near) - n)[len(near) - n :]
    if n < held:
        exact = x[first] @ direction
        least = np.partition(exact, n - top)[n - top]
        pick = np.flatnonzero((near + slack >= least) & ~own)
    else:
        pick = first
    if len(pick) > top:
        # products by BLAS differ from sums in order by less than this
        fast = (x @ direction)[pick] if len(pick) > len(x) // 8 else x[pick] @ direction
        edge = np.partition(fast, len(fast) - top)[len(fast) - top]
        pick = pick[fast >= edge - slack[pick] * 1e-6 - abs(edge) * 1e-9]
    score = (x[pick] * q).sum(axis=1)
    order = np.lexsort((pick, -score))[:top]
    return pick[order], score[order]


def search(vectors: DataFrame, is_query, top: int = TOP, rerank: int | None = None, books: int = BOOKS, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the `top` rows of largest inner product found for every query row."""
    spark = vectors.sparkSession
    ship(spark)
    df = valid(vectors, id_col, vec_col)
    total = df.count()
    kind, array = (df.schema[c].dataType.simpleString() for c in ("vec_id", "v"))
    if not total:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    most = rerank or reranked(total, top)
    share = int(min(1.0, sample / total) * (1 << 30))
    chosen = df.where(F.pmod(F.xxhash64("vec_id", F.lit("ann")), F.lit(1 << 30)) <= share).toArrow()  # about `sample` vectors
    chosen = (chosen if chosen.num_rows else df.limit(1).toArrow()).sort_by("vec_id")
    trained = train(unit(matrix(chosen.column("v").combine_chunks(), chosen.num_rows).astype(np.float64))[0], books)
    size = min(BLOCK, max(1024, BLOCK_NUMBERS // trained.shape[2]))
    shared = spark.sparkContext.broadcast(trained)  # books x words x dimensions: fixed size

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                x, length = unit(matrix(batch.column("v"), batch.num_rows).astype(np.float64))
                codes = encode(x, shared.value)
                sums = decode(codes, shared.value).astype(np.float64)
                norm = np.linalg.norm(sums, axis=1)
                scale = np.where(norm > 0, 1 / np.maximum(norm, 1e-30), 1.0)
                slack = np.linalg.norm(x - sums * scale[:, None], axis=1) + ROUNDING * np.maximum(1, scale)
                yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array([c.tobytes() for c in codes]), pa.array(scale * length), pa.array(slack * length)], ["vec_id", "v", "code", "scale", "slack"])

    coded = saved(df.mapInArrow(code, f"vec_id {kind}, v {array}, code binary, scale double, slack double"))
    asked = coded.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    blocks, groups = -(-total // size), max(1, -(-asked.count() // QUERIES))
    of = lambda c, salt, n: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = coded.select("vec_id", "v", "code", "scale", "slack", of("vec_id", "block", blocks).alias("b"), each(groups).alias("g"))
    tiles = asked.select("query_id", "q", of("query_id", "group", groups).alias("g"), each(blocks).alias("b"))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        fields = [("query_id", left.schema.field("query_id").type), ("vec_id", right.schema.field("vec_id").type), ("score", pa.float64())]
        if not left.num_rows or not right.num_rows:
            return pa.schema(fields).empty_table()
        right = right.sort_by("vec_id")
        ids, query_ids = np.array(right.column("vec_id")), np.array(left.column("query_id"))
        codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        codes = np.ascontiguousarray(codes.T).astype(np.int64)
        scale, slack = np.array(right.column("scale")), np.array(right.column("slack"))
        x = matrix(right.column("v").combine_chunks(), len(ids)).astype(np.float64)
        queries = matrix(left.column("q").combine_chunks(), left.num_rows).astype(np.float64)
        tables = unit(queries)[0].astype(np.float32)
        m, k, _ = shared.value.shape
        found = []
        for i in range(len(queries)):
            table = (shared.value.reshape(m * k, -1) @ tables[i]).reshape(m, k)
            near = table[0][codes[0]]
            for j in range(1, m):
                near += table[j][codes[j]]
            pick, score = nearest(queries[i], ids == query_ids[i], near * scale, slack, x, most, top)
            found.append((np.full(len(pick), i), pick, score))
        q, r, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table([pa.array(query_ids[q]), pa.array(ids[r]), pa.array(score)], schema=pa.schema(fields))

    scored = tiles.groupBy("b", "g").cogroup(rows.groupBy("b", "g")).applyInArrow(block, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
