"""Improbable-feature digests: rare byte windows in chained Bloom filters.

The entropy of every 64-byte window is quantised to 1024 levels. Levels rank by how rare they are over
all windows of the corpus (`rarity`); in every run of 64 consecutive windows the rarest is a candidate
(ties: the leftmost), and windows that are candidates of at least 16 runs become features. A feature's
64-bit hash sets five of the 2048 bits of a Bloom filter; after 160 features the next filter begins.
Two digests compare filter by filter: the overlap of bits, less what chance gives, over the most it
could be; each filter of the shorter digest counts with its best match, weighted by its bits.

Texts of fewer than FEW such features get features of a second, finer scale too, chosen in the same way
from 8-byte windows in runs of four, so that a short text isn't known by one or two places alone. Texts
too short even for one such run have one feature: their rarest window, or the whole text where it has
no window. Null and empty texts have no feature and the digest "0:"; two such are
alike (1), one such is unlike all others (0). Equal texts have equal digests. An empty table gives no
rows. Repeated rows give repeated rows; ids that tie are ordered by text. Only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import map_steps, texts_of, utf8

LEVELS = 1024
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5
#: Windows worked on at once.
CHUNK = 1 << 17
CUT = 0.3
#: Features below which the finer scale joins in.
FEW = 12


class Scale:
    """Windows of w bytes, runs of `run` windows (a power of two), features that win at least `popular` of them."""

    def __init__(self, w: int, run: int, popular: int):
        self.w, self.run, self.popular = w, run, popular
        # Entropy in fixed point: sum over a window's byte counts c of c*log2(c), from 0 for different bytes to w*log2(w) for one.
        sums = np.round((1 << 16) * np.array([0.0, *[c * np.log2(c) for c in range(1, w + 1)]])).astype(np.int64)
        self.step, self.top = np.diff(sums).astype(np.int32), int(sums[w])


COARSE, FINE = Scale(64, 64, 16), Scale(8, 4, 1)


def entropy_levels(data: np.ndarray, scale: Scale = COARSE) -> np.ndarray:
    """The entropy level of each window of `data` (uint8), exact: counts enter and leave by equal bytes within reach."""
    n, w = len(data), scale.w
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, w):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    gain, loss = scale.step[before], scale.step[after]
    # Byte i enters a window that holds `before` equal ones; byte i-w leaves one that holds it and `after` equal ones.
    # When i enters, i-w has left first, so its equal ones are those within w-1 before i.
    sums = np.cumsum(gain.astype(np.int64))
    out = sums[w - 1 :].copy()
    out[1:] -= np.cumsum(loss[: n - w].astype(np.int64))
    return ((scale.top - out) * (LEVELS - 1) // scale.top).astype(np.int16)


def chunks(data: np.ndarray, reach: int):
    """Pieces of CHUNK starts each, with `reach` bytes after the last start."""
    for at in range(0, max(0, len(data) - reach), CHUNK):
        yield at, data[at : at + CHUNK + reach]


def rarity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[list[int]]:
    """For both scales the rank of every entropy level by the number of the corpus's windows at it, rarest first."""

    def count(batches):
        total = np.zeros((2, LEVELS), np.int64)
        for batch in batches:
            for text in utf8(batch.column("text")):
                data = np.frombuffer(text, np.uint8)
                for k, scale in enumerate((COARSE, FINE)):
                    for _, piece in chunks(data, scale.w - 1):
                        total[k] += np.bincount(entropy_levels(piece, scale), minlength=LEVELS)
        scales, at = np.nonzero(total)
        yield pa.record_batch([pa.array(scales.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[scales, at])], ["scale", "level", "n"])

    found = texts_of(docs, id_col, text_col).select("text").mapInArrow(count, "scale int, level int, n long").groupBy("scale", "level").agg(F.sum("n")).collect()
    counts, ranks = np.zeros((2, LEVELS), np.int64), np.empty((2, LEVELS), np.int64)
    for scale, level, n in found:
        counts[scale, level] = n
    for k in range(2):
        ranks[k, np.lexsort((np.arange(LEVELS), counts[k]))] = np.arange(LEVELS)
    return ranks.tolist()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(data: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """64-bit hashes of the windows that begin at `at`."""
    words = np.lib.stride_tricks.sliding_window_view(data, w)[at].copy().view("<u8")
    h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(words.shape[1]):
        h = _mix(h ^ words[:, i]) + np.uint64(0x9E3779B97F4A7C15)
    return _mix(h)


def chosen(data: np.ndarray, ends: np.ndarray, ranks: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the features, on one scale, of texts that lie one after another in `data` and end at `ends`, in order."""
    reach = scale.w + scale.run - 2
    found, times = [], []
    for at, piece in chunks(data, reach):
        rank = ranks[entropy_levels(piece, scale)]
        low = (rank << 32) | np.arange(len(rank))
        width = 1
        while width < scale.run:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low &= 0xFFFFFFFF
        # A run of windows counts if all its bytes are of one text.
        first = np.searchsorted(ends, np.arange(at, at + len(low)), side="right")
        low = low[ends[first] - np.arange(at, at + len(low)) > reach] + at
        if len(low):
            new = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            found.append(low[new])
            times.append(np.diff(np.append(new, len(low))))
    at, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, times))
    if len(at):  # the same candidate may go on in the next piece
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        at, n = at[new], np.add.reduceat(n, new)
    at = at[n >= scale.popular]
    return np.searchsorted(ends, at, side="right"), _hashes(data, at, scale.w) if len(at) else np.zeros(0, np.uint64)


def features(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all features, by text."""
    join = lambda some: (np.frombuffer(b"".join(some), np.uint8), np.cumsum(np.fromiter(map(len, some), np.int64, len(some))))
    owner, hashed = chosen(*join(texts), ranks[0], COARSE)
    short = np.flatnonzero(np.bincount(owner, minlength=len(texts)) < FEW)
    more, fine = chosen(*join([texts[i] for i in short]), ranks[1], FINE) if len(short) else (owner[:0], hashed[:0])
    owner, hashed = np.concatenate((owner, short[more])), np.concatenate((hashed, fine))
    has = np.bincount(owner, minlength=len(texts)) > 0
    extra, extra_hash = [i for i in np.flatnonzero(~has) if texts[i]], []
    for i in extra:
        text = np.frombuffer(texts[i], np.uint8)
        if len(text) >= FINE.w:
            extra_hash.append(_hashes(text, np.argmin(ranks[1][entropy_levels(text, FINE)])[None], FINE.w)[0])
        else:
            extra_hash.append(np.uint64(int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest())))
    owner, hashed = np.concatenate((owner, np.array(extra, np.int64))), np.concatenate((hashed, np.array(extra_hash, np.uint64)))
    by = np.argsort(owner, kind="stable")
    return owner[by], hashed[by]


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """For each text its filters: a row of 256 bytes for every 160 features."""
    owner, hashed = features(texts, ranks)
    n = np.bincount(owner, minlength=len(texts))
    filters = -(-n // PER_FILTER)
    first = np.concatenate(([0], np.cumsum(filters)))
    place = np.arange(len(owner)) - np.concatenate(([0], np.cumsum(n)))[owner]
    base = (first[owner] + place // PER_FILTER) * FILTER_BITS
    bits = np.zeros(int(first[-1]) * FILTER_BITS, np.uint8)
    for k in range(HASHES):
        bits[base + ((hashed >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits).reshape(-1, FILTER_BITS // 8)
    return [packed[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal digests. Symmetric where both have as many filters."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    forward = _best(a, b)
    return forward if len(a) < len(b) else (forward + _best(b, a)) / 2


def _best(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    ones, others = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    score = 0.0
    for row, n in zip(a, ones, strict=True):
        overlap = np.bitwise_count(b & row).sum(1, dtype=np.int64)
        least, most = n * others / FILTER_BITS, np.minimum(n, others)
        cut = least + CUT * (most - least)
        score += n * float(np.clip((overlap - cut) / np.maximum(most - cut, 1e-9), 0, 1).max())
    return score / float(ones.sum())


def text_of(digest: np.ndarray) -> str:
    """Number of filters, colon, their bits in hex."""
    return f"{len(digest)}:{digest.tobytes().hex()}"


def fingerprint(docs: DataFrame, ranks: list[list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint: a narrow map."""
    table = np.array(ranks, np.int64)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = digests(utf8(batch.column("text")), table)
        return pa.record_batch([batch.column("doc_id"), pa.array(list(map(text_of, found)))], ["doc_id", "fingerprint"])

    df = texts_of(docs, id_col, text_col)
    return map_steps(df, step, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list]:
    """Rows dealt into ranges of descending id and sorted, each range followed by the row after it.

    The text moves once. Range bounds are quantiles of the ids alone; the row that follows a range is
    the first of the next range (after the last: of the first), copied by its id.
    """
    df = texts_of(docs, id_col, text_col)
    spark = df.sparkSession
    parts = min(1000, int(spark.conf.get("spark.sql.shuffle.partitions")))  # ranges stream: large ones cost no memory
    ids = df.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)
    part = F.lit(len(cuts))
    for lo, hi in [(i, min(i + 50, len(cuts))) for i in range(0, len(cuts), 50)][::-1]:  # two levels of comparisons
        inner = F.lit(hi)
        for i in range(hi - 1, lo - 1, -1):
            inner = F.when(F.col("doc_id") > cuts[i], F.lit(i)).otherwise(inner)
        part = F.when(F.col("doc_id") > cuts[hi - 1], inner).otherwise(part)
    # Null ids come last: no comparison holds for them.
    firsts = {r.part: r.top for r in ids.select(part.alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(firsts)
    follows = [(firsts[order[(i + 1) % len(order)]], p) for i, p in enumerate(order)]
    rows = df.select("doc_id", "text", part.cast("int").alias("part"), F.lit(0).alias("halo"))
    if follows:
        known = sorted([x for x in follows if x[0] is not None], key=lambda x: x[0])
        halo = df.where(F.col("doc_id").isin([x[0] for x in known]) | (F.col("doc_id").isNull() if len(known) < len(follows) else F.lit(False)))
        to = F.lit(next((p for top, p in follows if top is None), None)).cast("int")
        if known:
            table = F.create_map(*[x for top, p in known for x in (F.lit(top), F.lit(p))])
            to = F.coalesce(F.element_at(table, F.col("doc_id")) if len(known) == len(follows) else F.when(F.col("doc_id").isNotNull(), F.element_at(table, F.col("doc_id"))), to)
        rows = rows.unionAll(halo.select("doc_id", "text", to.alias("part"), F.lit(1).alias("halo")))
    return rows.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), "text"), cuts


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_edits(docs: DataFrame, ranks: list[list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every text and of its edited text, and their likeness and that of the next text's.

    Rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Next is
    by descending id (null ids last, ties by text); after the last comes the first.
    """
    table = np.array(ranks, np.int64)
    rows, _ = neighbours(docs, id_col, text_col)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(ids: pa.Array, texts: list[str], mine: list[bool]) -> pa.RecordBatch | None:
        """For each row that is `mine`, the row after it in the list is its next."""
        at = [i for i, m in enumerate(mine) if m]
        if not at:
            return None
        changed = [edited(texts[i], texts[i + 1]).encode() for i in at]
        plain = digests([t.encode() for t in texts], table)
        other = digests(changed, table)
        columns = [
            ids.take(pa.array(at)),
            pa.array([len(texts[i]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
            pa.array([text_of(plain[i]) for i in at]),
            pa.array([text_of(d) for d in other]),
            pa.array([likeness(plain[i], d) for i, d in zip(at, other, strict=True)], pa.float64()),
            pa.array([likeness(plain[i], plain[i + 1]) for i in at], pa.float64()),
        ]
        return pa.record_batch(columns, names)

    def mapped(batches):
        held = None  # the last row, whose next is still to come
        from weirflow.llm.common import steps

        for batch in batches:
            for step in steps(batch):
                if held is not None:
                    step = pa.concat_batches([held, step])
                held = step.slice(step.num_rows - 1)
                halo, part = step.column("halo").to_pylist(), step.column("part").to_pylist()
                mine = [halo[i] == 0 and part[i] == part[i + 1] for i in range(len(halo) - 1)] + [False]
                out = work(step.column("doc_id"), step.column("text").to_pylist(), mine)
                if out is not None:
                    yield out

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(mapped, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
