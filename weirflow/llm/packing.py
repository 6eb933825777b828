"""Packing token runs into windows by Karmarkar-Karp multiway differencing.

Every document becomes token ids and an end id. Full windows are cut off first; what is left of a
document is cut into runs of at most `run` tokens. Runs are packed a group at a time: each starts as a
partial partition of one run and otherwise empty windows, and the two partitions of the largest
imbalance merge with opposing order (largest with smallest window) until one is left, so that windows
come out nearly equal. If a window exceeds the capacity, the group is packed anew with one more.

Groups form along the rows of a partition and never leave it: no shuffle, and memory for one group.
Null and empty texts hold only the end id. Repeated rows are packed each for itself. An empty table
gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weirflow.llm.common import steps, texts_of

CAPACITY, RUN, ITEMS, END = 2048, 512, 512, 1
#: Fixed values of the vocabulary: its special string and that string's id.
SPECIAL = {"<|endoftext|>": 50256}
SCHEMA = "start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """Byte-level BPE from a rank file; strings of special tokens give their one id, as the vocabulary's own tokenizer does."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(SPECIAL))


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: items in k windows of nearly equal sums, as lists of their indices."""
    order, heap = count(), []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = size
        heap.append((-size if k > 1 else 0, next(order), sums, [[i], *[[] for _ in range(k - 1)]]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, sums, held = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        sums = sums + more[::-1]
        held = [x + y if y else x for x, y in zip(held, reversed(others), strict=True)]
        by = np.argsort(-sums, kind="stable")
        sums = sums[by]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), next(order), sums, [held[j] for j in by.tolist()]))
    return heap[0][3] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items (each at most the capacity) in windows that don't exceed it; the count rises until none does."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, k)
        if all(sum(sizes[i] for i in x) <= capacity for x in found):
            return [x for x in found if x]
        k += 1


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, run: int = RUN, items: int = ITEMS, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run: doc_id, start, length, tokens (little-endian uint32), doc_tokens, sequence_id, offset."""
    df = texts_of(docs, id_col, text_col)

    def emit(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]])

    def mapped(batches):
        from pyspark import TaskContext

        model, sequences = encoder(ranks_path, pattern), count(TaskContext.get().partitionId() << 36)
        held: list[tuple] = []

        def close(group: list[tuple]) -> list[tuple]:
            rows = []
            for window in windows([x[2] for x in group], capacity):
                at, sequence = 0, next(sequences)
                for i in sorted(window):
                    rows.append((*group[i], sequence, at))
                    at += group[i][2]
            return rows

        id_type = None
        for batch in batches:
            for step in steps(batch):
                rows, id_type = [], step.column("doc_id").type
                for doc_id, text in zip(step.column("doc_id").to_pylist(), step.column("text").to_pylist(), strict=True):
                    ids = np.array([*model.encode(text, allowed_special="all"), end], "<u4")
                    n, at = len(ids), 0
                    while n - at >= capacity:
                        rows.append((doc_id, at, capacity, ids[at : at + capacity].tobytes(), n, next(sequences), 0))
                        at += capacity
                        if len(rows) >= 4096:
                            yield emit(rows, id_type)
                            rows = []
                    while at < n:
                        size = min(run, n - at)
                        held.append((doc_id, at, size, ids[at : at + size].tobytes(), n))
                        at += size
                    while len(held) >= items:
                        rows += close(held[:items])
                        del held[:items]
                    if len(rows) >= 4096:
                        yield emit(rows, id_type)
                        rows = []
                if rows:
                    yield emit(rows, id_type)
        if held:
            yield emit(close(held), id_type)

    return df.mapInArrow(mapped, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
