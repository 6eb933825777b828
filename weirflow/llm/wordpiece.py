"""Token counts by a linear longest-match automaton.

Greedy word-piece segmentation of every white-space-separated word: at each place the longest piece of
the vocabulary, where pieces that open a word bear a mark. The vocabulary is a trie; a node's failure
link leads to the node that the rest of its string reaches once the pieces found on the way are popped,
and the number of those pieces is stored with the link. One walk over a word's characters with these
counts gives its length in pieces without building them.

Characters outside the vocabulary count as their UTF-8 bytes (byte fallback). Null and empty texts have
no words and no tokens. Very long words are walked in linear time. Repeated rows give repeated rows; an
empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from weirflow.llm.common import map_steps, texts_of

MARK = "▁"
#: Words whose counts are kept, and the longest of them.
CACHE, CACHED = 300_000, 48
_NODE = 21  # bits of a code point


class Automaton:
    """Trie of pieces with failure links (`fail`) and popped counts (`pops`); the root is node 0."""

    def __init__(self, pieces: list[str]):
        self.next: dict[int, int] = {}
        weight, parents, chars = [0], [0], [""]
        singles = {c for p in pieces for c in p}
        own = set(pieces)
        for piece in [*pieces, *sorted(singles - own)]:
            u = 0
            for c in piece:
                key = u << _NODE | ord(c)
                v = self.next.get(key)
                if v is None:
                    v = self.next[key] = len(weight)
                    weight.append(0)
                    parents.append(u)
                    chars.append(c)
                u = v
            # A character that is in pieces but none itself falls back to its bytes.
            weight[u] = 1 if piece in own else len(piece.encode())
        self.fail, self.pops = [0] * len(weight), [0] * len(weight)
        depth = [0] * len(weight)
        for v in range(1, len(weight)):
            depth[v] = depth[parents[v]] + 1
        for v in sorted(range(1, len(weight)), key=depth.__getitem__):
            if weight[v]:
                self.pops[v] = weight[v]
                continue
            # The parent's string is popped down to what its last piece leaves, then goes on with this character.
            u, code = parents[v], ord(chars[v])
            z, popped = self.fail[u], self.pops[u]
            while (z << _NODE | code) not in self.next:
                popped += self.pops[z]
                z = self.fail[z]
            self.fail[v], self.pops[v] = self.next[z << _NODE | code], popped

    def length(self, word: str) -> int:
        """Pieces of a word, in time linear in its characters."""
        following, fail, pops = self.next, self.fail, self.pops
        u = total = 0
        for c in word:
            code = ord(c)
            v = following.get(u << _NODE | code)
            while v is None:
                if u == 0:
                    total += len(c.encode())
                    v = 0
                    break
                total += pops[u]
                u = fail[u]
                v = following.get(u << _NODE | code)
            u = v
        while u:
            total += pops[u]
            u = fail[u]
        return total


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Of the ordinary pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Automaton([model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens for every row; a narrow map."""
    known: dict[str, int] = {}

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = automaton(path).length
        if len(known) > CACHE:
            known.clear()
        words, tokens = [], []
        for text in batch.column("text").to_pylist():
            cut, total = text.split(), 0
            for word in cut:
                n = known.get(word)
                if n is None:
                    n = length(MARK + word)
                    if len(word) <= CACHED:
                        known[word] = n
                total += n
            words.append(len(cut))
            tokens.append(total)
        return pa.record_batch([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    df = texts_of(docs, id_col, text_col)
    return map_steps(df, step, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
