"""Language identification by unigram models over a fixed vocabulary, summed over all segmentations.

Every language has a probability for each piece of a public vocabulary (and a floor for characters
outside it). The likelihood of a word is the sum over all ways to cut it into pieces, by the forward
algorithm; that of a text is the product over its words, lower-cased and split at white space. The
prediction is the likeliest language, the score its posterior under equal priors. Pieces are learned
by expectation maximisation (forward-backward) from a bounded sample: about DOCS whole texts a language.

Null texts and those without a letter: `und`, score 0; so are all texts if nothing was learned. Words may
have any length: probabilities along a word are scaled anew as they fall. Ties go to the first language by code point.
Repeated rows give repeated rows; an empty table gives no rows. Columns of other names play no part.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import map_steps, ship

DOCS, ROUNDS, PRIOR, FLOOR = 400, 4, 0.05, 1e-7
LONGEST, CACHE = 16, 300_000
#: Places of words worked on at once; places after which probabilities are scaled anew; characters of words kept.
CELLS, RESCALE, CHARS = 1 << 20, 8, 1 << 25
LETTER = regex.compile(r"\p{L}")


class Trie:
    """Pieces as a trie in an open-addressing table of numpy arrays, looked up for many places at once."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        following: dict[int, int] = {}
        ids = [-1]
        for i, piece in enumerate(pieces):
            u = 0
            for c in piece:
                u = following.setdefault(u << 21 | ord(c), len(ids))
                if u == len(ids):
                    ids.append(-1)
            ids[u] = i
        self.ids = np.array(ids, np.int32)
        keys, nodes = np.array(list(following), np.int64), np.array(list(following.values()), np.int32)
        self.bits = max(4, 3 + len(keys).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at = self.slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            placed = self.keys[at] == keys
            self.nodes[at[placed]] = nodes[placed]
            keys, nodes, at = keys[~placed], nodes[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The node that each code point leads to, or -1."""
        keys = nodes.astype(np.int64) << 21 | codes
        at = self.slot(keys)
        held, out = self.keys[at], self.nodes[at]
        out[held != keys] = -1
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.nodes[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Trie:
    """The ordinary pieces of a sentencepiece model, of at most LONGEST characters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return Trie(sorted({p for p in map(model.id_to_piece, ordinary) if len(p) <= LONGEST}))


def parts(text: str) -> list[str]:
    """The words of a text as they are scored, with a mark where a word begins."""
    return ["▁" + word for word in text.lower().split()]


def groups(words: list[str]):
    """The places of words by length, cut so that as many rows as words and columns as the longest make at most CELLS (one word: any)."""
    by = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable").tolist()
    held: list[int] = []
    for i in by:
        if held and (len(held) + 1) * (len(words[i]) + 1) > CELLS:
            yield held
            held = []
        held.append(i)
    if held:
        yield held


class Lattice:
    """All pieces in a list of words: edges (word, start, end, piece), grouped by end. Piece `n` is the floor."""

    def __init__(self, words: list[str], trie: Trie):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), self.lengths)
        start_of = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        left = np.repeat(self.lengths, self.lengths) - start_of
        alive, node = np.arange(len(codes)), np.zeros(len(codes), np.int32)
        floor = np.ones(len(codes), bool)
        at, size, piece = [], [], []
        for n in range(1, LONGEST + 1):
            more = left[alive] >= n
            alive, node = alive[more], node[more]
            node = trie.step(node, codes[alive + n - 1])
            alive, node = alive[node >= 0], node[node >= 0]
            if not len(alive):
                break
            ids = trie.ids[node]
            found = ids >= 0
            at.append(alive[found])
            size.append(np.full(int(found.sum()), n))
            piece.append(ids[found])
            if n == 1:
                floor[at[-1]] = False
        rest = np.flatnonzero(floor)
        at, size = np.concatenate([*at, rest]), np.concatenate([*size, np.ones(len(rest), np.int64)])
        piece = np.concatenate([*piece, np.full(len(rest), trie.n, np.int32)])
        end = start_of[at] + size
        by = np.argsort(end, kind="stable")
        self.word, self.start, self.end, self.piece = word_of[at][by], start_of[at][by], end[by], piece[by]
        self.most = int(self.lengths.max(initial=0))
        self.cuts = np.searchsorted(self.end, np.arange(self.most + 2))

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        """(word, language): log of the summed probability of all segmentations. p: (piece, language)."""
        n, k, wide = len(self.lengths), p.shape[1], LONGEST + 1
        ring, scale, out = np.zeros((n, wide, k)), np.zeros((n, k)), np.empty((n, k))
        ring[:, 0] = 1
        for e in range(1, self.most + 1):
            at = slice(self.cuts[e], self.cuts[e + 1])
            w = self.word[at]
            flow = ring[w, self.start[at] % wide] * p[self.piece[at]]
            here = np.stack([np.bincount(w, flow[:, j], n) for j in range(k)], axis=1) if k else ring[:, 0]
            ring[:, e % wide] = here
            done = self.lengths == e
            if done.any():
                out[done] = np.log(here[done]) + scale[done]
            if e % RESCALE == 0:  # only ratios of the last places matter
                top = ring.max(axis=1)
                ring /= np.where(top > 0, top, 1)[:, None]
                scale += np.log(np.where(top > 0, top, 1))
        return out

    def logs(self, q: np.ndarray, back: bool = False) -> np.ndarray:
        """(word, place): log probability of all segmentations up to a place or, going back, from it to the end. q: of pieces."""
        n, wide = len(self.lengths), LONGEST + 1
        out, ring, scale = np.full((n, self.most + 1), -np.inf), np.zeros((n, wide)), np.zeros(n)
        # Going back, place e of a word is its length less e; edges are grouped by where they begin.
        start, end = (self.lengths[self.word] - self.end, self.lengths[self.word] - self.start) if back else (self.start, self.end)
        by = np.argsort(end, kind="stable")
        word, start, piece = self.word[by], start[by], self.piece[by]
        cuts = np.searchsorted(end[by], np.arange(self.most + 2))
        ring[:, 0], out[:, 0] = 1, 0
        for e in range(1, self.most + 1):
            at = slice(cuts[e], cuts[e + 1])
            w = word[at]
            here = np.bincount(w, ring[w, start[at] % wide] * q[piece[at]], n)
            ring[:, e % wide] = here
            some = here > 0
            out[some, e] = np.log(here[some]) + scale[some]
            if e % RESCALE == 0:
                top = ring.max(axis=1)
                top = np.where(top > 0, top, 1)
                ring /= top[:, None]
                scale += np.log(top)
        return out

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts of one language (p: one column) over words that occur `counts` times."""
        q = p[:, 0]
        alpha, beta = self.logs(q), self.logs(q, back=True)
        total = alpha[np.arange(len(self.lengths)), self.lengths]
        left = beta[self.word, self.lengths[self.word] - self.end]
        flow = np.exp(alpha[self.word, self.start] + np.log(q[self.piece]) + left - total[self.word]) * counts[self.word]
        return np.bincount(self.piece, flow, len(q))


def fit(samples: dict[str, Counter], path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (piece, language), from word counts."""
    trie = vocabulary(path)
    n = trie.n
    names = sorted(samples, key=lambda s: s.encode())
    columns = []
    for name in names:
        words = list(samples[name])
        counts = np.array([samples[name][w] for w in words], float)
        lattices = [(Lattice([words[i] for i in at], trie), counts[at]) for at in groups(words)]
        p = np.full((n + 1, 1), 1 / n)
        p[n] = FLOOR
        for _ in range(rounds):
            seen = sum((lattice.expected(p, some)[:n] for lattice, some in lattices), np.zeros(n)) + PRIOR
            p[:n, 0] = seen / seen.sum()
        columns.append(p[:, 0])
    return names, np.stack(columns, axis=1) if columns else np.zeros((n + 1, 0))


def learn(docs: DataFrame, learnable, path: str, per_language: int = DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Fit on about per_language whole texts of each language among the learnable rows, chosen by a hash of the id."""
    ship(docs.sparkSession)
    df = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in df.groupBy(lang_col).count().collect()}
    share = F.lit(None)
    if sizes:
        share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, per_language / n) * (1 << 30)))]), F.col(lang_col))
    chosen = df.where(F.pmod(F.xxhash64(id_col, F.lit("langid")), F.lit(1 << 30)) < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(parts(text))
            rows = [(k, w, n) for k, c in found.items() for w, n in c.items()]
            if rows:
                yield pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], ["lang", "word", "n"])

    samples: dict[str, Counter] = {}
    for r in chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        samples.setdefault(r.lang, Counter())[r.word] = r.n
    return fit(samples, path)


class Scorer:
    """Scores texts; likelihoods of words are kept, up to CACHE words or CHARS characters."""

    def __init__(self, names: list[str], p: np.ndarray, path: str):
        self.names, self.p, self.trie = names, p, vocabulary(path)
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.chars = 0
        self.table = np.zeros((0, len(self.names)))

    def likelihoods(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.names)))
        for at in groups(words):
            out[at] = Lattice([words[i] for i in at], self.trie).log_likelihood(self.p)
        return out

    def add(self, words: list[str]) -> None:
        self.known.update(zip(words, range(len(self.table), len(self.table) + len(words)), strict=True))
        self.table = np.concatenate((self.table, self.likelihoods(words)))
        self.chars += sum(map(len, words))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        cut = [parts(t) if t is not None and self.names and LETTER.search(t) else None for t in texts]
        if len(self.known) > CACHE or self.chars > CHARS:
            self.clear()
        new = set()
        for words in cut:
            if words:
                new.update(words)
        self.add(sorted(new.difference(self.known), key=len))
        langs, scores = [], []
        for words in cut:
            if not words:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(np.argmax(total))
            langs.append(self.names[best])
            scores.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return langs, scores


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str, keep: tuple = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row; a narrow map. keep: further columns to pass through."""
    ship(docs.sparkSession)
    names, p = model
    shared = docs.sparkSession.sparkContext.broadcast((names, p.astype(np.float32)))  # vocabulary x languages: fixed size
    state: dict = {}

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "scorer" not in state:
            known, probabilities = shared.value
            state["scorer"] = Scorer(known, probabilities.astype(float), path)
        langs, scores = state["scorer"].score(batch.column("text").to_pylist())
        return pa.record_batch([*[batch.column(c) for c in ("doc_id", *keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", *keep, "lang_pred", "score"])

    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[c for c in keep if c != "text"])
    found = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_steps(df, step, T.StructType([*[df.schema[c] for c in ("doc_id", *keep)], *found]))
