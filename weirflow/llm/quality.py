"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character kinds, word lengths and repetition, of
the line itself and of the lines before and after it; labels of neighbouring lines have transition
weights. Forward-backward gives each line's probability of being good, and the mean of these, weighted
by the lines' bytes, becomes the document's score through a logistic fit on the training documents.

Weights are fitted on a bounded sample: about DOCS whole labelled texts of each class. Only documents
have labels, so those of lines are hidden: all lines of a good document are good; of a bad one at least
one is bad, and which others are is found in turns with the weights, from a first guess by each line's own
features. Lines are split at newlines; blank lines take part with their features. Null and empty texts
are one empty line. Scores have nine decimals, so that the order of sums, which follows the batches,
doesn't show. Without training rows of both classes every score is 0.5. Of different labels of one
document the lowest counts. Repeated rows give repeated rows; an empty table gives no rows. Columns of
other names play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import map_steps, ship, utf8

DOCS, ROUNDS, TURNS, RATE, DECAY = 1200, 120, 3, 0.1, 1e-3
NAMES = ["upper", "digit", "mark", "symbol", "odd", "stop", "word_len", "size", "repeats", "again", "loud", "one_word"]
_KIND = np.zeros(256, np.uint8)  # 0 letters and other
_KIND[65:91] = 1  # upper case
_KIND[48:58] = 2
_KIND[[ord(c) for c in "!?"]] = 3
_KIND[[ord(c) for c in "#$%&*@^~+=_"]] = 4
_KIND[[ord(c) for c in "|<>{}[]\\/"]] = 5
_KIND[[ord(c) for c in ".,;:"]] = 6
_KIND[[9, 10, 11, 12, 13, 32]] = 7


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x features, bytes of each line, lines of each text) of texts in order."""
    n_lines = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    kind = _KIND[data]
    # Two-byte Latin capitals (U+00C0 to U+00DE).
    kind[1:][(data[:-1] == 0xC3) & (data[1:] <= 0x9E)] = 1
    sizes = ends - starts
    sums = [np.add.reduceat((kind == k).astype(np.int32), starts) for k in range(8)]
    sums[7] = sums[7] - 1  # the line's own end
    solid = np.maximum(sizes - sums[7], 1)
    words, different, again = (np.zeros(len(starts)) for _ in range(3))
    at = 0
    for text in texts:
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            cut = line.split()
            words[at], different[at], again[at] = len(cut), len(set(cut)), line in seen and len(cut) > 0
            seen.add(line)
            at += 1
    some = np.maximum(words, 1)
    x = np.stack(
        [
            sums[1] / solid, sums[2] / solid, sums[3] / solid, sums[4] / solid, sums[5] / solid, sums[6] / solid,
            np.log1p(solid / some), np.log1p(sizes) / 5, 1 - different / some, again, sums[1] > 0.6 * solid, words <= 1,
        ],
        axis=1,
    )
    x[words == 0, 8] = 0
    return x, sizes, n_lines


def with_neighbours(x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its text, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    last = np.cumsum(n_lines) - 1
    before[last + 1 - n_lines], after[last] = 0, 0
    return np.concatenate((x, before, after, np.ones((len(x), 1))), axis=1)


def chain(unary: np.ndarray, link: np.ndarray, begins: np.ndarray, longest: int) -> np.ndarray:
    """Forward messages of every line, of sum 1, by doubling: products of ever longer runs of 2 x 2 steps.

    A step is link times the line's weights; that of a text's first line has two equal rows, so whatever
    stands before it has no influence.
    """
    m = [[np.where(begins, 1.0, link[a, b]) * unary[:, b] for b in (0, 1)] for a in (0, 1)]
    shift = 1
    while shift < longest:
        (p, q), (r, s) = [[x[:-shift] for x in row] for row in m]
        (t, u), (v, w) = [[x[shift:] for x in row] for row in m]
        new = [[p * t + q * v, p * u + q * w], [r * t + s * v, r * u + s * w]]
        size = new[0][0] + new[0][1] + new[1][0] + new[1][1]
        m = [[np.concatenate((m[a][b][:shift], new[a][b] / size)) for b in (0, 1)] for a in (0, 1)]
        shift *= 2
    out = np.stack((m[0][0] + m[1][0], m[0][1] + m[1][1]), axis=1)
    return out / out.sum(axis=1, keepdims=True)


def marginals(score: np.ndarray, link: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over every text at once.

    score: each line's weight of being good over bad; link: 2 x 2 transition weights. Gives each line's
    probability of being good and, for each pair of labels, the expected number of such transitions.
    """
    if not len(score):
        return np.zeros(0), np.zeros((2, 2))
    steps = np.exp(link)
    unary = np.exp(np.stack((-score / 2, score / 2), axis=1) - np.abs(score[:, None]) / 2)
    begins, ends = np.zeros(len(score), bool), np.zeros(len(score), bool)
    last = np.cumsum(n_lines) - 1
    begins[last + 1 - n_lines], ends[last] = True, True
    longest = int(n_lines.max())
    ahead = chain(unary, steps, begins, longest)
    back = chain(unary[::-1], steps.T, ends[::-1], longest)[::-1]
    into = np.ones_like(ahead)
    into[1:] = ahead[:-1] @ steps
    into[begins] = 1
    p = into * back
    p = p[:, 1] / p.sum(axis=1)
    inner = np.flatnonzero(~begins)
    both = ahead[inner - 1][:, :, None] * steps[None] * back[inner][:, None, :]
    return p, (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def adam(grad, w: np.ndarray, rounds: int) -> np.ndarray:
    """Weights after so many steps up the gradient."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, rounds + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w + RATE * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w


def fit(x: np.ndarray, sizes: np.ndarray, n_lines: np.ndarray, y: np.ndarray) -> dict:
    """Lines' hidden labels and likelihood weights in turns; then the logistic fit of documents."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = with_neighbours((x - mean) / scale, n_lines)
    of = np.repeat(y, n_lines).astype(float)
    first = np.cumsum(n_lines) - n_lines
    inner = np.ones(len(z), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)

    def hidden(p: np.ndarray) -> np.ndarray:
        """Labels of lines: good in good documents; in bad ones by probability, but the least good line is bad."""
        least = np.repeat(np.minimum.reduceat(p, first), n_lines)
        return np.where(of == 1, 1.0, ((p > 0.5) & (p > least)).astype(float))

    # The first guess: each line by its own features, both classes of equal weight.
    own = np.concatenate((z[:, : x.shape[1]], np.ones((len(z), 1))), axis=1)
    weight = np.where(of == 1, 0.5 / max((of == 1).sum(), 1), 0.5 / max((of == 0).sum(), 1))
    guess = adam(lambda w: own.T @ (weight * (of - 1 / (1 + np.exp(-np.clip(own @ w, -30, 30))))) - DECAY * w, np.zeros(own.shape[1]), ROUNDS)
    t = hidden(1 / (1 + np.exp(-np.clip(own @ guess, -30, 30))))
    w = np.zeros(z.shape[1] + 4)
    for _ in range(TURNS):
        label = t.astype(int)
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[inner - 1], label[inner]), 1)

        def grad(w, t=t, seen=seen):
            p, pairs = marginals(z @ w[:-4], w[-4:].reshape(2, 2), n_lines)
            return np.concatenate((z.T @ (t - p), (seen - pairs).ravel())) / len(z) - DECAY * w

        w = adam(grad, w, ROUNDS)
        t = hidden(marginals(z @ w[:-4], w[-4:].reshape(2, 2), n_lines)[0])
    model = {"mean": mean, "scale": scale, "w": w, "a": 1.0, "b": 0.0}
    good = document_logits(model, x, sizes, n_lines)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a damped two-weight logistic regression
        p = 1 / (1 + np.exp(-np.clip(a * good + b, -30, 30)))
        r, q = y - p, p * (1 - p) + 1e-9
        g = np.array([(r * good).sum() - 0.01 * a, r.sum() - 0.01 * b])
        h = np.array([[(q * good * good).sum() + 0.01, (q * good).sum()], [(q * good).sum(), q.sum() + 0.01]])
        a, b = np.array([a, b]) + np.linalg.solve(h, g)
    return model | {"a": float(a), "b": float(b)}


def line_probabilities(model: dict, x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Each line's probability of being good."""
    z = with_neighbours((x - model["mean"]) / model["scale"], n_lines)
    return marginals(z @ model["w"][:-4], model["w"][-4:].reshape(2, 2), n_lines)[0]


def document_logits(model: dict, x: np.ndarray, sizes: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Logit of the byte-weighted mean probability of a good line, bounded to +-6."""
    p = line_probabilities(model, x, n_lines)
    weight = sizes + 1.0
    first = np.cumsum(n_lines) - n_lines
    good = np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)
    good = np.clip(good, 1 / (1 + np.exp(6)), 1 / (1 + np.exp(-6)))
    return np.log(good / (1 - good))


def score_texts(model: dict | None, texts: list[bytes]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    logit = document_logits(model, *line_features(texts))
    return np.round(1 / (1 + np.exp(-(model["a"] * logit + model["b"]))), 9)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict | None:
    """Fit on about per_class whole texts of each class among the labels, chosen by a hash of the id."""
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    share = {y: int(min(1.0, per_class / n) * (1 << 30)) for y, n in sizes.items()}
    bound = F.when(F.col("y") == 1, share[1]).otherwise(share[0])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < bound)
    marks = {r.doc_id: r.y for r in chosen.toLocalIterator()}  # about 2 x per_class ids
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isin(list(marks)))

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, sizes, n_lines = line_features(utf8(batch.column("text")))
        cut = np.cumsum(n_lines)[:-1]
        return pa.record_batch([batch.column("doc_id"), pa.array([a.tobytes() for a in np.split(x, cut)]), pa.array([a.tobytes() for a in np.split(sizes, cut)])], ["doc_id", "x", "sizes"])

    rows = map_steps(texts, extract, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, x binary, sizes binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    if len({marks[r.doc_id] for r in rows}) < 2:
        return None
    x = np.concatenate([np.frombuffer(r.x).reshape(-1, len(NAMES)) for r in rows])
    sizes_of = [np.frombuffer(r.sizes, np.int64) for r in rows]
    return fit(x, np.concatenate(sizes_of), np.array([len(s) for s in sizes_of]), np.array([marks[r.doc_id] for r in rows]))


def classify(docs: DataFrame, model: dict | None, keep: tuple = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row; a narrow map. keep: further columns to pass through."""
    ship(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = score_texts(model, utf8(batch.column("text")))
        return pa.record_batch([*[batch.column(c) for c in ("doc_id", *keep)], pa.array(found)], ["doc_id", *keep, "score"])

    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[c for c in keep if c != "text"])
    return map_steps(df, step, T.StructType([*[df.schema[c] for c in ("doc_id", *keep)], T.StructField("score", T.DoubleType())]))


def label_lines(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line (from 0), good (its probability) for every line of every row; a narrow map. Without a model 0.5."""
    ship(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, _, n_lines = line_features(utf8(batch.column("text")))
        good = np.full(len(x), 0.5) if model is None else np.round(line_probabilities(model, x, n_lines), 9)
        row = np.repeat(np.arange(len(n_lines)), n_lines)
        line = np.arange(len(x)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
        return pa.record_batch([batch.column("doc_id").take(pa.array(row)), pa.array(line), pa.array(good)], ["doc_id", "line", "good"])

    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_steps(df, step, T.StructType([df.schema["doc_id"], T.StructField("line", T.LongType()), T.StructField("good", T.DoubleType())]))
