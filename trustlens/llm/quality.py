"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad.  A line's features are shares of its bytes by kind
and a few counts, and the same of the lines before and after it.  The field is trained
on lines that take the label of their document; forward-backward gives each line's
probability to be good, their mean weighted by line length gives the document's, and a
logistic curve fitted to the training documents turns it into a score.

Training takes at most TRAIN_DOCS labelled documents, those of smallest hash, each with
its whole text.  Only the features of their lines come to the driver, 72 bytes a line;
more than spark.driver.maxResultSize of them is an error, never a shorter text.  Scoring
takes whole texts.

Defined results: a null or empty text is one empty line.  Labels that are null are left
out; of several for a doc_id the smallest counts, and training takes the smallest text of
a doc_id with several rows.  Without labels, or with one kind only,
all scores are equal: the share of good labels (a half without any); keep_good keeps all
documents when there is no label to learn from.  Rows that repeat a
doc_id each get a row; a null doc_id is not held out, and has no label.  Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.common import bounded_batches, by_bytes, documents, powers, table, text_or_empty

TRAIN_DOCS = 4000
THRESHOLD = 0.7
STEPS = 150
#: Lines of a chain walked one by one.
PIECE = 256
HASH_BASE = 0x100000001B3

UPPER, LOWER, HIGH, DIGIT, SPACE, STOP, MARK, OTHER = range(8)


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, OTHER, dtype=np.uint8)
    for values, k in ((range(65, 91), UPPER), (range(97, 123), LOWER), (range(128, 256), HIGH), (range(48, 58), DIGIT),
                      ((9, 10, 11, 12, 13, 32), SPACE), (b".,;:?'\"()-", STOP), (b"!", MARK)):
        kind[list(values)] = k
    return kind


KINDS = _byte_kinds()
#: Features of one line; each stands three times: for the line, the one before, the next.
FEATURES = ["upper", "high", "digit", "space", "stop", "mark", "other", "pipe", "run", "word_length", "word_ends", "size", "repeated", "echo", "echo2", "there"]


def own_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, lines) of texts that lie end to end: a row per line without its
    neighbours, the bytes of each line and the number of lines of each text."""
    breaks = np.flatnonzero(data == 10)
    first = np.searchsorted(breaks, starts)
    lines = np.searchsorted(breaks, ends) - first + 1
    total = int(lines.sum())
    head = np.cumsum(lines) - lines
    number = np.arange(total) - np.repeat(head, lines)
    padded = np.append(breaks, 0)
    at = np.repeat(first, lines) + number
    begin = np.where(number == 0, np.repeat(starts, lines), padded[np.maximum(at - 1, 0)] + 1)
    end = np.where(number == np.repeat(lines, lines) - 1, np.repeat(ends, lines), padded[np.minimum(at, len(breaks))])
    size = end - begin
    kind = KINDS[data]

    def count(flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1, dtype=np.int32)
        np.cumsum(flags, out=c[1:], dtype=np.int32)
        return (c[end] - c[begin]).astype(np.float32)

    n = np.maximum(size, 1).astype(np.float32)
    by = [count(kind == k) for k in range(8)]
    letters = np.maximum(by[UPPER] + by[LOWER] + by[HIGH], 1)
    space = kind == SPACE
    edge = np.zeros(len(data) + 1, dtype=bool)  # where a text begins
    edge[starts] = edge[ends] = True
    word_end = ~space & (np.append(space[1:], True) | edge[1:])
    words = np.maximum(count(word_end), 1)
    again = np.concatenate([[False], data[1:] == data[:-1]])[:len(data)] & (kind >= STOP) & ~edge[:-1]
    closed = word_end & (kind >= MARK)
    weight = powers(HASH_BASE, len(data))
    hashed = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * weight, out=hashed[1:])
    undo = powers(pow(HASH_BASE, -1, 1 << 64), len(data) + 1)
    line_hash = ((hashed[end] - hashed[begin]) * undo[begin]) ^ (np.repeat(np.arange(len(lines)), lines).astype(np.uint64) << np.uint64(40))
    word_begin = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]])[:len(data)] | edge[:-1]))
    word_stop = np.flatnonzero(word_end) + 1
    word_text = np.searchsorted(ends, word_begin, side="right")
    word_hash = (hashed[word_stop] - hashed[word_begin]) * undo[word_begin]

    def echo(back: int) -> np.ndarray:
        """Words that equal the one so many words before (in the line or above it)."""
        flags = np.zeros(len(data), dtype=bool)
        flags[word_begin[back:][(word_hash[back:] == word_hash[:-back]) & (word_text[back:] == word_text[:-back])]] = True
        return count(flags) / words

    _, which, times = np.unique(line_hash, return_inverse=True, return_counts=True)
    own = np.stack([
        by[UPPER] / letters, by[HIGH] / n, by[DIGIT] / n, by[SPACE] / n, by[STOP] / words, by[MARK] / words, by[OTHER] / words,
        count(data == 124) / words, count(again) / words, np.log1p((size - by[SPACE]) / words), count(closed) / words,
        np.log1p(size), (times[which] > 1) & (size > 0), echo(1), echo(2), np.ones(total)], axis=1).astype(np.float32)
    return own, size, lines


def not_first(lines: np.ndarray) -> np.ndarray:
    """Of each line, whether one of the same text stands before it."""
    inner = np.ones(int(lines.sum()), dtype=bool)
    inner[np.cumsum(lines) - lines] = False
    return inner


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``own_features`` with those of the line before and of the next beside them."""
    own, size, lines = own_features(data, starts, ends)
    inner = not_first(lines)
    before = np.zeros_like(own)
    before[1:][inner[1:]] = own[:-1][inner[1:]]
    after = np.zeros_like(own)
    after[:-1][inner[1:]] = own[1:][inner[1:]]
    return np.concatenate([own, before, after], axis=1), size, lines


def messages(unary: np.ndarray, lines: np.ndarray, pair: np.ndarray, piece: int) -> np.ndarray:
    """Log odds of what stands before each line of its chain.  Long chains are cut into
    pieces: the odds a piece passes on follow from its matrix, all pieces' taken at once."""
    head, out = np.cumsum(lines) - lines, np.zeros(len(unary))
    count = np.maximum(-(-lines // piece), 1)
    first = np.cumsum(count) - count
    number = np.arange(int(count.sum())) - np.repeat(first, count)
    start = np.repeat(head, count) + number * piece
    n = np.minimum(piece, np.repeat(lines, count) - number * piece)
    pieces = int(count.max()) if len(count) else 0
    if pieces > 1:
        goes_on = number < np.repeat(count, count) - 1
        # rows good and bad, columns the good and bad that come in
        m = np.where(np.eye(2, dtype=bool), 0.0, -np.inf)[:, :, None] + np.zeros(int(goes_on.sum()))
        for t in range(piece):
            good = m[0] + unary[start[goes_on] + t]
            m = np.stack([np.logaddexp(good + pair[1, 1], m[1] + pair[0, 1]), np.logaddexp(good + pair[1, 0], m[1] + pair[0, 0])])
            m -= m.max(axis=(0, 1))
        place = np.cumsum(goes_on) - 1
        for k in range(1, pieces):
            at = first[count > k] + k - 1
            odds, ((a, b), (c, d)) = out[start[at]], m[:, :, place[at]]
            out[start[at + 1]] = np.logaddexp(odds + a, b) - np.logaddexp(odds + c, d)
    order = np.argsort(-n, kind="stable")
    start, longest = start[order], int(n.max()) if len(n) else 0
    active = np.searchsorted(-n[order], -np.arange(longest), side="left")  # pieces with more than t lines
    for t in range(1, longest):
        i = start[:active[t]] + t
        odds = out[i - 1] + unary[i - 1]
        out[i] = np.logaddexp(odds + pair[1, 1], pair[0, 1]) - np.logaddexp(odds + pair[1, 0], pair[0, 0])
    return out


def chain(unary: np.ndarray, lines: np.ndarray, pair: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains of two labels (1 good, 0 bad), in log odds.

    ``unary``: log odds of good of every line; ``pair[i, j]``: log weight of label j
    after i.  Returns the forward and backward messages (log odds of what stands before
    and after a line) and the probability that it is good."""
    forward = messages(unary, lines, pair, piece)
    backward = messages(unary[::-1], lines[::-1], pair.T, piece)[::-1]
    odds = forward + unary + backward
    return forward, backward, 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


class Field:
    """A trained field: scaling, weights of the features, pair weights, score curve.
    ``learned`` is false if there was no labelled document."""

    learned = True

    def __init__(self, mean, scale, weights, bias, pair, curve):
        self.mean, self.scale, self.weights, self.bias, self.pair, self.curve = mean, scale, weights, bias, pair, curve

    def good(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """The probability of each line to be good."""
        return chain((x - self.mean) / self.scale @ self.weights + self.bias, lines, self.pair)[2]

    def score(self, x: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        share = length_weighted(self.good(x, lines), size, lines)
        return 1 / (1 + np.exp(-(self.curve[0] * log_odds(share) + self.curve[1])))


def length_weighted(good: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Mean over a text's lines, by their bytes plus one."""
    head = np.cumsum(lines) - lines
    w = size + 1.0
    return np.add.reduceat(good * w, head) / np.add.reduceat(w, head) if len(lines) else np.zeros(0)


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_curve(value: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, float]:
    """A logistic curve by Newton steps, halved until they descend; the slope is drawn
    towards one."""
    x = np.stack([value, np.ones(len(value))], axis=1)
    pull, aim = np.array([penalty, 0.01]), np.array([1.0, 0.0])

    def loss(c: np.ndarray) -> float:
        z = x @ c
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * pull @ (c - aim) ** 2)

    c = aim.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (p - y) + pull * (c - aim)
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull)
        step, now = np.linalg.solve(hess, grad), loss(c)
        while loss(c - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        c = c - step
    return float(max(c[0], 0.05)), float(c[1])


def fit(own: np.ndarray, size: np.ndarray, lines: np.ndarray, y: np.ndarray, steps: int = STEPS, penalty: float = 1e-3) -> Field:
    """Train on documents with ``lines`` lines each (rows of ``own``) and labels ``y``.
    The neighbours' features are never laid out: products with them are shifted."""
    inner = not_first(lines)
    nxt = np.flatnonzero(inner)

    def apply(w: np.ndarray) -> np.ndarray:
        """The features of lines and neighbours times ``w``."""
        part = own @ w.reshape(3, -1).T
        out = part[:, 0].copy()
        out[nxt] += part[nxt - 1, 1]
        out[nxt - 1] += part[nxt, 2]
        return out

    def collect(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
        """``v`` times the features ``rows`` of lines and neighbours."""
        return np.concatenate([v @ rows, (v[1:] * inner[1:]) @ rows[:-1], (v[:-1] * inner[1:]) @ rows[1:]])

    each = np.full(len(own), 1 / len(own))
    mean = collect(own, each)
    scale = np.sqrt(np.maximum(collect(own ** 2, each) - mean ** 2, 0)) + 1e-3
    label = np.repeat(y, lines).astype(float)
    # every document weighs the same, and both labels together
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    weight = np.repeat(share / lines, lines)
    pairs_seen = np.zeros((2, 2))
    for k in (0, 1):
        pairs_seen[k, k] = weight[nxt][label[nxt] == k].sum()
    theta = np.zeros(len(mean) + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, bias, pair = theta[:-5] / scale, theta[-5], theta[-4:].reshape(2, 2)
        unary = apply(w) + (bias - mean @ w)
        forward, backward, good = chain(unary, lines, pair)
        before, after = (forward + unary)[nxt - 1], (unary + backward)[nxt]
        joint = np.stack([np.zeros(len(nxt)) + pair[0, 0], after + pair[0, 1], before + pair[1, 0], before + after + pair[1, 1]], axis=1)
        joint = np.exp(joint - joint.max(axis=1, keepdims=True))
        joint /= joint.sum(axis=1, keepdims=True)
        error = weight * (good - label)
        grad = np.concatenate([(collect(own, error) - mean * error.sum()) / scale, [error.sum()], (weight[nxt] @ joint) - pairs_seen.ravel()]) + penalty * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad ** 2
        # smaller steps towards the end: one step moves all lines of a long chain
        theta -= 0.1 * (1 - (t - 1) / steps) * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-9)
    w, bias, pair = theta[:-5] / scale, theta[-5], theta[-4:].reshape(2, 2)
    good = chain(apply(w) + (bias - mean @ w), lines, pair)[2]
    field = Field(mean, scale, theta[:-5], theta[-5], theta[-4:].reshape(2, 2), (1.0, 0.0))
    field.curve = fit_curve(log_odds(length_weighted(good, size, lines)), y)
    return field


def constant_field(share: float) -> Field:
    n = 3 * len(FEATURES)
    return Field(np.zeros(n), np.ones(n), np.zeros(n), 0.0, np.zeros((2, 2)), (0.0, float(np.log(share / (1 - share)))))


def _layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[ends[0]:ends[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, ends[:-1] - ends[0], ends[1:] - ends[0]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; one without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> Field:
    """Fit on the labelled documents that are not held out, ``max_docs`` at most,
    one row and the whole text of each."""
    spark = docs.sparkSession
    bounded_batches(spark)
    taken = (labels.select("doc_id", "quality").filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, "text"):
                x, size, lines = own_features(*_layout(part.column("text")))
                rows = [(x[at:at + n].tobytes(), size[at:at + n].astype(np.int64).tobytes())
                        for at, n in zip(np.cumsum(lines) - lines, lines, strict=True)]
                xs, sizes = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(xs, pa.binary()), pa.array(sizes, pa.binary())],
                                                 names=["doc_id", "quality", "x", "size"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    taken = taken.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    # max_docs rows at most
    one = own.join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    rows = sorted(one.mapInArrow(features, "doc_id long, quality int, x binary, size binary").collect(), key=lambda r: r.doc_id)
    y = np.array([int(r.quality == 1) for r in rows])
    if len(set(y.tolist())) < 2:
        field = constant_field((y.sum() + 0.5) / (len(y) + 1))
        field.learned = len(y) > 0
        return field
    size = [np.frombuffer(r.size, dtype=np.int64) for r in rows]
    x = np.concatenate([np.frombuffer(r.x, dtype=np.float32) for r in rows], dtype=np.float64).reshape(-1, len(FEATURES))
    del rows
    return fit(x, np.concatenate(size), np.array([len(s) for s in size]), y)


def score(docs: DataFrame, field: Field, keep: bool = False) -> DataFrame:
    """doc_id and score of every row; with ``keep`` all of a row's columns, as ``row``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, "text"):
                value = field.score(*line_features(*_layout(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value, pa.float64()), *([part.column("row")] if keep else [])],
                                                 names=["doc_id", "score", *["row"] * keep])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text"), *([F.struct(*docs.columns).alias("row")] if keep else []))
    schema = f"doc_id {kind}, score double"
    if keep:
        return rows.mapInArrow(run, schema + f", row {rows.schema['row'].dataType.simpleString()}")
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents scored below ``threshold``, all columns kept.
    Without a label to learn from (none, or of held-out documents only) nothing speaks
    against a document: all are kept."""
    field = train(docs, labels)
    if not field.learned:
        return docs
    return score(docs, field, keep=True).filter(F.col("score") >= threshold).select("row.*")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole table ``documents``, learned from ``labels``."""
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
