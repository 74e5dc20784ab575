"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are measures of its characters and
words and the same measures of the lines beside it; two more weights tie the
labels of neighbouring lines. Forward-backward gives each line the marginal
probability of being good; their mean, weighted by the lines' lengths, is the
document's quality.

The field is fitted on at most ``FIT_ROWS`` labelled documents (those with the
smallest hash of their id), all lines taking the label of their document; only
line measures reach the driver. Scoring sees a text and nothing else.

Null and empty texts are one line without characters and get a score too.
Blank lines are left out of a text that has others. Repeated rows and ties are
scored alike, a null id is kept; labels that repeat an id count once, the largest of them. Without
labels every score is 0.5. Extra columns are ignored; an empty table gives an
empty result. Very long texts are one sequence, however many lines they have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, mix, prefix_hash, short_batches, texts_of, window_hash

#: Bound of the labelled sample, steps of its fit and weight of the squared-norm penalty.
FIT_ROWS, STEPS, PENALTY = 2000, 250, 1e-3
THRESHOLD = 0.7

_KINDS = np.zeros(256, np.int64)  # 0: lower-case letters and whatever else is part of a word
_KINDS[ord("A") : ord("Z") + 1] = 1
_KINDS[ord("0") : ord("9") + 1] = 2
for _c in b" \t\r\x0b\x0c":
    _KINDS[_c] = 3
for _c in b".,;:'\"()-":
    _KINDS[_c] = 4
for _c in b"!?":
    _KINDS[_c] = 5
for _c in b"#$%&*+=<>^~_@\\/{}[]`":
    _KINDS[_c] = 6
_KINDS[ord("|")] = 7
_KINDS[0x80:] = 8
_N_KINDS = 9
N_MEASURES = _N_KINDS + 7


def line_measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measures of every line, its length in bytes, number of lines of each text)."""
    lines = []
    counts = np.empty(len(texts), np.int64)
    for k, t in enumerate(texts):
        own = [x for x in t.split(b"\n") if x.strip()] or [b""]
        counts[k] = len(own)
        lines += own
    data = np.frombuffer(b"\n".join([*lines, b""]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in lines])
    starts = np.r_[0, ends[:-1]]
    length = ends - starts - 1
    kind = _KINDS[data]
    shares = np.zeros((len(lines), _N_KINDS))
    for c in range(_N_KINDS):
        total = np.r_[0, np.cumsum(kind == c)]
        shares[:, c] = total[ends - 1] - total[starts]
    shares[:, 0] = length - shares[:, 1:].sum(axis=1)
    size = np.maximum(length, 1)[:, None]

    # Words: how many, how long, how many of them distinct, how many end in a letter.
    space = (kind == 3) | (data == 10)
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    line_of = np.searchsorted(ends, begin, "right")
    words = np.bincount(line_of, minlength=len(lines)).astype(float)
    some = np.maximum(words, 1)
    prefix = prefix_hash(data)
    keys = mix(window_hash(prefix, begin, end) ^ (line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, first = np.unique(keys, return_index=True)
    distinct = np.bincount(line_of[first], minlength=len(lines)) / some
    last = kind[end - 1] if len(end) else end
    clean_end = np.bincount(line_of, weights=(last == 0) | (last == 4) | (last == 8), minlength=len(lines)) / some
    capital = np.bincount(line_of, weights=kind[begin] == 1 if len(begin) else begin, minlength=len(lines)) / some

    # Lines that their text has more than once.
    text_of = np.repeat(np.arange(len(texts)), counts)
    whole = mix(window_hash(prefix, starts, ends - 1) ^ (text_of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    _, back, times = np.unique(whole, return_inverse=True, return_counts=True)
    repeated = np.minimum(times[back] - 1, 5) / 5 * (length > 0)
    more = np.stack([np.log1p(length) / 8, np.log1p(words) / 8, np.minimum(length / some, 30) / 10, distinct, clean_end, capital, repeated], 1)
    return np.concatenate([shares / size, more], 1), length, counts


def with_neighbours(measures: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Measures of a line, of the lines before and after it in its text, whether these exist, and a constant."""
    n = len(measures)
    ends = np.cumsum(counts)
    has_before, has_after = np.ones(n, bool), np.ones(n, bool)
    has_before[ends - counts] = False
    has_after[ends - 1] = False
    before = np.r_[np.zeros((1, measures.shape[1])), measures[:-1]] * has_before[:, None]
    after = np.r_[measures[1:], np.zeros((1, measures.shape[1]))] * has_after[:, None]
    return np.concatenate([measures, before, after, has_before[:, None], has_after[:, None], np.ones((n, 1))], 1)


class LineField:
    """Two labels a line: ``weights`` of the features for good, ``ties``: log weights of (bad, good) x (bad, good)."""

    def __init__(self, weights: np.ndarray, ties: np.ndarray):
        self.weights, self.ties = weights, ties

    def marginals(self, features: np.ndarray, counts: np.ndarray):
        """P(good) by line; P of both labels by neighbouring lines, summed by text order; log partition summed."""
        unary = features @ self.weights
        return forward_backward(unary, self.ties, counts)


def forward_backward(unary: np.ndarray, ties: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good by line, expected pairs of labels (2 x 2, all texts), log partition by text.

    Texts run side by side, longest first, so that step ``t`` works on those with more than ``t`` lines.
    """
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    longest = counts[order]
    steps = int(longest[0]) if len(longest) else 0
    alive = np.searchsorted(-longest, -np.arange(steps), "left")
    alpha = np.zeros((len(unary), 2))
    weight = np.exp(ties)
    log_z = np.zeros(len(counts))
    # Scaled recursions: each step's vector sums to one, the scales make up the partition function.
    good = np.exp(unary - np.maximum(unary, 0))
    bad = np.exp(-np.maximum(unary, 0))
    shift = np.maximum(unary, 0)
    scale = np.ones(len(unary))
    for t in range(steps):
        at = begin[: alive[t]] + t
        if t == 0:
            a0, a1 = bad[at], good[at]
        else:
            p = alpha[at - 1]
            a0 = (p[:, 0] * weight[0, 0] + p[:, 1] * weight[1, 0]) * bad[at]
            a1 = (p[:, 0] * weight[0, 1] + p[:, 1] * weight[1, 1]) * good[at]
        s = a0 + a1
        alpha[at, 0], alpha[at, 1] = a0 / s, a1 / s
        scale[at] = s
        log_z[: alive[t]] += np.log(s) + shift[at]
    beta = np.ones((len(unary), 2))
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        nxt = at + 1
        g0, g1 = bad[nxt] * beta[nxt, 0] / scale[nxt], good[nxt] * beta[nxt, 1] / scale[nxt]
        beta[at, 0] = weight[0, 0] * g0 + weight[0, 1] * g1
        beta[at, 1] = weight[1, 0] * g0 + weight[1, 1] * g1
        a = alpha[at]
        pairs += np.array([[(a[:, 0] * g0).sum(), (a[:, 0] * g1).sum()], [(a[:, 1] * g0).sum(), (a[:, 1] * g1).sum()]]) * weight
    both = alpha * beta
    out = np.empty(len(counts))
    out[order] = log_z
    return both[:, 1] / np.maximum(both.sum(axis=1), 1e-300), pairs, out


class QualityModel:
    """The fitted field with the scaling of its measures."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, field: LineField, known: bool = True):
        self.mean, self.spread, self.field, self.known = mean, spread, field, known

    def line_marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        measures, length, counts = line_measures(texts)
        features = with_neighbours((measures - self.mean) / self.spread, counts)
        return self.field.marginals(features, counts)[0], length, counts

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.known or not texts:
            return np.full(len(texts), 0.5)
        good, length, counts = self.line_marginals(texts)
        weight = np.maximum(length, 1).astype(float)
        at = np.cumsum(counts) - counts
        return np.clip(np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at), 0.0, 1.0)


def fit_field(measures: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> QualityModel:
    """Penalised likelihood of the label sequences, by gradient steps with running moments."""
    mean, spread = measures.mean(axis=0), measures.std(axis=0) + 1e-6
    features = with_neighbours((measures - mean) / spread, counts)
    y = np.repeat(labels.astype(float), counts)
    # A text counts as one, however many lines it has.
    by_line = np.repeat(1.0 / counts, counts) / len(counts)
    inner = counts - 1
    seen = np.diag([float((inner * (1 - labels) / np.maximum(counts, 1)).sum()), float((inner * labels / np.maximum(counts, 1)).sum())]) / len(counts)
    theta = np.zeros(features.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        ties = theta[-4:].reshape(2, 2)
        good, pairs, _ = forward_backward(features @ theta[:-4], ties, counts)
        grad_w = features.T @ ((y - good) * by_line) - penalty * theta[:-4]
        expected = pairs / max(pairs.sum(), 1e-9) * seen.sum()
        grad_t = (seen - expected).ravel() - 10 * penalty * theta[-4:]
        grad = np.r_[grad_w, grad_t]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -1.0, 1.0)
    return QualityModel(mean, spread, LineField(theta[:-4], theta[-4:].reshape(2, 2)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QualityModel:
    """``labels``: (doc_id, quality) that may be learnt from; at most ``rows`` of them are."""
    short_batches(docs.sparkSession)
    chosen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def measure(batches):
        for batch in batches:
            texts = texts_of(batch)
            found = [line_measures([t]) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int64()), pa.array([f[0].astype("<f4").tobytes() for f in found], pa.binary())], ["doc_id", "quality", "measures"])

    got = sorted(sample.mapInArrow(measure, "doc_id long, quality long, measures binary").collect())
    if len({r.quality for r in got}) < 2:
        return QualityModel(np.zeros(N_MEASURES), np.ones(N_MEASURES), LineField(np.zeros(3 * N_MEASURES + 3), np.zeros((2, 2))), False)
    each = [np.frombuffer(bytes(r.measures), "<f4").reshape(-1, N_MEASURES).astype(float) for r in got]
    return fit_field(np.concatenate(each), np.array([len(x) for x in each]), np.array([r.quality for r in got]))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_lines, good_lines) of every row."""
    short_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            if model.known and texts:
                good, length, counts = model.line_marginals(texts)
                weight = np.maximum(length, 1).astype(float)
                at = np.cumsum(counts) - counts
                scores = np.clip(np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at), 0.0, 1.0)
                better = np.add.reduceat((good >= 0.5).astype(np.int64), at)
            else:
                scores, counts, better = np.full(len(texts), 0.5), np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(better, pa.int64())], ["doc_id", "score", "n_lines", "good_lines"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_lines long, good_lines long")


def fold(doc_id) -> "F.Column":
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(F.col("doc_id")) != 2)
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines", "good_lines")
