"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad; a line's features are its own and its neighbours'. Forward-backward
marginals, weighted by line length, average into one number a document, and a one-variable logistic
curve turns that into a score. The field is fitted here on a bounded sample of labelled documents
(``TRAIN_DOCS`` documents of at most ``TRAIN_LINES`` lines); scoring maps over whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.runtime import bound_batches, table

from .common import batch, documents, id_remainder, map_batches, texts, tidied

#: Bound of the sample that the field is fitted on.
TRAIN_DOCS = 6_000
TRAIN_LINES = 256
STEPS, RATE, DECAY = 120, 0.08, 1e-3

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_STOPS = b".,;:!?"
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _STOPS)
FEATURES = 15


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x FEATURES, lengths) of a text's lines; an empty text is one empty line."""
    lines = text.encode("utf-8").split(b"\n")
    seen: dict[bytes, int] = {}
    rows = []
    for line in lines:
        n = len(line)
        words = line.split()
        k = len(words)
        if not k:
            rows.append((1.0, *(0.0,) * (FEATURES - 2), 0.0))
            continue
        upper = n - len(line.translate(None, _UPPER))
        digits = n - len(line.translate(None, _DIGIT))
        stops = n - len(line.translate(None, _STOPS))
        symbols = n - len(line.translate(None, _SYMBOLS))
        distinct = len(set(words))
        lengths = list(map(len, words))
        before = seen.get(line, 0)
        seen[line] = before + 1
        rows.append((
            0.0,
            math.log1p(k),
            math.log1p(n),
            sum(lengths) / k,
            max(lengths) / 50.0,
            distinct / k,
            math.log(k / distinct),
            upper / n,
            min(upper / k, 5.0),
            digits / n,
            stops / k,
            symbols / n,
            min(symbols / k, 5.0),
            sum(1 for m in lengths if m <= 3) / k,
            math.log1p(before),
        ))
    return np.array(rows, "f4"), np.array([len(line) + 1 for line in lines], "f8")


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """A line's features, the previous line's and the next one's, and marks of the text's two ends."""
    none = np.zeros((1, x.shape[1]), x.dtype)
    ends = np.zeros((len(x), 2), x.dtype)
    ends[0, 0] = ends[-1, 1] = 1
    return np.concatenate([x, np.concatenate([none, x[:-1]]), np.concatenate([x[1:], none]), ends, np.ones((len(x), 1), x.dtype)], axis=1)


INPUTS = 3 * FEATURES + 3


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of sequences of like length, so that padding at most doubles the work."""
    size = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for s in np.unique(size):
        found = np.flatnonzero(size == s)
        per = max(1, (1 << 18) >> int(s))
        for k in range(0, len(found), per):
            yield found[k : k + per]


def forward_backward(unary: np.ndarray, mask: np.ndarray, trans: np.ndarray):
    """(marginal of state 1: docs x lines, pair marginals summed over lines: docs x 2 x 2, log Z).

    ``unary`` is the log-odds of state 1 by line, ``mask`` marks real lines, ``trans`` scores pairs.
    """
    n, length = unary.shape
    alpha = np.zeros((length, n, 2))
    beta = np.zeros((length, n, 2))
    alpha[0, :, 1] = unary[:, 0]
    for t in range(1, length):
        step = np.logaddexp(alpha[t - 1, :, :1] + trans[0], alpha[t - 1, :, 1:] + trans[1])
        step[:, 1] += unary[:, t]
        alpha[t] = np.where(mask[:, t, None], step, alpha[t - 1])
    for t in range(length - 2, -1, -1):
        after = beta[t + 1].copy()
        after[:, 1] += unary[:, t + 1]
        step = np.logaddexp(after[:, :1] + trans[:, 0], after[:, 1:] + trans[:, 1])
        beta[t] = np.where(mask[:, t + 1, None], step, beta[t + 1])
    log_z = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
    joint = alpha + beta
    marginal = np.exp(joint[:, :, 1] - log_z).T
    pairs = np.zeros((n, 2, 2))
    if length > 1:
        after = beta[1:].copy()
        after[:, :, 1] += unary.T[1:]
        real = mask.T[1:]
        for a in (0, 1):
            for b in (0, 1):
                pairs[:, a, b] = np.where(real, np.exp(alpha[:-1, :, a] + trans[a, b] + after[:, :, b] - log_z), 0).sum(axis=0)
    return marginal, pairs, log_z


@dataclass
class Field:
    """A fitted field: feature scaling, weights, pair scores, and the curve from average to score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def averages(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean over each document's lines of the marginal of being good."""
        lengths = np.array([len(x) for x, _ in docs])
        out = np.zeros(len(docs))
        for group in _groups(lengths):
            width = int(lengths[group].max())
            unary, mask, weight = np.zeros((len(group), width)), np.zeros((len(group), width), bool), np.zeros((len(group), width))
            for row, k in enumerate(group):
                x, n = docs[k]
                unary[row, : len(x)] = with_neighbours((x - self.mean) / self.scale) @ self.weights
                mask[row, : len(x)] = True
                weight[row, : len(x)] = n
            marginal, _, _ = forward_backward(unary, mask, self.trans)
            out[group] = (marginal * weight).sum(axis=1) / weight.sum(axis=1)
        return out

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.averages(docs) - 0.5) + self.shift, -30, 30)))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Field:
    """Maximum likelihood with every line carrying its document's label; without both classes, 0.5."""
    if not len(labels) or labels.min() == labels.max():
        prior = float(labels[0]) if len(labels) else 0.5
        return Field(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(INPUTS), np.zeros((2, 2)), 0.0, (prior - 0.5) * 8)
    flat = np.concatenate([x for x, _ in docs]).astype("f8")
    field = Field(flat.mean(axis=0), np.maximum(flat.std(axis=0), 1e-3), np.zeros(INPUTS), np.zeros((2, 2)))
    lengths = np.array([len(x) for x, _ in docs])
    prepared = []
    for group in _groups(lengths):
        width = int(lengths[group].max())
        x = np.zeros((len(group), width, INPUTS))
        mask = np.zeros((len(group), width), bool)
        for row, k in enumerate(group):
            x[row, : lengths[k]] = with_neighbours((docs[k][0] - field.mean) / field.scale)
            mask[row, : lengths[k]] = True
        y = labels[group].astype(float)
        # Each document counts once, however many lines it has.
        share = 1.0 / lengths[group]
        observed = np.zeros((len(group), 2, 2))
        observed[np.arange(len(group)), labels[group], labels[group]] = lengths[group] - 1
        prepared.append((x, mask, y, share, observed))
    theta = np.zeros(INPUTS + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, trans = theta[:INPUTS], theta[INPUTS:].reshape(2, 2)
        grad = -DECAY * theta * len(docs)
        for x, mask, y, share, observed in prepared:
            marginal, pairs, _ = forward_backward(np.where(mask, x @ w, 0), mask, trans)
            gap = np.where(mask, y[:, None] - marginal, 0) * share[:, None]
            grad[:INPUTS] += np.einsum("nt,ntf->f", gap, x)
            grad[INPUTS:] += ((observed - pairs) * share[:, None, None]).sum(axis=0).ravel()
        grad /= len(docs)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field.weights, field.trans = theta[:INPUTS], theta[INPUTS:].reshape(2, 2)
    z, y = field.averages(docs) - 0.5, labels.astype(float)
    a, b = 4.0, 0.0
    for _ in range(50):  # Newton steps of the two-parameter logistic curve
        p = 1 / (1 + np.exp(-(a * z + b)))
        r = p * (1 - p) + 1e-9
        g = np.array([((y - p) * z).sum() - 0.01 * a, (y - p).sum()])
        h = np.array([[(r * z * z).sum() + 0.01, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-9]])
        d = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + d[0], b + d[1]
    field.slope, field.shift = float(a), float(b)
    return field


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit on labelled documents whose id remainder mod 3 is not 1, the TRAIN_DOCS of smallest id hash.

    Reads doc_id and text of ``docs``, doc_id and quality of ``labels``. Labels other than 0 and 1,
    null ids and documents of over TRAIN_LINES lines take no part; of repeated labels the least does.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), 3) != 1))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = texts(docs)
    lines = F.length("text") - F.length(F.regexp_replace("text", "\n", "")) + 1
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = known.join(ids, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    # TRAIN_DOCS rows at most: small enough to send to every executor.
    sample = rows.join(F.broadcast(chosen), "doc_id").where(lines <= TRAIN_LINES)
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [line_features(t) for t in b.column("text").to_pylist()]
            yield batch(schema, b.column("doc_id"), b.column("quality"), [x.tobytes() for x, _ in found], [n.tobytes() for _, n in found])

    got = map_batches(sample.select("doc_id", F.col("quality").cast("int").alias("quality"), "text"), run, "doc_id long, quality int, x binary, n binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    return fit([(np.frombuffer(r.x, "f4").reshape(-1, FEATURES), np.frombuffer(r.n, "f8")) for r in got], np.array([r.quality for r in got], int))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id long, score double) of every whole text; null and empty texts are one empty line."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, b.column("doc_id"), field.scores([line_features(t) for t in b.column("text").to_pylist()]))

    return map_batches(texts(docs), run, "doc_id long, score double")


def keep_good(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores 0.5 or more."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            yield pa.array(field.scores([line_features(t or "") for t in c.to_pylist()]), pa.float64())

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidied(run)(columns)

    bound_batches(docs.sparkSession)
    return docs.where(scored("text") >= 0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
