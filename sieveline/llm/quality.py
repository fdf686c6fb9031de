"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x), with one weight vector w for all grades and ordered thresholds.
x holds the hashed words of a text (each once) and a few hashed marks of its form: repeated words, trailing
symbols, share of distinct words. The score gives each document its expected grade and the probability of a
grade at or above a cut, by which documents are selected.

The model is fitted on at most about ``sample`` rated documents, taken evenly by a hash of their id; ratings
beyond that bound don't enter. Every document is scored, whole.

Null and empty texts have no features; they get the grade of the thresholds alone, and are not kept. Null
grades, and ratings of unknown documents, are ignored; a document rated more than once takes its lowest grade.
Without ratings of two grades there is nothing to learn: all scores are those of the only grade, and all
documents with text are kept. Repeated documents each get their row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import lower_space_words

BITS, SAMPLE, RIDGE, TOLERANCE = 18, 12_000, 7e-4, 1e-5
#: Features that one step of the fit takes, about.
BLOCK = 1 << 18


class Features(dict):
    """Feature numbers of words, remembered up to a bound: that of the word, that of its first letters, and whether it ends in an odd symbol."""

    BOUND = 1 << 19
    HEAD = 5

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def number(self, name: bytes) -> int:
        return zlib.crc32(name) * 0x9E3779B1 >> 13 & self.mask

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        core = word.rstrip(b".,;:!?")
        odd = not word[-1:].isalnum() and word[-1] < 128 and core == word
        value = self[word] = self.number(b"w:" + core) | self.number(b"h:" + core[: self.HEAD]) << 30 | odd << 60
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = lower_space_words(text)
        if not words:
            return np.zeros(0, np.int64)
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        distinct = np.unique(both)
        n = len(words)
        marks = [b"distinct:%d" % (10 * len(distinct) // n), b"size:%d" % n.bit_length(), b"symbols:%d" % (10 * int((both >> 60).sum()) // n)]
        marks.append(b"repeats:%d" % (10 * int((both[1:] == both[:-1]).sum()) // n))
        return np.concatenate([np.unique(np.concatenate([distinct & self.mask, distinct >> 30 & self.mask])), [self.number(m) for m in marks]])


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all k but the last."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def judge(self, score: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of a grade of cut or more."""
        below = self.at_most(score)
        return (1 - below).sum(axis=1), 1 - below[:, cut - 1] if 0 < cut <= below.shape[1] else np.full(len(score), float(cut <= 0))


def descend(value, x: np.ndarray, tolerance: float = TOLERANCE, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS on value(x) -> (f, gradient), until no component of the gradient exceeds the tolerance, or f can't be lowered in floating point."""
    f, g = value(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while np.abs(g).max() > tolerance:
        d, by = g.copy(), []
        for s, y in reversed(steps):
            by.append(s @ d / (s @ y))
            d -= by[-1] * y
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(by), strict=True):
            d += (a - y @ d / (s @ y)) * s
        slope, step = -(d @ g), 1.0 if steps else min(1.0, 1 / np.abs(g).sum())
        if slope >= 0:  # the memory misleads
            if not steps:
                break
            steps.clear()
            continue
        while True:
            new_f, new_g = value(new := x - step * d)
            if new_f <= f + 1e-4 * step * slope:
                break
            step /= 2
            if step < 1e-12:
                break
        if step < 1e-12:
            if not steps:
                break
            steps.clear()
            continue
        if (new - x) @ (new_g - g) > 1e-14:
            steps = [*steps, (new - x, new_g - g)][-memory:]
        x, f, g = new, new_f, new_g
    return x


def train(ids: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int = BITS, ridge: float = RIDGE) -> OrdinalModel:
    """Maximum penalised likelihood, fitted until it converges; thresholds stay ordered through positive steps between them."""
    sizes = np.array([len(x) for x in ids])
    held = np.zeros(1 << bits, bool)
    for x in ids:
        held[x] = True
    known, place = np.flatnonzero(held), np.cumsum(held, dtype=np.int32) - 1
    flat = np.concatenate([place[x] for x in ids])
    # runs of documents, so that only the features themselves are held for all at once
    ends = np.cumsum(sizes)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(BLOCK, ends[-1], BLOCK)), [len(ids)]]))
    blocks = [(a, b, ends[a] - sizes[a], ends[b - 1]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    share = np.bincount(grades, minlength=n_grades) / len(grades)
    cumulative = np.clip(np.cumsum(share)[:-1], 0.01, 0.99)
    thresholds = np.maximum.accumulate(np.log(cumulative / (1 - cumulative)) + 1e-3 * np.arange(n_grades - 1))
    d = len(known)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    rows = np.arange(len(grades))

    def ordered(x: np.ndarray) -> np.ndarray:
        return x[d] + np.concatenate([[0.0], np.cumsum(np.exp(x[d + 1 :]))])

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean negative log-likelihood with the ridge, and its gradient."""
        score = np.concatenate([np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), x[flat[low:high]], minlength=b - a) for a, b, low, high in blocks])
        edges = np.concatenate([[-np.inf], ordered(x), [np.inf]])
        up, low = sigmoid(edges[grades + 1] - score), sigmoid(edges[grades] - score)
        up[grades == n_grades - 1], low[grades == 0] = 1.0, 0.0
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p  # d log p by the upper and lower edge
        g = np.empty_like(x)
        each = (du - dl) / len(ids)
        g[:d] = ridge * x[:d]
        for a, b, low, high in blocks:
            g[:d] += np.bincount(flat[low:high], np.repeat(each[a:b], sizes[a:b]), minlength=d)
        by_edge = np.zeros((len(ids), n_grades - 1))
        inner = grades < n_grades - 1
        by_edge[rows[inner], grades[inner]] += du[inner]
        inner = grades > 0
        by_edge[rows[inner], grades[inner] - 1] -= dl[inner]
        edge = -by_edge.mean(axis=0)
        g[d] = edge.sum()
        g[d + 1 :] = np.exp(x[d + 1 :]) * np.cumsum(edge[::-1])[::-1][1:]
        return float(-np.log(p).mean() + ridge / 2 * (x[:d] @ x[:d])), g

    x = descend(value, np.concatenate([np.zeros(d), [thresholds[0]], np.log(np.maximum(np.diff(thresholds), 1e-2))]))
    weights = np.zeros(1 << bits, np.float32)
    weights[known] = x[:d]
    return OrdinalModel(weights, ordered(x), bits)


def fit(documents: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", n_grades: int = 3, sample: int = SAMPLE, bits: int = BITS) -> OrdinalModel | None:
    """Learns from ratings (doc_id, grade from 0 to n_grades - 1); None if there are not two grades."""
    rated = ratings.where(F.col(doc_id).isNotNull() & F.col(grade).isNotNull()).groupBy(doc_id).agg(F.min(grade).cast("int").alias("__grade"))
    n = rated.count()
    if n > sample:  # a share by hash, so that no sort over all ratings is needed
        rated = rated.where(F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    chosen = documents.select(doc_id, text).join(F.broadcast(rated) if n <= 4 * sample else rated, doc_id).select("__grade", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features.of(x) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["grade", "ids"])

    got = chosen.mapInArrow(run, "grade int, ids array<int>").toArrow()
    grades = got.column("grade").to_numpy().astype(np.int64)
    if len(set(grades.tolist())) < 2:
        return None
    values = got.column("ids").combine_chunks()
    del got
    offsets, flat = values.offsets.to_numpy(), values.values.to_numpy()
    order = np.lexsort((np.diff(offsets), grades))  # sums don't depend on the order in which tasks ended
    return train([flat[offsets[i] : offsets[i + 1]] for i in order], grades[order], n_grades, bits)


def score(documents: DataFrame, model: OrdinalModel | None, text: str = "text", cut: int = 2, least: float = 0.5) -> DataFrame:
    """Adds expected_grade, p_tail (probability of a grade of cut or more) and keep to documents."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    plain = documents.select(*[c for c in documents.columns if c not in ("expected_grade", "p_tail", "keep")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        features = Features(own.bits if own else 1)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            if own is None:
                scores = np.array([float(bool(lower_space_words(x))) for x in texts])
                grade = tail = scores
            else:
                ids = [features.of(x) for x in texts]
                scores = np.array([own.weights[x].sum(dtype=np.float64) for x in ids])
                grade, tail = own.judge(scores, cut)
            keep = (tail >= least) & np.array([bool(x and x.strip()) for x in texts], bool)
            columns = {c: batch.column(c) for c in batch.schema.names}
            columns |= {"expected_grade": pa.array(grade, pa.float64()), "p_tail": pa.array(tail, pa.float64()), "keep": pa.array(keep)}
            yield pa.RecordBatch.from_pydict(columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, expected_grade double, p_tail double, keep boolean")


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """Grades from the two labels: 0 toxic, 1 of low quality, 2 good; null where neither says."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))
