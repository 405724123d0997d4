"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A text becomes a vector of document statistics.  Random Fourier features
approximate a Gaussian kernel over the standardised statistics; every
partition sums its share of the normal equations, the shares are added in two
steps on Spark, and the driver solves one small system.  Isotonic regression
over the binned training scores turns raw scores into probabilities.

The fit reads at most ``max_rows`` labelled training rows (those with the
smallest hash of their doc_id), so the labels joined to the documents have a
proven size and are broadcast; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import claim, cut, documents, portions

#: Labelled rows that the fit reads at most.
MAX_ROWS = 20_000
#: Random features, kernel width in standard deviations per root of the number of statistics, ridge, bins, seed.
FEATURES, WIDTH, RIDGE, BINS, SEED = 192, 0.7, 1e-3, 512, 20240229
#: Shares of the normal equations are added in so many groups before the driver adds these.
GROUPS = 8

_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_UPPER, _DIGITS, _SPACE, _POINTS = bytes(range(65, 91)), b"0123456789", b" \t\n\r\x0b\x0c", b".,;:!?'\"-()"


def statistics(text: str) -> list[float]:
    """Statistics of one whole text; an empty one has zeros throughout."""
    if not text:
        return [0.0] * 20
    data = text.encode()
    size = len(data)
    words = data.split()
    n = len(words) or 1
    lines = [x for x in data.split(b"\n") if x]
    n_lines = len(lines) or 1
    without = lambda chars: 1 - len(data.translate(None, chars)) / size
    letters, digits, space, points = without(_LETTERS), without(_DIGITS), without(_SPACE), without(_POINTS)
    counts = Counter(words)
    most = counts.most_common(2) if counts else []
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    in_lines = np.fromiter((x.count(b" ") + 1 for x in lines), np.int32, len(lines)) if lines else np.zeros(1, np.int32)
    once = sum(1 for c in counts.values() if c == 1)
    return [
        math.log1p(size),
        math.log1p(n),
        float(lengths.mean()),
        float(lengths.std()),
        len(counts) / n,
        math.log(len(counts) + 1) / math.log(n + 1),
        once / n,
        most[0][1] / n if most else 0.0,
        (most[0][1] + most[-1][1]) / n if most else 0.0,
        letters,
        without(_UPPER),
        digits,
        points,
        max(0.0, 1 - letters - digits - space - points),
        data.count(b"|") / n,
        data.count(b".") / n,
        math.log1p(float(in_lines.mean())),
        1 - len(set(lines)) / n_lines,
        float((in_lines <= 3).mean()),
        float((lengths <= 3).mean()),
    ]


@dataclass
class Model:
    """What scoring needs: standardisation, frequencies, weights, calibration points."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return mapped(stats, self.mean, self.scale) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw order stays in, so that isotonic steps do not tie."""
        raw = self.raw(stats)
        return np.clip(0.999 * np.interp(raw, self.knots, self.values) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def mapped(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised, clipped statistics, with a constant."""
    z = np.clip((stats - mean) / scale, -4, 4)
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(z.shape[1], FEATURES)) / (WIDTH * math.sqrt(z.shape[1]))
    b = rng.uniform(0, 2 * math.pi, FEATURES)
    return np.hstack([math.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(z), 1))])


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(s, y) of at most ``max_rows`` labelled rows outside the held-out fold; a document labelled twice counts its mean."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    joined = documents(docs).join(F.broadcast(few), "doc_id").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([statistics(t) for (part,) in portions(batch["text"]) for t in part], pa.list_(pa.float64())), batch["y"]], names=["s", "y"])

    return cut(joined.mapInArrow(run, "s array<double>, y double"))


def _sums(rows: DataFrame, share) -> np.ndarray | None:
    """Adds ``share(stats, y)``, an array per partition, over all partitions in two steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = share(np.array(batch["s"].to_pylist(), np.float64), batch["y"].to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"g": pa.array([zlib.crc32(total.tobytes()) % GROUPS], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    def added(group: pa.Table) -> pa.Table:
        return pa.table({"v": pa.array([sum(np.frombuffer(v) for v in group["v"].to_pylist()).tobytes()], pa.binary())})

    found = rows.mapInArrow(run, "g int, v binary").groupBy("g").applyInArrow(added, "v binary").collect()
    return sum(np.frombuffer(r.v) for r in found) if found else None


def _isotonic(n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over weighted means."""
    blocks: list[list[float]] = []
    for weight, total in zip(n, y):
        blocks.append([weight, total, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, t, k = blocks.pop()
            blocks[-1][0] += w
            blocks[-1][1] += t
            blocks[-1][2] += k
    return np.concatenate([np.full(int(k), t / w) for w, t, k in blocks])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learn from labelled rows outside the held-out fold; without any, every score is one half."""
    rows = _training(docs, labels, max_rows)
    moments = _sums(rows, lambda s, y: np.concatenate([[len(y)], s.sum(axis=0), (s * s).sum(axis=0)]))
    if moments is None:
        d = len(statistics(""))
        return Model(np.zeros(d), np.ones(d), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    n, d = moments[0], (len(moments) - 1) // 2
    mean = moments[1 : d + 1] / n
    scale = np.sqrt(np.maximum(moments[d + 1 :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0

    def equations(s: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = mapped(s, mean, scale)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _sums(rows, equations)
    k = FEATURES + 1
    ridge = RIDGE * n * np.diag([1 / FEATURES] * FEATURES + [0.0]) + 1e-9 * n * np.eye(k)
    weights = np.linalg.solve(sums[: k * k].reshape(k, k) + ridge, sums[k * k :])

    def binned(s: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = mapped(s, mean, scale) @ weights
        at = np.clip(((raw + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, raw, BINS), np.bincount(at, y, BINS)]).astype(float)

    n_bin, raw_bin, y_bin = _sums(rows, binned).reshape(3, BINS)
    full = n_bin > 0
    knots = raw_bin[full] / n_bin[full]
    return Model(mean, scale, weights, knots, _isotonic(n_bin[full], y_bin[full]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (of any columns with ``text``) plus ``score``, from the whole text alone, in one pass.

    Null and empty texts are scored as empty.  A clashing ``score`` column is replaced.
    """

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim("quality")
        for texts in batches:
            stats = [statistics(t or "") for (part,) in portions(texts) for t in part]
            yield pa.array(model.scores(np.array(stats, np.float64)) if stats else [], pa.float64())

    # annotations are text here, so the kind of function is told to Spark by hand
    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("score", F.arrow_udf(score, "double")(F.col("text")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null texts are scored as empty ones, long ones whole.  Rows that repeat a
    doc_id are scored each by its own text, and each of them teaches if the id
    is labelled; rows without a doc_id are scored, not learned from, and not
    held out.  An empty table gives an empty one; without labels every score is
    near one half.  Other columns, whatever their names, play no part.
    """
    model = fit(docs, labels, max_rows)
    return scored(documents(docs), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, columns as they were, that the classifier does not reject.

    Null and empty texts are judged as empty, repeated rows each, rows without
    a doc_id like others; an empty table stays empty and clashing names are
    kept apart.
    """
    model = fit(docs, labels, max_rows)
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return scored(docs.select(held, F.col("text")), model).where(F.col("score") >= threshold).select("row.*")
