"""Document quality by a regularised quadratic discriminant over transformed text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import as_bytes, map_batches
from weft.llm.quality import CONTINUATION, SPACE, SYMBOLS, repeated_words
from weft.operators.skew import join_unique
from weft.session import freeze

FOLDS = 3
# Shares of the pooled covariance in a class's own, and of the scaled identity in the sum.
POOLED = (0.0, 0.1, 0.3, 0.7)
SPHERE = (0.001, 0.01, 0.1)
# Factors on the difference of the log densities: statistics are only roughly normal.
FACTORS = (1.0, 0.5, 0.25, 0.1)

UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes(range(ord("a"), ord("z") + 1))
DIGITS = b"0123456789"
CALLS = b"!?"
STOPS = b".,;:"
SHORT_WORD = 3

STATISTICS = (
    "bytes", "words", "word_length", "word_spread", "short_words", "distinct_words", "top_word", "ended_words",
    "line_words", "repeated_lines", "repeated_windows", "upper", "symbols", "calls", "stops", "digits",
)


def _share(part: float, whole: float) -> float:
    """A share as an angle, which spreads shares near 0 and 1."""
    return float(np.arcsin(np.sqrt(min(1.0, part / whole)))) if whole else 0.0


def statistics(text: bytes | None) -> list[float]:
    """The transformed STATISTICS of a whole text: counts as logarithms, shares as angles.

    A null text counts as empty, which has zeros. Memory is about ten times the text.
    """
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [float(np.log1p(len(text)))] + [0.0] * (len(STATISTICS) - 1)

    def without(marks: bytes) -> int:
        return len(text) - len(text.translate(None, marks))

    lengths = np.fromiter(map(len, words), np.int64, n)
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lines = [line for line in text.split(b"\n") if line.strip()]
    solid = len(text.translate(None, SPACE))
    upper, lower = without(UPPER), without(LOWER)
    ended = sum(not (w[-1] >= 0x80 or w[-1:].isalnum()) for w in words)
    return [
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        float(np.log((solid - without(CONTINUATION)) / n)),
        float(np.log1p(lengths.std())),
        _share(int((lengths <= SHORT_WORD).sum()), n),
        _share(len(counts), n),
        _share(max(counts.values()), n),
        _share(ended, n),
        float(np.log(n / len(lines))),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(repeated_words(words), n),
        _share(upper, upper + lower),
        _share(without(SYMBOLS), solid),
        _share(without(CALLS), solid),
        _share(without(STOPS), solid),
        _share(without(DIGITS), solid),
    ]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [np.array(statistics(t)).tobytes() for t in as_bytes(batch["text"])]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["held_out"], pa.array(blobs, pa.binary())], names=["doc_id", "held_out", "x"]
        )


def describe(docs: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, x``: the statistics of every row, 128 bytes each. No shuffle."""
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    return map_batches(rows, _describe, "doc_id long, held_out boolean, x binary")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch["x"].to_pylist()), np.float64).reshape(batch.num_rows, -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per fold and class: weight, sums and sums of products, as one row of numbers each."""
    p = len(STATISTICS)
    total = np.zeros((FOLDS, 2, 1 + p + p * p))
    for batch in batches:
        if not batch.num_rows:
            continue
        x, fold = _matrix(batch), batch["fold"].to_numpy()
        for k, name in enumerate(("n0", "n1")):
            weight = batch[name].to_numpy().astype(float)
            for f in range(FOLDS):
                w = np.where(fold == f, weight, 0.0)
                total[f, k] += np.concatenate(([w.sum()], w @ x, ((x * w[:, None]).T @ x).ravel()))
    rows = [(f, k, total[f, k].tolist()) for f in range(FOLDS) for k in range(2)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.list_(pa.float64())))],
        names=["fold", "class", "sums"],
    )


class Discriminant:
    """Two normal densities with shrunken covariances, by their Cholesky factors.

    ``moments`` holds weight, sums and products of class 0 and 1. Statistics are scaled to
    variance 1 over both classes; a class's covariance is mixed with the pooled one by
    ``pooled``, then with a multiple of the identity by ``sphere``. With a class missing
    the score is the smoothed share of label 1.
    """

    def __init__(self, moments: np.ndarray, pooled: float, sphere: float, factor: float = 1.0):
        n = moments[:, 0]
        self.factor = factor
        self.share = float((n[1] + 1) / (n.sum() + 2))
        self.classes = []
        if (n <= 0).any():
            return
        p = len(STATISTICS)
        means = moments[:, 1 : 1 + p] / n[:, None]
        products = moments[:, 1 + p :].reshape(2, p, p)
        own = [products[k] / n[k] - np.outer(means[k], means[k]) for k in range(2)]
        self.centre = (n @ means) / n.sum()
        within = (n[0] * own[0] + n[1] * own[1]) / n.sum()
        spread = within + sum(n[k] / n.sum() * np.outer(d, d) for k in range(2) for d in [means[k] - self.centre])
        self.scale = 1 / np.sqrt(np.maximum(np.diag(spread), 1e-9))
        within = within * np.outer(self.scale, self.scale)
        for k in range(2):
            mixed = (1 - pooled) * own[k] * np.outer(self.scale, self.scale) + pooled * within
            mixed = (1 - sphere) * mixed + sphere * max(np.trace(mixed) / p, 1e-6) * np.eye(p)
            lower = np.linalg.cholesky(mixed)
            # The factor is inverted once here; a density is then one product.
            offset = float(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())
            self.classes.append(((means[k] - self.centre) * self.scale, np.linalg.inv(lower).T, offset))

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log density and prior of label 1 less those of label 0."""
        if not self.classes:
            return np.full(len(x), np.log(self.share / (1 - self.share)))
        z = (x - self.centre) * self.scale
        sides = [offset - 0.5 * (((z - mean) @ inverse) ** 2).sum(axis=1) for mean, inverse, offset in self.classes]
        return sides[1] - sides[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = self.margins(x) * (self.factor if self.classes else 1.0)
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def _losses(models):
    """Summed log loss of every candidate model over the rows of the fold that it was not fitted on."""

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models[0]), len(FACTORS)))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, fold = _matrix(batch), batch["fold"].to_numpy()
            n0, n1 = (batch[c].to_numpy().astype(float) for c in ("n0", "n1"))
            for f in range(FOLDS):
                at = fold == f
                for m, model in enumerate(models[f]):
                    margin = model.margins(x[at])
                    for c, factor in enumerate(FACTORS):
                        t = margin * factor
                        total[m, c] += (n1[at] * np.logaddexp(0, -t) + n0[at] * np.logaddexp(0, t)).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    return losses


def _summed(rows: DataFrame, *keys: str) -> dict:
    """{keys: sums}: arrays added up place by place, in the tasks first."""
    placed = rows.select(*keys, F.posexplode("sums").alias("place", "value"))
    out: dict[tuple, list] = {}
    # As many rows as there are numbers in one array, times the few keys.
    for row in placed.groupBy(*keys, "place").agg(F.sum("value").alias("value")).collect():
        out.setdefault(tuple(row[k] for k in keys), []).append((row["place"], row["value"]))
    return {k: np.array([v for _, v in sorted(pairs)]) for k, pairs in out.items()}


def fit(described: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality") -> Discriminant:
    """The discriminant of all labelled rows of ``described`` that are not held out.

    A label row with 0 or 1 counts once for each row of its id; other labels and null ids
    teach nothing. Only sums reach the driver. The two shrinkages and the factor have the
    smallest log loss over FOLDS folds by id, each scored by a model of the others.
    """
    per_id = (
        labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull())
        .groupBy(F.col(id).cast("bigint").alias("doc_id"))
        .agg(F.sum((F.col(label) == 0).cast("bigint")).alias("n0"), F.sum((F.col(label) == 1).cast("bigint")).alias("n1"))
    )
    rows = described.filter("NOT held_out").select("doc_id", "x").withColumn(
        "fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    )
    taught = freeze(join_unique(rows, per_id, "doc_id", ["x"], "inner").select("fold", "n0", "n1", "x"))
    p = len(STATISTICS)
    moments = np.zeros((FOLDS, 2, 1 + p + p * p))
    for (f, k), sums in _summed(taught.mapInArrow(_moments, "fold int, class int, sums array<double>"), "fold", "class").items():
        moments[f, k] = sums
    whole = moments.sum(axis=0)
    choices = list(product(POOLED, SPHERE))
    models = [[Discriminant(whole - moments[f], *choice) for choice in choices] for f in range(FOLDS)]
    losses = _summed(taught.mapInArrow(_losses(models), "sums array<double>")).get((), np.zeros(len(choices) * len(FACTORS)))
    best, factor = divmod(int(np.argmin(losses)), len(FACTORS))
    return Discriminant(whole, *choices[best], FACTORS[factor])


def _score(model: Discriminant):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = model.scores(_matrix(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["held_out"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return score


def assess(docs: DataFrame, labels: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    The statistics of a whole text are taken once and written below the checkpoint folder;
    the model (two means and Cholesky factors) is fitted on the labelled rows that are not
    held out, and travels with the function. The score rises with the likelihood of label 1;
    ``predicted`` is 1 from 0.5 on.

    A null or empty text is scored by its zeros; a null id is never held out and teaches
    nothing; repeated rows get equal scores; an empty table gives no rows. Without labels of
    both values every score is the smoothed share of label 1. Other columns are not read.
    """
    described = freeze(describe(docs, F.coalesce(held_out, F.lit(False)), id, text))
    model = fit(described, labels, id, label)
    return described.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
