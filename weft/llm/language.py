"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import as_bytes, map_batches, worker_cache
from weft.session import freeze

UNKNOWN = "und"
# The bounded sample that the centroids are fitted on: documents of each language.
SAMPLE = 256
MAX_LANGUAGES = 1000
CENTROIDS = 3
ROUNDS = 12
# n-grams of one to three letters, hashed into so many features.
FEATURES = 1 << 14
LETTERS = 3
# A text further from its centroid than this share of the centroid's own members is rejected.
QUANTILE = 0.995
MARGIN = 1.25
ROWS = 64


def _letter_table() -> np.ndarray:
    """Number of each code point: its lower case for letters, 0 for all else."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def _mix(codes: np.ndarray) -> np.ndarray:
    """Features of 64-bit codes; the constant is the odd one of the golden ratio."""
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64)


def features(text: bytes) -> np.ndarray | None:
    """Hashed counts of the letter n-grams of a whole text; None without letters.

    Runs of other characters count as one word end. n-grams reach into a word end and
    not beyond.
    """
    letters = worker_cache("letters", _letter_table)
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    mapped = letters[points]
    known = mapped != 0
    if not known.any():
        return None
    keep = known.copy()
    keep[1:] |= known[:-1]
    # A word end before the first letter and after the last.
    run = np.concatenate(([0], mapped[keep], [0])).astype(np.uint64)
    counts = np.bincount(_mix(run[run != 0]), minlength=FEATURES)
    for n in range(2, LETTERS + 1):
        code = run[: len(run) - n + 1]
        inside = np.ones(len(code), bool)
        for k in range(1, n):
            nxt = run[k : len(run) - n + 1 + k]
            if k < n - 1:
                inside &= nxt != 0
            code = (code << np.uint64(21)) | nxt
        inside &= code != 0
        counts += np.bincount(_mix(code[inside] + np.uint64(n)), minlength=FEATURES)
    return counts


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as TF-IDF vectors of length 1."""
    rows = np.log1p(counts, dtype=np.float32) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) if t else None for t in as_bytes(batch["text"])]
        keep = [i for i, f in enumerate(found) if f is not None]
        if keep:
            blobs = [found[i].astype(np.uint32).tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays(
                [batch["lang"].take(pa.array(keep)), pa.array(blobs, pa.binary())], names=["lang", "counts"]
            )


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for blob in batch["counts"].to_pylist():
            total += np.frombuffer(blob, np.uint32) > 0
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "seen"])


def cluster(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means: the first centre is the mean, each next the row furthest from all."""
    centres = rows.mean(axis=0, keepdims=True)
    centres /= np.linalg.norm(centres)
    while len(centres) < min(k, len(rows)):
        near = (rows @ centres.T).max(axis=1)
        centres = np.concatenate([centres, rows[[int(np.argmin(near))]]])
    for _ in range(rounds):
        nearest = np.argmax(rows @ centres.T, axis=1)
        moved = [rows[nearest == c].mean(axis=0) for c in range(len(centres)) if (nearest == c).any()]
        centres = np.stack(moved)
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return centres


def _fit(idf: np.ndarray):
    def fit(rows: pa.Table) -> pa.Table:
        counts = np.stack([np.frombuffer(b, np.uint32) for b in rows["counts"].to_pylist()])
        order = np.lexsort(counts[:, :8].T)  # not the order of arrival
        vectors = weigh(counts[order], idf)
        centres = cluster(vectors, CENTROIDS, ROUNDS)
        near = vectors @ centres.T
        nearest = np.argmax(near, axis=1)
        radii = [float(np.quantile(1 - near[nearest == c, c], QUANTILE)) if (nearest == c).any() else 0.0 for c in range(len(centres))]
        lang = rows["lang"][0].as_py()
        return pa.table(
            {
                "lang": [lang] * len(centres),
                "radius": radii,
                "centre": pa.array([c.astype(np.float32).tobytes() for c in centres], pa.binary()),
            }
        )

    return fit


class Model:
    """Centroids with their languages and radii, and the weights of the features."""

    def __init__(self, langs: list[str], centres: np.ndarray, radii: np.ndarray, idf: np.ndarray):
        self.langs, self.centres, self.radii, self.idf = langs, centres, radii, idf

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine and rejection of each text."""
        langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if not self.langs:
            return langs, scores, rejected
        counted = [(i, f) for i, t in enumerate(texts) if t and (f := features(t)) is not None]
        for at in range(0, len(counted), ROWS):
            part = counted[at : at + ROWS]
            near = weigh(np.stack([f for _, f in part]), self.idf) @ self.centres.T
            best = np.argmax(near, axis=1)
            for (i, _), c, row in zip(part, best, near):
                langs[i] = self.langs[c]
                scores[i] = float(min(1.0, max(0.0, row[c])))
                rejected[i] = bool(1 - row[c] > MARGIN * self.radii[c])
        return langs, scores, rejected


def fit(docs: DataFrame, labelled: Column, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Centroids of every language, from up to ``sample`` documents of each.

    The sample is drawn by a hash of the id among rows where ``labelled`` holds and ``lang``
    is given; the idf weights and radii are those of the sample. Texts without letters
    teach nothing. Without any labelled text the model is empty. More than MAX_LANGUAGES
    languages are an error, as the model is broadcast.
    """
    from pyspark.sql import Window

    drawn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = (
        docs.filter(labelled & F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(id).alias("doc_id"), F.col(lang).alias("lang"))
        .withColumn("n", drawn).filter(F.col("n") <= sample).select("doc_id", "lang").distinct()
    )
    names = chosen.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if names > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = docs.filter(labelled).select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    # At most sample x MAX_LANGUAGES keys of a few bytes; the counts are 64 KB a row.
    counted = freeze(
        map_batches(rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("text", "lang"), _count, "lang string, counts binary")
    )
    seen, n = np.zeros(FEATURES, np.int64), 0
    for row in counted.mapInArrow(_documents_with, "n long, seen binary").toLocalIterator():
        seen += np.frombuffer(row.seen, np.int64)
        n += row.n
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    fitted = counted.groupBy("lang").applyInArrow(_fit(idf), "lang string, radius double, centre binary").collect()
    fitted.sort(key=lambda r: (r.lang, r.centre))
    centres = np.stack([np.frombuffer(r.centre, np.float32) for r in fitted]) if fitted else np.zeros((0, FEATURES), np.float32)
    return Model([r.lang for r in fitted], centres, np.array([r.radius for r in fitted]), idf)


def _predict(sent):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            langs, scores, rejected = model.predict(as_bytes(batch["text"]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return predict


def identify(docs: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row.

    The centroids are fitted on a sample of the rows that are not held out (``fit``). A text
    gets the language of the nearest centroid by the cosine of TF-IDF vectors over its
    letter n-grams; the score is that cosine. ``rejected``: it lies further from the
    centroid than nearly all texts the centroid was made from, so the language is a guess;
    callers that want no guesses take ``und`` there.

    A null, empty or letterless text is ``und``, score 0, rejected; so is every text when
    nothing is labelled. A null id is hashed like any other value; repeated rows get equal
    answers; an empty table gives no rows. Other columns are not read.
    """
    out = F.coalesce(held_out, F.lit(False))
    model = fit(docs, ~out, id, text, lang, sample)
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.centres, model.radii, model.idf))
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), out.alias("held_out"))
    return map_batches(
        rows.select("doc_id", "text", "held_out"), _predict(sent),
        "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean",
    )
