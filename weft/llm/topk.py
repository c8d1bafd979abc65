"""Exact top-k search by term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import map_batches

SCALE = 1024
# Candidates in a block: with 64 terms, 2 MB of postings; its score rows take 32 KB a query.
BLOCK = 4096
QUERY_BLOCK = 512

_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null for a vector that takes no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(
        wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return F.when(
        vector.isNotNull() & ~odd, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    )


def _packed(rows: DataFrame, block_rows: int, total: int) -> DataFrame:
    """``block, ids, lengths, parts``: rows gathered in blocks of about ``block_rows``."""
    blocks = max(1, -(-total // block_rows))
    return (
        rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "ints"), F.lit(blocks)).cast("int"))
        .groupBy("block")
        .agg(F.collect_list(F.struct("vec_id", "ints")).alias("rows"))
        .select("block", F.col("rows.vec_id").alias("ids"), F.col("rows.ints").alias("ints"))
    )


def _matrix(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Rows of any lengths: the matrix, padded by zeros."""
    lists = rows.values
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _scan(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch["ids"][i].values.to_numpy()
                postings = _matrix(batch["ints"][i])
                terms = [
                    (at, postings[at, d]) for d in range(postings.shape[1]) for at in [np.flatnonzero(postings[:, d])]
                ]
                found = ([], [], [])
                for query, weights in zip(batch["q_ids"][i].values.to_numpy(), _matrix(batch["q_ints"][i])):
                    scores = np.zeros(len(ids), np.int64)
                    for d in np.flatnonzero(weights[: len(terms)]):
                        at, posted = terms[d]
                        if len(at) == len(scores):
                            scores += weights[d] * posted
                        else:
                            scores[at] += weights[d] * posted
                    own = np.flatnonzero(ids != query)
                    if len(own) > k:
                        # All that reach the k-th score, so that ties are settled by id.
                        least = np.partition(scores[own], len(own) - k)[len(own) - k]
                        own = own[scores[own] >= least]
                    own = own[np.lexsort((ids[own], -scores[own]))[:k]]
                    found[0].append(np.full(len(own), query, np.int64))
                    found[1].append(ids[own])
                    found[2].append(scores[own])
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], schema=_HITS)

    return scan


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of every query.

    Every component becomes floor(scale * x). Each block of candidates holds a postings list
    per term (component); a query scatters its weighted postings into the block's dense
    scores, the block's best k are selected by partition, and the blocks' results are merged.
    Queries come in blocks too, so a task holds one block of each whatever the table's size.

    Rows without id, without vector, or with a component that is null, NaN or infinite take
    no part. Vectors of other lengths count as padded by zeros; an empty vector scores 0. A
    query's own row is every row of its id; rows repeated with one id are each candidates of
    the others, and a query that is repeated is asked once a distinct vector. Ties go to the
    smaller id. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id).cast("bigint").alias("vec_id"), integers(F.col(vector), scale).alias("ints"), is_query.alias("asked"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("ints").isNotNull())
    asked = rows.filter("asked").select("vec_id", "ints").distinct()
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q")).first()
    candidates = _packed(rows.select("vec_id", "ints"), BLOCK, sizes.n)
    queries = _packed(asked, QUERY_BLOCK, sizes.q).select(
        F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("ints").alias("q_ints")
    )
    blocks = max(1, -(-sizes.q // QUERY_BLOCK))
    pairs = candidates.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(queries, "q")
    hits = map_batches(
        pairs.select("ids", "ints", "q_ids", "q_ints"), _scan(k), "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
