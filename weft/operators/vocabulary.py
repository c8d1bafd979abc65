"""Frequency vocabularies and dictionary encoding.

A vocabulary is a table ``id BIGINT, token STRING, cnt BIGINT`` (0 for tokens that were given
and not counted), most frequent first. Rows with a token meet a dictionary in an equi-join
whose frequent keys are cut into groups, so they never meet in one shuffle partition. Token
arrays are coded in chunks; only the distinct tokens of a chunk meet the dictionary. A
dictionary within a bound in bytes is broadcast, which saves the shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from weft.operators.ordering import ID_BITS, ranked, running_start
from weft.operators.skew import join_unique
from weft.session import freeze, spread

# Reserved tokens, in id order.
SPECIALS = ["<null>", "<s>", "</s>", "UNK"]
DECODER_SPECIALS = ["</s>", "<unk>"]
UNKNOWN = "UNK"

# Bytes of a dictionary that may be broadcast, and what an entry takes besides its text.
BROADCAST_BYTES = 32 << 20
ENTRY_BYTES = 48
# Bytes of the rows of a chunk, which a task holds with its distinct elements, and entries that it hands on at once.
CHUNK_BYTES = 32 << 20
CHUNK_ROWS = 10_000


def token_counts(tokens: DataFrame, *keys: str, token: str = "token") -> DataFrame:
    """``token, cnt`` (per extra key); counted in every task before the shuffle."""
    return tokens.groupBy(*keys, token).agg(F.count(F.lit(1)).alias("cnt"))


def frequent(counts: DataFrame, threshold: int = 10) -> DataFrame:
    """Tokens seen at least ``threshold`` times."""
    return counts.filter(F.col("cnt") >= threshold)


def _reserved(spark: SparkSession, specials: Sequence[str]) -> DataFrame:
    rows = [(i, token, 0) for i, token in enumerate(specials)]
    return spark.createDataFrame(rows, "id bigint, token string, cnt bigint")


def vocab_of_counts(counts: DataFrame, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """Vocabulary of tokens already counted (``token, cnt``)."""
    ids = ranked(counts.select("token", "cnt"), [F.col("cnt").desc(), F.col("token")], "__rank")
    learnt = ids.select((F.col("__rank") + len(specials)).alias("id"), "token", "cnt")
    return _reserved(counts.sparkSession, specials).unionByName(learnt)


def build_vocab(
    tokens: DataFrame,
    limit: int | None = None,
    specials: Sequence[str] = SPECIALS,
    order: Sequence[str] = (),
) -> DataFrame:
    """Vocabulary of a column ``token``: reserved tokens, then by (count down, token).

    ``limit`` counts the reserved tokens. Survivors are chosen by (count down, first
    occurrence) and only then sorted; ``order`` names the columns that say where in the
    corpus a token stands. A learnt token equal to a reserved one is kept as well, and
    ``lookup`` lets the later id win.
    """
    if limit is None:
        return vocab_of_counts(token_counts(tokens), specials)
    if limit < len(specials):
        raise ValueError(f"limit {limit} leaves no room for {len(specials)} reserved tokens")
    if not order:
        raise ValueError("a limit needs the columns of the corpus order")
    keep = limit - len(specials)
    # Counts and first places come from one pass; both combine before the shuffle.
    counts = freeze(
        tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct(*order)).alias("__first"))
    )
    cut, room = _cut(counts, keep)
    kept = counts.filter(F.col("cnt") > cut)
    if room:
        # Of the tokens with the count at the cut, those that come first.
        tied = ranked(counts.filter(F.col("cnt") == cut), [F.col("__first")], "__row").filter(F.col("__row") < room)
        kept = kept.unionByName(tied.select(*kept.columns))
    return vocab_of_counts(kept, specials)


def _cut(counts: DataFrame, keep: int) -> tuple[int, int]:
    """The largest count of which not all tokens fit into ``keep`` rows, and the rows left for them.

    From the histogram of the counts, whose rows grow with the root of the corpus at the
    most, by prefix sums. (0, 0) when everything fits.
    """
    histogram = freeze(counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("n")))
    total = histogram.agg(F.sum("n")).first()[0] or 0
    if total <= keep:
        return 0, 0
    above = F.lit(total) - F.col("__below") - F.col("n")
    below = running_start(histogram, "cnt", "n", "__below", ID_BITS).withColumn("__above", above)
    row = below.filter((F.col("__above") <= keep) & (F.col("__above") + F.col("n") > keep)).first()
    return row["cnt"], keep - row["__above"]


def set_vocab(tokens: DataFrame, order: str, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """Vocabulary from a list of unique tokens, in the order of column ``order``."""
    numbered = ranked(tokens.select("token", order), [F.col(order), F.col("token")], "__rank")
    return _reserved(tokens.sparkSession, specials).unionByName(
        numbered.select(
            (F.col("__rank") + len(specials)).alias("id"),
            "token",
            F.lit(0).cast("bigint").alias("cnt"),
        )
    )


def add_tokens(vocab: DataFrame, tokens: DataFrame, order: str) -> DataFrame:
    """Append the tokens that the vocabulary lacks, in the order of their first occurrence."""
    fresh = (
        tokens.groupBy("token").agg(F.min(order).alias(order)).join(vocab.select("token"), "token", "left_anti")
    )
    size = vocab.agg(F.count(F.lit(1))).scalar()
    numbered = ranked(fresh, [F.col(order), F.col("token")], "__rank")
    return vocab.unionByName(
        numbered.select(
            (F.col("__rank") + size).alias("id"), "token", F.lit(0).cast("bigint").alias("cnt")
        )
    )


def lookup(vocab: DataFrame) -> DataFrame:
    """``token, id`` with one row per token; the largest id wins."""
    return vocab.groupBy("token").agg(F.max("id").alias("id"))


def broadcastable(dictionary: DataFrame, key: str, value: str, broadcast_bytes: int | None = None) -> bool:
    """Whether a dictionary has at most ``broadcast_bytes`` (BROADCAST_BYTES unless given), which are counted."""
    bound = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    size = F.octet_length(F.to_json(F.struct(key, value))) + ENTRY_BYTES
    return bound > 0 and (dictionary.agg(F.sum(size)).first()[0] or 0) <= bound


def dictionary_join(
    rows: DataFrame,
    dictionary: DataFrame,
    key: str,
    value: str,
    row_id: Sequence[str],
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """``rows`` with ``value`` from a dictionary with unique ``key``; NULL on a miss.

    A dictionary of at most ``broadcast_bytes`` (BROADCAST_BYTES unless given), which are counted, is
    broadcast; any other meets the rows in ``join_unique``, which reads them twice: once to
    find the frequent keys, known to the dictionary or not, and once to join. ``row_id`` tells rows of one key apart.
    """
    table = dictionary.select(key, value)
    if broadcastable(table, key, value, broadcast_bytes):
        return rows.join(F.broadcast(table), key, "left")
    return join_unique(rows, table, key, row_id)


def _packed(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The numbers of each row as bytes: seven bits each, the lowest first, and a mark where more follow."""
    sizes = 1 + sum((numbers >> 7 * k > 0).astype(np.int64) for k in range(1, 5))
    starts = np.append(0, np.cumsum(sizes))
    data = np.zeros(starts[-1], dtype=np.uint8)
    for k in range(sizes.max(initial=0)):
        some = np.flatnonzero(sizes > k)
        data[starts[some] + k] = numbers[some] >> 7 * k & 127 | (sizes[some] > k + 1) << 7
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(starts[ends].astype(np.int32)), pa.py_buffer(data)])


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``_packed`` took."""
    rows = packed.to_pylist()
    data = np.frombuffer(b"".join(rows), dtype=np.uint8)
    last = data < 128
    stops = np.flatnonzero(last) + 1
    starts = np.append(0, stops[:-1])
    sizes = stops - starts[: len(stops)]
    numbers = np.zeros(len(stops), dtype=np.int64)
    for k in range(sizes.max(initial=0)):
        some = np.flatnonzero(sizes > k)
        numbers[some] |= (data[starts[some] + k] & 127).astype(np.int64) << 7 * k
    return numbers, np.append(0, np.cumsum(last))[np.cumsum([0, *map(len, rows)])]


def _coded(keys: list[str], items: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of a task's rows: elements as codes of the chunk, and what each code stands for."""

    def chunk(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        # A random number, as short as any, that no other chunk takes.
        name = uuid.uuid4().int >> 65
        # Codes begin with 1; elements that are null are 0, which stands for nothing.
        coded = rows[items].flatten().dictionary_encode()
        elements = coded.dictionary
        codes = coded.indices.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) + 1
        ends = np.append(0, np.cumsum(rows[items].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        yield pa.record_batch(
            [pa.array([name] * len(rows)), *[rows[k] for k in keys], _packed(codes, ends), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), elements.type)],
            ["__chunk", *keys, "__codes", "__code", "__element"],
        )
        for i in range(0, len(elements), CHUNK_ROWS):
            some = elements[i : i + CHUNK_ROWS]
            yield pa.record_batch(
                [
                    pa.array([name] * len(some)), *[pa.nulls(len(some), rows.schema.field(k).type) for k in keys],
                    pa.nulls(len(some), pa.binary()), pa.array(np.arange(i + 1, i + 1 + len(some), dtype=np.int32)), some,
                ],
                ["__chunk", *keys, "__codes", "__code", "__element"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if held and size + batch.nbytes > CHUNK_BYTES:
                yield from chunk(held)
                held, size = [], 0
            if len(batch):
                held.append(batch)
                size += batch.nbytes
        if held:
            yield from chunk(held)

    return run


def _decoded(keys: list[str], value: str, out: str, missing) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        codes, values = known["__code"].combine_chunks(), known[value].combine_chunks()
        made = []
        for batch in rows.to_batches():
            numbers, ends = _unpacked(batch["__codes"])
            found = values.take(pc.index_in(pa.array(numbers, pa.int32()), value_set=codes))
            if missing is not None:
                found = found.fill_null(missing)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)
            made.append(pa.table([*[batch[k] for k in keys], lists], [*keys, out]))
        return pa.concat_tables(made)

    return run


def translate(
    df: DataFrame, dictionary: DataFrame, keys: Sequence[str], items: str, key: str, value: str, out: str, missing=None
) -> DataFrame:
    """``keys, out``: the arrays ``items`` with every element replaced by its ``value``, or ``missing``.

    For a dictionary (unique ``key``) of any size. The rows of a task are coded in chunks where
    they are; the distinct elements of each chunk meet the dictionary, so an element has one row a
    chunk there at most, however often it occurs. Only codes travel to the entries of their chunk.
    Rows of one key are read as one, element by element, those of one place by their value.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = StructType(
        [StructField("__chunk", LongType()), *[StructField(k, kinds[k]) for k in keys]]
        + [StructField("__codes", BinaryType()), StructField("__code", IntegerType())]
        + [StructField("__element", kinds[items].elementType)]
    )
    # The names of chunks are made as they are written.
    chunks = freeze(df.select(*keys, items).mapInArrow(_coded(keys, items), schema))
    rows = chunks.filter("__code is null").select("__chunk", *keys, "__codes")
    entries = chunks.filter("__code is not null").select(F.col("__chunk").alias("__of"), "__code", F.col("__element").alias(key))
    known = entries.join(dictionary.select(key, value), key).select("__of", "__code", value)
    fields = [StructField(k, kinds[k]) for k in keys] + [StructField(out, ArrayType(dictionary.schema[value].dataType))]
    found = rows.groupBy("__chunk").cogroup(known.groupBy("__of")).applyInArrow(_decoded(keys, value, out, missing), StructType(fields))
    if rows.groupBy(*keys).count().filter("count > 1").isEmpty():
        return found
    placed = F.transform(out, lambda v, i: F.struct(i.alias("p"), v.alias("v")))
    return found.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(placed))).alias(out)).withColumn(out, F.col(f"{out}.v"))


def _ordered(values: Column | str, pos: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(values).alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


def encode(
    df: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str],
    tokens: str = "tokens",
    ids: str = "ids",
    broadcast_bytes: int | None = None,
    unknown: str = UNKNOWN,
) -> DataFrame:
    """``keys, ids``: token arrays as arrays of ids; unknown tokens get the id of ``unknown``.

    ``keys`` identify a row. If the vocabulary may be broadcast (``broadcastable``), the rows
    are spread by key once, before the tokens are unnested; lookup and regrouping then stay
    in place. If not, only distinct tokens meet it (``translate``).
    """
    keys = list(keys)
    table = lookup(vocab)
    unk = vocab.filter(F.col("token") == unknown).agg(F.max("id"))
    if not broadcastable(table, "token", "id", broadcast_bytes):
        coded = translate(df, table, keys, tokens, "token", "id", ids, unk.first()[0])
        return coded.withColumn(ids, F.filter(ids, lambda i: i.isNotNull()))
    placed = spread(df.select(*keys, tokens), *keys)
    unnested = placed.select(*keys, F.posexplode_outer(tokens).alias("__pos", "token"))
    coded = unnested.join(F.broadcast(table), "token", "left").withColumn(
        "id", F.when(F.col("__pos").isNotNull(), F.coalesce("id", unk.scalar()))
    )
    return coded.groupBy(*keys).agg(_ordered("id", "__pos").alias(ids)).withColumn(
        ids, F.filter(ids, lambda i: i.isNotNull())
    )


def decode(
    df: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str],
    ids: str = "ids",
    tokens: str = "tokens",
    broadcast_bytes: int | None = None,
    unknown: str = UNKNOWN,
) -> DataFrame:
    """``keys, tokens``: id arrays as arrays of tokens; ids outside the table give ``unknown``."""
    keys = list(keys)
    table = vocab.select("id", "token")
    if not broadcastable(table, "id", "token", broadcast_bytes):
        return translate(df, table, keys, ids, "id", "token", tokens, unknown)
    placed = spread(df.select(*keys, ids), *keys)
    unnested = placed.select(*keys, F.posexplode_outer(ids).alias("__pos", "id"))
    named = unnested.join(F.broadcast(table), "id", "left").withColumn(
        "token", F.when(F.col("__pos").isNotNull(), F.coalesce("token", F.lit(unknown)))
    )
    return named.groupBy(*keys).agg(_ordered("token", "__pos").alias(tokens)).withColumn(
        tokens, F.filter(tokens, lambda t: t.isNotNull())
    )


def contains(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """The rows whose ``token`` is in the vocabulary; a token of very many rows is split."""
    rest = [c for c in tokens.columns if c != "token"]
    known = vocab.select("token").distinct()
    return join_unique(tokens, known, "token", rest or ["token"], "left_semi").select(*tokens.columns)


def size(vocab: DataFrame) -> DataFrame:
    """``size``: number of ids."""
    return vocab.agg(F.count(F.lit(1)).alias("size"))


def token_list(vocab: DataFrame) -> DataFrame:
    """Tokens in id order."""
    return vocab.orderBy("id").select("id", "token")


def oov_rate(counts: DataFrame, vocab: DataFrame, *groups: str) -> DataFrame:
    """Running tokens and types of a counted corpus, and those the vocabulary lacks.

    Takes ``token, cnt`` per group, so the join sees each type once and not each token.
    """
    known = vocab.select("token").distinct().withColumn("__known", F.lit(True))
    missing = F.col("__known").isNull()
    return (
        counts.join(known, "token", "left")
        .groupBy(*groups)
        .agg(
            F.sum("cnt").alias("n_tokens"),
            F.sum(F.when(missing, F.col("cnt")).otherwise(0)).alias("n_oov"),
            F.count(F.lit(1)).alias("n_types"),
            F.sum(F.when(missing, 1).otherwise(0)).alias("n_oov_types"),
        )
        .withColumn("oov_rate", F.round(F.col("n_oov") / F.col("n_tokens"), 6))
    )
