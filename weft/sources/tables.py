"""Views over the given parquet tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import CODE_END, NBEST_SEPARATOR
from weft.operators.ordering import dense_index, running_start
from weft.operators.projection import mean_pool, project
from weft.session import freeze, widen

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, line_no, line``: documents cut at line ends."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return widen(docs, "doc_id").select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, src, tgt``: a user turn and the assistant turn right after it."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.translate("text", "\n", " "))
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")
    )
    return asked.join(answered, ["conv_id", "turn"])


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, doc_id, lang, source, pos, line``: all lines of all documents as one corpus.

    The number of a line is the start of its document, a prefix sum over the documents in
    the order of their ids, plus its place ``pos`` there.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    sizes = docs.select("doc_id", F.size(F.split("text", "\n", -1)).cast("bigint").alias("n"))
    starts = running_start(sizes, "doc_id", "n", "start", 60).select("doc_id", "start")
    return (
        docs.join(starts, "doc_id")
        .select("doc_id", "lang", "source", "start", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select((F.col("start") + F.col("pos")).alias("line_no"), "doc_id", "lang", "source", "pos", "line")
    )


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, line``: all lines of all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.split("html", "\n", -1).alias("parts"))
    sizes = pages.select("page_id", F.size("parts").cast("bigint").alias("n"))
    starts = running_start(sizes, "page_id", "n", "start", 60).select("page_id", "start")
    return (
        pages.join(starts, "page_id")
        .select("start", F.posexplode("parts").alias("pos", "line"))
        .select((F.col("start") + F.col("pos")).alias("line_no"), "line")
    )


def nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rank, value``: every line as a raw n-best line. Block = source, code = language if labelled."""
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    coded = F.when(F.col("labelled"), F.concat(F.col("lang"), F.lit(CODE_END))).otherwise("")
    return numbered(spark, sf_dir).join(labelled, "doc_id", "left").select(
        F.col("line_no").alias("rank"),
        F.concat_ws(
            NBEST_SEPARATOR,
            "source",
            F.concat(coded, "line"),
            F.concat(F.lit("length="), F.length("line").cast("string")),
            F.col("line_no").cast("string"),
        ).alias("value"),
    )


def by_turns(corpus: DataFrame, items: DataFrame, item_no: str) -> DataFrame:
    """``corpus`` (``line_no``) beside ``items``, whose numbers from 0 are taken in turn."""
    n = items.agg(F.count(F.lit(1))).scalar()
    turns = corpus.withColumn(item_no, F.pmod("line_no", n))
    # Items whose turn never comes are not moved.
    last = turns.agg(F.max(item_no)).scalar()
    return turns.join(items.filter(F.col(item_no) <= last), item_no)


def label_weights(spark: SparkSession, sf_dir: str, bias: float = 0.25) -> DataFrame:
    """``bit, weights, bias``: an affine score per label, its mean vector."""
    pooled = mean_pool(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return pooled.select(F.col("label").alias("bit"), F.col("pooled").alias("weights"), F.lit(bias).alias("bias"))


def numbered_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tree_no, cfg``: the trees of the orders, numbered from 0."""
    keyed = trees(spark, sf_dir).withColumnRenamed("line_no", "o_orderkey")
    return dense_index(keyed, "o_orderkey", "tree_no").select("tree_no", "cfg")


def labelling(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(line_no, src)``, ``(line_no, cfg)``, ``(line_no, vec)``: lines, trees and vectors, taken in turn.

    The numbered lines and trees are written once: all three and the counts read them.
    """
    corpus = freeze(numbered(spark, sf_dir).select("line_no", F.col("line").alias("src")))
    parsed = freeze(numbered_trees(spark, sf_dir))
    vectors = dense_index(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec_id", "vec_no")
    return (
        corpus,
        by_turns(corpus.select("line_no"), parsed, "tree_no").select("line_no", "cfg"),
        by_turns(corpus.select("line_no"), vectors, "vec_no").select("line_no", "vec"),
    )


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, cfg``: the bracket tree of each order that has items."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag"
    )
    in_order = F.array_sort(
        F.collect_list(
            F.struct(
                "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag"
            )
        )
    )
    grouped = items.groupBy("l_orderkey").agg(in_order.alias("items"))
    leaves = F.array_join(
        F.transform(
            "items",
            lambda i: F.concat(
                F.lit("("), i["l_returnflag"], F.lit(" (PART "), i["l_partkey"].cast("string"), F.lit("))")
            ),
        ),
        " ",
    )
    return orders.join(grouped, orders["o_orderkey"] == grouped["l_orderkey"]).select(
        F.col("o_orderkey").alias("line_no"),
        F.concat(
            F.lit("(ROOT (ORDER (STATUS "), "o_orderstatus", F.lit(") (ITEMS "), leaves, F.lit(")))")
        ).alias("cfg"),
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run, epoch, ts, event_id, name, value`` from the event table."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.to_date("ts").alias("epoch"),
        "ts",
        "event_id",
        F.col("event_type").alias("name"),
        "value",
    )


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, scores``: affine scores of whole vectors, one per label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    return project(vectors, label_weights(spark, sf_dir)).select("vec_id", "label", "scores")
