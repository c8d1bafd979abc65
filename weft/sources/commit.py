"""Tables that are written whole or not at all.

Every attempt writes below a folder of its own, then what it wrote is read back and listed in a
manifest: rows, bytes and a digest of each file. One row added to the commits makes the
attempt the content of the path. Readers go by the last commit and its manifest, so files of
broken or running attempts, and files that somebody adds, are not seen. Nothing is
renamed or deleted, and no reader sees a mix of two writes.

Layout of a path: ``commits/``, ``manifests/<attempt>/`` and ``attempts/<attempt>/<table>/``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "version long, attempt string, n_files long, n_rows long, digest long"
MANIFEST = "name string, file string, n_rows long, n_bytes long, digest long"


def _folder(path: str, attempt: str) -> str:
    return f"{path}/attempts/{attempt}"


def _digest(columns: Sequence[str]) -> Column:
    # Rows in any order; equal rows cancel out in pairs, which the row count tells.
    return F.bit_xor(F.xxhash64(*columns))


def _files(df: DataFrame, attempt: str, name: str) -> DataFrame:
    """Rows, bytes and digest of each file of a table that was read back."""
    inside = F.substring_index(F.col("_metadata.file_path"), f"/{attempt}/", -1)
    columns = df.columns
    return (
        df.select(*columns, inside.alias("__file"), F.col("_metadata.file_size").alias("__size"))
        .groupBy(F.lit(name).alias("name"), F.col("__file").alias("file"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max("__size").alias("n_bytes"), _digest(columns).alias("digest"))
    )


def _read(spark: SparkSession, folder: str | list[str], schema) -> DataFrame:
    return spark.read.text(folder) if schema is None else spark.read.schema(schema).parquet(*([folder] if isinstance(folder, str) else folder))


def commit_tables(path: str, tables: dict[str, DataFrame], text: Sequence[str] = (), by: Sequence[str] = ()) -> str:
    """Write all ``tables`` below ``path`` in one commit; returns the attempt's name.

    Those named in ``text`` hold one column ``value`` (lines without line ends, checked), and
    columns of ``by``, which become folders; the others are Parquet. Parts are written as
    the rows come: sort before.
    """
    spark = next(iter(tables.values())).sparkSession
    attempt = uuid.uuid4().hex
    listed = []
    for name, df in tables.items():
        folder = f"{_folder(path, attempt)}/{name}"
        if name in text:
            whole = F.when(F.col("value").rlike("[\\n\\r]"), F.raise_error(F.lit("a line holds a line end"))).otherwise(F.coalesce("value", F.lit("")))
            df.withColumn("value", whole).write.partitionBy(*by).text(folder)
            back = spark.read.option("recursiveFileLookup", "true").text(folder)
        else:
            df.write.parquet(folder)
            back = _read(spark, folder, df.schema)
        listed.append(_files(back, attempt, name))
    manifest = listed[0]
    for more in listed[1:]:
        manifest = manifest.unionByName(more)
    manifest.write.parquet(f"{path}/manifests/{attempt}")
    sums = spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{attempt}").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), F.bit_xor("digest").alias("digest")
    )
    last = _last(spark, path)
    version = 0 if last is None else last["version"] + 1
    row = sums.select(F.lit(version).cast("bigint").alias("version"), F.lit(attempt).alias("attempt"), "n_files", "n_rows", "digest")
    row.coalesce(1).write.mode("append").json(f"{path}/commits")
    return attempt


def _last(spark: SparkSession, path: str):
    try:
        commits = spark.read.schema(COMMITS).json(f"{path}/commits")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    # Of two writers that took one version, all readers see the same.
    return commits.orderBy(F.col("version").desc(), F.col("attempt").desc()).first()


def committed_files(spark: SparkSession, path: str, name: str) -> list[str]:
    """The files of a table in its last commit, in the order of their names; the manifest is checked against the commit."""
    last = _last(spark, path)
    if last is None:
        raise FileNotFoundError(f"nothing was committed below {path}")
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{last['attempt']}")
    sums = manifest.agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("rows"), F.bit_xor("digest").alias("digest")).first()
    if (sums["n"], sums["rows"], sums["digest"]) != (last["n_files"], last["n_rows"], last["digest"]):
        raise ValueError(f"the manifest of {path} is not the one that was committed")
    # One name a part file, as in any listing of a folder.
    rows = manifest.filter(F.col("name") == name).select("file").orderBy("file").collect()
    return [f"{_folder(path, last['attempt'])}/{r['file']}" for r in rows]


def verify(spark: SparkSession, path: str, name: str, schema=None) -> None:
    """Compare the files of a table with the manifest of the last commit; a difference is an error."""
    files = committed_files(spark, path, name)
    if not files:
        return
    attempt = _last(spark, path)["attempt"]
    found = _files(_read(spark, files, schema), attempt, name)
    listed = spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{attempt}").filter(F.col("name") == name)
    keys = ["name", "file", "n_rows", "n_bytes", "digest"]
    lost = listed.select(keys).join(found.select(keys), keys, "left_anti").first()
    if lost is not None:
        raise ValueError(f"{lost['file']} below {path} is not as it was committed")


def read_table(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    """A Parquet table of the last commit; ``schema`` also serves one without files."""
    files = committed_files(spark, path, name)
    return _read(spark, files, schema) if files else spark.createDataFrame([], schema)
