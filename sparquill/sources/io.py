"""Sources and sinks: text, JSON lines, prompts, CSV, split releases with a manifest, verification of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file, whole; a byte-order mark is dropped."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str, fail_fast: bool = True) -> DataFrame:
    """JSON lines of a declared schema; bad lines fail, or come back in _corrupt_record. Blank lines are skipped."""
    if fail_fast:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def numbered_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same with path and line_no, the line's place in its file."""
    lines = whole_texts(spark, path).select("path", F.posexplode(F.split("text", "\r\n|\n")).alias("i", "line")).where(F.trim("line") != "")
    return lines.select("path", (F.col("i") + 1).alias("line_no"), F.from_json("line", schema).alias("r")).select("path", "line_no", "r.*")


def authorised_split(df: DataFrame, split: str) -> DataFrame:
    """df, whose rows must all be of one split; any other row fails the job that reads it."""
    return df.where(F.when(F.col("split").eqNullSafe(F.lit(split)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("row of another split: "), F.coalesce("split", F.lit("null")))).cast("boolean")))


def prefix(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by order; a bounded top-n in each task, then one merge."""
    return df.orderBy(order).limit(n)


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("prompt")).where("prompt <> ''")


def metric_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, or JSON lines by suffix."""
    return spark.read.schema(schema).json(path) if path.endswith((".json", ".jsonl")) else spark.read.schema(schema).csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with keys in alphabetical order; nulls are kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_release(df: DataFrame, path: str, ready: bool = True) -> DataFrame:
    """Writes one folder a split, then the manifest; not ready, only a manifest that says so. Returns the manifest.

    The manifest is written last and through the commit protocol, so its presence marks a complete release.
    """
    spark = df.sparkSession
    if not ready:
        blocked = spark.createDataFrame([("freeze_not_ready", None, None)], "status string, split string, rows long")
        blocked.write.mode("overwrite").json(f"{path}/manifest")
        return blocked
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    manifest = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("complete").alias("status"), "split", "rows")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema("status string, split string, rows long").json(f"{path}/manifest")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of each file under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def sidecar(found: DataFrame) -> DataFrame:
    """Lines `<sha256>  <name>`."""
    return found.select(F.concat("sha256", F.lit("  "), "name").alias("line"))


def verified(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """name, status (ok, missing or changed) of each expected artifact."""
    a = actual.select("name", F.col("sha256").alias("found"))
    return expected.join(a, "name", "left").select("name", F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed").otherwise("ok").alias("status"))




def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row of each file that is one JSON document; a file that doesn't fit the schema fails."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def token_arrays(spark: SparkSession, path: str, column: str = "tokens") -> DataFrame:
    """Rows with an array of token ids. It must be one-dimensional, of 64-bit integers, without nulls."""
    df = spark.read.parquet(path)
    kind = df.schema[column].dataType.simpleString()
    if kind != "array<bigint>":
        raise ValueError(f"{column} is {kind}, not array<bigint>")
    bad = F.exists(column, lambda x: x.isNull())
    return df.withColumn(column, F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(f"null in {column}")).cast(kind)).otherwise(F.col(column)))


def publish(df: DataFrame, path: str) -> None:
    """Writes df beside path, and only when it is complete puts it in path's place by renaming; a reader sees the old or
    the new table, never a part. What was there before goes after the new one has arrived."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"can't move {path} away")
    if not fs.rename(at(new), at(path)):
        raise OSError(f"can't put {new} in its place")
    fs.delete(at(old), True)


def folder_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of each folder under path: of its files' digests in their order, so of all it holds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    own = files.select(F.element_at(F.split("path", "/"), -2).alias("name"), F.sha2("content", 256).alias("d"))
    return own.groupBy("name").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), "\n"), 256).alias("sha256"))


def discovered(spark: SparkSession, path: str, aliases: list[tuple[str, list[str]]]) -> DataFrame:
    """artifact, found, status: for each artifact the first of its names that there is a folder of under path."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -2).alias("name")).distinct()
    wanted = spark.createDataFrame([(k, i, a) for k, xs in aliases for i, a in enumerate(xs)], "artifact string, preference int, name string")
    there = wanted.join(names.withColumn("there", F.lit(True)), "name", "left")
    found = F.min_by(F.when(F.col("there"), F.col("name")), F.when(F.col("there"), F.col("preference"))).alias("found")
    return there.groupBy("artifact").agg(found).withColumn("status", F.when(F.col("found").isNull(), "missing").otherwise("found"))
