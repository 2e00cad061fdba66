"""Staged tables in the folder that driver and executors share, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session that is one process (master
    local[...], as in tests) may leave it unset and gets a folder of its own; elsewhere that is an error, since a
    machine's own folder is not seen by the others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not _one_process(context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="sparquill-")
    return _own_dirs[app]


def _one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package also where only the driver's sys.path has it: in one process by the
    path, on a cluster by a zip of the package that Spark sends to every executor (once for each application)."""
    context = spark.sparkContext
    if _one_process(context.master):
        env = context.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if PACKAGE_ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_ROOT])
    elif context.applicationId not in _shipped:
        package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(os.path.join(PACKAGE_ROOT, package)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, PACKAGE_ROOT))
        own = tempfile.mkdtemp(prefix="sparquill-")  # the driver's file server reads it as executors come and go
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = os.path.join(own, f"{package}.zip")
        with open(path, "wb") as f:
            f.write(data.getvalue())
        context.addPyFile(path)
        _shipped.add(context.applicationId)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df once, as a table in the shared folder, and reads it back.

    It cuts the lineage: a lost executor costs the rereading of files, not a recomputation, and what was dealt
    out by an unstable plan (range partitions, partition numbers) is fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, queries that are planned and run send Python at most so many rows at once: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], size: str, spread: Column, hot_share: int = 512, salts: int = 64) -> DataFrame:
    """Inner join of `many` with `one` (unique by keys), safe for hot keys.

    `one` carries in column `size` how many rows of `many` have its keys. Keys with over total/hot_share rows are hot:
    there are fewer than hot_share of them whatever the size of the tables, so that set is broadcast. Rows of hot keys
    are dealt over `salts` salts by `spread`, and only the hot rows of `one` are repeated for each salt.
    """
    total = one.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"))
    marked = one.crossJoin(F.broadcast(total)).withColumn("_hot", (F.col(size) * hot_share > F.col("_total")) & (F.col(size) > 1000)).drop("_total")
    hot = F.broadcast(marked.where("_hot").select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_is_hot")))
    condition = None
    for k in keys:
        term = F.col(k) == F.col(f"_h_{k}")
        condition = term if condition is None else condition & term
    left = many.join(hot, condition, "left").withColumn("_salt", F.when(F.col("_is_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_is_hot", *[f"_h_{k}" for k in keys])
    right = marked.withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [*keys, "_salt"]).drop("_salt")
