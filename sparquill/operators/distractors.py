"""Distractors of facts: others of the same family, the likest in frequency and length first."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.operators.staging import importable, staged

#: Facts of a block; blocks are compared in pairs.
BLOCK = 1024


def nearest_facts(facts: DataFrame, most: int = 3) -> DataFrame:
    """target, family, other, k: of each fact (fact_id, family, freq, n) the `most` likest others of its family: such of
    equal length with at most twice the frequency first, then by difference in length, in frequency, then by the
    SHA-256 of both ids.

    Facts of a family with equal freq and n are one class; all but the digest is the same for two classes, so a fact needs
    digests only with the nearest classes that hold `most` others. Their members meet in blocks, of which only the best
    leave a task: as many digests as that leaves, the square of a large class, but no pair is shuffled or sorted.
    """
    spark = facts.sparkSession
    importable(spark)
    facts = staged(facts.where("family IS NOT NULL AND fact_id IS NOT NULL").select("fact_id", "family", "freq", "n"), "facts")
    keys = ["family", "n", "freq"]
    sizes = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    other = sizes.select("family", F.col("n").alias("n2"), F.col("freq").alias("freq2"), F.col("size").alias("size2"))
    near = F.when((F.greatest("freq", "freq2") <= 2 * F.least("freq", "freq2")) & (F.col("n") == F.col("n2")), 0).otherwise(1)
    level = F.struct(near.alias("near"), F.abs(F.col("n") - F.col("n2")).alias("dn"), F.abs(F.col("freq") - F.col("freq2")).alias("df"))
    others = F.col("size2") - F.when((F.col("n") == F.col("n2")) & (F.col("freq") == F.col("freq2")), 1).otherwise(0)
    links = sizes.drop("size").join(other, "family").withColumn("level", level).withColumn("others", others)
    upto, own = F.sum("others").over(W.partitionBy(*keys).orderBy("level")), F.sum("others").over(W.partitionBy(*keys, "level"))
    links = links.withColumn("_before", upto - own).where((F.col("_before") < most) & (F.col("others") > 0)).select(*keys, "n2", "freq2", "level")
    block = F.pmod(F.xxhash64("fact_id"), F.ceil(F.col("size") / BLOCK))
    blocks = staged(facts.join(sizes, keys).groupBy(*keys, block.alias("block")).agg(F.collect_list("fact_id").alias("ids")).drop("block"), "fact-blocks")
    second = blocks.select("family", F.col("n").alias("n2"), F.col("freq").alias("freq2"), F.col("ids").alias("ids2"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    jobs = blocks.join(links, keys).join(second, ["family", "n2", "freq2"]).select("family", "level.near", "level.dn", "level.df", "ids", "ids2").repartition(parts)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                family, near, dn, df, ids, ids2 = (b.column(c)[k].as_py() for c in range(6))
                rows = []
                data = [x.encode() for x in ids2]
                for target in ids:
                    begun = hashlib.sha256(f"{target}|".encode()).copy
                    digests = []
                    for x in data:
                        h = begun()
                        h.update(x)
                        digests.append(h.digest())
                    chosen = heapq.nsmallest(most + 1, zip(digests, ids2, strict=True))
                    rows += [(target, family, near, dn, df, d, o) for d, o in [c for c in chosen if c[1] != target][:most]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)

    names = ["target", "family", "near", "dn", "df", "digest", "other"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
    found = jobs.mapInArrow(best, "target string, family string, near int, dn int, df long, digest binary, other string")
    order = W.partitionBy("target", "family").orderBy("near", "dn", "df", "digest")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("target", "family", "other", "k")
