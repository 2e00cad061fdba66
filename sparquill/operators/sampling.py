"""Splits, quotas, samplers and stateful sequences; every random choice is an order of SHA-256 digests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cumulative_split(groups: DataFrame, digest: Column, key: str, size: str, train: float = 0.9, val: float = 0.05) -> DataFrame:
    """Whole groups, ordered by digest, go to train until its share of the sizes is reached, then val, then test; the
    last two go to val and test whatever comes before. Adds split. Groups are few next to rows."""
    order = W.orderBy("_h", key)
    g = groups.withColumn("_h", digest)
    before = F.sum(size).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(size)
    total, after = F.sum(size).over(W.partitionBy(F.lit(0))), F.count(F.lit(1)).over(W.partitionBy(F.lit(0))) - F.row_number().over(order)
    split = F.when(after == 1, "val").when(after == 0, "test").when(before < total * train, "train").when(before < total * (train + val), "val").otherwise("test")
    return g.withColumn("split", split).drop("_h")


def exact_counts(df: DataFrame, digest: Column, quotas: list[tuple[str, int]], rest: str) -> DataFrame:
    """The first rows by digest fill the quotas in turn; what is left goes to rest. Adds split."""
    k, upto, split = F.row_number().over(W.orderBy(digest)), 0, None
    for name, n in quotas:
        upto += n
        split = F.when(F.col("_k") <= upto, name) if split is None else split.when(F.col("_k") <= upto, name)
    return df.withColumn("_k", k).withColumn("split", split.otherwise(rest)).drop("_k")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds k, 0, 1, ... by order over the whole table: range-sorted in parallel, then offset by the counts of the
    tasks before, so no task sees all rows."""
    from sparquill.operators.staging import staged

    spread = staged(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_task", F.spark_partition_id()), "numbered")
    counts = spread.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy("_task").orderBy(order))
    return spread.join(F.broadcast(before), "_task").withColumn("k", F.col("_before") + within - 1).drop("_task", "_before")


def numbered_within(df: DataFrame, keys: list[str], order: list[Column], total: bool = False) -> DataFrame:
    """Adds k, 0, 1, ... by order within each of a few large groups (and, with total, n, the group's rows): one
    range-sort over groups and order deals even a single group over all tasks; a task's numbers begin where those of
    the tasks before end."""
    from sparquill.operators.staging import staged

    names = [f"_o{i}" for i in range(len(order))]
    ranked = df.select("*", *[c.alias(x) for c, x in zip(order, names, strict=True)])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = staged(ranked.repartitionByRange(parts, *keys, *names).withColumn("_task", F.spark_partition_id()), "numbered")
    counts = spread.groupBy(*keys, "_task").agg(F.count(F.lit(1)).alias("_n"))  # a row for each group and task
    own = W.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    placed = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_task").alias("_t"), before, F.sum("_n").over(own).alias("_total"))
    same = F.col("_task") == F.col("_t")
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    within = F.row_number().over(W.partitionBy(*keys, "_task").orderBy(*names)) - 1
    joined = spread.withColumn("_within", within).join(placed, same)
    return joined.select(*df.columns, (F.col("_before") + F.col("_within")).alias("k"), *([F.col("_total").alias("n")] if total else []))


def evenly_spaced(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at equal distances of the ordered table, first and last included: i and the row's columns."""
    rows = numbered(df, order)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    want = df.sparkSession.range(n).withColumnRenamed("id", "i").crossJoin(total).select("i", F.floor(F.col("i") * (F.col("total") - 1) / max(1, n - 1)).alias("k"))
    return F.broadcast(want).join(rows, "k").drop("k")


def early_stopping(histories: DataFrame, column: str, patience: int, min_delta: float) -> DataFrame:
    """Replaces an ordered array of a metric by stop_step, best, best_step and stopped; nothing counts after a stop."""
    zero = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(0).alias("best_step"), F.lit(0).alias("step"))

    def step(s: Column, m: Column) -> Column:
        better = m < s["best"] - min_delta
        now = F.struct(F.when(better, m).otherwise(s["best"]).alias("best"), F.when(better, 0).otherwise(s["bad"] + 1).alias("bad"), F.when(better, s["step"] + 1).otherwise(s["best_step"]).alias("best_step"), (s["step"] + 1).alias("step"))
        return F.when(s["bad"] >= patience, s).otherwise(now)

    h = histories.withColumn("_s", F.aggregate(column, zero, step))
    return h.select(*[c for c in histories.columns if c != column], F.col("_s.step").alias("stop_step"), F.col("_s.best").alias("best"), F.col("_s.best_step").alias("best_step"), (F.col("_s.bad") >= patience).alias("stopped"))


def tiers(df: DataFrame, key: str, n: str, least: int = 4, most: int = 24) -> DataFrame:
    """The top and the bottom third by n (least to most rows each); a row of both is high. Two bounded top-k lists."""
    size = min(most, max(least, df.count() // 3))
    high = df.orderBy(F.desc(n), key).limit(size).select(key, F.lit("high").alias("tier"))
    low = df.orderBy(n, key).limit(size).select(key, F.lit("low").alias("tier"))
    return high.unionByName(low.join(F.broadcast(high.select(key)), key, "left_anti"))


def diverse(df: DataFrame, key: str, facets: list[str], n: int) -> DataFrame:
    """n rows in digest order, first such as bring a new value in every facet, then in any, then the others.

    The choice is sequential: each step asks the cluster for the first row in digest order that qualifies, a minimum
    over all rows, so there are at most n steps and only chosen rows come to the driver. Null is a value of its own."""
    from sparquill.operators.staging import staged

    rows = staged(df.select(key, *facets, F.sha2(F.col(key).cast("string"), 256).alias("_h")), "diverse")
    kinds = [rows.schema[f].dataType.simpleString() for f in facets]
    seen: list[list] = [[] for _ in facets]
    chosen: list = []

    def fresh(f: str, kind: str, values: list) -> Column:
        known = F.col(f).isin([v for v in values if v is not None]) if any(v is not None for v in values) else F.lit(False)
        return F.when(F.col(f).isNull(), F.lit(None not in values)).otherwise(~known)

    for wanted in ("AND", "OR", ""):
        while len(chosen) < n:
            test = F.lit(True)
            if wanted:
                parts = [fresh(*x) for x in zip(facets, kinds, seen, strict=True)]
                test = parts[0]
                for p in parts[1:]:
                    test = test & p if wanted == "AND" else test | p
            left = rows.where(test & ~F.col(key).isin([r[key] for r in chosen]) if chosen else test)
            best = left.orderBy("_h", key).limit(1).collect() if wanted else left.orderBy("_h", key).limit(n - len(chosen)).collect()
            if not best:
                break
            for r in best:
                chosen.append(r)
                for values, f in zip(seen, facets, strict=True):
                    values.append(r[f])
            if not wanted:
                break
    return df.sparkSession.createDataFrame([(r[key], i) for i, r in enumerate(chosen)], f"`{key}` {df.schema[key].dataType.simpleString()}, place int")


def exact_subset(groups: DataFrame, key: str, size: str, target: int) -> DataFrame:
    """Whole groups whose sizes add up to exactly target (none if that can't be), in digest order.

    Groups enter a reachability table of at most target + 1 sums. Of one size, at most target / size groups can be
    of use, so that many of each size are fetched: a bounded list, however many groups there are."""
    digest = F.sha2(F.col(key).cast("string"), 256)
    k = F.row_number().over(W.partitionBy(size).orderBy(digest))
    rows = groups.where((F.col(size) > 0) & (F.col(size) <= target)).withColumn("_h", digest).withColumn("_k", k).where(F.col("_k") * F.col(size) <= target).orderBy("_h").collect()
    back: dict[int, tuple[int, object] | None] = {0: None}
    for r in rows:
        for total in sorted(back, reverse=True):
            new = total + r[size]
            if new <= target and new not in back:
                back[new] = (total, r[key])
        if target in back:
            break
    chosen, total = [], target if target in back else 0
    while total:
        total, name = back[total]
        chosen.append((name,))
    return groups.sparkSession.createDataFrame(chosen, f"`{key}` {groups.schema[key].dataType.simpleString()}")


def distinct_places(hits: DataFrame, label: str, place: str, n_labels: int) -> DataFrame:
    """For each label, in order, its first place that no label before it took. A label can be pushed back by others
    at most n_labels - 1 times, so its first n_labels places are enough."""
    k = F.row_number().over(W.partitionBy(label).orderBy(place))
    rows = hits.distinct().withColumn("_k", k).where(F.col("_k") <= n_labels).orderBy(label, place).collect()
    taken: dict = {}
    for r in rows:
        if r[label] not in taken and r[place] not in taken.values():
            taken[r[label]] = r[place]
    return hits.sparkSession.createDataFrame(list(taken.items()), f"`{label}` string, `{place}` {hits.schema[place].dataType.simpleString()}")


def pool_sequence(weights: list[tuple[str, int]], draws: int) -> list[str]:
    """Which pool each draw takes: every pool earns its weight, the richest (first on ties) pays the sum."""
    credit, total, out = [0] * len(weights), sum(w for _, w in weights), []
    for _ in range(draws):
        credit = [c + w for c, (_, w) in zip(credit, weights, strict=True)]
        best = max(range(len(weights)), key=lambda i: (credit[i], -i))
        credit[best] -= total
        out.append(weights[best][0])
    return out


def weighted_draws(df: DataFrame, weights: list[tuple[str, int]], draws: int, seed: int = 7) -> DataFrame:
    """Draws of records by weighted pools without replacement within an epoch: draw, pool, epoch, id.

    Only the sequence of pools is sequential, and it doesn't depend on the data; records meet it by an equi join on
    (pool, epoch, place in digest order)."""
    spark = df.sparkSession
    picks = pd.DataFrame({"draw": range(1, draws + 1), "pool": pool_sequence(weights, draws)})
    picks["k"] = picks.groupby("pool").cumcount()
    sizes = df.groupBy("pool").agg(F.count(F.lit(1)).alias("size"))
    e = spark.createDataFrame(picks, "draw int, pool string, k int").join(F.broadcast(sizes), "pool").select("draw", "pool", F.floor(F.col("k") / F.col("size")).alias("epoch"), (F.col("k") % F.col("size")).alias("pos"))
    q = df.join(F.broadcast(e.select("pool", "epoch").distinct()), "pool")
    pos = F.row_number().over(W.partitionBy("pool", "epoch").orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("id").cast("string")), 256))) - 1
    return e.join(q.withColumn("pos", pos.cast("long")), ["pool", "epoch", "pos"]).select("draw", "pool", "epoch", "id")


def epoch_draws(df: DataFrame, draws: int, seed: int) -> DataFrame:
    """Draws of a shuffled table, shuffled anew for each epoch: draw, epoch, id."""
    size = df.count()
    e = df.sparkSession.range(draws).select(F.col("id").alias("draw"), F.floor(F.col("id") / size).alias("epoch"), (F.col("id") % size).alias("pos"))
    q = df.crossJoin(F.broadcast(e.select("epoch").distinct()))
    q = numbered_within(q, ["epoch"], [F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("id").cast("string")), 256)])
    return e.join(q.withColumnRenamed("k", "pos"), ["epoch", "pos"]).select("draw", "epoch", "id")
