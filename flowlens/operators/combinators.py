"""The relational patterns that detectors share. All reduce where the rows are before they shuffle, and take each capture by itself:
an order (seq) holds within a capture, so capture_id is part of every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.streaming import state
from flowlens.tables import cut

CAPTURE = "capture_id"
BLOCK = 1 << 16


def first_match(df: DataFrame, keys: list[str], order: str = "seq", cfg: dict | None = None) -> DataFrame:
    """The first row of each key in a capture, without its payload: an aggregate, so that a frequent key sends one row from each
    task; on a stream the first that comes."""
    if watch := state.watching(cfg):
        return state.first_rows(df, keys, watch)
    keys = [CAPTURE, *keys]
    kept = [c for c in df.columns if c != "payload"]
    found = df.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in kept if c not in keys)), order).alias("_row"))
    return found.select(*keys, "_row.*").select(*kept)


def first_crossing(df: DataFrame, key: str, targets: list[str], threshold: int, order: str = "seq") -> DataFrame:
    """For each key the row at which its number of distinct targets first reaches the threshold: capture_id, key and crossing.

    Targets are reduced to their first rows; of these the threshold-th of a key is the crossing."""
    firsts = df.groupBy(CAPTURE, key, *targets).agg(F.min(order).alias("crossing"))
    by = Window.partitionBy(CAPTURE, key).orderBy("crossing")
    return firsts.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= threshold).where(F.col("_n") == threshold).select(CAPTURE, key, "crossing")


def so_far(df: DataFrame, crossings: DataFrame, key: str, aggregates: list, order: str = "seq") -> DataFrame:
    """Aggregates of each key's rows up to its crossing."""
    return df.join(crossings, [CAPTURE, key]).where(F.col(order) <= F.col("crossing")).groupBy(CAPTURE, key).agg(*aggregates)


def at_crossing(df: DataFrame, crossings: DataFrame, key: str, order: str = "seq") -> DataFrame:
    return df.join(crossings.withColumnRenamed("crossing", order), [CAPTURE, key, order])


def crossed(df: DataFrame, key: str, targets: list[str], threshold: int, cfg: dict | None = None) -> DataFrame:
    """The row of each key at which its number of different targets first reaches the threshold, with n (rows so far), targets (their
    number), and ips and ports, the different dst_ip and dst_port so far, ascending."""
    if watch := state.watching(cfg):
        return state.crossed(df, key, targets, threshold, watch)
    found = first_crossing(df, key, targets, threshold)
    values = lambda c: F.array_sort(F.collect_set(c))
    seen = so_far(df, found, key, [F.count("*").alias("n"), F.count_distinct(*targets).alias("targets"), values("dst_ip").alias("ips"), values("dst_port").alias("ports")])
    return at_crossing(df, found, key).join(seen, [CAPTURE, key])


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """df written by ranges of `by`, each a _block, so that one key's rows may lie in many blocks; blocks rise with `by`."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return cut(df.repartitionByRange(parts, *by).withColumn("_block", F.spark_partition_id()))


def medians(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The sum of the two middle values (of an odd number, twice the middle one) of each key, exactly. Equal values are counted
    first, their counts dealt by ranges of key and value, and added up from block to block, so no key's values are in one task."""
    rows = dealt(df.groupBy(*keys, value.alias("_value")).agg(F.count("*").alias("_n")), [*keys, "_value"])
    blocks = rows.groupBy(*keys, "_block").agg(F.sum("_n").alias("_all"))
    along = Window.partitionBy(*keys).orderBy("_block")
    before = F.sum("_all").over(along) - F.col("_all")
    blocks = blocks.select(*keys, "_block", before.alias("_before"), F.sum("_all").over(Window.partitionBy(*keys)).alias("_total"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_block").orderBy("_value"))
    ranks = rows.withColumn("_upto", upto).join(blocks, [*keys, "_block"]).withColumn("_upto", F.col("_upto") + F.col("_before"))
    holds = lambda rank: ((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)).cast("long")
    held = holds(F.floor((F.col("_total") + 1) / 2)) + holds(F.floor(F.col("_total") / 2) + 1)
    return ranks.where(held > 0).groupBy(*keys).agg(F.sum(F.col("_value") * held).alias(name))


def running(df: DataFrame, keys: list[str], sums: dict[str, Column], order: str = "seq", block: int = BLOCK) -> DataFrame:
    """df with running sums by key. Blocks of `block` numbers of the order are summed up first and carried forward, so that a frequent
    key is spread over its blocks."""
    keys = [CAPTURE, *keys]
    rows = df.withColumns({f"_{n}": c.cast("long") for n, c in sums.items()}).withColumn("_block", F.floor(F.col(order) / block))
    totals = rows.groupBy(*keys, "_block").agg(*(F.sum(f"_{n}").alias(f"_all_{n}") for n in sums))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_block", *(F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums))
    to = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumns({n: F.sum(f"_{n}").over(to) for n in sums}).join(before, [*keys, "_block"])
    return within.select(*df.columns, *((F.col(n) + F.col(f"_before_{n}")).alias(n) for n in sums))


def smallest(df: DataFrame, key: str, column: str, n: int = 5) -> DataFrame:
    """key, and column as an array of its n smallest different values in order; Spark keeps n of a key in each task before it shuffles."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(column))
    few = df.select(key, column).distinct().withColumn("_nth", nth).where(F.col("_nth") <= n)
    return few.groupBy(key).agg(F.array_sort(F.collect_list(column)).alias(column))
