"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources, in order of their names (null last), weigh 3, 1, 2, 3, 1, 2 and so on, and share a budget of words by weight. A
target stops at `most_epochs` times its source's size; what is above is shared again by weight until none is above.

A source first gives complete epochs, all its documents once each. The rest of its target is chosen: each document has
the key -ln(u) / weight, u a hash of its id and text in (0, 1) and the weight its quality; documents are sorted by key within the
source and their sizes prefix-summed, and a document is in as long as at least half of it is within the budget. So the
words taken differ from the target by half a document at most.

No source is sorted as a whole. A source's keys fall into ranges, and sums by range tell in which one its budget ends; that one
falls into ranges again, LEVELS times. What is left is added up by equal keys, and these are put in order. So every step is an
aggregate whose size is fixed, but for the different keys of the last range: one in 2**20 of a source.

Rows that are equal in id and text have the same key, and are in order of the hash of their other columns. Where the budget ends
among rows equal in all columns, only as many as fit are chosen: by the hash of a row number, its ranges counted in the same way.
These can't be told apart, so reruns agree.

A null text or one without words has size 0 and comes with complete epochs only, though it adds nothing. A null id hashes as an
empty one. Sources are metadata: their rows, not their documents, meet in one task. A weight that is null or below LEAST_QUALITY
counts as LEAST_QUALITY. An empty table gives no rows; other columns don't matter, and `mix` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm._spark import cut

DIGIT, LEVELS, TIES = 10, 2, 4096  #: bits of a range, how often ranges are divided, ranges of tied rows
WEIGHTS = (3, 1, 2)
SIGNS = "#*$%&|<>!"
LEAST_QUALITY = 0.05


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain text, less the more signs are in it."""
    signs = F.length(text) - F.length(F.translate(text, SIGNS, ""))
    return F.greatest(F.lit(LEAST_QUALITY), F.coalesce(F.lit(1.0) - F.lit(4.0) * signs / F.greatest(F.length(text), F.lit(1)), F.lit(1.0)))


def keyed(df: DataFrame, weight: str | None = None, *more: Column) -> DataFrame:
    """of (the source as text that is never null), source, size, digits (the key's ranges), key, id, hash (of the text) and look (of the
    other columns), which order a source's rows, tie and row, which order equal ones; more: further columns. weight: a column of document quality."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text_hash = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    look = F.md5(F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns) if c != "text"))).cast("binary"))
    u = (F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), text_hash).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    quality = quality_weight(F.col("text")) if weight is None else F.greatest(F.lit(LEAST_QUALITY), F.coalesce(F.col(weight).cast("double"), F.lit(LEAST_QUALITY)))
    key = -F.log(u) / quality
    bits = DIGIT * LEVELS
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("of"), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"), n_words(F.col("text")).alias("size"), key.alias("key"),
        name.alias("id"), text_hash.alias("hash"), look.alias("look"), F.monotonically_increasing_id().alias("row"), *more,
    )
    place = F.least(F.floor((1 - F.exp(-F.col("key"))) * float(1 << bits)), F.lit((1 << bits) - 1)).cast("long")
    digits = F.array(*(F.shiftright(place, DIGIT * (LEVELS - 1 - k)).bitwiseAND((1 << DIGIT) - 1).cast("int") for k in range(LEVELS)))
    return rows.withColumn("digits", digits).withColumn("tie", F.xxhash64("row"))


def targets(sizes: DataFrame, share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """source, source_size -> and target: each row is a source; all of them meet in one task."""
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), place + 1))
    weighed = weighed.withColumn("most", F.lit(most_epochs) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = weighed.withColumn("level", (F.lit(share) * total - before) / weight_left)
    # the first source, by the level it fills up at, that stays below its limit tells the common level
    reached = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.col("ratio"))).over(Window.partitionBy())
    out = level.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.coalesce(reached, F.lit(float("inf")))))
    return out.select("source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def where_it_ends(cells: DataFrame, ends: DataFrame, order: list[str], amount: str) -> DataFrame:
    """Of cells (of, order columns, amount) the one of each `of` in which ends (of, budget, before) ends: its before is what comes earlier."""
    to = Window.partitionBy("of").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = cells.join(ends, "of").withColumn("begin", F.col("before") + F.sum(amount).over(to) - F.col(amount))
    return rows.where((F.col("begin") < F.col("budget")) & (F.col("budget") <= F.col("begin") + F.col(amount))).drop("before").withColumnRenamed("begin", "before")


def plan(rows: DataFrame, share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """For each source of keyed rows: of, source_size, target, epochs, and beyond them the last key, id, hash and look of which rows are
    chosen (null: none), with the last tie and row of these (null: none of them, only what comes before)."""
    sizes = rows.groupBy("of", "source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes.drop("of"), share, most_epochs)
    goal = sizes.select("of", F.col("source").alias("name")).join(goal, F.col("name").eqNullSafe(F.col("source"))).drop("name", "source")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = cut(goal)
    ends = goal.select("of", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("before"))
    near = rows.where("size > 0")
    for k in range(LEVELS):
        near = near.withColumn("digit", F.col("digits")[k])
        ends = cut(where_it_ends(near.groupBy("of", "digit").agg(F.sum("size").alias("sum")), ends, ["digit"], "sum").drop("sum"))
        near = near.join(ends.select("of", "digit"), ["of", "digit"], "left_semi").drop("digit")
        ends = ends.drop("digit")
    groups = near.groupBy("of", "key", "id", "hash", "look", "size").agg(F.count("*").alias("rows")).withColumn("sum", F.col("rows") * F.col("size"))
    last = where_it_ends(groups, ends, ["key", "id", "hash", "look"], "sum")
    fit = F.floor((F.col("budget") - F.col("before")) / F.col("size") + 0.5).cast("long")
    last = cut(last.select("of", "key", "id", "hash", "look", F.least(fit, "rows").alias("fit")))
    tied = near.join(last.where("fit > 0").drop("fit"), ["of", "key", "id", "hash", "look"], "left_semi").withColumn("range", F.pmod("tie", F.lit(TIES)))
    ties = last.where("fit > 0").select("of", F.col("fit").alias("budget"), F.lit(0).cast("long").alias("before"))
    ties = cut(where_it_ends(tied.groupBy("of", "range").agg(F.count("*").alias("sum")), ties, ["range"], "sum").drop("sum"))
    at = Window.partitionBy("of").orderBy("tie", "row")
    final = tied.join(ties, ["of", "range"]).withColumn("n", F.row_number().over(at)).where(F.col("n") == F.col("budget") - F.col("before"))
    final = final.select("of", F.struct("range", "tie", "row").alias("tied"))
    return goal.join(last.select("of", F.struct("key", "id", "hash", "look").alias("last")), "of", "left").join(final, "of", "left")


def times(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Keyed rows with source_size, target and times: how often the mix takes each."""
    own, tie = F.struct("key", "id", "hash", "look"), F.struct(F.pmod("tie", F.lit(TIES)).alias("range"), F.col("tie"), F.col("row"))
    chosen = (F.col("size") > 0) & ((own < F.col("last")) | ((own == F.col("last")) & F.coalesce(tie <= F.col("tied"), F.lit(False))))
    out = rows.join(sources, "of")
    return out.withColumn("times", (F.col("epochs") + F.coalesce(chosen, F.lit(False)).cast("int")).cast("int"))


def taken(df: DataFrame, share: float = 1.5, most_epochs: int = 2, weight: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of each row."""
    rows = cut(keyed(df, weight))
    out = times(rows, cut(plan(rows, share, most_epochs)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix(df: DataFrame, share: float = 1.5, most_epochs: int = 2, weight: str | None = None) -> DataFrame:
    """The mix itself: rows of df, each as often as it is taken; same columns."""
    rows = cut(keyed(df, weight, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("kept")))  # row numbers hold in this table only, so texts are in it
    out = times(rows, cut(plan(rows, share, most_epochs)))
    return out.where("times > 0").select("kept", F.explode(F.sequence(F.lit(1), "times"))).select("kept.*")


ORACLE_SQL = rf"""
WITH k AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / greatest({LEAST_QUALITY}::DOUBLE, coalesce(1.0::DOUBLE - 4.0::DOUBLE * (length(text) - length(translate(text, '{SIGNS}', ''))) / greatest(length(text), 1), 1.0::DOUBLE)) AS key,
    coalesce(CAST(doc_id AS VARCHAR), '') AS id, md5(coalesce(text, '')) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM k GROUP BY source),
r AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) / weight AS ratio,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
      / CAST(sum(weight) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM s),
t AS (
  SELECT source, source_size,
    coalesce(least(CAST(2 * source_size AS DOUBLE), weight * (SELECT arg_min(level, ratio) FROM r WHERE ratio >= level)), 0.0::DOUBLE) AS target
  FROM r),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS budget,
    CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.id, k.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - k.size AS start
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN start + size / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
