"""Line dedup by distinct-site spread.

A line that many sites carry is boilerplate. Lines are compared trimmed of white space; blank ones don't count, others do
whatever their length (`min_words` raises that). For each line hash a HyperLogLog sketch of its sites is built where the rows are and merged by
aggregation. Sketches far from the threshold decide; lines whose estimate is within `band` of it get an exact distinct
count. Lines on `min_sites` sites or more are removed, wherever they stand.

Copies are for document-level dedup: a text that as a whole stands on `min_sites` sites or more is left whole, and so is a
document of which no other line would be left. All others lose such lines, whatever their share.

Everything is DataFrame functions. Texts are grouped by their MD5, so repeated rows are judged alike, and the line tables
hold hashes and positions, not text. Null texts stay null and have no lines; a null site counts as no site; null ids and
other columns don't matter. A document keeps its other lines in order, joined by line feeds; n_chars, where there is such
a column of numbers, is set anew. A column of the caller named as `into` gives way to the count, so ask for another name to
keep it. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm._spark import cut

MIN_SITES, MIN_WORDS, LOG_SIZE, BAND = 6, 1, 12, 0.25
TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, TRIM, "")


def exploded(df: DataFrame, min_words: int) -> DataFrame:
    """A row for each line that counts: text hash, position, line hash, site."""
    lines = df.where(F.col("text").isNotNull()).select("site", F.md5(F.col("text").cast("binary")).alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = lines.withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    if min_words > 1:
        line = line.where(F.size(F.split("line", r"[\x20\x09-\x0D]+")) >= min_words)
    return line.select("doc", "pos", F.md5(F.col("line").cast("binary")).alias("hash"), "site")


def spread(lines: DataFrame, min_sites: int, band: float = BAND, log_size: int = LOG_SIZE) -> DataFrame:
    """Hashes of lines on min_sites sites or more."""
    sketches = lines.where(F.col("site").isNotNull()).groupBy("hash").agg(F.hll_sketch_agg("site", log_size).alias("sketch"))
    guessed = sketches.select("hash", F.hll_sketch_estimate("sketch").alias("n")).where(F.col("n") >= min_sites * (1 - band))
    guessed = cut(guessed)
    near = guessed.where(F.col("n") < min_sites * (1 + band)).select("hash")
    exact = lines.join(near, "hash", "left_semi").groupBy("hash").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites)
    return guessed.where(F.col("n") >= min_sites * (1 + band)).select("hash").unionByName(exact.select("hash"))


def boilerplate(df: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc (MD5 of a text), n (its lines on many sites) and mask (a byte for each line as far as the last of them, "1" where it is
    one), for texts that have any and are not on many sites as a whole."""
    lines = cut(exploded(df, min_words))
    hits = lines.join(spread(lines, min_sites), "hash", "left_semi")
    places = hits.groupBy("doc", "pos").agg(F.countDistinct("site").alias("sites"))
    cuts = places.where(F.col("sites") < min_sites).groupBy("doc").agg(F.array_sort(F.collect_list("pos")).alias("cuts"))
    before = F.concat(F.array(F.lit(-1)), F.slice("cuts", 1, F.size("cuts") - 1))
    mask = F.array_join(F.zip_with("cuts", before, lambda c, p: F.concat(F.repeat(F.lit("0"), c - p - 1), F.lit("1"))), "")
    return cuts.select("doc", F.size("cuts").cast("long").alias("n"), mask.cast("binary").alias("mask"))


def remove_boilerplate(df: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, into: str = "n_removed") -> DataFrame:
    """df with cleaned texts and, in the column `into`, the number of lines removed."""
    slim = df.select("text", F.col(site).alias("site"))
    cuts = cut(boilerplate(slim, min_sites, min_words))  # a table, so that the join can split a text with many copies
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.md5(F.col("text").cast("binary")).alias("doc")).join(cuts, "doc", "left")
    text = F.col("row.text")
    kept = F.filter(F.split(text, "\n"), lambda x, i: F.substring("mask", i + 1, 1) != F.lit(bytearray(b"1")))
    clear = F.col("mask").isNotNull() & F.exists(kept, lambda x: trimmed(x) != "")
    out = rows.withColumn("new", F.when(clear, F.array_join(kept, "\n"))).withColumn("clear", F.col("new").isNotNull())
    columns = []
    for c, t in df.dtypes:
        own = F.col(f"row.`{c}`")
        anew = {"text": F.col("new"), "n_chars": F.length("new").cast(t) if t in ("bigint", "int") else own}.get(c, own)
        columns += [F.when(F.col("clear"), anew).otherwise(own).alias(c)] if c != into else []
    return out.select(*columns, F.when(F.col("clear"), F.col("n")).otherwise(0).cast("long").alias(into))


ORACLE_SQL = rf"""
WITH e AS (
  SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
l AS (
  SELECT *, regexp_replace(raw, '{TRIM}', '', 'g') AS line FROM e),
c AS (
  SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
copied AS (
  SELECT text FROM documents GROUP BY text HAVING count(DISTINCT source) >= {MIN_SITES}),
g AS (
  SELECT l.doc_id, l.text, count(c.line) AS n, bool_or(c.line IS NULL AND l.line <> '') AND l.text NOT IN (SELECT text FROM copied) AS clear,
    coalesce(string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE c.line IS NULL), '') AS kept
  FROM l LEFT JOIN c ON l.line = c.line GROUP BY l.doc_id, l.text)
SELECT doc_id, CASE WHEN clear THEN n ELSE 0 END AS n_removed, md5(CASE WHEN clear THEN kept ELSE text END) AS kept_md5 FROM g
"""
