"""Addresses in long lists of networks: the longest prefix that holds each."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.net import ipv4_number
from flowlens.tables import cut


def _bits6(address: Column) -> Column:
    def number(text: str | None) -> str | None:
        try:
            return format(int(ipaddress.IPv6Address(text)), "0128b")
        except (ValueError, TypeError):
            return None

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(number)

    return read(address)


def bits(address: Column, six: bool = True) -> Column:
    """An address as a text of 32 or 128 zeros and ones; null for what is no address."""
    four = F.lpad(F.bin(ipv4_number(address)), 32, "0")
    return F.coalesce(four, F.when(address.contains(":"), _bits6(address))) if six else four


def longest_prefix(df: DataFrame, column: str, networks: DataFrame, six: bool = True) -> DataFrame:
    """df with network and prefix_len, the longest of networks (network, as `address/length`) that holds the address in `column`, null
    where none does. Host bits of a network don't count; networks that can't be read are passed over, of equal ones the least text counts.

    Networks are keyed by length and leading bits; each different address meets them by equality, once for every length that the list has
    (162 at most), so the list may be of any size and an address may be as frequent as it likes. six: whether there are IPv6 addresses."""
    parts = F.split("network", "/")
    length = F.expr("try_cast(get(split(network, '/'), 1) AS INT)")
    read = networks.select("network", bits(parts[0], six).alias("_bits"), length.alias("prefix_len")).where("_bits is not null and prefix_len between 0 and length(_bits)")
    read = read.groupBy(F.length("_bits").alias("_family"), "prefix_len", F.expr("substring(_bits, 1, prefix_len)").alias("_head")).agg(F.min("network").alias("network"))
    read = cut(read)
    lengths = read.select("_family", "prefix_len").distinct().collect()  # 33 of IPv4 and 129 of IPv6 at most
    of = lambda family: F.array(*(F.lit(n) for n in sorted(r["prefix_len"] for r in lengths if r["_family"] == family))).cast("array<int>")
    addresses = df.select(F.col(column).alias("_address")).distinct().withColumn("_bits", bits(F.col("_address"), six)).where("_bits is not null").withColumn("_family", F.length("_bits"))
    heads = addresses.select("_address", "_bits", "_family", F.explode(F.when(F.col("_family") == 32, of(32)).otherwise(of(128))).alias("prefix_len"))
    heads = heads.withColumn("_head", F.expr("substring(_bits, 1, prefix_len)"))
    held = heads.join(read, ["_family", "prefix_len", "_head"]).groupBy("_address").agg(F.max(F.struct("prefix_len", "network")).alias("_best"))
    held = cut(held.select("_address", "_best.network", "_best.prefix_len"))  # a table, so that the join can split a frequent address
    return df.join(held, F.col(column) == F.col("_address"), "left").drop("_address")
