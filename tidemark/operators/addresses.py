"""Literal addresses against a table of address ranges of any size: a range join by equality.

An address is a string of bits (32, or 128 for IPv6), a range the first bits of its network. Each distinct address is cut at the lengths that the table has
(at most 33 and 129), and what is cut joins the ranges by equality; so the work is a hash join however many ranges there are, in place of comparing each
address with each range. IPv4 addresses inside IPv6 ones (``::ffff:1.2.3.4``) count as IPv4. Text that is no address has no bits and is in no range.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.web import BLOCKED_V4, url_host

#: IPv6 ranges that are never fetched.
BLOCKED_V6 = ("::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8")


def blocked_ranges(spark: SparkSession) -> DataFrame:
    """The ranges that are never fetched, as a table ``(cidr)``."""
    return spark.createDataFrame([(f"{network}/{n}",) for network, n in BLOCKED_V4] + [(c,) for c in BLOCKED_V6], "cidr string")


def with_bits(df: DataFrame, column: str, out: str = "bits") -> DataFrame:
    """Adds the bits of an IPv4 or IPv6 address (with or without brackets and zone), null for any other text. Called on distinct texts; in Arrow batches, since
    the steps of reading an IPv6 address as one column expression repeat each other so often that planning it takes a minute."""

    @F.pandas_udf("string")
    def bits(texts: pd.Series) -> pd.Series:
        import ipaddress

        def one(text: str | None) -> str | None:
            try:
                a = ipaddress.ip_address((text or "").strip().removeprefix("[").removesuffix("]").split("%")[0])
            except ValueError:
                return None
            a = getattr(a, "ipv4_mapped", None) or a
            return f"{int(a):0{a.max_prefixlen}b}"

        return texts.map(one, na_action=None).astype(object).where(lambda x: x.notna(), None)

    return df.withColumn(out, bits(F.col(column)))


def range_bits(ranges: DataFrame) -> DataFrame:
    """``(cidr, family, length, head)`` of the ranges that are well formed."""
    length = F.expr("try_cast(substring_index(cidr, '/', -1) as int)")
    df = with_bits(ranges.select("cidr", F.substring_index("cidr", "/", 1).alias("network"), length.alias("length")), "network").withColumn("family", F.length("bits"))
    return df.where("length between 0 and family").select("cidr", "family", "length", F.expr("left(bits, length)").alias("head"))


def ranges_of(addresses: DataFrame, ranges: DataFrame, column: str = "address") -> DataFrame:
    """``(address, cidr)``: the narrowest range of ``ranges(cidr)`` that each distinct address lies in; no row for one that lies in none."""
    heads = range_bits(ranges)
    lengths = heads.select("family", "length").distinct()  # at most 33 + 129 rows
    wanted = {f: sorted(r["length"] for r in lengths.collect() if r["family"] == f) for f in (32, 128)}
    cuts = F.when(F.length("bits") == 32, F.array(*map(F.lit, wanted[32])).cast("array<int>")).otherwise(F.array(*map(F.lit, wanted[128])).cast("array<int>"))
    cut = addresses.select(F.col(column).alias("address")).distinct()
    cut = with_bits(cut, "address").where("bits is not null")
    cut = cut.select("address", F.length("bits").alias("family"), F.explode(cuts).alias("length"), "bits").withColumn("head", F.expr("left(bits, length)"))
    found = cut.join(heads, ["family", "length", "head"])
    return found.groupBy("address").agg(F.max(F.struct("length", "cidr"))["cidr"].alias("cidr"))


def literal_host(url: Column) -> Column:
    """The host of an HTTP(S) address; of a bracketed IPv6 one what stands between the brackets."""
    six = F.lower(F.regexp_extract(url, r"(?i)^\s*https?://(?:[^/?#@]*@)?\[([^\]/]*)\]", 1))
    return F.when(six != "", six).otherwise(url_host(url))


def fetchable_urls(urls: DataFrame, allowed: DataFrame, ranges: DataFrame | None = None, resolved: DataFrame | None = None) -> DataFrame:
    """Rows of ``urls(url, ...)`` that are HTTP(S), whose host is among ``allowed(host)``, and which lead to no address of ``ranges(cidr)`` (the blocked ones if
    it is not given): neither the host itself nor any address that ``resolved(host, address)`` has for it. A resolved text that is no address is refused."""
    ranges = blocked_ranges(urls.sparkSession) if ranges is None else ranges
    df = urls.withColumn("host", literal_host(F.col("url"))).where("host is not null").join(allowed.select("host").distinct(), "host", "left_semi")
    hosts = df.select("host").distinct()
    leads = with_bits(hosts.withColumn("address", F.col("host")), "address").where("bits is not null")
    if resolved is not None:
        leads = leads.unionByName(with_bits(resolved.select("host", "address").distinct(), "address"))
    bad = leads.join(ranges_of(leads, ranges), "address", "left").where("cidr is not null or bits is null").select("host").distinct()
    return df.join(bad, "host", "left_anti")
