"""Allowlists of networks as tables, one row a network, of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.constants import DEFAULT_ALLOWLIST
from flowrisk.functions.address import address_bits, bits_hex, ipv4_from_number, ipv4_number, ipv6_from_hex, let
from flowrisk.functions.barrier import computed_once


def _mask_length(mask: Column) -> Column:
    """The prefix length that a dotted net mask or host mask stands for; NULL if it is neither."""
    ones = lambda low: F.when(low.bitwiseAND(low + 1) == 0, F.when(low == 0, 32).otherwise(32 - F.length(F.bin(low))))
    return let(ipv4_number(mask), lambda n: F.coalesce(ones(F.lit(4294967295) - n), ones(n)))


def parse_networks(lines: DataFrame, column: str = "value") -> DataFrame:
    """(network, width, length, head) of the distinct networks in lines of text.

    '#' starts a comment, blank lines count for nothing, host bits may be set, a mask may be a length or dotted, and
    an address without one is a network of its own. ``head`` is the network's leading bits as text, ``length`` of the
    address's ``width`` (32 or 128). Any other line fails the job.
    """
    entry = F.btrim(F.regexp_replace(F.substring_index(column, "#", 1), "^\ufeff+", ""), F.lit(" \t\r\n\f\x0b"))
    rows = computed_once(lines.select(entry.alias("entry")).filter("entry <> ''"))
    mask = F.when(F.col("entry").contains("/"), F.substring_index("entry", "/", -1))
    single = F.length(F.regexp_replace("entry", "[^/]", "")) <= 1
    rows = computed_once(rows.select("entry", mask.alias("mask"), F.when(single, address_bits(F.substring_index("entry", "/", 1))).alias("bits")))
    width = F.length("bits")
    length = (F.when(F.col("mask").isNull(), width).when(F.col("mask").rlike("^[0-9]{1,9}$"), F.col("mask").try_cast("int"))
              .when(width == 32, _mask_length(F.col("mask"))))
    rows = computed_once(rows.select("entry", "bits", width.alias("width"), length.alias("length")))
    wrong = F.raise_error(F.concat(F.lit("invalid network in the allowlist: "), F.col("entry"))).cast("string")
    head = F.when(F.col("length") <= F.col("width"), F.substring(F.col("bits"), F.lit(1), F.col("length"))).otherwise(wrong)
    rows = computed_once(rows.select("width", "length", head.alias("head"))).distinct()
    bits = F.rpad("head", F.col("width"), F.lit("0"))
    text = F.when(F.col("width") == 32, ipv4_from_number(F.conv(bits, 2, 10).cast("bigint"))).otherwise(ipv6_from_hex(bits_hex(bits)))
    return rows.select(F.concat(text, F.lit("/"), F.col("length").cast("string")).alias("network"), "width", "length", "head")


def networks(spark: SparkSession, names: list[str]) -> DataFrame:
    return parse_networks(spark.createDataFrame([(n,) for n in names], "value string"))


def default_networks(spark: SparkSession) -> DataFrame:
    return networks(spark, DEFAULT_ALLOWLIST)


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """The default networks and those of the files under ``path``."""
    return default_networks(spark).unionByName(parse_networks(spark.read.text(path))).distinct()


def allowlist_ranges(networks: DataFrame) -> DataFrame:
    """(version, network, lo, hi) with the bounds as fixed-width hexadecimal text, which sorts
    like the address and holds both versions."""
    def bound(digit: str) -> Column:
        return bits_hex(F.rpad("head", F.col("width"), F.lit(digit)))

    return networks.select(F.when(F.col("width") == 32, 4).otherwise(6).alias("version"), "network",
                           bound("0").alias("lo"), bound("1").alias("hi"))
