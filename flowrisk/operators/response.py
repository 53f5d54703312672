"""Review tables for temporary blocks. Nothing here changes a firewall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.functions.address import address_bits, address_text
from flowrisk.functions.barrier import computed_once
from flowrisk.functions.normalize import iso_text
from flowrisk.sources.allowlist import networks as named_networks

RULE_PREFIX = "flowrisk-block-"
LOCAL_NETWORKS = ["0.0.0.0/32", "224.0.0.0/4", "127.0.0.0/8", "169.254.0.0/16",
                  "::/128", "ff00::/8", "::1/128", "fe80::/10"]


def network_matches(addresses: DataFrame, networks: DataFrame, bits: str = "_bits") -> DataFrame:
    """(bits, length, network and other columns) of every network that holds an address.

    An address meets the networks by its first bits, once for each prefix length that occurs (at most 33 and 129),
    in one join on (width, head); the tables may be of any size.
    """
    lengths = {32: [], 128: []}
    for width, length in networks.select("width", "length").distinct().collect():
        lengths[width].append(length)
    heads = [F.when(F.length(bits) == width, F.transform(F.array(*map(F.lit, sorted(found))), lambda n: F.substring(F.col(bits), F.lit(1), n)))
             for width, found in lengths.items() if found]
    probes = (addresses.select(bits).distinct().filter(F.col(bits).isNotNull())
              .select(bits, F.length(bits).alias("width"), F.explode(F.coalesce(*heads, F.array().cast("array<string>"))).alias("head")))
    return probes.join(networks, ["width", "head"]).drop("width", "head")


def longest_matches(addresses: DataFrame, networks: DataFrame, bits: str = "_bits") -> DataFrame:
    """(bits, network): the network with the longest prefix that holds the address, if there is one."""
    best = F.max(F.struct("length", "network")).alias("best")
    return network_matches(addresses, networks, bits).groupBy(bits).agg(best).select(bits, F.col("best.network").alias("network"))


def check_duration(seconds: int) -> None:
    if not 60 <= seconds <= 86400:
        raise ValueError("a block lasts 60 to 86400 seconds")


def _local(spark) -> DataFrame:
    return named_networks(spark, LOCAL_NETWORKS).withColumn("local", F.lit(True))


def _candidates(targets: DataFrame, address: str) -> DataFrame:
    given = targets.select(F.col(address).alias("given")).distinct()
    return computed_once(given.withColumns({"remote_address": address_text("given"), "_bits": address_bits("given")}))


def block_plan(targets: DataFrame, networks: DataFrame, duration: int, created_at: Column,
               address: str = "src_ip", prefix: str = RULE_PREFIX) -> DataFrame:
    """One row per address that may be blocked, with its rule names and expiry.

    Local, multicast and allowlisted addresses are left out; ``networks`` is a table of ``sources.allowlist``.
    """
    check_duration(duration)
    closed = networks.unionByName(_local(targets.sparkSession).drop("local"))
    candidates = _candidates(targets, address).filter("remote_address is not null").select("remote_address", "_bits").distinct()
    open_to_block = candidates.join(network_matches(candidates, closed).select("_bits").distinct(), "_bits", "left_anti")
    name = F.concat(F.lit(prefix), F.substring(F.sha2("remote_address", 256), 1, 16))
    expires = F.timestamp_micros(F.unix_micros(created_at) + duration * 1_000_000)
    return open_to_block.select(
        name.alias("name"),
        F.array(F.concat(name, F.lit("-In")), F.concat(name, F.lit("-Out"))).alias("names"),
        "remote_address", F.lit(duration).cast("bigint").alias("duration_seconds"),
        F.concat(iso_text(created_at), F.lit("+00:00")).alias("created_at"),
        F.concat(iso_text(expires), F.lit("+00:00")).alias("expires_at"))


def rejected_targets(targets: DataFrame, networks: DataFrame, address: str = "src_ip") -> DataFrame:
    """Addresses that must not be blocked, with the reason and the longest network that holds them."""
    rows = _candidates(targets, address)
    closed = networks.withColumn("local", F.lit(False)).unionByName(_local(targets.sparkSession))
    held = network_matches(rows, closed).groupBy("_bits").agg(
        F.max("local").alias("local"), F.max(F.struct("length", "network")).alias("best"))
    reason = (F.when(F.col("remote_address").isNull(), "not an address").when(F.col("local"), "local or multicast")
              .when(~F.col("local"), "allowlisted"))
    return (rows.join(held, "_bits", "left").select("given", reason.alias("reason"), F.col("best.network").alias("network"))
            .filter("reason is not null"))


def new_blocks(plan: DataFrame, active: DataFrame) -> DataFrame:
    """One active block per address."""
    return plan.join(active.select("name").distinct(), "name", "left_anti")


def expired_blocks(ledger: DataFrame, now: Column, prefix: str = RULE_PREFIX) -> DataFrame:
    """Managed rules whose time is up. Times without a zone are UTC; unreadable ones stay."""
    names = F.when(F.coalesce(F.size("names"), F.lit(0)) > 0, F.col("names")).otherwise(
        F.array(F.coalesce("name", F.lit(""))))
    managed = F.forall(names, lambda n: n.startswith(prefix))
    return ledger.filter(managed & F.coalesce(
        F.col("expires_at").try_cast("timestamp") <= now, F.lit(False)))
