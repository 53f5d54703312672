import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from flowrisk.operators import response as R
from flowrisk.functions.address import address_text
from flowrisk.sources.allowlist import allowlist_ranges, default_networks, networks, parse_networks, read_allowlist

def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")



def targets(spark, *addresses):
    return spark.createDataFrame([(a,) for a in addresses], "src_ip string")


def test_plan_protects_local_and_allowlisted_addresses(spark, tmp_path):
    path = tmp_path / "allow.txt"
    path.write_text("﻿# office\n\n198.51.100.7/24  # host bits\n2001:db8:1::/48\n", encoding="utf-8")
    networks = read_allowlist(spark, str(path))
    names = {r.network for r in networks.collect()}
    assert names >= {"198.51.100.0/24", "2001:db8:1::/48", "10.0.0.0/8", "fc00::/7"} and len(names) == 10
    given = ["8.8.8.8", "8.8.8.8", "2001:0DB8:2::1", "192.168.1.1", "198.51.100.9", "2001:db8:1::5",
             "0.0.0.0", "::", "224.0.0.9", "127.0.0.5", "::1", "fe80::1", "ff02::1", "nonsense",
             "198.51.101.1"]
    plan = {r.remote_address: r for r in R.block_plan(targets(spark, *given), networks, 600, now())
            .collect()}
    assert set(plan) == {"8.8.8.8", "2001:db8:2::1", "198.51.101.1"}
    one = plan["8.8.8.8"]
    assert one.names == [one.name + "-In", one.name + "-Out"]
    assert (one.created_at, one.expires_at) == ("2026-01-01T00:00:00+00:00",
                                                "2026-01-01T00:10:00+00:00")
    refused = {r.given: r.reason for r in R.rejected_targets(targets(spark, *given), networks)
               .collect()}
    assert refused["nonsense"] == "not an address" and refused["192.168.1.1"] == "allowlisted"
    assert refused["::1"] == "local or multicast" and len(refused) == 11
    longest = {r.given: r.network for r in R.rejected_targets(targets(spark, *given), networks).collect()}
    assert (longest["2001:db8:1::5"], longest["::1"], longest["nonsense"]) == ("2001:db8:1::/48", "::1/128", None)
    fresh = R.new_blocks(spark.createDataFrame([("a",), ("b",)], "name string"),
                         spark.createDataFrame([("a",)], "name string"))
    assert [r.name for r in fresh.collect()] == ["b"]
    for seconds in (59, 86401):
        with pytest.raises(ValueError, match="60 to 86400"):
            R.check_duration(seconds)


def holds(net, address):
    return net.version == address.version and address in net


def test_longest_prefix_agrees_with_ipaddress(spark):
    rng = random.Random(4)
    four = [f"{rng.choice([10, 11, 203])}.{rng.randrange(3)}.{rng.randrange(3)}.{rng.randrange(256)}" for _ in range(200)]
    six = [f"2001:db8:{rng.randrange(3):x}:{rng.randrange(3):x}::{rng.randrange(65536):x}" for _ in range(200)]
    names = [f"{a}/{rng.randint(6, 32)}" for a in four[:80]] + [f"{a}/{rng.randint(20, 128)}" for a in six[:80]] + ["0.0.0.0/1", "::/0"]
    nets = [ipaddress.ip_network(n, strict=False) for n in names]
    seen = targets(spark, *four, *six, "200.1.1.1").withColumn("_bits", R.address_bits("src_ip"))
    got = {r.src_ip: r.network for r in seen.join(R.longest_matches(seen, networks(spark, names)), "_bits", "left").collect()}
    for text, network in got.items():
        held = [n for n in nets if holds(n, ipaddress.ip_address(text))]
        assert network == (str(max(held, key=lambda n: n.prefixlen)) if held else None)


def test_a_large_allowlist_is_a_table(spark):
    rows_ = spark.range(20_000).select(F.concat(F.lit("100."), (F.col("id") % 256).cast("string"), F.lit("."),
                                                F.expr("id div 256").cast("string"), F.lit(".0/24")).alias("value"))
    found = R.block_plan(targets(spark, "100.255.77.9", "100.1.79.1", "100.1.90.1", "101.1.1.1"), parse_networks(rows_), 600, now())
    assert sorted(r.remote_address for r in found.collect()) == ["100.1.79.1", "100.1.90.1", "101.1.1.1"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "100.1." not in plan


def test_allowlist_lines(spark):
    given = ["1.2.3.4/30", "5.6.7.8", "9.9.9.9/255.255.0.0 # mask", "9.8.0.1/0.0.255.255", "0.0.0.0/0", "::ffff:1.2.3.4", "FE80::1/64"]
    found = {r.network: (r.version, r.lo, r.hi) for r in allowlist_ranges(networks(spark, [*given, "", "  # none"])).collect()}
    want = [ipaddress.ip_network(g.split("#")[0].strip(), strict=False) for g in given]
    assert found == {str(n): (n.version, format(int(n.network_address), "08x" if n.version == 4 else "032x"),
                              format(int(n.broadcast_address), "08x" if n.version == 4 else "032x")) for n in want}
    assert default_networks(spark).count() == 8
    for wrong in ("300.1.1.1", "1.2.3.4/33", "1.2.3.4/8/8", "::1/129", "name", "1.2.3.4/255.0.255.0", "/8", "1.2.3.4/"):
        with pytest.raises(Exception, match="invalid network"):
            networks(spark, [wrong]).collect()


def test_address_text_agrees_with_ipaddress(spark):
    rng = random.Random(7)
    texts = ["::", "::1", "1::", "::ffff:1.2.3.4", "::1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1::2::3", ":::",
             "1:", ":1::", "12345::", "g::", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "%e", "01.2.3.4", "256.1.1.1", "1:2:3:4:5:6:1.2.3.4",
             "1:2:3:4:5:6:7:1.2.3.4", "1.2.3.4::", "0:0:1:0:0:0:1:0", "0:0:1:1:0:0:1:1", "1:2:0:4:5:6:7:8", "::/0", " ::1", "", ":", "::01.2.3.4", None]
    for _ in range(1500):
        groups = [rng.choice(["0", "0", "0000", "1", "ab", "0ABC", "ffff"]) for _ in range(rng.randint(0, 9))]
        at = rng.randint(0, len(groups))
        texts.append(":".join(groups) if rng.random() < .4 else ":".join(groups[:at]) + "::" + ":".join(groups[at:]))

    def expected(text):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return None, None
        return str(address), format(int(address), "032b" if address.version == 4 else "0128b")

    df = targets(spark, *texts).select("src_ip", address_text("src_ip").alias("text"), R.address_bits("src_ip").alias("bits"))
    assert {r.src_ip: (r.text, r.bits) for r in df.collect()} == {t: expected(t) for t in texts}
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_only_expired_managed_rules_are_selected(spark):
    p = R.RULE_PREFIX
    data = [(p + "old", [p + "old-In"], "2025-12-31T23:59:00+00:00"),
            (p + "naive", None, "2025-12-31T23:59:00"), (p + "new", [p + "new-In"],
                                                        "2026-01-01T00:10:00+00:00"),
            ("foreign", ["foreign"], "2025-01-01T00:00:00+00:00"), (p + "odd", None, "soon"),
            (p + "mixed", [p + "x", "foreign"], "2025-01-01T00:00:00+00:00")]
    ledger = spark.createDataFrame(data, "name string, names array<string>, expires_at string")
    assert sorted(r.name for r in R.expired_blocks(ledger, now()).collect()) == [p + "naive", p + "old"]
