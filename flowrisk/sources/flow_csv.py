"""The engine's own flow CSV: strict on read, fixed column order on write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowrisk.constants import FLOW_COLUMNS
from flowrisk.functions.normalize import timestamp
from flowrisk.sources.headers import header_groups, read_group

_CASTS = {
    "src_port": "int", "dst_port": "int", "duration_ms": "double", "packets": "bigint",
    "bytes_sent": "bigint", "bytes_received": "bigint", "syn_count": "bigint",
    "rst_count": "bigint", "unique_dst_ports_60s": "bigint", "connections_60s": "bigint",
    "failed_connections_60s": "bigint",
}


def check_columns(names: list[str]) -> None:
    missing = sorted(set(FLOW_COLUMNS) - {"label"} - set(names))
    if missing:
        raise ValueError(f"flow CSV lacks columns: {', '.join(missing)}")


def parse_flow_rows(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Typed flows from text columns. A value that is missing or no number fails the job (ANSI casts)."""
    check_columns(raw.columns)

    def typed_column(name: str):
        text = F.col(name)
        value = text.cast(_CASTS[name]) if name in _CASTS else F.upper(text) if name == "protocol" else text
        empty = F.raise_error(F.lit(f"flow CSV: a row lacks {name}")).cast(_CASTS.get(name, "string"))
        return F.when(text.isNull(), empty).otherwise(value).alias(name)

    label = F.col("label") if "label" in raw.columns else F.lit(None).cast("string")
    return raw.select(*keep, *map(typed_column, FLOW_COLUMNS[:-1]),
                      F.nullif(label, F.lit("")).alias("label"))


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flows with ``seq``, a number that rises along a file, and ``ts_us`` (naive times are UTC).

    Files may list the columns in different orders. An empty field or an unreadable time fails the job. The
    number is not dense: no pass over the data is needed to give it out.
    """
    groups = []
    for header, files in sorted(header_groups(spark, path).items()):
        check_columns(list(header))
        raw = read_group(spark, files)
        groups.append(raw.select(*[F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c)
                                   for c in FLOW_COLUMNS]))
    raw = reduce(DataFrame.unionByName, groups).withColumn("seq", F.monotonically_increasing_id())
    flows = parse_flow_rows(raw, ["seq"])
    ts = F.unix_micros(timestamp("timestamp"))
    unreadable = F.raise_error(F.concat(F.lit("flow CSV: no time: "), F.col("timestamp"))).cast("bigint")
    return flows.withColumn("ts_us", F.coalesce(ts, unreadable))


def write_flow_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write and return the number of rows, counted during the write."""
    seen = Observation()
    (df.select(*FLOW_COLUMNS).observe(seen, F.count(F.lit(1)).alias("rows"))
     .write.mode(mode).csv(path, header=True, nullValue="", emptyValue=""))
    return seen.get["rows"]
