"""Public intrusion datasets turned into flows: CICIDS2017 and UNSW-NB15 CSV files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.address import address_text
from flowrisk.constants import CICIDS_ALIASES, FLOW_COLUMNS, UNSW_ALIASES, UNSW_RAW_COLUMNS
from flowrisk.functions import normalize as N
from flowrisk.functions.barrier import computed_once
from flowrisk.operators.context import time_reversals, with_context
from flowrisk.session import stage
from flowrisk.sources.headers import header_groups, read_group
from flowrisk.sources.order import FILE_ORDER, head_rows, with_file_order


class _Fields:
    """Finds the columns of a raw frame by any of their accepted spellings."""

    def __init__(self, raw: DataFrame, aliases: dict[str, list[str]], keep: list[str]):
        self.headers = N.header_map([c for c in raw.columns if c not in keep])
        self.aliases = aliases

    def columns(self, name: str) -> list[Column]:
        keys = [N.header_key(a) for a in self.aliases[name]]
        return [F.col(f"`{self.headers[k]}`") for k in keys if k in self.headers]

    def require(self, *names: str) -> None:
        for name in names:
            if not self.columns(name):
                raise ValueError(f"dataset CSV lacks the column {name}")

    def text(self, name: str) -> Column:
        found = self.columns(name)
        return N.first_filled(found) if found else F.lit(None).cast("string")


def _typed(raw: DataFrame, keep: list[str], texts: dict[str, Column], numbers: list[str],
           ts: Column, parts: dict[str, Column], needed: list[str], failed: Column) -> DataFrame:
    """Typed columns, ``failed`` and ``error``: the first field that could not be accepted.

    One projection each for the texts, the parsed numbers and the typed values, so that nothing is
    parsed twice. ``parts`` refer to ``t_*`` texts, ``d_*`` numbers and ``ts``.
    """
    names = [n for n in parts if n not in ("timestamp", "label")]
    staged = raw.select(*keep, *[c.alias(f"t_{n}") for n, c in texts.items()])
    staged = staged.select("*", ts.alias("ts"),
                           *[N.as_double(f"t_{n}").alias(f"d_{n}") for n in numbers],
                           *[N.port_number(f"t_{n}").alias(f"d_{n}")
                             for n in ("src_port", "dst_port")])
    missing = F.coalesce(*[F.when(F.col(f"t_{n}").isNull(), F.lit(f"missing {n}")) for n in needed])
    staged = staged.select(*keep, *[c.alias(n) for n, c in parts.items()], failed.alias("failed"),
                           missing.alias("_missing"))
    error = F.coalesce("_missing", *[F.when(F.col(n).isNull(), F.lit(f"invalid {n}"))
                                     for n in names])
    return computed_once(staged.withColumn("error", error).drop("_missing"))


def normalize_cicids(raw: DataFrame, timestamp_format: str | None = None,
                     keep: list[str] = ()) -> DataFrame:
    """CICIDS2017 text columns to flows; durations are microseconds."""
    f = _Fields(raw, CICIDS_ALIASES, keep)
    f.require(*CICIDS_ALIASES)
    numbers = ["duration", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "syn", "rst"]

    def whole(name: str) -> Column:
        return N.accept_integer(F.col(f"d_{name}"))

    parts = {
        "ts_us": F.unix_micros("ts"), "timestamp": N.timestamp_text("t_timestamp", "ts"),
        "src_ip": address_text("t_src_ip"), "dst_ip": address_text("t_dst_ip"),
        "src_port": N.accept_port(F.col("d_src_port")),
        "dst_port": N.accept_port(F.col("d_dst_port")),
        "protocol": N.protocol("t_protocol"),
        "duration_ms": N.accept_number(F.col("d_duration"), 0.001),
        "packets": whole("fwd_packets") + whole("bwd_packets"),
        "bytes_sent": whole("fwd_bytes"), "bytes_received": whole("bwd_bytes"),
        "syn_count": whole("syn"), "rst_count": whole("rst"),
        "label": N.dataset_label("t_label"),
    }
    return _typed(raw, list(keep), {n: f.text(n) for n in CICIDS_ALIASES}, numbers,
                  N.timestamp("t_timestamp", timestamp_format), parts, list(CICIDS_ALIASES),
                  F.col("d_rst") > 0)


def normalize_unsw(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """UNSW-NB15 text columns to flows; times are epoch seconds, durations seconds."""
    f = _Fields(raw, UNSW_ALIASES, keep)
    required = [n for n in UNSW_ALIASES if n not in ("label", "attack_category")]
    f.require(*required)
    if not f.columns("label") and not f.columns("attack_category"):
        raise ValueError("dataset CSV lacks both label and attack_cat")
    texts = {n: f.text(n) for n in required}
    texts["state"] = F.upper(texts["state"])
    texts["label"] = F.coalesce(f.text("label"), f.text("attack_category"))
    numbers = ["duration", "src_packets", "dst_packets", "src_bytes", "dst_bytes"]

    def whole(name: str) -> Column:
        return N.accept_integer(F.col(f"d_{name}"))

    parts = {
        "ts_us": F.unix_micros("ts"), "timestamp": N.timestamp_text_utc("ts"),
        "src_ip": address_text("t_src_ip"), "dst_ip": address_text("t_dst_ip"),
        "src_port": N.accept_port(F.col("d_src_port")),
        "dst_port": N.accept_port(F.col("d_dst_port")),
        "protocol": N.protocol("t_protocol"),
        "duration_ms": N.accept_number(F.col("d_duration"), 1000.0),
        "packets": whole("src_packets") + whole("dst_packets"),
        "bytes_sent": whole("src_bytes"), "bytes_received": whole("dst_bytes"),
        "syn_count": F.lit(0).cast("bigint"),
        "rst_count": (F.col("t_state") == "RST").cast("bigint"),
        "label": N.dataset_label("t_label"),
    }
    needed = [n for n in texts if n not in ("src_port", "dst_port")]
    return _typed(raw, list(keep), texts, numbers,
                  F.timestamp_micros(N.epoch_us("t_timestamp")), parts, needed,
                  F.col("t_state").isin("REQ", "RST"))


def reject_rows(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects with their reason."""
    return (normalized.filter(F.col("error").isNull()).drop("error"),
            normalized.filter(F.col("error").isNotNull()))


def strict_rows(normalized: DataFrame) -> DataFrame:
    """The first bad row fails the job."""
    place = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in FILE_ORDER[1:3]
             if c in normalized.columns]
    message = F.concat_ws(" ", F.lit("bad row:"), F.col("error"), *place)
    return normalized.filter(F.when(F.col("error").isNull(), F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean"))).drop("error")


def in_time_order(valid: DataFrame, order: list[str],
                  block: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows in order, and those older than a row before them in their source, with the reason.

    The text is parsed once into a columnar table; the passes that follow read the columns they need.
    """
    checked = time_reversals(stage(valid, "normalized"), ["src_ip"], seq=order, block=block)
    reason = F.concat(F.lit("time runs backwards in source "), F.col("src_ip"))
    helpers = ["reversed", "previous_ts"]
    return (checked.filter(~F.col("reversed")).drop(*helpers),
            checked.filter("reversed").drop(*helpers).withColumn("error", reason))


def contextualize(valid: DataFrame, order: list[str], block: list[str] | None = None) -> DataFrame:
    """60-second context in arrival order. A source whose time runs backwards fails the job."""
    rows = stage(valid, "normalized")
    checked = time_reversals(rows, ["src_ip"], seq=order, block=block)
    bad = checked.filter("reversed").select("src_ip").first()
    if bad:
        raise ValueError(f"time runs backwards in source {bad[0]}")
    return with_context(rows, ["src_ip"], seq=order, failed=F.col("failed"))


def _by_key(raw: DataFrame) -> DataFrame:
    """Columns under their normalised names, so that files with different headers go together."""
    names = N.header_map([c for c in raw.columns if c not in FILE_ORDER])
    return raw.select(*[F.col(f"`{c}`").alias(k) for k, c in names.items()], *FILE_ORDER)


def _joined(groups: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)


def read_cicids(spark: SparkSession, path: str) -> DataFrame:
    """Files may differ in the order and the spelling of their columns."""
    groups = []
    for header, files in sorted(header_groups(spark, path).items()):
        N.header_map(list(header))
        groups.append(_by_key(with_file_order(read_group(spark, files))))
    return _joined(groups)


def read_unsw(spark: SparkSession, path: str) -> DataFrame:
    """With headers, or without one in the official layout of 49 columns."""
    groups, plain = [], []
    for header, files in sorted(header_groups(spark, path).items()):
        if {"srcip", "dstip", "stime"} <= {N.header_key(v) for v in header}:
            N.header_map(list(header))
            groups.append(_by_key(with_file_order(read_group(spark, files))))
        elif len(header) == len(UNSW_RAW_COLUMNS):
            plain += files
        else:
            raise ValueError(f"a file without header must have {len(UNSW_RAW_COLUMNS)} columns, "
                             f"this one has {len(header)}")
    if plain:
        schema = ", ".join(f"`{c}` STRING" for c in UNSW_RAW_COLUMNS)
        groups.append(_by_key(with_file_order(spark.read.schema(schema).csv(sorted(plain)))))
    return _joined(groups)


def _normalized(spark: SparkSession, dataset: str, path: str, timestamp_format: str | None,
                max_rows: int | None) -> DataFrame:
    if max_rows is not None and max_rows <= 0:
        raise ValueError("max_rows must be positive")
    if dataset not in ("cicids2017", "unsw-nb15"):
        raise ValueError(f"unknown dataset {dataset}")
    if dataset == "unsw-nb15" and timestamp_format:
        raise ValueError("timestamp_format is for cicids2017 only")
    raw = read_cicids(spark, path) if dataset == "cicids2017" else read_unsw(spark, path)
    if max_rows is not None:
        raw = head_rows(raw, max_rows)
    return (normalize_cicids(raw, timestamp_format, FILE_ORDER) if dataset == "cicids2017"
            else normalize_unsw(raw, FILE_ORDER))


def read_dataset(spark: SparkSession, dataset: str, path: str, timestamp_format: str | None = None,
                 max_rows: int | None = None) -> DataFrame:
    """Flows with context from one public dataset; the first bad row fails the job."""
    rows = strict_rows(_normalized(spark, dataset, path, timestamp_format, max_rows))
    return contextualize(rows, FILE_ORDER, FILE_ORDER[:3]).select(*FLOW_COLUMNS, *FILE_ORDER)


def read_dataset_with_rejects(spark: SparkSession, dataset: str, path: str,
                              timestamp_format: str | None = None,
                              max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(flows with context, rejected rows with ``error`` and their place in the files)."""
    rows = stage(_normalized(spark, dataset, path, timestamp_format, max_rows), "normalized")
    valid, bad = reject_rows(rows)
    good, late = in_time_order(valid, FILE_ORDER, FILE_ORDER[:3])
    flows = with_context(good, ["src_ip"], seq=FILE_ORDER, failed=F.col("failed"))
    return (flows.select(*FLOW_COLUMNS, *FILE_ORDER),
            bad.unionByName(late).select(*FILE_ORDER, "src_ip", "timestamp", "error"))
