"""Connection snapshots: collected JSON, netstat text and process lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.constants import NETSTAT_STATES
from flowrisk.functions.normalize import strip
from flowrisk.schema import CONNECTION
from flowrisk.sources.order import FILE_ORDER, with_file_order


def clean_connections(raw: DataFrame) -> DataFrame:
    """Defaults for missing values; rows without a remote port are no connections."""
    def filled(name: str, default) -> Column:
        column = F.col(name)
        if isinstance(default, str):
            column = F.nullif(column, F.lit(""))
        return F.coalesce(column, F.lit(default)).alias(name)

    defaults = {"local_address": "", "local_port": 0, "remote_address": "", "remote_port": 0,
                "state": "Unknown", "owning_process": 0, "process_name": "unknown"}
    extra = [c for c in raw.columns if c not in defaults and c != "_corrupt_record"]
    return raw.select(*extra, *[filled(n, d) for n, d in defaults.items()]).filter(
        F.col("remote_port") > 0)


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON files, each one an object or an array of objects."""
    texts = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return parse_connection_json(texts, "value", [c for c in texts.columns if c != "value"])


def parse_connection_json(texts: DataFrame, column: str, keep: list[str] = ()) -> DataFrame:
    """The same from a text column. Broken JSON and ports that are no numbers fail the job; elements
    that are no objects are skipped, and numbers may be written as text."""
    text = strip(F.regexp_replace(column, "^\ufeff", ""))
    listed = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    fields = ", ".join(f"`{f.name}` string" for f in CONNECTION)
    elements = texts.filter(text != "").select(*keep, F.explode(F.from_json(
        listed, "array<string>", {"mode": "FAILFAST"})).alias("_element"))
    objects = elements.filter(strip("_element").startswith("{")).select(
        *keep, F.from_json("_element", fields, {"mode": "FAILFAST"}).alias("_row"))

    def typed(field):
        value = F.nullif(F.col(f"_row.{field.name}"), F.lit(""))
        return value.cast(field.dataType).alias(field.name)

    return clean_connections(objects.select(*keep, *map(typed, CONNECTION)))


def endpoint(text: Column) -> tuple[Column, Column]:
    """Address and port around the last colon, brackets removed."""
    return (F.btrim(F.regexp_extract(text, r"^(.*):(\d+)$", 1), F.lit("[]")),
            F.nullif(F.regexp_extract(text, r"^(.*):(\d+)$", 2), F.lit("")).try_cast("bigint"))


def parse_netstat(lines: DataFrame, column: str = "value", keep: list[str] = ()) -> DataFrame:
    """TCP connections from netstat output lines; other lines are skipped."""
    fields = F.split(strip(column), r"\s+")
    parts = lines.filter(F.size(fields) == 5).select(*keep, fields.alias("f")).filter(
        (F.upper(F.col("f")[0]) == "TCP") & (F.upper(F.col("f")[3]) != "LISTENING"))
    local, remote = endpoint(F.col("f")[1]), endpoint(F.col("f")[2])
    names = F.create_map(*[F.lit(x) for pair in NETSTAT_STATES.items() for x in pair])
    state = F.coalesce(F.try_element_at(names, F.upper(F.col("f")[3])), F.col("f")[3])
    rows = parts.select(
        *keep, local[0].alias("local_address"), local[1].alias("local_port"),
        remote[0].alias("remote_address"), remote[1].alias("remote_port"), state.alias("state"),
        F.col("f")[4].try_cast("bigint").alias("owning_process"))
    return rows.filter("local_port is not null and remote_port > 0 and owning_process is not null")


def parse_processes(raw: DataFrame, order: list[str], name: str = "_c0", pid: str = "_c1",
                    per: list[str] = ()) -> DataFrame:
    """pid -> process name; rows without a numeric pid are skipped, the last one along ``order`` wins.

    ``per`` are columns, such as the host, within which a pid is a pid.
    """
    rows = raw.select(*per, *order, F.col(pid).try_cast("bigint").alias("pid"), F.col(name).alias("process_name"))
    return (rows.filter(F.col("pid").isNotNull()).groupBy(*per, "pid")
            .agg(F.max_by("process_name", F.struct(*order)).alias("process_name")))


def read_processes(spark: SparkSession, path: str) -> DataFrame:
    """Files are taken in the order in which they were written."""
    rows = spark.read.schema("_c0 string, _c1 string").csv(path, header=False)
    return parse_processes(with_file_order(rows), FILE_ORDER)


def as_snapshots(connections: DataFrame) -> DataFrame:
    """What the tracker needs from collected connections with ``host``, ``snapshot_no`` and ``ts_us``."""
    rows = connections.withColumnRenamed("owning_process", "pid")
    names = ["local_address", "local_port", "remote_address", "remote_port", "state", "pid"]
    named = F.col("process_name") if "process_name" in rows.columns else F.lit("unknown")
    return rows.select("host", F.col("snapshot_no").cast("bigint").alias("snapshot_no"),
                       F.col("ts_us").cast("bigint").alias("ts_us"), *names, named.alias("process_name"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Collected polls as JSON files in folders ``host=.../snapshot_no=.../ts_us=...``."""
    return as_snapshots(read_connections(spark, path))


def read_netstat(spark: SparkSession, path: str) -> DataFrame:
    """Columns that the folders name, such as the host, are kept."""
    lines = spark.read.text(path)
    return parse_netstat(lines, keep=[c for c in lines.columns if c != "value"])


def name_processes(connections: DataFrame, processes: DataFrame, pid: str = "owning_process",
                   on: list[str] = ()) -> DataFrame:
    """Left lookup of the process name, 'unknown' where there is none.

    No broadcast is forced: the optimizer broadcasts the list when its size allows it.
    """
    names = processes.withColumnRenamed("pid", pid)
    return connections.join(names, [*on, pid], "left").withColumn(
        "process_name", F.coalesce("process_name", F.lit("unknown")))
