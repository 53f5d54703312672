"""Alert identity, search, the review queue and the training ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.constants import ALERT_ID_PATTERN, FEATURE_NAMES, SEVERITIES
from flowrisk.functions.barrier import computed_once

SEARCH_FIELDS = ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "severity",
                 "process_id", "process_name", "direction", "connection_state", "model_algorithm",
                 "model_version"]


def _fixed(value: Column, digits: int) -> Column:
    """A number as the text of a scaled integer: no exponent, the same in every engine."""
    return F.coalesce((F.round(value * 10 ** digits, 0)).cast("bigint").cast("string"), F.lit(""))


def alert_id() -> Column:
    """First 16 hex digits of the SHA-256 of the alert's fields in a fixed order and format.

    The canonical text is our own: ids identify alerts of this engine only.
    """
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    parts = [text(c) for c in ("timestamp", "src_ip", "dst_ip", "dst_port", "protocol")]
    parts += [_fixed(F.col(c), 4) for c in ("model_score", "rule_score", "risk_score")]
    parts += [text("severity"), F.coalesce(F.array_join("rule_ids", ","), F.lit("")),
              text("model_version")]
    parts += [_fixed(F.col(f"feature_snapshot.{n}"), 6) for n in FEATURE_NAMES]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def search_text(columns: list[str]) -> Column:
    """Lower-case text of the searchable fields that exist, reasons and rules."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEARCH_FIELDS if c in columns]
    lists = [F.array_join(c, " ") for c in ("reasons", "rule_ids") if c in columns]
    return F.lower(F.concat_ws(" ", *fields, *lists))


def search_alerts(alerts: DataFrame, severity: str = "", query: str = "") -> DataFrame:
    if severity and severity.lower() not in SEVERITIES:
        raise ValueError(f"unknown severity {severity}")
    if len(query) > 100:
        raise ValueError("the search text is longer than 100 characters")
    found = alerts
    if severity:
        found = found.filter(F.lower("severity") == severity.lower())
    if query.strip():
        found = found.filter(search_text(alerts.columns).contains(query.strip().lower()))
    return found


def last_alerts(alerts: DataFrame, limit: int = 500, order: list[str] = ("seq",)) -> DataFrame:
    """The newest ``limit`` rows, newest first; filter before."""
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be between 1 and 5000")
    return alerts.orderBy(*[F.desc(c) for c in order]).limit(limit)


def flag_feedback(alerts: DataFrame, pending: DataFrame) -> DataFrame:
    """Add ``has_feedback``: the alert's id is already in the queue."""
    ids = (pending.select("alert_id").filter(F.col("alert_id").rlike(ALERT_ID_PATTERN)).distinct()
           .withColumn("has_feedback", F.lit(True)))
    return alerts.join(ids, "alert_id", "left").withColumn(
        "has_feedback", F.coalesce("has_feedback", F.lit(False)))


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))


def last_per_key(df: DataFrame, key: list[str], order) -> DataFrame:
    """The last row of every key. The aggregate reduces a busy key before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
            .select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]))


def _request_error() -> Column:
    return (F.when(~F.coalesce(F.col("alert_id").rlike(ALERT_ID_PATTERN), F.lit(False)), "malformed alert id")
            .when(F.length(F.coalesce("note", F.lit(""))) > 240, "note longer than 240 characters"))


def new_feedback(requests: DataFrame, alerts: DataFrame, queue: DataFrame,
                 order: list[str] = ("created_at", "note")) -> DataFrame:
    """Requests that target a current alert and are not queued yet, as queue rows.

    The first request for an alert along ``order`` wins. ``rejected_feedback`` has the invalid ones.
    """
    first = requests.filter(_request_error().isNull()).groupBy("alert_id").agg(
        F.min_by(F.struct("note", "created_at"), F.struct(*order)).alias("_row"))
    return (first.join(alerts.select("alert_id"), "alert_id", "left_semi")
            .join(queue.select("alert_id"), "alert_id", "left_anti")
            .select("alert_id", F.lit("false_positive").alias("label"), "_row.note",
                    F.lit("pending").alias("review_status"), "_row.created_at"))


def rejected_feedback(requests: DataFrame, alerts: DataFrame) -> DataFrame:
    """Requests that cannot be queued, with the reason: malformed, too long, or for no current alert."""
    known = alerts.select(F.col("alert_id").alias("_known")).distinct()
    joined = requests.join(known, F.col("alert_id") == F.col("_known"), "left")
    error = F.coalesce(_request_error(), F.when(F.col("_known").isNull(), "no such alert"))
    return joined.withColumn("error", error).drop("_known").filter("error is not null")


def open_reviews(pending: DataFrame, order) -> DataFrame:
    """Pending rows with a well-formed id, the last one per id."""
    rows = pending.filter((F.col("review_status") == "pending")
                          & F.col("alert_id").rlike(ALERT_ID_PATTERN))
    return last_per_key(rows, ["alert_id"], order)


def missing_ids(selected: DataFrame, pending: DataFrame) -> DataFrame:
    """Selected ids that are not pending."""
    return selected.select("alert_id").distinct().join(
        pending.select("alert_id"), "alert_id", "left_anti")


def _snapshot_ok() -> Column:
    """All ten features are there and finite."""
    ok = F.col("feature_snapshot").isNotNull()
    for name in FEATURE_NAMES:
        value = F.col(f"feature_snapshot.{name}")
        ok = ok & F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))
    return ok


def review_entries(alerts: DataFrame, pending: DataFrame, reviewed: DataFrame, decision: str,
                   reviewer: str, reviewed_at: str, selected: DataFrame | None = None) -> DataFrame:
    """Ledger rows for the selected pending items that are not reviewed yet.

    Only the id, the decision and, for approvals, label and features are copied: no address, port,
    time or process. An item without its alert, an approval of another label or of incomplete
    features fails the job.
    """
    if decision not in ("approve", "reject"):
        raise ValueError("decision must be approve or reject")
    if not reviewer.strip() or len(reviewer) > 80:
        raise ValueError("reviewer must have 1 to 80 characters")
    todo = pending if selected is None else pending.join(
        selected.select("alert_id").distinct(), "alert_id", "left_semi")
    todo = todo.join(reviewed.select("alert_id"), "alert_id", "left_anti").select(
        "alert_id", F.coalesce("label", F.lit("")).alias("feedback_label"))
    # Alerts with one id agree in all fields that the id is made of, also in these.
    source = alerts.groupBy("alert_id").agg(
        F.max(F.struct("model_version", "feature_snapshot")).alias("_alert")).select(
        "alert_id", "_alert.model_version", "_alert.feature_snapshot", F.lit(True).alias("_found"))
    joined = todo.join(source, "alert_id", "left")
    problem = F.when(F.col("_found").isNull(), "no alert for this feedback")
    if decision == "approve":
        problem = (problem.when(F.col("feedback_label") != "false_positive",
                                "only false_positive can be approved")
                   .when(~_snapshot_ok(), "the alert lacks a complete feature snapshot"))
    checked = computed_once(joined.withColumn("_problem", problem)).filter(
        F.when(F.col("_problem").isNull(), F.lit(True)).otherwise(F.raise_error(
            F.concat_ws(" ", "_problem", "alert_id")).cast("boolean")))
    approved = decision == "approve"
    features = F.struct(*[F.col(f"feature_snapshot.{n}").cast("double").alias(n)
                          for n in FEATURE_NAMES])
    return checked.select(
        F.lit("1.0").alias("schema_version"), "alert_id", "feedback_label",
        F.lit(decision).alias("decision"), F.lit(reviewer.strip()).alias("reviewer"),
        F.lit(reviewed_at).alias("reviewed_at"),
        F.coalesce("model_version", F.lit("unknown")).alias("source_model_version"),
        F.lit(0 if approved else None).cast("int").alias("training_label"),
        (features if approved else F.lit(None).cast(features_type())).alias("features"))


def features_type() -> str:
    return "struct<" + ",".join(f"{n}:double" for n in FEATURE_NAMES) + ">"


def review_counters(pending: DataFrame, selected: DataFrame, reviewed: DataFrame) -> DataFrame:
    """One row: pending, selected, written and already reviewed ids."""
    known = reviewed.select("alert_id").filter(F.col("alert_id").rlike(ALERT_ID_PATTERN)).distinct()
    marks = [pending.select("alert_id", F.lit(1).alias("p"), F.lit(0).alias("s"), F.lit(0).alias("r")),
             selected.select("alert_id", F.lit(0), F.lit(1), F.lit(0)),
             known.select("alert_id", F.lit(0), F.lit(0), F.lit(1))]
    ids = marks[0].union(marks[1]).union(marks[2]).groupBy("alert_id").agg(
        F.max("p").alias("p"), F.max("s").alias("s"), F.max("r").alias("r"))
    return ids.agg(F.count_if(F.expr("p = 1")).alias("pending"), F.count_if(F.expr("s = 1")).alias("selected"),
                   F.count_if(F.expr("s = 1 and r = 0")).alias("written"),
                   F.count_if(F.expr("s = 1 and r = 1")).alias("already_reviewed"))


def ledger_duplicates(reviewed: DataFrame) -> DataFrame:
    """Approved ids that occur more than once."""
    return (reviewed.filter("decision = 'approve'").groupBy("alert_id")
            .agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))


def feedback_cap(base_rows: int, max_fraction: float = 0.20) -> int:
    if not 0.0 < max_fraction <= 0.5:
        raise ValueError("max_feedback_fraction must be in (0, 0.5]")
    return max(1, int(base_rows * max_fraction))


def id_digest(ids: DataFrame, column: str = "alert_id") -> DataFrame:
    """One digest of a set of ids, in two levels: ids sharing four leading digits are hashed in
    order, then the at most 65,536 digests. No task ever holds the whole list."""
    wrong = F.raise_error(F.concat(F.lit("no alert id: "), F.col(column))).cast("string")
    checked = F.when(F.col(column).rlike(ALERT_ID_PATTERN), F.col(column)).otherwise(wrong)
    groups = (ids.select(checked.alias("id")).groupBy(F.substring("id", 1, 4).alias("p"))
              .agg(F.count(F.lit(1)).alias("n"),
                   F.sha2(F.array_join(F.sort_array(F.collect_list("id")), "\n"), 256).alias("h")))
    return groups.agg(F.sum("n").alias("ids"), F.sha2(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "\n"), 256)
        .alias("digest"))




def canonical_text(value: Column, kind: T.DataType) -> Column:
    """One text for each value: '-' for null, else its length in bytes, ':' and its content.

    A struct's content is its fields by name, each as ``name=text``; an array's its number of elements and their
    texts; a number's is its shortest decimal text.
    """
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        content = F.concat(*[F.concat(F.lit(f"{f.name}="), canonical_text(value[f.name], f.dataType)) for f in fields])
    elif isinstance(kind, T.ArrayType):
        texts = F.transform(value, lambda x: canonical_text(x, kind.elementType))
        content = F.concat(F.size(value).cast("string"), F.array_join(texts, ""))
    else:
        content = value.cast("string")
    text = F.concat(F.octet_length(content).cast("string"), F.lit(":"), content)
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("-"))


def row_digest(rows: DataFrame) -> DataFrame:
    """(rows, digest) of a table with nested columns, whatever the order of its rows and columns.

    A tree of two levels: equal rows are one leaf with its count, leaves that share four leading digits are hashed in
    order, then the at most 65,536 digests. Leaves are uniform, so no task holds more than its share of the rows.
    """
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    text = F.concat(*[F.concat(F.lit(f"{f.name}="), canonical_text(F.col(f"`{f.name}`"), f.dataType)) for f in fields])
    leaves = rows.select(F.sha2(text, 256).alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat("leaf", F.lit(":"), F.col("n").cast("string"))
    groups = leaves.groupBy(F.substring("leaf", 1, 4).alias("p")).agg(
        F.sum("n").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("h"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))
