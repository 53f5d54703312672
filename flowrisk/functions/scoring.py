"""Features, rules, model score and hybrid risk as column expressions.

Everything is built-in and free of lambdas, so scoring is one projection inside whole-stage code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.constants import (AUTH_PORTS, FEATURE_NAMES, HIGH_RISK_PORTS, MODEL_REASON,
                                QUIET_REASON, RULE_REASONS, RULE_SCORES, SUSPICIOUS_PORTS)
from flowrisk.functions.model import BASELINE, LinearModel

FEATURE_COLUMNS = [f"f_{name}" for name in FEATURE_NAMES]


def bytes_total() -> Column:
    return F.col("bytes_sent") + F.col("bytes_received")


def feature_columns() -> dict[str, Column]:
    per_packet = F.greatest(F.col("packets"), F.lit(1)).cast("double")
    return {
        "duration_ms": F.col("duration_ms").cast("double"),
        "packets": F.col("packets").cast("double"),
        "bytes_total": bytes_total().cast("double"),
        "avg_packet_bytes": bytes_total() / per_packet,
        "syn_ratio": F.col("syn_count") / per_packet,
        "rst_ratio": F.col("rst_count") / per_packet,
        "unique_dst_ports_60s": F.col("unique_dst_ports_60s").cast("double"),
        "connections_60s": F.col("connections_60s").cast("double"),
        "failed_connections_60s": F.col("failed_connections_60s").cast("double"),
        "high_risk_port": F.col("dst_port").isin(HIGH_RISK_PORTS).cast("double"),
    }


def with_features(df: DataFrame) -> DataFrame:
    """Add the ten features as ``f_*`` columns."""
    return df.withColumns({f"f_{name}": c for name, c in feature_columns().items()})


def rule_conditions() -> dict[str, Column]:
    ports, conns = F.col("unique_dst_ports_60s"), F.col("connections_60s")
    return {
        "PORT_SCAN": (ports >= 20) & (conns >= 20),
        "BRUTE_FORCE": F.col("dst_port").isin(AUTH_PORTS) & (F.col("failed_connections_60s") >= 10),
        "CONNECTION_FLOOD": (conns >= 200) | (F.col("syn_count") >= 100),
        "DATA_SPIKE": (bytes_total() >= 50_000_000) & (F.col("duration_ms") <= 60_000),
        "SUSPICIOUS_PORT": F.col("dst_port").isin(SUSPICIOUS_PORTS),
    }


def with_rules(df: DataFrame) -> DataFrame:
    """Add one boolean ``h_*`` column per rule, so that every rule is tested once."""
    return df.withColumns({f"h_{rule}": hit for rule, hit in rule_conditions().items()})


def _per_hit(item, kind: str) -> Column:
    """An array with ``item(rule)`` for every rule that holds, in rule order."""
    return F.concat(*[F.when(F.col(f"h_{rule}"), F.array(item(rule))).otherwise(
        F.array().cast(f"array<{kind}>")) for rule in RULE_SCORES])


def rule_ids() -> Column:
    """Needs the ``h_*`` columns, as do the next three."""
    return _per_hit(F.lit, "string")


def rule_reasons() -> Column:
    return _per_hit(lambda rule: F.lit(RULE_REASONS[rule]), "string")


def rule_evidence() -> Column:
    return _per_hit(lambda rule: F.struct(
        F.lit(rule).alias("rule_id"), F.lit(RULE_SCORES[rule]).alias("score"),
        F.lit(RULE_REASONS[rule]).alias("reason")),
        "struct<rule_id:string,score:double,reason:string>")


def rule_score() -> Column:
    return F.greatest(*[F.when(F.col(f"h_{rule}"), F.lit(score)).otherwise(F.lit(0.0))
                        for rule, score in RULE_SCORES.items()])


def _standardized(model: LinearModel) -> list[Column]:
    return [(F.col(f"f_{n}") - F.lit(m)) / F.lit(s)
            for n, m, s in zip(FEATURE_NAMES, model.means, model.scales)]


def contributions(model: LinearModel) -> list[Column]:
    return [F.lit(w) * x for w, x in zip(model.weights, _standardized(model))]


def model_probability(model: LinearModel) -> Column:
    """Needs the ``f_*`` columns."""
    logit = F.lit(model.bias) + reduce(lambda a, b: a + b, contributions(model))
    # greatest and least skip NULL: an unknown feature must not look like a certain attack.
    bounded = F.when(logit.isNotNull(), F.greatest(F.least(logit, F.lit(40.0)), F.lit(-40.0)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-bounded))


def with_explanation(df: DataFrame, model: LinearModel, limit: int = 3) -> DataFrame:
    """Add ``top_features``, the strongest contributions by rounded size, then name.

    Needs the ``f_*`` columns. Sorting an array of structs keeps this inside generated code, and only
    the chosen entries get their other numbers rounded, which is the costly part.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    parts = df.withColumns({f"_c_{n}": F.round(c, 6)
                            for n, c in zip(FEATURE_NAMES, contributions(model))})
    entries = [F.struct(
        (-F.abs(F.col(f"_c_{name}"))).alias("order"), F.lit(name).alias("name"),
        F.col(f"f_{name}").alias("value"), x.alias("standardized_value"),
        F.lit(round(weight, 6)).alias("weight"), F.col(f"_c_{name}").alias("contribution"),
        F.when(F.lit(weight) * x >= 0, "raises_risk").otherwise("lowers_risk").alias("direction"))
        for name, weight, x in zip(FEATURE_NAMES, model.weights, _standardized(model))]
    ranked = parts.withColumn("_ranked", F.sort_array(F.array(*entries)))
    rounded = ("value", "standardized_value")
    fields = ("name", "value", "standardized_value", "weight", "contribution", "direction")

    def entry(i: int) -> Column:
        picked = F.col("_ranked")[i]
        return F.struct(*[(F.round(picked[f], 6) if f in rounded else picked[f]).alias(f)
                          for f in fields])

    top = F.array(*[entry(i) for i in range(min(limit, len(FEATURE_NAMES)))])
    return ranked.withColumn("top_features", top).drop(
        "_ranked", *[f"_c_{n}" for n in FEATURE_NAMES])


# Features that can have a fraction; the others are whole numbers and need no rounding.
FRACTIONAL = {"duration_ms", "avg_packet_bytes", "syn_ratio", "rst_ratio"}


def feature_snapshot() -> Column:
    return F.struct(*[(F.round(f"f_{n}", 6) if n in FRACTIONAL else F.col(f"f_{n}")).alias(n)
                      for n in FEATURE_NAMES])


def check_threshold(threshold: float) -> None:
    if not 0.0 < threshold < 1.0:
        raise ValueError("threshold must be between 0 and 1")


def with_scores(df: DataFrame, model: LinearModel = BASELINE,
                threshold: float = 0.60) -> DataFrame:
    """Add the unrounded ``p_model``, ``p_rule`` and ``p_risk``, ``severity`` and ``is_alert``."""
    check_threshold(threshold)
    scored = with_rules(with_features(df)).withColumns(
        {"p_model": model_probability(model), "p_rule": rule_score()})
    mixed = F.greatest(F.lit(0.70) * F.col("p_model") + F.lit(0.30) * F.col("p_rule"),
                       F.col("p_rule") * F.lit(0.90))
    known = F.col("p_model").isNotNull() & F.col("p_rule").isNotNull()
    scored = scored.withColumn("p_risk", F.when(known, F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0))))
    risk = F.col("p_risk")
    return scored.withColumns({
        "severity": F.when(risk >= 0.85, "critical").when(risk >= 0.70, "high")
                     .when(risk >= threshold, "medium").when(risk.isNotNull(), "info"),
        "is_alert": risk >= threshold,
    })


def reasons(threshold: float) -> Column:
    """Needs ``p_model``, ``p_rule`` and the ``h_*`` columns."""
    return (F.when(F.col("p_rule") > 0, rule_reasons())
            .when(F.col("p_model") >= threshold, F.array(F.lit(MODEL_REASON)))
            .otherwise(F.array(F.lit(QUIET_REASON))))


def detections(df: DataFrame, model: LinearModel = BASELINE, threshold: float = 0.60,
               keep: list[str] = (), explain: int = 3) -> DataFrame:
    """Scored rows with their evidence; ``keep`` carries extra input columns along."""
    scored = with_explanation(with_scores(df, model, threshold), model, explain)
    return scored.select(
        *keep, "timestamp", "src_ip", "dst_ip", "dst_port", "protocol",
        F.round("p_model", 4).alias("model_score"), F.round("p_rule", 4).alias("rule_score"),
        F.round("p_risk", 4).alias("risk_score"), "severity", "is_alert",
        reasons(threshold).alias("reasons"), rule_ids().alias("rule_ids"),
        rule_evidence().alias("rule_evidence"),
        "top_features",
        F.lit(model.algorithm).alias("model_algorithm"),
        F.lit(model.version).alias("model_version"),
        feature_snapshot().alias("feature_snapshot"))
