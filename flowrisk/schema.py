"""Fixed schemas: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from flowrisk.constants import FEATURE_NAMES

_S, _I, _L, _D, _B = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(),
                      T.BooleanType())


def _struct(fields: dict) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FEATURES = _struct({name: _D for name in FEATURE_NAMES})

DETECTION = _struct({
    "timestamp": _S, "src_ip": _S, "dst_ip": _S, "dst_port": _I, "protocol": _S,
    "model_score": _D, "rule_score": _D, "risk_score": _D, "severity": _S, "is_alert": _B,
    "reasons": T.ArrayType(_S), "rule_ids": T.ArrayType(_S),
    "rule_evidence": T.ArrayType(_struct({"rule_id": _S, "score": _D, "reason": _S})),
    "top_features": T.ArrayType(_struct({
        "name": _S, "value": _D, "standardized_value": _D, "weight": _D, "contribution": _D,
        "direction": _S})),
    "model_algorithm": _S, "model_version": _S, "feature_snapshot": FEATURES,
})

# Monitor rows carry the process too.
ALERT = T.StructType(DETECTION.fields + _struct({
    "src_port": _I, "process_id": _L, "process_name": _S, "connection_state": _S,
    "direction": _S}).fields)

CONNECTION = _struct({
    "local_address": _S, "local_port": _L, "remote_address": _S, "remote_port": _L, "state": _S,
    "owning_process": _L, "process_name": _S})

PENDING = _struct({"alert_id": _S, "label": _S, "note": _S, "review_status": _S, "created_at": _S})

REVIEWED = _struct({
    "schema_version": _S, "alert_id": _S, "feedback_label": _S, "decision": _S, "reviewer": _S,
    "reviewed_at": _S, "source_model_version": _S, "training_label": _I, "features": FEATURES})

BLOCK = _struct({
    "name": _S, "names": T.ArrayType(_S), "remote_address": _S, "duration_seconds": _L,
    "created_at": _S, "expires_at": _S})

PACKET = _struct({"file": _S, "pkt_no": _L, "ts_us": _L, "link_type": _I, "frame": T.BinaryType()})
