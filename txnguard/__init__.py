"""Transaction-risk analytics on Spark: patterns, changing rules, scoring, training and monitoring."""

from txnguard.config import Config
from txnguard.functions.alerts import to_alert, to_records
from txnguard.functions.conform import conform
from txnguard.functions.decode import decode_rules, decode_transactions
from txnguard.ml.metrics import classification_report, ranking_metrics
from txnguard.ml.registry import activate
from txnguard.ml.train import save, train
from txnguard.operators import monitor
from txnguard.operators.detect import detect_all
from txnguard.operators.merge import dedupe_first, new_rows
from txnguard.operators.patterns import (
    BUILTIN, RULES_FILE, PatternRule, fail_then_success, match_sequence, midrange_velocity, new_country, rapid_small,
)
from txnguard.operators.rules import new_country_dynamic, rule_as_of, rule_current
from txnguard.operators.scoring import score, score_linear, score_python
from txnguard.sources.sinks import insert_or_ignore, jdbc_insert_or_ignore
from txnguard.streaming.jobs import first_seen_stream, sequence_stream, stream_session
from txnguard.streaming.service import Service

__all__ = [
    "BUILTIN", "RULES_FILE", "Config", "PatternRule", "Service", "activate", "classification_report", "conform",
    "decode_rules", "decode_transactions", "dedupe_first", "detect_all", "fail_then_success", "first_seen_stream",
    "insert_or_ignore", "jdbc_insert_or_ignore", "match_sequence", "midrange_velocity", "monitor", "new_country",
    "new_country_dynamic", "new_rows", "ranking_metrics", "rapid_small", "rule_as_of", "rule_current", "save", "score",
    "score_linear", "score_python", "sequence_stream", "stream_session", "to_alert", "to_records", "train",
]
