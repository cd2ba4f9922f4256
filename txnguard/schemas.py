"""Declared schemas. Nothing is inferred at read time."""

from __future__ import annotations

# Field and column names, types and lengths of the records and tables below.
FEATURE_NAMES = [f"V{i}" for i in range(1, 29)] + ["Amount", "Time"]

RAW_RECORD = "key binary, value binary, timestamp timestamp"

# Scalars are read as text first so that a wrong type can be told from a missing value.
TRANSACTION_TEXT = (
    "id string, userId string, cardNumber string, amount string, currency string, merchantId string, "
    "country string, status string, eventTime string, mlFeatures string"
)
TRANSACTION_FIELDS = [
    "id", "userId", "cardNumber", "amount", "currency", "merchantId", "country", "status", "eventTime", "mlFeatures",
]

RULE = (
    "ruleId string, ruleName string, enabled boolean, thresholdAmount double, thresholdAmountHigh double, "
    "windowSeconds int, minOccurrences int, severity string"
)
RULE_FIELDS = [
    "ruleId", "ruleName", "enabled", "thresholdAmount", "thresholdAmountHigh", "windowSeconds", "minOccurrences",
    "severity",
]

CARD_CSV = "Time double, " + ", ".join(f"V{i} double" for i in range(1, 29)) + ", Amount double, Class int"

REGISTRY = "version string, auroc double, auprc double, trained_at timestamp, model_file string, status string"
ACTIVATION = "version string, activated_at timestamp"

# Stored tables: column -> (type, nullable, maximum text length or None).
TRANSACTIONS_TABLE = {
    "id": ("string", False, 36),
    "user_id": ("string", False, 50),
    "card_number": ("string", False, 30),
    "amount": ("decimal(12,2)", False, None),
    "currency": ("string", False, 3),
    "merchant_id": ("string", True, 50),
    "country": ("string", True, 2),
    "status": ("string", False, 20),
    "event_time": ("timestamp", False, None),
    "ingested_at": ("timestamp", True, None),
}
ALERTS_TABLE = {
    "id": ("string", False, 36),
    "transaction_id": ("string", False, 36),
    "user_id": ("string", False, 50),
    "pattern_id": ("string", False, 10),
    "pattern_name": ("string", False, 100),
    "severity": ("string", False, 10),
    "amount": ("decimal(12,2)", False, None),
    "description": ("string", True, None),
    "source": ("string", False, 10),
    "ml_probability": ("decimal(6,4)", True, None),
    "detected_at": ("timestamp", True, None),
}


def ddl(table: dict) -> str:
    return ", ".join(f"{name} {kind}" for name, (kind, _, _) in table.items())
