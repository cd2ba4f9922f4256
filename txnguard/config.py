"""Settings, each read from the environment with a default; blank counts as unset."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# Names and defaults a deployment already relies on.
ENV_DEFAULTS = {
    "kafka_bootstrap": ("KAFKA_BOOTSTRAP", "localhost:9093"),
    "transactions_topic": ("TRANSACTIONS_TOPIC", "transactions"),
    "rules_topic": ("RULES_TOPIC", "fraud-rules"),
    "alerts_topic": ("ALERTS_TOPIC", "fraud-alerts"),
    "jdbc_url": ("PG_URL", "jdbc:postgresql://localhost:5433/frauddb"),
    "jdbc_user": ("PG_USER", "frauduser"),
    "jdbc_password": ("PG_PASSWORD", "fraudpass"),
    "ml_threshold": ("ML_THRESHOLD", "0.5"),
    "checkpoint_interval_ms": ("CHECKPOINT_INTERVAL", "30000"),
}


@dataclass(frozen=True)
class Config:
    kafka_bootstrap: str
    transactions_topic: str
    rules_topic: str
    alerts_topic: str
    jdbc_url: str
    jdbc_user: str
    jdbc_password: str
    ml_threshold: float
    checkpoint_interval_ms: int

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Config":
        env = os.environ if env is None else env
        values = {}
        for f in fields(cls):
            name, default = ENV_DEFAULTS[f.name]
            text = env.get(name) or ""
            values[f.name] = text if text.strip() else default
        values["ml_threshold"] = float(values["ml_threshold"])
        values["checkpoint_interval_ms"] = int(values["checkpoint_interval_ms"])
        return cls(**values)
