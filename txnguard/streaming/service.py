"""The whole streaming job: records in, rules kept up to date, patterns and model scored, alerts and rows out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from txnguard import schemas
from txnguard.config import Config
from txnguard.functions import alerts as A
from txnguard.functions import decode as D
from txnguard.functions.conform import conform
from txnguard.ml import registry, train
from txnguard.operators import patterns as P
from txnguard.operators import scoring
from txnguard.operators.merge import dedupe_first
from txnguard.sources.sinks import (
    ALERT_BATCH, TRANSACTION_BATCH, jdbc_insert_or_ignore, jdbc_options, send_alert_records,
)
from txnguard.sources.tables import PARTITIONS, utc_date, with_date
from txnguard.streaming import jobs, live_rules


class QualityListener(StreamingQueryListener):
    """Adds up the valid and malformed counts that decoding observes, over all micro-batches."""

    def __init__(self, name: str = "decode"):
        self.name = name
        self.valid = 0
        self.malformed = 0
        self.attached = False

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.valid += row.valid
            self.malformed += row.malformed

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


@dataclass
class ActiveModel:
    """The active model, looked up once per micro-batch and loaded only when the version changed."""

    root: str
    version: str | None = None
    _loaded: tuple = field(default=(None, None), repr=False)

    def get(self, spark: SparkSession):
        row = registry.active_version(spark, self.root)
        if row is None:
            return None
        if row.version != self.version:
            self._loaded = train.load(spark, self.root, row.version)
            self.version = row.version
        return self.version, *self._loaded


@dataclass
class Service:
    """Settings of one deployment. ``out`` holds the tables, ``checkpoint`` the progress and state of each query. With
    ``live_rules`` all patterns follow the rule records while they run, otherwise P002 alone does."""

    spark: SparkSession
    out: str
    checkpoint: str
    rules: dict[str, P.PatternRule] = field(default_factory=lambda: dict(P.BUILTIN))
    model_root: str | None = None
    cfg: Config | None = None
    threshold: float = 0.5
    delay: str = jobs.DELAY
    available_now: bool = True
    interval_ms: int = 30_000
    send_to_topic: bool = False
    to_database: bool = False
    live_rules: bool = False
    quality: QualityListener = field(default_factory=QualityListener)

    @property
    def rule_table(self) -> str:
        return f"{self.out}/rules"

    def start_rules(self, records: DataFrame) -> StreamingQuery:
        """Rule changes become rows of the rule table; the record position orders them."""
        seq = F.col("offset") if "offset" in records.columns else F.unix_micros("timestamp")
        raw = records.select("key", "value", F.col("timestamp").alias("rule_ts"), seq.alias("rule_seq"))
        rows = D.decode_rules(raw).select(*[c.split()[0] for c in jobs.RULE_TABLE.split(", ")])
        return jobs.to_files(rows, self.rule_table, f"{self.checkpoint}/rules", self.available_now, self.interval_ms)

    def transactions(self, records: DataFrame) -> DataFrame:
        arrival = F.col("offset") if "offset" in records.columns else F.unix_micros("timestamp")
        valid, _ = D.decode_transactions(records.withColumn("arrival", arrival).select("key", "value", "timestamp", "arrival"))
        return D.with_event_ms(valid)

    def write_alerts(self, alerts: DataFrame, name: str, batch_id: int) -> None:
        """One computed batch, two sinks: the alert table and the outgoing records. The batch with all that made it, state
        and scores included, is computed once."""
        found = A.write_defaults(alerts.select(*A.ALERT_COLUMNS)).persist()
        try:
            rows, rejected = conform(found, schemas.ALERTS_TABLE, {"detected_at": F.current_timestamp()})
            path = f"{self.out}/alerts/query={name}"
            dated = with_date(rows).persist()
            rows = jobs.first_stored(dated, path, batch_id, "detected_date", ("transaction_id",), near=1).persist()
            jobs.write_batch(rows, path, batch_id, PARTITIONS)
            rows = rows.drop("detected_date")
            jobs.write_batch(rejected, f"{self.out}/rejected_alerts/query={name}", batch_id)
            if self.send_to_topic:
                send_alert_records(rows, self.cfg)
            else:
                send_alert_records(rows, path=f"{self.out}/alert_records/query={name}/batch_id={batch_id}")
            if self.to_database:
                jdbc_insert_or_ignore(rows, "fraud_alerts", name, batch_id, jdbc_options(self.cfg), ALERT_BATCH)
            dated.unpersist()
            rows.unpersist()
        finally:
            found.unpersist()

    def _each(self, df: DataFrame, name: str, handle) -> StreamingQuery:
        return jobs.each_batch(df, handle, f"{self.checkpoint}/{name}", self.available_now, self.interval_ms)

    def start_card_patterns(self, txns: DataFrame) -> StreamingQuery:
        found = jobs.sequence_stream(txns, "card_number", jobs.card_stages(self.rules), self.delay)
        return self._each(
            jobs.sequence_alerts(found, self.rules), "card", lambda b, i: self.write_alerts(b, "card", i)
        )

    def start_user_patterns(self, txns: DataFrame) -> StreamingQuery:
        found = jobs.sequence_stream(txns, "user_id", jobs.user_stages(self.rules), self.delay)
        return self._each(
            jobs.sequence_alerts(found, self.rules), "user", lambda b, i: self.write_alerts(b, "user", i)
        )

    def start_new_country(self, txns: DataFrame, ttl_ms: int | None = None) -> StreamingQuery:
        def handle(batch: DataFrame, batch_id: int) -> None:
            log = jobs.rule_log(batch.sparkSession, self.rule_table)
            with jobs.computed_once(batch):
                self.write_alerts(jobs.new_country_alerts(batch, log), "country", batch_id)

        return self._each(jobs.first_seen_stream(txns, ttl_ms), "country", handle)

    def start_live_patterns(self, txns: DataFrame, rule_records: DataFrame, key: str, name: str) -> StreamingQuery:
        """The patterns of one key under rules that change meanwhile; ``rules`` hold until a pattern's first version."""
        seq = F.col("offset") if "offset" in rule_records.columns else F.unix_micros("timestamp")
        raw = rule_records.select("key", "value", F.col("timestamp").alias("rule_ts"), seq.alias("rule_seq"))
        base = {k: r for k, r in self.rules.items() if k != "P002"}
        found = live_rules.live_matches(txns, D.decode_rules(raw), key, base, {**P.BUILTIN, **self.rules}, delay=self.delay)
        return self._each(live_rules.live_alerts(found), name, lambda b, i: self.write_alerts(b, name, i))

    def start_model(self, txns: DataFrame) -> StreamingQuery:
        """Scores with the version active when the micro-batch starts; without one, nothing is scored."""
        active = ActiveModel(self.model_root)

        def handle(batch: DataFrame, batch_id: int) -> None:
            found = active.get(batch.sparkSession)
            if found is None:
                return
            version, model, scale = found
            scored = scoring.score(batch, model, scale, self.threshold, version)
            self.write_alerts(A.model_alerts(scored, self.threshold), "model", batch_id)

        return self._each(txns, "model", handle)

    def start_transactions(self, records: DataFrame) -> StreamingQuery:
        """Every valid transaction, whether it alerts or not; malformed and unstorable rows go to their own tables."""
        arrival = F.col("offset") if "offset" in records.columns else F.unix_micros("timestamp")
        seen = D.observe_quality(D.classify_transactions(records.withColumn("arrival", arrival)))

        def handle(batch: DataFrame, batch_id: int) -> None:
            batch.persist()
            try:
                valid = batch.filter(F.col("reason").isNull())
                valid = valid.withColumn("event_time", F.coalesce("event_time", "timestamp"))
                rows, rejected = conform(valid, schemas.TRANSACTIONS_TABLE, {"ingested_at": F.current_timestamp()}, ("arrival",))
                path = f"{self.out}/transactions"
                rows = rows.withColumn("event_date", utc_date(F.col("event_time")))
                new = jobs.first_stored(rows, path, batch_id, "event_date").drop("arrival")
                jobs.write_batch(new, path, batch_id, ("event_date",))
                if self.to_database:
                    staged = dedupe_first(rows, "id", ("arrival",)).drop("event_date")
                    jdbc_insert_or_ignore(staged, "transactions", "transactions", batch_id, jdbc_options(self.cfg), TRANSACTION_BATCH)
                jobs.write_batch(rejected.select("id", "reject_reason"), f"{self.out}/rejected_transactions", batch_id)
                malformed = batch.filter(F.col("reason").isNotNull()).select("value", "timestamp", "reason")
                jobs.write_batch(malformed, f"{self.out}/malformed", batch_id)
            finally:
                batch.unpersist()

        return self._each(seen, "transactions", handle)

    def start_all(self, records: DataFrame, rule_records: DataFrame | None = None) -> dict[str, StreamingQuery]:
        """Each part is its own query with its own checkpoint, so one can fail and restart alone."""
        queries = {}
        if not self.quality.attached:
            self.spark.streams.addListener(self.quality)
            self.quality.attached = True
        if rule_records is not None:
            queries["rules"] = self.start_rules(rule_records)
            if self.available_now:
                queries["rules"].awaitTermination()
        txns = self.transactions(records)
        if self.live_rules and rule_records is not None:
            queries["card"] = self.start_live_patterns(txns, rule_records, "card_number", "card")
            queries["user"] = self.start_live_patterns(txns, rule_records, "user_id", "user")
        else:
            if jobs.card_stages(self.rules):
                queries["card"] = self.start_card_patterns(txns)
            if jobs.user_stages(self.rules):
                queries["user"] = self.start_user_patterns(txns)
            queries["country"] = self.start_new_country(txns)
        if self.model_root:
            queries["model"] = self.start_model(txns)
        queries["transactions"] = self.start_transactions(records)
        return queries
