"""Registered queries: streams whose settings or state come from elsewhere while they run, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnguard.operators import patterns as P
from txnguard.plans import inputs
from txnguard.plans.inputs import TX_SQL, WIDE
from txnguard.plans.pattern_queries import ALERT, NEW_TEXT, P002_DYNAMIC_SQL, P002_SQL, alert_sql, changelog
from txnguard.streaming import jobs, live_rules
from txnguard.workdir import materialize, run_dir

# Versions (rule, enabled, amount, upper amount, window, times, day): each pattern changes once and is off for a while.
VERSIONS = [
    ("P001", True, 80.0, 0.0, 43_200, 3, 8), ("P001", False, 80.0, 0.0, 43_200, 3, 18), ("P001", True, 30.0, 0.0, 86_400, 2, 24),
    ("P002", True, 50.0, 0.0, 0, 0, 3), ("P002", False, 50.0, 0.0, 0, 0, 20), ("P002", True, 20.0, 0.0, 0, 0, 25),
    ("P003", False, 0.0, 0.0, 0, 0, 10), ("P003", True, 0.0, 0.0, 43_200, 1, 19),
    ("P004", True, 90.0, 400.0, 0, 3, 12), ("P004", False, 90.0, 400.0, 0, 3, 22),
]
HALF_DAY = 16
BASE = {k: r for k, r in WIDE.items() if k != "P002"}


def versions(spark: SparkSession) -> DataFrame:
    rows = [(f"2024-01-{day:02d}T00:00:00Z", k, i, e, a, h, w, n) for k, (i, e, a, h, w, n, day) in enumerate(VERSIONS)]
    df = spark.createDataFrame(
        rows, "at string, rule_seq long, rule_id string, enabled boolean, threshold_amount double, threshold_amount_high double, window_seconds int, min_occurrences int"
    )
    return df.select("*", F.lit(None).cast("string").alias("rule_name"), F.lit(None).cast("string").alias("severity"), F.to_timestamp("at").alias("rule_ts"))


def stream_rules_live(spark, d):
    """Alerts of all patterns while rules are changed, switched off and on: each half of the month arrives with its rule
    versions, and the streams are stopped in between."""
    own = jobs.stream_session(spark)
    base = run_dir(spark, "live")
    t, log = inputs.tx(spark, d), versions(spark)
    cut = F.lit(f"2024-01-{HALF_DAY}T00:00:00Z").cast("timestamp")
    for part in (True, False):
        log.filter((F.col("rule_ts") < cut) == part).write.mode("append").parquet(f"{base}/rules")
        t.filter((F.col("event_ms") < F.unix_millis(cut)) == part).write.mode("append").parquet(f"{base}/in")
        for key in ("card_number", "user_id"):
            txns, changes = own.readStream.schema(t.schema).parquet(f"{base}/in"), own.readStream.schema(log.schema).parquet(f"{base}/rules")
            found = live_rules.live_alerts(live_rules.live_matches(txns, changes, key, BASE, WIDE))
            jobs.to_files(found.select(*ALERT), f"{base}/{key}", f"{base}/checkpoint-{key}").awaitTermination()
    return spark.read.parquet(f"{base}/card_number").unionByName(spark.read.parquet(f"{base}/user_id"))


def halves(spark, d):
    """The table by arrival, in two parts."""
    t = inputs.tx(spark, d)
    middle = t.select(F.percentile_approx("arrival", 0.5, 1_000_000)).first()[0] or 0
    return t, t.filter(F.col("arrival") <= middle), t.filter(F.col("arrival") > middle)


def stream_p002_bootstrap(spark, d):
    """New-country alerts of the first half in a batch, whose pairs then fill the state of the stream over the second half."""
    base, own = run_dir(spark, "bootstrap"), jobs.stream_session(spark)
    t, first, second = halves(spark, d)
    P.first_in_country(first).write.parquet(f"{base}/known")
    known = spark.read.schema(t.schema).parquet(f"{base}/known")
    second.write.parquet(f"{base}/in")
    changelog(spark).write.parquet(f"{base}/rules")

    def handle(batch: DataFrame, batch_id: int) -> None:
        with jobs.computed_once(batch):
            jobs.write_batch(jobs.new_country_alerts(batch, batch.sparkSession.read.parquet(f"{base}/rules")).select(*ALERT), f"{base}/out", batch_id)

    history = own.read.schema(known.schema).parquet(f"{base}/known")
    rows = own.readStream.schema(t.schema).parquet(f"{base}/in")
    jobs.each_batch(jobs.first_seen_stream(rows, history=history), handle, f"{base}/checkpoint").awaitTermination()
    earlier = jobs.new_country_alerts(known.withColumn("amount", F.col("amount").cast("double")), changelog(spark)).select(*ALERT)
    return earlier.unionByName(spark.read.schema(earlier.schema).parquet(f"{base}/out").select(*ALERT))


def stream_state_audit(spark, d):
    """The pairs that the stopped new-country stream holds, read from its state after each half of the input, and the rows
    that it gave so far."""
    base, own = run_dir(spark, "audit"), jobs.stream_session(spark)
    t, *parts = halves(spark, d)
    out = []
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(f"{base}/in")
        rows = own.readStream.schema(t.schema).parquet(f"{base}/in")
        jobs.to_files(jobs.first_seen_stream(rows), f"{base}/out", f"{base}/checkpoint").awaitTermination()
        given = spark.read.parquet(f"{base}/out").select("user_id", "country", F.lit(True).alias("given"))
        held = jobs.seen_pairs(own, f"{base}/checkpoint").select("user_id", "country", "since")
        found = held.join(given, ["user_id", "country"], "full").select(F.lit(k + 1).alias("part"), "user_id", "country", "since", "given")
        out.append(materialize(found, "audit"))
    return out[0].unionByName(out[1])


CLOSED = "(SELECT max(event_ms) - 5001 FROM tx)"


def day_ms(day: int) -> int:
    return 1_704_067_200_000 + (day - 1) * 86_400_000


def spans(rule_id: str):
    """(settings, from, until) of the times in which a pattern is on; the built-in ones hold before its first version."""
    own = [v for v in VERSIONS if v[0] == rule_id]
    out = [(WIDE[rule_id], 0, day_ms(own[0][6]))] if rule_id in BASE else []
    for k, (_, enabled, amount, high, window, times, day) in enumerate(own):
        changes = {"P001": {"high": amount}, "P002": {"low": amount}, "P003": {}, "P004": {"low": amount, "high": high}}[rule_id]
        rule = WIDE[rule_id].with_(**{c: v for c, v in {**changes, "window_s": window, "times": times}.items() if v})
        if enabled:
            out.append((rule, day_ms(day), day_ms(own[k + 1][6]) if k + 1 < len(own) else 2**62))
    return out


def live_sql(rule, begin: int, until: int) -> str:
    when = f"event_ms >= {begin} AND event_ms < {until} AND event_ms <= {CLOSED}"
    names = f"'{rule.rule_id}'", f"'{rule.name}'", f"'{rule.severity}'"
    if rule.rule_id == "P002":
        return alert_sql(f"(SELECT * FROM seen WHERE amount > {rule.low} AND {when})", *names, NEW_TEXT, "id")
    if rule.rule_id == "P003":
        back = rule.times - 1
        rows = f"""(SELECT s.*, f.first_id FROM (SELECT nxt, status, coalesce(lag(id, {back}) OVER w, CASE WHEN {back} = 0 THEN id END) AS first_id,
            coalesce(lag(event_ms, {back}) OVER w, CASE WHEN {back} = 0 THEN event_ms END) AS first_ms
          FROM (SELECT *, lead(CASE WHEN status = 'SUCCESS' THEN arrival END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_ms, arrival) AS nxt FROM tx)
          WHERE status = 'FRAUD' WINDOW w AS (PARTITION BY user_id ORDER BY event_ms, arrival)) f
          JOIN tx s ON s.arrival = f.nxt WHERE s.event_ms - f.first_ms < {rule.window_s * 1000})"""
        text = f"'{rule.times} fraud attempts followed by success for ' || user_id"
    else:
        inside = f"amount < {rule.high}" if rule.rule_id == "P001" else f"amount BETWEEN {rule.low} AND {rule.high}"
        back = rule.times - 1
        rows = f"""(SELECT *, lag(id, {back}) OVER w AS first_id, event_ms - lag(event_ms, {back}) OVER w AS gap FROM tx WHERE {inside} AND status = 'SUCCESS'
          WINDOW w AS (PARTITION BY card_number ORDER BY event_ms, arrival) QUALIFY gap < {rule.window_s * 1000})"""
        span = f"under {rule.high:g}" if rule.rule_id == "P001" else f"between {rule.low:g}-{rule.high:g}"
        text = f"'{rule.times} transactions {span} EUR within {rule.window_s}s on card ' || card_number"
    return alert_sql(f"(SELECT * FROM {rows} WHERE {when})", *names, text, "first_id, id")


LIVE_SQL = f"WITH {TX_SQL}, {P002_SQL} " + " UNION ALL ".join(live_sql(*s) for r in WIDE for s in spans(r))
AUDIT_SQL = f"""WITH {TX_SQL}, middle AS (SELECT quantile_disc(arrival, 0.5) AS m FROM tx),
  parts AS (SELECT 1 AS part, tx.* FROM tx, middle WHERE arrival <= m UNION ALL SELECT 2, tx.* FROM tx)
  SELECT part, user_id, country, arg_min(event_ms, arrival) AS since, true AS given FROM parts
  WHERE user_id IS NOT NULL AND country IS NOT NULL GROUP BY ALL"""
QUERIES = {
    "stream_rules_live": (stream_rules_live, LIVE_SQL),
    "stream_p002_bootstrap": (stream_p002_bootstrap, P002_DYNAMIC_SQL),
    "stream_state_audit": (stream_state_audit, AUDIT_SQL),
}
