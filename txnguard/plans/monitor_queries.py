"""Registered queries: monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnguard.functions import decode as D
from txnguard.operators import monitor as M
from txnguard.plans.decode_queries import DEC, raw_records
from txnguard.plans.inputs import TX_SQL, tx
from txnguard.plans.pattern_queries import ALL_SQL, alerts
from txnguard.workdir import materialize


def score_log(spark: SparkSession, d: str) -> DataFrame:
    return tx(spark, d).withColumns(
        {
            "is_fraud": F.col("score") >= 0.5,
            "latency_ms": F.col("amount").cast("double"),
            "status_code": F.when(F.col("arrival") % 50 == 0, 500).otherwise(200),
            "day_ms": F.floor(F.col("event_ms") / 86_400_000) * 86_400_000,
        }
    )


LOG_SQL = """score_log AS (
  SELECT *, score >= 0.5 AS is_fraud, CAST(amount AS DOUBLE) AS latency_ms,
         CASE WHEN arrival % 50 = 0 THEN 500 ELSE 200 END AS status_code, event_ms // 86400000 * 86400000 AS day_ms FROM tx)"""


def fraud_count_5m(spark, d):
    return M.fraud_count(score_log(spark, d))


def fraud_count_sliding(spark, d):
    """Five-minute counts renewed every 15 seconds, for each window with traffic."""
    return M.fraud_count(score_log(spark, d), "5 minutes", "15 seconds")


def fraud_rate_5m(spark, d):
    out = M.fraud_rate(score_log(spark, d))
    return out.select("window_ms", F.round("fraud_rate", 6).alias("fraud_rate"))


def fraud_rate_sliding(spark, d):
    """Rate over five minutes, renewed every 15 seconds, for every such window of the month."""
    out = M.fraud_rate_sliding(score_log(spark, d))
    return out.select("window_ms", "fraud", "total", F.round("fraud_rate", 6).alias("fraud_rate"))


def latency_sketch_rollup(spark, d):
    """Stored five-minute sketches merged to hours and days, beside the rows: counts, and whether the true rank of each
    quantile is within the sketches' error."""
    log = score_log(spark, d).select("event_ms", "latency_ms")
    stored = materialize(M.latency_sketches(log), "latency-sketches")
    hours = materialize(M.merge_sketches(stored, 3_600_000), "hour-sketches")
    parts = [("hour", 3_600_000, hours), ("day", 86_400_000, M.merge_sketches(hours, 86_400_000))]
    out = []
    for name, length, sketches in parts:
        found = M.sketch_quantiles(sketches)
        rows = log.withColumn("window_ms", F.floor(F.col("event_ms") / length) * length)
        met = rows.join(found, "window_ms").groupBy("window_ms", "q", "n").agg(
            F.count_if(F.col("latency_ms") < F.col("value")).alias("under"), F.count_if(F.col("latency_ms") <= F.col("value")).alias("upto"), F.count("*").alias("counted"),
        )
        near = (F.col("under") <= (F.col("q") + M.RANK_ERROR) * F.col("n") + 1) & (F.col("upto") >= (F.col("q") - M.RANK_ERROR) * F.col("n") - 1)
        out.append(met.select(F.lit(name).alias("span"), "window_ms", "q", F.col("n").alias("n"), (F.col("n") == F.col("counted")).alias("complete"), near.alias("in_bound")))
    return out[0].unionByName(out[1])


def prediction_counts(spark, d):
    return M.prediction_counts(score_log(spark, d))


def prediction_rate_1m(spark, d):
    out = M.prediction_rate(score_log(spark, d))
    return out.select("window_ms", F.round("fraud_per_s", 6).alias("fraud_per_s"), F.round("total_per_s", 6).alias("total_per_s"))


def scoring_outcome_rate_1m(spark, d):
    out = M.outcome_rate(score_log(spark, d))
    return out.select("window_ms", F.round("success_per_s", 6).alias("success_per_s"), F.round("error_per_s", 6).alias("error_per_s"))


def quality_rate_1m(spark, d):
    out = M.quality_rate(D.classify_transactions(raw_records(spark, d)))
    return out.select("window_ms", F.round("valid_per_s", 6).alias("valid_per_s"), F.round("malformed_per_s", 6).alias("malformed_per_s"))


def malformed_5m(spark, d):
    return M.malformed_count(D.classify_transactions(raw_records(spark, d)))


def alerts_by_pattern(spark, d):
    return M.alerts_by_pattern(alerts(spark, d))


def alert_rate_by_source(spark, d):
    rows = alerts(spark, d).withColumn("at", F.timestamp_millis("event_ms"))
    out = M.alert_rate(rows, "1 hour", 3600, ts="at")
    return out.select("window_ms", "source", F.round("per_s", 9).alias("per_s"))


def latency_quantiles(spark, d):
    out = M.latency_quantiles(score_log(spark, d), keys=["day_ms"])
    return out.select("day_ms", "q", F.round("value", 6).alias("value"))


def latency_quantiles_overall(spark, d):
    return M.latency_quantiles(score_log(spark, d)).select("q", F.round("value", 6).alias("value"))


def histogram_quantile(spark, d):
    out = M.quantile_from_histogram(score_log(spark, d), F.col("latency_ms") / 1000, 0.95, ["day_ms"])
    return out.select("day_ms", "q", F.round("value", 9).alias("value"))


def health_bands(spark, d):
    log = score_log(spark, d)
    rate = M.windowed(log, "1 day", {"rate": M.ratio_percent(F.count_if("is_fraud"), F.count("*"))})
    p95 = M.quantile_from_histogram(log, F.col("latency_ms") / 1000, 0.95, ["day_ms"]).withColumnRenamed("day_ms", "window_ms")
    bad = M.malformed_count(D.classify_transactions(raw_records(spark, d)), "1 day")
    joined = rate.join(p95, "window_ms").join(bad, "window_ms")
    return joined.select(
        "window_ms",
        M.band(F.col("rate"), M.FRAUD_RATE_BANDS).alias("fraud_rate_band"),
        M.band(F.col("value") * 1000, M.LATENCY_BANDS_MS).alias("latency_band"),
        M.band(F.col("malformed"), M.MALFORMED_BANDS).alias("malformed_band"),
    )


def counter_increase(spark, d):
    rows = tx(spark, d).withColumn("reading", F.col("amount").cast("double")).select("user_id", "event_ms", "arrival", "reading")
    out = M.counter_increase(rows, "user_id", "reading", 86_400_000)
    return out.select("user_id", "window_ms", F.round("increase", 4).alias("increase"))


BOUNDS = "(VALUES " + ", ".join(
    f"({lo}, {hi})" for lo, hi in zip((0.0, *M.LATENCY_BOUNDS), (*M.LATENCY_BOUNDS, "'Infinity'::DOUBLE"))
) + ") b(lo, le)"
HIST_SQL = f"""hist AS (SELECT day_ms, CAST(lo AS DOUBLE) AS lo, CAST(le AS DOUBLE) AS le, count(*) AS n FROM score_log JOIN {BOUNDS}
    ON latency_ms / 1000 <= le AND (latency_ms / 1000 > lo OR lo = 0) GROUP BY ALL),
  cum AS (SELECT *, sum(n) OVER (PARTITION BY day_ms ORDER BY le) AS c, sum(n) OVER (PARTITION BY day_ms) * 0.95 AS rank FROM hist),
  p95 AS (SELECT day_ms, CASE WHEN le = 'Infinity'::DOUBLE THEN {M.LATENCY_BOUNDS[-1]} ELSE lo + (le - lo) * (rank - (c - n)) / n END AS value
    FROM cum WHERE c >= rank AND c - n < rank)"""
W5 = "event_ms // 300000 * 300000 AS window_ms"
W1 = "event_ms // 60000 * 60000 AS window_ms"
L = f"WITH {TX_SQL}, {LOG_SQL}"
SLIDING_SQL = f"""WITH {TX_SQL}, {LOG_SQL}, panes AS (SELECT event_ms // 15000 AS pane, count(*) FILTER (WHERE is_fraud) AS fraud, count(*) AS total
    FROM score_log GROUP BY 1),
  axis AS (SELECT unnest(range((SELECT min(pane) FROM panes) - 19, (SELECT max(pane) FROM panes) + 1)) AS start),
  sums AS (SELECT start, coalesce(sum(fraud), 0) AS fraud, coalesce(sum(total), 0) AS total FROM axis
    LEFT JOIN (SELECT pane - unnest(range(20)) AS start, fraud, total FROM panes) USING (start) GROUP BY start)
  SELECT start * 15000 AS window_ms, CAST(fraud AS BIGINT) AS fraud, CAST(total AS BIGINT) AS total,
    round(CASE WHEN total > 0 THEN fraud * 100.0 / total END, 6) AS fraud_rate FROM sums"""


def rollup_sql(name: str, length: int) -> str:
    return f"""SELECT '{name}' AS span, event_ms // {length} * {length} AS window_ms, q, count(*) AS n, true AS complete, true AS in_bound
  FROM score_log, (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS q) GROUP BY ALL"""


QUERIES = {
    "fraud_rate_sliding": (fraud_rate_sliding, SLIDING_SQL),
    "latency_sketch_rollup": (
        latency_sketch_rollup, f"WITH {TX_SQL}, {LOG_SQL} {rollup_sql('hour', 3_600_000)} UNION ALL {rollup_sql('day', 86_400_000)}",
    ),
    "fraud_count_5m": (fraud_count_5m, f"{L} SELECT {W5}, count(*) FILTER (WHERE is_fraud) AS fraud FROM score_log GROUP BY 1"),
    "fraud_count_sliding": (
        fraud_count_sliding,
        f"""{L} SELECT w AS window_ms, count(*) FILTER (WHERE is_fraud) AS fraud FROM (SELECT is_fraud, unnest(range(event_ms // 15000 * 15000 - 285000,
        event_ms // 15000 * 15000 + 1, 15000)) AS w FROM score_log) GROUP BY 1""",
    ),
    "fraud_rate_5m": (fraud_rate_5m, f"{L} SELECT {W5}, round(count(*) FILTER (WHERE is_fraud) * 100.0 / count(*), 6) AS fraud_rate FROM score_log GROUP BY 1"),
    "prediction_counts": (prediction_counts, f"{L} SELECT is_fraud, count(*) AS n FROM score_log GROUP BY 1"),
    "prediction_rate_1m": (
        prediction_rate_1m,
        f"{L} SELECT {W1}, round(count(*) FILTER (WHERE is_fraud) / 60.0, 6) AS fraud_per_s, round(count(*) / 60.0, 6) AS total_per_s FROM score_log GROUP BY 1",
    ),
    "scoring_outcome_rate_1m": (
        scoring_outcome_rate_1m,
        f"""{L} SELECT {W1}, round(count(*) FILTER (WHERE status_code BETWEEN 200 AND 299) / 60.0, 6) AS success_per_s,
        round(count(*) FILTER (WHERE status_code BETWEEN 500 AND 599) / 60.0, 6) AS error_per_s FROM score_log GROUP BY 1""",
    ),
    "quality_rate_1m": (
        quality_rate_1m,
        f"""{DEC} SELECT {W1}, round(count(*) FILTER (WHERE reason IS NULL) / 60.0, 6) AS valid_per_s,
        round(count(*) FILTER (WHERE reason IS NOT NULL) / 60.0, 6) AS malformed_per_s FROM marked GROUP BY 1""",
    ),
    "malformed_5m": (malformed_5m, f"{DEC} SELECT {W5}, count(*) FILTER (WHERE reason IS NOT NULL) AS malformed FROM marked GROUP BY 1"),
    "alerts_by_pattern": (alerts_by_pattern, f"{ALL_SQL} SELECT source, pattern_id, severity, count(*) AS n FROM alerts GROUP BY ALL"),
    "alert_rate_by_source": (
        alert_rate_by_source,
        f"""{ALL_SQL} SELECT event_ms // 3600000 * 3600000 AS window_ms, source, round(count(*) / 3600.0, 9) AS per_s
        FROM alerts a JOIN tx t ON t.id = a.transaction_id GROUP BY ALL""",
    ),
    "latency_quantiles": (
        latency_quantiles,
        f"""{L} SELECT day_ms, unnest([0.5, 0.95, 0.99])::DOUBLE AS q, round(unnest(quantile_cont(latency_ms, [0.5, 0.95, 0.99])), 6) AS value
        FROM score_log GROUP BY day_ms""",
    ),
    "latency_quantiles_overall": (
        latency_quantiles_overall,
        f"{L} SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS q, round(unnest(quantile_cont(latency_ms, [0.5, 0.95, 0.99])), 6) AS value FROM score_log",
    ),
    "histogram_quantile": (histogram_quantile, f"{L}, {HIST_SQL} SELECT day_ms, 0.95::DOUBLE AS q, round(CAST(value AS DOUBLE), 9) AS value FROM p95"),
    "health_bands": (
        health_bands,
        f"""{DEC}, {LOG_SQL}, {HIST_SQL}, r AS (SELECT day_ms, count(*) FILTER (WHERE is_fraud) * 100.0 / count(*) AS rate FROM score_log GROUP BY 1),
        m AS (SELECT event_ms // 86400000 * 86400000 AS day_ms, count(*) FILTER (WHERE reason IS NOT NULL) AS bad FROM marked GROUP BY 1)
        SELECT r.day_ms AS window_ms, CASE WHEN rate >= 20 THEN 'red' WHEN rate >= 5 THEN 'yellow' ELSE 'green' END AS fraud_rate_band,
        CASE WHEN value * 1000 >= 500 THEN 'red' WHEN value * 1000 >= 100 THEN 'yellow' ELSE 'green' END AS latency_band,
        CASE WHEN bad >= 10 THEN 'red' WHEN bad >= 1 THEN 'yellow' ELSE 'green' END AS malformed_band
        FROM r JOIN p95 USING (day_ms) JOIN m USING (day_ms)""",
    ),
    "counter_increase": (
        counter_increase,
        f"""WITH {TX_SQL}, s AS (SELECT user_id, event_ms, CAST(amount AS DOUBLE) AS v,
        lag(CAST(amount AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY event_ms, arrival) AS p FROM tx)
        SELECT user_id, event_ms // 86400000 * 86400000 AS window_ms,
        round(sum(CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END), 4) AS increase FROM s GROUP BY 1, 2""",
    ),
}
