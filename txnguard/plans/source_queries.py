"""Registered queries: card files, rule streams, missing keys, scorers that fail or are replaced, near neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard import schemas
from txnguard.functions import decode as D
from txnguard.ml import hist_boost, lsh, neighbours, registry
from txnguard.operators import detect, scoring
from txnguard.plans import inputs
from txnguard.plans.boost_queries import BINNED, STUMPS, ZERO, stump_sql
from txnguard.plans.decode_queries import stream_like_rules
from txnguard.plans.inputs import TX_SQL, table
from txnguard.plans.ml_queries import cards, cards_of, learnable
from txnguard.plans.pattern_queries import ALL_SQL, alerts
from txnguard.plans.stream_queries import finish, table_stream
from txnguard.sources import files, record_log, tables
from txnguard.sources.records import read_rule_records
from txnguard.streaming import jobs
from txnguard.streaming.service import ActiveModel
from txnguard.workdir import materialize, run_dir


def cards_csv_scan(spark, d):
    """The vectors written as a card file with its header and read back with the declared schema."""
    x = F.col("embedding")
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").cast("double").alias("Time"), *[F.round(x[i].cast("double"), 6).alias(f"V{i + 1}") for i in range(28)],
        F.round(F.abs(x[28].cast("double")) * 1000, 2).alias("Amount"), (F.col("label") == 0).cast("int").alias("Class"),
    )
    path = run_dir(spark, "cards")
    rows.select(*[f.name for f in spark.createDataFrame([], schemas.CARD_CSV).schema]).write.option("header", True).csv(path)
    return files.read_cards(spark, path).select("Time", "V1", "V28", "Amount", "Class")


def stream_scan_rules(spark, d):
    """The rule topic from its beginning, as a stream of records."""
    base, own = run_dir(spark, "rule-records"), jobs.stream_session(spark)
    raw = stream_like_rules(spark, d)
    made = raw.select(F.col("key") if "key" in raw.columns else F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.timestamp_micros("rule_seq").alias("timestamp"))
    made.write.parquet(base)
    rows = read_rule_records(own, path=base)
    raw = rows.select("key", "value", F.col("timestamp").alias("rule_ts"), F.unix_micros("timestamp").alias("rule_seq"))
    out = D.decode_rules(raw).select("rule_id", "rule_name", "enabled", "threshold_amount", "window_seconds", "rule_seq")
    return finish(spark, out, "rules")


def null_keys(spark, d):
    """Rows that patterns by user or by card cannot use."""
    t = inputs.tx(spark, d)
    t = t.withColumns({"user_id": F.when(F.col("arrival") % 7 != 0, F.col("user_id")), "card_number": F.when(F.col("arrival") % 11 != 0, F.col("card_number"))})
    return detect.null_key_rows(t)


def first_feature(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * x[:, 0]))


def unavailable():
    raise ConnectionError("the scorer is not there")


def stream_score_failing(spark, d):
    """Two scorers in a stream, one of which is never there: its rows say so, and the stream goes on."""
    own = jobs.stream_session(spark)
    rows = cards_of(table_stream(own, d, "embeddings"))
    parts = []
    for load, own_rows in ((lambda: first_feature, F.col("vec_id") % 3 != 0), (unavailable, F.col("vec_id") % 3 == 0)):
        scored = scoring.score_python(rows.filter(own_rows), load, version="python")
        parts.append(scored.select("id", F.round("fraud_probability", 9).alias("fraud_probability"), "is_fraud", "outcome", "score_error"))
    return finish(spark, parts[0].union(parts[1]), "failing")


def stream_model_swap(spark, d):
    """A model is activated while the stream stands still between two batches: each batch has the version of its time."""
    base, own = run_dir(spark, "swap"), jobs.stream_session(spark)
    known = learnable(spark, d).select("id", "vec_id", "Class", "v")
    root, model = f"{base}/models", hist_boost.fit(known, "id", "Class", "v", **STUMPS)
    for n in (1, 2):
        version = f"v{n}"
        hist_boost.Model(model.edges, model.trees[:n]).save(spark, f"{root}/models/{version}/model")
        for name, text in (("scale", "{}"), ("kind", "histograms")):
            spark.createDataFrame([(text,)], "value string").write.text(f"{root}/models/{version}/{name}")
        registry.record(spark, root, version, 0.9, 0.9, f"models/{version}/model")
    active = ActiveModel(root)

    def handle(batch: DataFrame, batch_id: int) -> None:
        version, now, _ = active.get(batch.sparkSession)
        p = now.probability_column(batch.sparkSession, F.col("v"))
        out = scoring.label_scores(batch.withColumns({"fraud_probability": p, "skip_reason": F.lit(None).cast("string")}), 0.5, version)
        jobs.write_batch(out.select("id", F.round("fraud_probability", 9).alias("fraud_probability"), "model_version", "outcome"), f"{base}/out", batch_id)

    for n in (1, 2):
        registry.activate(spark, root, f"v{n}")
        known.filter((F.col("vec_id") % 2 == 0) == (n == 1)).write.mode("append").parquet(f"{base}/in")
        rows = own.readStream.schema(known.schema).parquet(f"{base}/in")
        jobs.each_batch(rows, handle, f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", "fraud_probability", "model_version", "outcome")


def minority_knn_lsh(spark, d):
    """Near neighbours of all rows by random projections beside the exact ones: rows, exact pairs, and whether at least nine of
    ten are found."""
    rows = cards(spark, d).select("id", "v")
    exact = neighbours.nearest(rows, "id", "v", 5).select("id", "neighbour")
    near = lsh.near_neighbours(rows, "id", "v", 5).select("id", "neighbour", F.lit(1).alias("met"))
    met = exact.join(near, ["id", "neighbour"], "left")
    return met.agg(F.countDistinct("id").alias("n"), F.count("*").alias("pairs"), (F.count("met") >= 0.9 * F.count("*")).alias("recall_reached"))


def stream_log_source(spark, d):
    """The events through a record log of six partitions, in two commits: read from the beginning and from the end, each stream
    stopped in between, and alerts' way out by a stream that writes to a second log."""
    base = run_dir(spark, "log")
    t = inputs.tx(spark, d).select("user_id", "id", "arrival", "event_time")
    middle = t.select(F.percentile_approx("arrival", 0.5, 1_000_000)).first()[0] or 0
    for part in (F.col("arrival") <= middle, F.col("arrival") > middle):
        for k, starting in enumerate(("earliest", "latest")):
            if k:  # the second stream starts when the first part is there
                rows = record_log.read_stream(spark, f"{base}/in", starting)
                jobs.to_files(rows.select(F.lit(starting).alias("starting"), "key", "value", "partition"), f"{base}/{starting}", f"{base}/checkpoint-{starting}").awaitTermination()
            else:
                record_log.append(t.filter(part).select(F.col("user_id").alias("key"), F.col("id").alias("value"), F.col("event_time").alias("timestamp")), f"{base}/in")
                rows = record_log.read_stream(spark, f"{base}/in", starting)
                record_log.write_stream(rows, f"{base}/copy", f"{base}/checkpoint-{starting}", "copy").awaitTermination()
    copied = spark.read.format(record_log.NAME).option("path", f"{base}/copy").load().select(F.lit("earliest").alias("starting"), "key", "value", "partition")
    every = copied.unionByName(spark.read.schema(copied.schema).parquet(f"{base}/latest"))
    return every.select("starting", F.col("key").cast("string").alias("user_id"), F.col("value").cast("string").alias("id"), F.col("partition").cast("long").alias("partition"))


def _lookup_table(spark, d):
    """The alerts, with the event's time as theirs, laid out for lookups in about 32 files."""
    path = run_dir(spark, "lookups")
    rows = materialize(alerts(spark, d).withColumn("detected_at", F.timestamp_millis("event_ms")).drop("event_ms"), "found-alerts")
    tables.write_for_lookups(rows, path, rows_per_file=max(1, rows.count() // 32))
    return spark.read.parquet(path)


def alerts_by_id_pruned(spark, d):
    """One alert by its id, and whether the scan passed over four fifths of the table."""
    stored = _lookup_table(spark, d)
    key = stored.agg(F.min("id")).first()[0]
    found = tables.lookup_id(stored, key)
    share = tables.rows_scanned(found) / max(1, stored.count())
    return found.select("id", "transaction_id", "user_id", "pattern_id", F.lit(share <= 0.2).alias("mostly_skipped"))


def alerts_by_user_pruned(spark, d):
    """A user's alerts of ten days, and whether the scan passed over half of the table."""
    stored = _lookup_table(spark, d)
    found = tables.lookup_user(stored, "7", "2024-01-05T00:00:00Z", "2024-01-15T00:00:00Z")
    share = tables.rows_scanned(found) / max(1, stored.count())
    return found.select("id", "transaction_id", "pattern_id", F.lit(share <= 0.5).alias("mostly_skipped"))


EMB = "round(CAST(embedding[{}] AS DOUBLE), 6)"
# The partition of a user: CRC-32, its table computed, folded over the name's bytes.
LOG_SQL = f"""WITH RECURSIVE {TX_SQL}, crc(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8), middle AS (SELECT quantile_disc(arrival, 0.5) AS m FROM tx),
users AS (SELECT user_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(user_id, ''), lambda d: CAST(ascii(d) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295::BIGINT) % 6 AS partition FROM (SELECT DISTINCT user_id FROM tx), tab),
every AS (SELECT 'earliest' AS starting, tx.* FROM tx UNION ALL SELECT 'latest', tx.* FROM tx, middle WHERE arrival > m)
SELECT starting, user_id, id, partition FROM every JOIN users USING (user_id)"""
QUERIES = {
    "alerts_by_id_pruned": (
        alerts_by_id_pruned,
        f"{ALL_SQL} SELECT id, transaction_id, user_id, pattern_id, true AS mostly_skipped FROM alerts WHERE id = (SELECT min(id) FROM alerts)",
    ),
    "alerts_by_user_pruned": (
        alerts_by_user_pruned,
        f"""{ALL_SQL} SELECT a.id, transaction_id, pattern_id, true AS mostly_skipped FROM alerts a JOIN tx ON tx.id = a.transaction_id
        WHERE a.user_id = '7' AND event_ms >= 1704412800000 AND event_ms < 1705276800000""",
    ),
    "stream_log_source": (stream_log_source, LOG_SQL),
    "cards_csv_scan": (
        cards_csv_scan,
        f"""SELECT CAST(vec_id AS DOUBLE) AS "Time", {EMB.format(1)} AS "V1", {EMB.format(28)} AS "V28",
        round(abs(CAST(embedding[29] AS DOUBLE)) * 1000, 2) AS "Amount", CAST(label = 0 AS INTEGER) AS "Class" FROM embeddings""",
    ),
    "stream_scan_rules": (
        stream_scan_rules,
        f"""WITH {TX_SQL} SELECT 'R' || user_id AS rule_id, 'limit' AS rule_name, status <> 'FRAUD' AS enabled, CAST(amount AS DOUBLE) AS threshold_amount,
        CASE WHEN status = 'FRAUD' THEN 0 ELSE 60 END AS window_seconds, arrival AS rule_seq FROM tx WHERE country NOT IN ('MY','TH','AU')""",
    ),
    "null_keys": (
        null_keys,
        f"WITH {TX_SQL} SELECT count(*) FILTER (WHERE arrival % 7 = 0 OR user_id IS NULL) AS null_user, count(*) FILTER (WHERE arrival % 11 = 0 OR card_number IS NULL) AS null_card FROM tx",
    ),
    "stream_score_failing": (
        stream_score_failing,
        """WITH p AS (SELECT vec_id, 1 / (1 + exp(-4 * CAST(embedding[1] AS DOUBLE))) AS p, vec_id % 3 <> 0 AS ok FROM embeddings)
        SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN ok THEN round(p, 9) END AS fraud_probability, CASE WHEN ok THEN p >= 0.5 END AS is_fraud,
        CASE WHEN ok THEN 'scored' ELSE 'error' END AS outcome, CASE WHEN NOT ok THEN 'ConnectionError: the scorer is not there' END AS score_error FROM p""",
    ),
    "stream_model_swap": (
        stream_model_swap,
        f"""WITH {BINNED}, {ZERO}, {stump_sql(1, 'zero')}, {stump_sql(2, 'm1')}, both_ AS (SELECT id, margin, 'v1' AS model_version FROM m1 WHERE CAST(id AS BIGINT) % 2 = 0
        UNION ALL SELECT id, margin, 'v2' FROM m2 WHERE CAST(id AS BIGINT) % 2 = 1)
        SELECT id, round(1 / (1 + exp(-margin)), 9) AS fraud_probability, model_version, 'scored' AS outcome FROM both_""",
    ),
    "minority_knn_lsh": (minority_knn_lsh, "SELECT count(*) AS n, count(*) * least(5, count(*) - 1) AS pairs, true AS recall_reached FROM embeddings"),
}
