"""Registered queries: scaling, split, oversampling, training, metrics, scoring, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnguard.functions.features import feature_map
from txnguard.ml import metrics, neighbours, registry, scaler, smote, split, train
from txnguard.operators import scoring
from txnguard.plans.inputs import TX_SQL, table, tx
from txnguard.workdir import run_dir

WEIGHTS = [((i * 7) % 11 - 5) / 4 for i in range(30)]
BIAS = -0.25
LINEAR_SCALE = {"Amount": (100.0, 60.0), "Time": (1000.0, 500.0)}


def cards(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows from the embeddings: the first 28 numbers, an amount and a time, and class = label 0."""
    return cards_of(table(spark, d, "embeddings"))


def cards_of(embeddings: DataFrame) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    return embeddings.select(
        F.col("vec_id").cast("string").alias("id"),
        "vec_id",
        (F.col("label") == 0).cast("int").alias("Class"),
        F.slice(x, 1, 28).alias("v"),
        feature_map(x, F.round(F.abs(x[28]) * 1000, 2), F.col("vec_id").cast("double")).alias("features"),
    )


def amounts(spark, d) -> DataFrame:
    return tx(spark, d).select(
        "id",
        F.col("amount").cast("double").alias("Amount"),
        ((F.col("event_ms") - 1704067200000) / 1000.0).alias("Time"),
    )


def labelled(spark, d) -> DataFrame:
    return tx(spark, d).select("id", "event_ms", "score", (F.col("status") == "FRAUD").cast("int").alias("y"))


def scaler_fit(spark, d):
    out = scaler.fit_frame(amounts(spark, d), ["Amount", "Time"])
    return out.select("name", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def scaler_transform(spark, d):
    rows = amounts(spark, d)
    out = scaler.transform(rows, scaler.fit(rows, ["Amount", "Time"]))
    return out.select("id", F.round("Amount_sc", 6).alias("amount_sc"), F.round("Time_sc", 6).alias("time_sc"))


def stratified_split(spark, d):
    out = split.stratified_split(table(spark, d, "labels"), "toxic", "doc_id")
    return out.select("doc_id", "toxic", "is_test")


def minority_knn(spark, d):
    rare = cards(spark, d).filter(F.col("Class") == 1)
    out = neighbours.nearest(rare, "id", "v", 5)
    return out.select("id", "neighbour", "rank", F.round("distance", 6).alias("distance"))


def smote_rows(spark, d):
    out = smote.oversample(cards(spark, d), "Class", "id", "v", ratio=0.5)
    return out.select("id", "base", "neighbour", F.round(F.col("vector")[0], 6).alias("v1"))


def smote_counts(spark, d):
    out = smote.resample(cards(spark, d), "Class", "id", "v", ratio=0.5)
    return out.groupBy(F.col("Class").alias("class")).agg(F.count("*").alias("n"))


def metric_auroc(spark, d):
    return metrics.ranking_metrics(labelled(spark, d), "score", "y").select(F.round("auroc", 9).alias("auroc"))


def metric_avg_precision(spark, d):
    return metrics.ranking_metrics(labelled(spark, d), "score", "y").select(F.round("auprc", 9).alias("auprc"))


def confusion_matrix(spark, d):
    return metrics.confusion(labelled(spark, d), "score", "y", 0.05)


def classification_report(spark, d):
    out = metrics.classification_report(labelled(spark, d), "score", "y", 0.05)
    return out.select("row", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


def quality_gate(spark, d):
    rows = labelled(spark, d).withColumn("day_ms", F.floor(F.col("event_ms") / 86_400_000) * 86_400_000)
    out = metrics.gate_frame(metrics.ranking_metrics(rows, "score", "y", ["day_ms"]), 0.5)
    return out.select("day_ms", F.round("auroc", 9).alias("auroc"), F.round("auprc", 9).alias("auprc"), "passed")


def dataset_profile(spark, d):
    """Positives and positive rate per part of the split."""
    out = split.stratified_split(table(spark, d, "labels"), "toxic", "doc_id")
    return metrics.dataset_profile(out, "toxic", ["is_test"]).select("is_test", "n", "positives", F.round("positive_rate", 9).alias("positive_rate"))


def score_linear(spark, d):
    out = scoring.score_linear(cards(spark, d), WEIGHTS, BIAS, LINEAR_SCALE)
    return out.select("id", F.round("fraud_probability", 9).alias("fraud_probability"), "is_fraud", "model_version", "outcome")


def learnable(spark, d):
    """The cards with a class that their features decide, so that a trained model can be held to the gate."""
    x = F.col("v")
    return cards(spark, d).withColumn("Class", (x[0] + x[1] > 0.2).cast("int"))


def _trained(spark, d):
    """At the full settings of ``train.SETTINGS``."""
    return train.train(learnable(spark, d), ratio=0.5, trainer="histograms")


def gbt_train_eval(spark, d):
    """Support of each class in the test part; whether the model is above the gate, and whether its figure is the one that
    its own test scores give."""
    t = _trained(spark, d)
    again = metrics.ranking_metrics(t.test, "fraud_probability", "Class").first().auroc
    report = t.report.filter(F.col("row").isin("0", "1"))
    return report.select("row", "support", F.lit(t.auroc >= 0.85).alias("above_gate"), F.lit(abs(again - t.auroc) < 1e-12).alias("same_auroc"))


def score_gbt(spark, d):
    """Train, save behind the gate under a version, load that version back and score every row with it."""
    t = _trained(spark, d)
    root = run_dir(spark, "models")
    version = train.save(spark, t, root)
    model, scale = train.load(spark, root, version)
    out = scoring.score(learnable(spark, d), model, scale, 0.5, version)
    p = F.col("fraud_probability")
    return out.select("id", "outcome", p.between(0, 1).alias("in_range"), (F.col("is_fraud") == (p >= 0.5)).alias("consistent"))


def _registry(spark, d) -> str:
    """A registry with one version per day of data: its quality is that day's, and versions above 0.5 were activated."""
    root = run_dir(spark, "registry")
    rows = quality_gate(spark, d).withColumn("trained_at", F.timestamp_millis(F.col("day_ms") + 86_400_000))
    version = F.concat(F.lit("v"), F.floor(F.col("day_ms") / 86_400_000))
    rows = rows.withColumns({"version": version, "model_file": F.concat(F.lit("models/"), version), "status": F.lit("active")})
    registry.append_entries(rows, root)
    known = registry.entries(spark, root)
    passed = known.filter(F.col("auroc") >= 0.5)
    registry.append_activations(passed.withColumn("activated_at", F.col("trained_at") + F.expr("interval 1 hour")), root)
    return root


def registry_latest(spark, d):
    out = registry.latest(registry.entries(spark, _registry(spark, d)))
    return out.select("version", "auroc", "auprc", "model_file", "status")


def registry_list(spark, d):
    root = _registry(spark, d)
    out = registry.listing(registry.entries(spark, root), registry.activations(spark, root))
    return out.select("version", "auroc", "auprc", F.unix_millis("trained_at").alias("trained_ms"), "is_active")


def activation_current(spark, d):
    root = _registry(spark, d)
    return registry.active_info(spark, root)


LABELLED = f"""WITH {TX_SQL}, labelled AS (SELECT id, event_ms, score, CASE WHEN status = 'FRAUD' THEN 1 ELSE 0 END AS y,
  event_ms // 86400000 * 86400000 AS day_ms FROM tx)"""


def ranking_sql(keys: str) -> str:
    by, part = (f"{keys}, ", f"PARTITION BY {keys} ") if keys else ("", "")
    group = f"GROUP BY {keys}" if keys else ""
    return f"""d AS (SELECT {by}score, sum(y) AS tp, count(*) - sum(y) AS fp FROM labelled GROUP BY {by}score),
    c AS (SELECT *, sum(tp) OVER ({part}ORDER BY score DESC) AS ctp, sum(fp) OVER ({part}ORDER BY score DESC) AS cfp FROM d),
    ranking AS (SELECT {by}CAST(sum(fp * (ctp - tp / 2.0)) AS DOUBLE) / (sum(tp) * sum(fp)) AS auroc,
      sum(tp * CAST(ctp AS DOUBLE) / (ctp + cfp)) / sum(tp) AS auprc FROM c {group})"""


DAILY = f"""{LABELLED}, {ranking_sql('day_ms')}, reg AS (SELECT 'v' || (day_ms // 86400000) AS version, round(auroc, 9) AS auroc,
  round(auprc, 9) AS auprc, day_ms + 86400000 AS trained_ms FROM ranking)"""
SPLIT_SQL = """s AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(concat_ws('|', doc_id, 42)), doc_id)
  <= round(0.2 * count(*) OVER (PARTITION BY toxic)) AS is_test FROM labels)"""
CONF = f"""{LABELLED}, m AS (SELECT count(*) FILTER (WHERE y = 0 AND score < 0.05) AS tn, count(*) FILTER (WHERE y = 0 AND score >= 0.05) AS fp,
  count(*) FILTER (WHERE y = 1 AND score < 0.05) AS fn, count(*) FILTER (WHERE y = 1 AND score >= 0.05) AS tp FROM labelled),
  cls AS (SELECT '0' AS "row", tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, 2 * tn / (2 * tn + fn + fp) AS f1, tn + fp AS support FROM m
  UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM m)"""
KNN_SQL = """WITH r AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding[1:28] AS DOUBLE[]) AS v FROM embeddings WHERE label = 0),
  p AS (SELECT a.id, b.id AS neighbour, list_distance(a.v, b.v) AS distance FROM r a JOIN r b ON a.id <> b.id)
  SELECT id, neighbour, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank, round(distance, 6) AS distance FROM p
  QUALIFY rank <= 5"""
# The synthetic rows again in SQL: same hashes, same hash order of the minority, neighbours by brute force.
SMOTE_SQL = """WITH r AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding[1:28] AS DOUBLE[]) AS v,
    row_number() OVER (ORDER BY md5(concat_ws('|', vec_id, 42)), CAST(vec_id AS VARCHAR)) - 1 AS idx FROM embeddings WHERE label = 0),
  c AS (SELECT count(*) FILTER (WHERE label = 0) AS mino, CAST(trunc(0.5 * count(*) FILTER (WHERE label <> 0) - count(*) FILTER (WHERE label = 0)) AS BIGINT) AS wanted FROM embeddings),
  near AS (SELECT a.id, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank
    FROM r a JOIN r b ON a.id <> b.id QUALIFY rank <= 5),
  n AS (SELECT unnest(range(wanted)) AS num, mino FROM c),
  h AS (SELECT num, mino, CAST('0x' || md5('base42|' || num)[1:12] AS BIGINT) / 281474976710656.0 AS b,
    CAST('0x' || md5('near42|' || num)[1:12] AS BIGINT) / 281474976710656.0 AS k, CAST('0x' || md5('gap42|' || num)[1:12] AS BIGINT) / 281474976710656.0 AS u FROM n)
  SELECT 'new-' || num AS id, r.id AS base, near.neighbour, round(r.v[1] + u * (o.v[1] - r.v[1]), 6) AS v1
  FROM h JOIN r ON r.idx = CAST(floor(b * mino) AS BIGINT) JOIN near ON near.id = r.id AND near.rank = CAST(floor(k * 5) AS BIGINT) + 1
  JOIN r o ON o.id = near.neighbour"""
LINEAR_SQL = f"""WITH f AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_concat(CAST(embedding[1:28] AS DOUBLE[]),
  [(round(abs(CAST(embedding[29] AS DOUBLE)) * 1000, 2) - 100.0) / 60.0, (vec_id - 1000.0) / 500.0]) AS x FROM embeddings),
  p AS (SELECT id, 1 / (1 + exp(-({BIAS} + list_sum(list_transform(list_zip(x, {WEIGHTS}), lambda z: z[1] * z[2]))))) AS p FROM f)
  SELECT id, round(p, 9) AS fraud_probability, p >= 0.5 AS is_fraud, 'linear' AS model_version, 'scored' AS outcome FROM p"""
QUERIES = {
    "scaler_fit": (
        scaler_fit,
        f"""WITH {TX_SQL}, a AS (SELECT CAST(amount AS DOUBLE) AS x, (event_ms - 1704067200000) / 1000.0 AS t FROM tx)
        SELECT 'Amount' AS name, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation FROM a
        UNION ALL SELECT 'Time', round(avg(t), 6), round(stddev_pop(t), 6) FROM a""",
    ),
    "scaler_transform": (
        scaler_transform,
        f"""WITH {TX_SQL}, a AS (SELECT id, CAST(amount AS DOUBLE) AS x, (event_ms - 1704067200000) / 1000.0 AS t FROM tx)
        SELECT id, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS amount_sc,
        round((t - avg(t) OVER ()) / stddev_pop(t) OVER (), 6) AS time_sc FROM a""",
    ),
    "stratified_split": (stratified_split, f"WITH {SPLIT_SQL} SELECT doc_id, toxic, is_test FROM s"),
    "dataset_profile": (
        dataset_profile,
        f"""WITH {SPLIT_SQL} SELECT is_test, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS positives, round(avg(toxic), 9) AS positive_rate
        FROM s GROUP BY 1""",
    ),
    "minority_knn": (minority_knn, KNN_SQL),
    "smote_counts": (
        smote_counts,
        """WITH c AS (SELECT count(*) FILTER (WHERE label <> 0) AS maj, count(*) FILTER (WHERE label = 0) AS mino FROM embeddings)
        SELECT 0 AS class, maj AS n FROM c UNION ALL SELECT 1, mino + CAST(trunc(0.5 * maj - mino) AS BIGINT) FROM c""",
    ),
    "smote_rows": (smote_rows, SMOTE_SQL),
    "metric_auroc": (metric_auroc, f"{LABELLED}, {ranking_sql('')} SELECT round(auroc, 9) AS auroc FROM ranking"),
    "metric_avg_precision": (metric_avg_precision, f"{LABELLED}, {ranking_sql('')} SELECT round(auprc, 9) AS auprc FROM ranking"),
    "confusion_matrix": (
        confusion_matrix,
        f"{LABELLED} SELECT y AS actual, CASE WHEN score >= 0.05 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM labelled GROUP BY 1, 2",
    ),
    "classification_report": (
        classification_report,
        f"""{CONF}, a AS (SELECT *, (tn + tp) / (tn + fp + fn + tp) AS acc, tn + fp + fn + tp AS total FROM m)
        SELECT "row", round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM cls
        UNION ALL SELECT 'accuracy', round(acc, 9), round(acc, 9), round(acc, 9), total FROM a
        UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM cls
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
          round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM cls""",
    ),
    "quality_gate": (
        quality_gate,
        f"{LABELLED}, {ranking_sql('day_ms')} SELECT day_ms, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc, auroc >= 0.5 AS passed FROM ranking",
    ),
    "score_linear": (score_linear, LINEAR_SQL),
    "gbt_train_eval": (
        gbt_train_eval,
        """WITH c AS (SELECT vec_id, CAST(CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) > 0.2 AS INTEGER) AS class FROM embeddings),
        s AS (SELECT class, row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws('|', vec_id, 42)), CAST(vec_id AS VARCHAR))
          <= round(0.2 * count(*) OVER (PARTITION BY class)) AS is_test FROM c)
        SELECT CAST(class AS VARCHAR) AS "row", count(*) AS support, true AS above_gate, true AS same_auroc FROM s WHERE is_test GROUP BY class""",
    ),
    "score_gbt": (score_gbt, "SELECT CAST(vec_id AS VARCHAR) AS id, 'scored' AS outcome, true AS in_range, true AS consistent FROM embeddings"),
    "registry_latest": (
        registry_latest,
        f"""{DAILY} SELECT version, auroc, auprc, 'models/' || version AS model_file, 'active' AS status FROM reg ORDER BY trained_ms DESC LIMIT 1""",
    ),
    "registry_list": (
        registry_list,
        f"""{DAILY} SELECT version, auroc, auprc, trained_ms,
        coalesce(version = (SELECT version FROM reg WHERE auroc >= 0.5 ORDER BY trained_ms DESC LIMIT 1), false) AS is_active FROM reg""",
    ),
    "activation_current": (
        activation_current,
        f"{DAILY} SELECT version, CAST(auroc AS VARCHAR) AS auroc FROM reg WHERE auroc >= 0.5 ORDER BY trained_ms DESC LIMIT 1",
    ),
}
