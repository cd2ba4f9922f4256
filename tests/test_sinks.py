from pyspark.sql import functions as F

from txnguard import schemas
from txnguard.config import Config
from txnguard.operators import monitor as M
from txnguard.sources import files, sinks, tables


def test_insert_or_ignore_stages_then_inserts(spark):
    """The first row by arrival is staged; the database decides what is new, in one statement after the stage is full."""
    stages, table, steps = {}, {}, []

    def stage(rows, name):
        stages[name] = rows.collect()
        steps.append(("stage", name))

    def execute(statements):
        steps.append(("execute", statements))
        for r in stages[statements[0].split(" FROM ")[1].split(" ")[0]]:
            table.setdefault(r.id, r.v)

    def go(rows, batch_id):
        df = spark.createDataFrame(rows, "id string, v int, arrival long")
        sinks.insert_or_ignore(df, "fraud_alerts", "card", batch_id, stage, execute)

    go([("a", 1, 1), ("a", 2, 0), ("b", 3, 5)], 7)
    go([("a", 1, 1), ("a", 2, 0), ("b", 3, 5)], 7)
    go([("b", 9, 0), ("c", 4, 0)], 8)
    assert table == {"a": 2, "b": 3, "c": 4}
    assert [s[0] for s in steps] == ["stage", "execute"] * 3
    assert steps[0][1] == steps[2][1] == "fraud_alerts_stage_card_7" != steps[4][1]
    assert steps[1][1] == [
        "INSERT INTO fraud_alerts (id, v) SELECT id, v FROM fraud_alerts_stage_card_7 ON CONFLICT (id) DO NOTHING",
        "DROP TABLE fraud_alerts_stage_card_7",
    ]


def test_config_blank_counts_as_unset():
    cfg = Config.from_env({"ML_THRESHOLD": "0.7", "ALERTS_TOPIC": "  ", "CHECKPOINT_INTERVAL": ""})
    assert (cfg.ml_threshold, cfg.alerts_topic, cfg.checkpoint_interval_ms) == (0.7, "fraud-alerts", 30000)


def test_rule_file_and_cards(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"ruleId":"P1","thresholdAmount":2.5}\n')
    row = files.read_rules(spark, str(tmp_path / "r.jsonl")).first()
    assert (row.ruleId, row.enabled, row.thresholdAmount, row.thresholdAmountHigh, row.windowSeconds) == ("P1", False, 2.5, None, 0)
    names = ["Time", *[f"V{i}" for i in range(1, 29)], "Amount", "Class"]
    (tmp_path / "c.csv").write_text(",".join(names) + "\n" + ",".join(["1.5"] * 30 + ["1"]) + "\n")
    card = files.read_cards(spark, str(tmp_path / "c.csv")).first()
    assert (card.Time, card.V28, card.Amount, card.Class) == (1.5, 1.5, 1.5, 1)


def test_alert_table_prunes_partitions(spark, tmp_path):
    rows = spark.range(20).select(
        F.concat(F.lit("a"), "id").alias("id"), F.lit("t").alias("transaction_id"), F.col("id").cast("string").alias("user_id"),
        F.lit("P001").alias("pattern_id"), F.lit("n").alias("pattern_name"), F.lit("HIGH").alias("severity"), F.lit(1).cast("decimal(12,2)").alias("amount"),
        F.lit("d").alias("description"), F.when(F.col("id") % 2 == 0, "ML").otherwise("CEP").alias("source"), F.lit(0).cast("decimal(6,4)").alias("ml_probability"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 43200).alias("detected_at"),
    )
    path = str(tmp_path / "alerts")
    tables.write_alerts(rows, path)
    stored = tables.read_alerts(spark, path)
    found = tables.alerts_by_time(stored, "2024-01-03T00:00:00Z", "2024-01-04T00:00:00Z")
    assert sorted(r.id for r in found.collect()) == ["a4", "a5"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(detected_date" in plan
    assert tables.alerts_by_source(stored, "ML").count() == 10
    assert [r.source for r in tables.alerts_recent(stored, 2).collect()] == ["CEP", "ML"]
    assert set(stored.columns) == {*schemas.ALERTS_TABLE, "detected_date"}


def test_counter_restart_and_bands(spark):
    df = spark.createDataFrame([("s", 0, 0, 5.0), ("s", 10, 1, 8.0), ("s", 1000, 2, 2.0), ("s", 1001, 3, 4.0)], "k string, event_ms long, arrival long, v double")
    got = M.counter_increase(df, "k", "v", 1000).orderBy("window_ms").collect()
    assert [(r.window_ms, r.increase) for r in got] == [(0, 3.0), (1000, 4.0)]
    bands = spark.createDataFrame([(4.9,), (5.0,), (20.0,)], "v double").select(M.band(F.col("v"), M.FRAUD_RATE_BANDS).alias("b"))
    assert [r.b for r in bands.collect()] == ["green", "yellow", "red"]


def test_histogram_quantile(spark):
    df = spark.createDataFrame([(0.05,)] * 50 + [(0.3,)] * 40 + [(0.9,)] * 10, "s double")
    row = M.quantile_from_histogram(df, F.col("s"), 0.5, bounds=(0.1, 0.5, 1.0)).first()
    assert row.value == 0.1
    row = M.quantile_from_histogram(df, F.col("s"), 0.95, bounds=(0.1, 0.5)).first()
    assert row.value == 0.5
