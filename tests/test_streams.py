import json
import random
from datetime import datetime, timezone

import pytest
from helpers import brute_force, failed, random_rows, small, success, txns
from pyspark.sql import functions as F

from txnguard import schemas
from txnguard.functions import alerts as A
from txnguard.functions import decode as D
from txnguard.ml import registry
from txnguard.operators import patterns as P
from txnguard.operators import scoring
from txnguard.sources import tables
from txnguard.streaming import jobs, service
from txnguard.streaming.service import QualityListener, Service

RULES = {"P001": P.BUILTIN["P001"], "P003": P.BUILTIN["P003"].with_(window_s=40), "P004": P.BUILTIN["P004"].with_(window_s=30)}
FAR = 10_000_000


def feed(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def source(own, df, path):
    return own.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def ends(rows):
    return [*rows, (FAR, "sentinel", 1, "OTHER"), (FAR, "sentinel", 1, "SUCCESS"), (FAR, "sentinel", 1, "FRAUD")]


def run(spark, own, stream, base):
    jobs.to_files(stream, f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def pairs(df, pattern_id):
    rows = df.filter((F.col("kind") == "match") & (F.col("pattern_id") == pattern_id)).select("first_id", "id").collect()
    return sorted((r.first_id, r.id) for r in rows)


@pytest.fixture(scope="module")
def own(spark):
    return jobs.stream_session(spark, partitions=2)


def test_stream_equals_batch_on_disordered_files(spark, own, tmp_path):
    """Rows arrive up to five seconds out of order, over several files, with a short chunk."""
    rows = sorted(random_rows(11, n=240, span_ms=120_000), key=lambda r: r[0])
    rng = random.Random(1)
    all_rows = ends(rows)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0] + rng.randrange(0, 4_900))
    df = txns(spark, all_rows)
    path = str(tmp_path / "in")
    for part in range(3):
        ids = [f"t{i}" for i in order[part * 80 : (part + 1) * 80]]
        feed(df.filter(F.col("id").isin(ids)), path)
    feed(df.filter("user_id = 'sentinel'"), path)
    stages = [*jobs.card_stages(RULES), *jobs.user_stages(RULES)]
    out = jobs.sequence_stream(source(own, df, path), "card_number", stages, chunk_ms=25_000, slots=4)
    got = run(spark, own, out, str(tmp_path))
    assert pairs(got, "P001") == brute_force(rows, [(small, 3)], 60_000)
    assert pairs(got, "P003") == brute_force(rows, [(failed, 2), (success, 1)], 40_000)
    assert got.filter("kind = 'match'").dropDuplicates(["pattern_id", "first_id", "id"]).count() == got.count()


def test_restart_from_checkpoint(spark, own, tmp_path):
    rows = [(500, "c", 1, "SUCCESS"), (1000, "c", 1, "SUCCESS"), (9000, "c", 1, "SUCCESS"), (30_000, "c", 1, "SUCCESS"), (FAR, "z", 1, "OTHER")]
    df = txns(spark, rows)
    path, base = str(tmp_path / "in"), str(tmp_path)

    def go():
        stream = jobs.sequence_stream(source(own, df, path), "card_number", jobs.card_stages({"P001": P.BUILTIN["P001"]}))
        return pairs(run(spark, own, stream, base), "P001")

    feed(df.filter("arrival < 3"), path)
    assert go() == []  # the third row is not final yet
    feed(df.filter("arrival = 3"), path)
    assert go() == [("t0", "t2")]
    feed(df.filter("arrival = 4"), path)
    assert go() == [("t0", "t2"), ("t1", "t3")]


def test_late_rows_at_the_watermark(spark, own, tmp_path):
    """After 100 000 ms the watermark stands at 94 999: a row there is late, one at 95 000 is on time."""
    rows = [(500, "c", 1, "SUCCESS"), (100_000, "x", 1, "SUCCESS"), (94_998, "c", 1, "SUCCESS"), (94_999, "c", 1, "SUCCESS"), (95_000, "c", 1, "SUCCESS"), (FAR, "z", 1, "SUCCESS")]
    df = txns(spark, rows)
    path = str(tmp_path / "in")
    feed(df.filter("arrival < 2"), path)
    feed(df.filter("arrival between 2 and 4"), path)
    feed(df.filter("arrival = 5"), path)
    rule = P.BUILTIN["P001"].with_(times=2, window_s=600)
    out = jobs.sequence_stream(source(own, df, path), "card_number", jobs.card_stages({"P001": rule}), report_late=True)
    got = run(spark, own, out, str(tmp_path))
    assert sorted(r.id for r in got.filter("kind = 'late'").collect()) == ["t2", "t3"]
    assert pairs(got, "P001") == [("t0", "t4")]


def test_first_seen_over_batches(spark, own, tmp_path):
    rows = [(5000, "u", 1, "SUCCESS", "VN"), (4000, "u", 2, "SUCCESS", "VN"), (1000, "u", 3, "SUCCESS", "VN"), (2000, "u", 4, "SUCCESS", "US"), (2000, "v", 5, "SUCCESS", "US"), (9000, "v", 5, "SUCCESS", None)]
    df = txns(spark, rows)
    path = str(tmp_path / "in")
    feed(df.filter("arrival < 2"), path)
    feed(df.filter("arrival >= 2"), path)
    got = run(spark, own, jobs.first_seen_stream(source(own, df, path)), str(tmp_path))
    # The row that arrived first counts, whatever its event time; a later batch cannot take it back.
    assert sorted(r.id for r in got.collect()) == ["t0", "t3", "t4"]


def records(spark, bodies):
    data = [(b"k", None if b is None else json.dumps(b).encode(), datetime(2024, 1, 1, tzinfo=timezone.utc)) for b in bodies]
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), t) for k, v, t in data], schemas.RAW_RECORD)


def body(i, user, amount, second, status="SUCCESS", country="VN", features=None):
    return {"id": f"x{i}", "userId": user, "cardNumber": f"card-{user}", "amount": amount, "currency": "EUR", "merchantId": "m",
            "country": country, "status": status, "eventTime": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z", "mlFeatures": features}


def test_whole_service(spark, own, tmp_path):
    out, cp, inbox, rules = (str(tmp_path / n) for n in ("out", "cp", "in", "rules"))
    rows = [body(0, "a", 10, 1), body(1, "a", 20, 2), body(2, "a", 30, 3), body(3, "b", 60, 4, "FRAUD"), body(4, "b", 70, 5, "FRAUD"),
            body(5, "b", 80, 6), body(6, "b", 90, 7), body(7, "a", 900, 8, country="US"), None, {"id": "bad"}, body(99, "z", 10, 1800)]
    feed(records(spark, rows), inbox)
    rule = {"ruleId": "P002", "ruleName": "New place", "enabled": True, "thresholdAmount": 500, "severity": "LOW"}
    feed(records(spark, [rule]), rules)
    own.sparkContext.setLogLevel("ERROR")
    listener = QualityListener()
    own.streams.addListener(listener)
    job = Service(own, out, cp)

    def go():
        recs = own.readStream.schema(schemas.RAW_RECORD).parquet(inbox)
        changes = own.readStream.schema(schemas.RAW_RECORD).parquet(rules)
        for q in job.start_all(recs, changes).values():
            q.awaitTermination()

    go()
    found = spark.read.parquet(f"{out}/alerts")
    got = sorted((r.pattern_id, r.transaction_id) for r in found.collect())
    assert got == [("P001", "x2"), ("P002", "x7"), ("P003", "x5"), ("P004", "x6")]
    assert found.filter("pattern_id = 'P002'").first().severity == "LOW"
    assert spark.read.json(f"{out}/alert_records").count() == 4
    assert spark.read.parquet(f"{out}/transactions").count() == 9
    assert sorted(r.reason for r in spark.read.parquet(f"{out}/malformed").collect()) == ["missing_required", "null_value"]
    # The rule is switched off while the service is down for a moment; countries go on being remembered.
    later = {**rule, "enabled": False}
    late = records(spark, [later]).withColumn("timestamp", F.expr("timestamp + interval 10 minutes"))
    feed(late, rules)
    feed(records(spark, [body(100, "c", 900, 1801, country="US")]), inbox)
    go()
    assert spark.read.parquet(f"{out}/alerts").count() == 4
    assert spark.read.parquet(f"{out}/transactions").count() == 10
    # The lookups read what the service has written, and a transaction that is delivered again is stored once.
    stored = tables.read_alerts(spark, f"{out}/alerts")
    assert tables.alerts_by_time(stored, "2000-01-01T00:00:00Z", "2100-01-01T00:00:00Z").count() == 4
    kept = spark.read.parquet(f"{out}/transactions")
    assert tables.transactions_by_user_time(kept, "a", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z").count() == 4
    feed(records(spark, [body(7, "a", 900, 8, country="US"), body(101, "d", 1, 1802)]), inbox)
    go()
    assert sorted(r.id for r in spark.read.parquet(f"{out}/transactions").collect()) == sorted({f"x{i}" for i in (*range(8), 99, 100, 101)})
    own.streams.removeListener(listener)
    assert job.quality.valid == listener.valid
    own.streams.removeListener(job.quality)
    assert (listener.valid, listener.malformed) == (12, 2)


def test_alerts_are_computed_once_and_stored_once(spark, own, tmp_path):
    """The same alerts in two batches, and one batch run twice: one row per id, and what made them runs once a batch."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    df = spark.createDataFrame([(f"a{i}", f"t{i}") for i in range(6)], "id string, transaction_id string")
    made = {"user_id": "u", "pattern_id": "P001", "pattern_name": "n", "severity": "LOW", "amount": "1.50", "description": "d", "source": "CEP"}
    df = df.withColumns({k: F.lit(v) for k, v in made.items()}).withColumns({"ml_probability": F.lit(None).cast("double"), "detected_at": F.lit(None).cast("timestamp")})
    df = df.select(*A.ALERT_COLUMNS)
    df = df.mapInPandas(count, df.schema)
    job = service.Service(own, str(tmp_path / "out"), str(tmp_path / "cp"))
    for n, batch_id in enumerate((0, 1, 1), start=1):
        job.write_alerts(df, "card", batch_id)
        assert seen.value == 6 * n
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out/alerts").collect()) == [f"a{i}" for i in range(6)]


def test_model_hot_swap(spark, tmp_path, monkeypatch):
    """The active version is looked up every time and loaded only when it changed."""
    root, loads = str(tmp_path / "models"), []
    monkeypatch.setattr(service.train, "load", lambda _, __, version: loads.append(version) or (f"model {version}", {}))
    active = service.ActiveModel(root)
    assert active.get(spark) is None
    registry.record(spark, root, "v1", 0.9, 0.5, "m")
    registry.record(spark, root, "v2", 0.95, 0.5, "m")
    registry.activate(spark, root, "v1")
    assert active.get(spark)[:2] == ("v1", "model v1") and active.get(spark)[0] == "v1"
    registry.activate(spark, root, "v2")
    assert active.get(spark)[0] == "v2"
    registry.activate(spark, root, "v1")
    assert active.get(spark)[0] == "v1" and loads == ["v1", "v2", "v1"]


def test_model_alerts_in_the_service(spark, own, tmp_path, monkeypatch):
    """Only rows with usable features are scored; the batch is written with the version active at its start."""
    root, inbox = str(tmp_path / "models"), str(tmp_path / "in")
    registry.record(spark, root, "v1", 0.9, 0.5, "m")
    registry.activate(spark, root, "v1")
    monkeypatch.setattr(service.train, "load", lambda *_: (None, {}))
    weights = [1.0] + [0.0] * 29
    monkeypatch.setattr(
        service.scoring, "score",
        lambda df, model, scale, threshold, version: scoring.score_linear(df, weights, 0.0, scale, threshold, version).filter("outcome = 'scored'"),
    )
    full = {n: 0.0 for n in schemas.FEATURE_NAMES}
    rows = [body(0, "a", 10, 1, features={**full, "V1": 9.0}), body(1, "a", 10, 2, features={**full, "V1": -9.0}), body(2, "a", 10, 3), body(3, "a", 10, 4, features={"V1": 9.0})]
    feed(records(spark, rows), inbox)
    job = Service(own, str(tmp_path / "out"), str(tmp_path / "cp"), model_root=root)
    job.start_model(job.transactions(own.readStream.schema(schemas.RAW_RECORD).parquet(inbox))).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/alerts").collect()
    assert [(r.transaction_id, r.pattern_id, r.source, r.severity) for r in got] == [("x0", "ML001", "ML", "CRITICAL")]
