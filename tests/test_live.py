"""Rules that change under a running stream, bounded merging, state that is filled and read from outside, panes and sketches."""

from datetime import date

import pandas as pd
import pytest
from helpers import txns
from pyspark.sql import functions as F
from test_streams import body, feed, records, run, source

from txnguard import schemas
from txnguard.operators import monitor as M
from txnguard.operators import patterns as P
from txnguard.operators.rules import busiest_slots, rule_as_of, with_version
from txnguard.sources import tables
from txnguard.streaming import jobs, live_rules
from txnguard.streaming.service import Service

FAR = 10_000_000
LOG = "rule_id string, rule_name string, enabled boolean, threshold_amount double, threshold_amount_high double, window_seconds int, min_occurrences int, severity string, rule_ts timestamp, rule_seq long"
BASE = {"P001": P.BUILTIN["P001"].with_(times=2), "P003": P.BUILTIN["P003"].with_(times=1), "P004": P.BUILTIN["P004"].with_(window_s=60)}
KNOWN = {**BASE, "P002": P.BUILTIN["P002"]}


@pytest.fixture(scope="module")
def own(spark):
    return jobs.stream_session(spark, partitions=2)


def log(spark, rows):
    """(rule, enabled, amount, times, seconds, seq)."""
    made = [(r, None, e, a, 0.0, 0, n, "LOW" if r == "P002" else None, s, q) for r, e, a, n, s, q in rows]
    df = spark.createDataFrame(made, LOG.replace("rule_ts timestamp", "at double"))
    return df.withColumn("rule_ts", F.timestamp_seconds("at")).select(*[c.split(" ")[0] for c in LOG.split(", ")])


def live(spark, own, tmp_path, key, steps):
    """Each step feeds rows and rule versions, then the stream runs and stops; alerts after each."""
    out = []
    for rows, versions in steps:
        feed(rows, str(tmp_path / "in"))
        feed(versions, str(tmp_path / "rules"))
        changes = own.readStream.schema(versions.schema).parquet(str(tmp_path / "rules"))
        found = live_rules.live_matches(own.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), changes, key, BASE, KNOWN, slots=3)
        out.append(sorted((r.pattern_id, r.id, r.severity) for r in run(spark, own, found, str(tmp_path / key)).collect()))
    return out


def test_a_country_batch_goes_through_its_state_once(spark, own, tmp_path):
    """However many steps use the rows that the state gives, each input row reaches the state one time."""
    rows = txns(spark, [(k * 1000, f"u{k % 7}", 300, "SUCCESS", "US" if k % 3 else "DE") for k in range(60)])
    feed(rows, str(tmp_path / "in"))
    given = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            given.add(len(pdf))
            yield pdf

    stream = jobs.first_seen_stream(own.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream, versions, found = stream.mapInPandas(counted, stream.schema), log(spark, [("P002", True, 100.0, 0, 0.0, 1)]), []

    def handle(batch, batch_id):
        with jobs.computed_once(batch):
            found.extend(jobs.new_country_alerts(batch, versions).collect())

    jobs.each_batch(stream, handle, str(tmp_path / "cp")).awaitTermination()
    assert len(found) == given.value == 14


def test_rule_changes_between_batches(spark, own, tmp_path):
    """P003 goes off and on, P002 begins with its first version, and rows before a change keep the older settings."""
    rows = txns(spark, [
        (1000, "a", 9, "FRAUD"), (2000, "a", 9, "SUCCESS"), (3000, "a", 300, "SUCCESS", "US"), (20_000, "b", 300, "SUCCESS", "US"),
        (30_000, "a", 9, "FRAUD"), (31_000, "a", 9, "SUCCESS"), (50_000, "a", 9, "FRAUD"), (51_000, "a", 9, "SUCCESS"),
        (52_000, "c", 300, "SUCCESS", "US"), (FAR, "z", 1, "OTHER"),
    ])
    first = log(spark, [("P002", True, 100.0, 0, 10.0, 1), ("P003", False, 0.0, 0, 25.0, 2)])
    second = log(spark, [("P003", True, 0.0, 1, 45.0, 3), ("P002", False, 100.0, 0, 50.0, 4)])
    got = live(spark, own, tmp_path, "user_id", [(rows.filter("event_ms < 40000"), first), (rows.filter("event_ms >= 40000"), second)])
    assert got[0] == [("P002", "t3", "LOW"), ("P003", "t1", "HIGH")]
    assert got[1] == [("P002", "t3", "LOW"), ("P003", "t1", "HIGH"), ("P003", "t7", "HIGH")]
    # A version from before the watermark is not lost: it counts for the rows that are not judged yet.
    more = txns(spark, [(FAR + 1, "q", 300, "SUCCESS", "VN"), (2 * FAR, "z", 1, "OTHER")]).withColumn("id", F.concat(F.lit("m"), "id"))
    late = log(spark, [("P002", True, 200.0, 0, 60.0, 5)])
    assert live(spark, own, tmp_path, "user_id", [(more, late)])[0] == [("P002", "mt0", "LOW"), *got[1]]


def test_lowered_limits_see_earlier_rows(spark, own, tmp_path):
    """A version that asks for more, or for other amounts, is applied to all rows of its window."""
    rows = txns(spark, [(1000 * i, "a", 70, "SUCCESS") for i in range(1, 7)] + [(FAR, "z", 1, "OTHER")])
    versions = log(spark, [("P001", True, 80.0, 3, 3.5, 1), ("P004", False, 0.0, 0, 0.0, 2), ("P001", False, 80.0, 3, 5.5, 3)])
    got = live(spark, own, tmp_path, "card_number", [(rows, versions)])
    assert got == [[("P001", "t3", "HIGH"), ("P001", "t4", "HIGH")]]


class Calls:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _call(self, out):
        self.calls += 1
        return out

    def exists(self):
        return self._call(bool(self.held))

    def containsKey(self, key):
        return self._call(key in self.held)

    def getValue(self, key):
        return self._call(self.held.get(key))

    def updateValue(self, key, value):
        self._call(self.held.__setitem__(key, value))


def test_state_calls_do_not_grow_with_the_pairs():
    """20,000 pairs of one slot, then the same and some new ones: a pair's first row counts, in a bounded number of state calls."""
    one = live_rules.LiveRuleProcessor.__new__(live_rules.LiveRuleProcessor)
    one.seen = Calls()
    users = [f"u{k}" for k in range(10_000)]
    rows = pd.DataFrame({"user_id": users * 2, "country": ["VN"] * 10_000 + ["US"] * 10_000, "event_ms": 5, "arrival": range(20_000)})
    assert one._first_seen(rows).all()
    more = pd.DataFrame({"user_id": ["u7", "u7", "new", "new", "u8"], "country": ["VN", "DE", "VN", "VN", None], "event_ms": 6, "arrival": [1, 2, 9, 3, 4]})
    assert one._first_seen(pd.concat([rows, more], ignore_index=True))[-5:].tolist() == [False, True, False, True, False]
    assert not one._first_seen(more).any() and not one._first_seen(rows).any()
    assert one.seen.calls < 1000


def test_service_with_live_rules(spark, own, tmp_path):
    """A switched-off pattern gives no alerts, the others keep their built-in settings, and a first version starts P002."""
    out, cp, inbox, rules = (str(tmp_path / n) for n in ("out", "cp", "in", "rules"))
    rows = [body(0, "b", 60, 4, "FRAUD"), body(1, "b", 70, 5, "FRAUD"), body(2, "b", 80, 6), body(3, "a", 10, 7), body(4, "a", 20, 8), body(5, "a", 30, 9),
            body(6, "c", 900, 10, country="US"), body(99, "z", 10, 1800)]
    feed(records(spark, rows), inbox)
    feed(records(spark, [{"ruleId": "P003", "enabled": False}, {"ruleId": "P002", "ruleName": "Far", "enabled": True, "thresholdAmount": 500, "severity": "LOW"}]), rules)
    job = Service(own, out, cp, live_rules=True)
    try:
        queries = job.start_all(own.readStream.schema(schemas.RAW_RECORD).parquet(inbox), own.readStream.schema(schemas.RAW_RECORD).parquet(rules))
        assert set(queries) == {"rules", "card", "user", "transactions"}
        for q in queries.values():
            q.awaitTermination()
    finally:
        own.streams.removeListener(job.quality)
    got = sorted((r.pattern_id, r.transaction_id, r.severity) for r in spark.read.parquet(f"{out}/alerts").collect())
    assert got == [("P001", "x5", "HIGH"), ("P002", "x6", "LOW")]


def test_versions_leave_absent_settings_alone():
    rule = with_version(P.BUILTIN["P004"], {"threshold_amount": 0.0, "threshold_amount_high": None, "window_seconds": 9, "rule_name": "", "severity": None})
    assert rule == P.BUILTIN["P004"].with_(window_s=9)


def dated(spark, rows):
    return spark.createDataFrame([(i, a, date(2024, 1, d)) for i, a, d in rows], "id string, arrival long, event_date date")


def test_merging_reads_the_batch_days_only(spark, tmp_path):
    """The first writer stays; a second day's batch reads nothing of the first day, and a batch run again replaces itself."""
    path, listed = str(tmp_path / "out"), []

    def put(batch_id, rows):
        new = jobs.first_stored(dated(spark, rows), path, batch_id, "event_date")
        jobs.write_batch(new, path, batch_id, ("event_date",))

    put(0, [("a", 2, 1), ("a", 1, 1), ("b", 3, 1)])
    put(1, [("a", 9, 1), ("c", 4, 2)])
    put(1, [("a", 9, 1), ("c", 4, 2)])
    assert sorted((r.id, r.arrival) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    known = jobs.stored_ids(spark, path, 7, "event_date", [date(2024, 1, 2)])
    assert [r.id for r in known.collect()] == ["c"]
    scan = known._jdf.queryExecution().executedPlan()
    listed = [f for f in spark.read.parquet(path).inputFiles() if "2024-01-02" in f]
    assert "PartitionFilters" in scan.toString() and "ReadSchema: struct<id:string>" in scan.toString() and len(listed) == 1
    assert jobs.stored_ids(spark, path, 7, "event_date", []).collect() == []


def test_a_busy_user_is_split_over_files(spark, tmp_path):
    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).cast("string").alias("user_id"),
        F.lit("c").alias("card_number"), F.lit(1).cast("decimal(12,2)").alias("amount"), F.lit("EUR").alias("currency"), F.lit("m").alias("merchant_id"),
        F.lit("VN").alias("country"), F.lit("SUCCESS").alias("status"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("event_time"),
        F.lit(None).cast("timestamp").alias("ingested_at"),
    )
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_transactions(rows.select(*schemas.TRANSACTIONS_TABLE), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(path).withColumn("file", F.input_file_name()).groupBy("user_id").agg(F.countDistinct("file").alias("n"))
    assert files.filter("user_id = '0'").first().n > 1 and files.filter("user_id <> '0'").agg(F.max("n")).first()[0] == 1


def test_state_from_history_and_its_audit(spark, own, tmp_path):
    history = own.createDataFrame([("u", "VN", 5), (None, "VN", 5), ("v", None, 5)], "user_id string, country string, event_ms long")
    rows = txns(spark, [(1000, "u", 1, "SUCCESS", "VN"), (2000, "u", 1, "SUCCESS", "US"), (3000, "v", 1, "SUCCESS", "VN")])
    feed(rows, str(tmp_path / "in"))
    got = run(spark, own, jobs.first_seen_stream(source(own, rows, str(tmp_path / "in")), history=history), str(tmp_path))
    assert sorted(r.id for r in got.collect()) == ["t1", "t2"]
    held = jobs.seen_pairs(own, f"{tmp_path}/cp").collect()
    assert sorted((r.user_id, r.country, r.since) for r in held) == [("u", "US", 2000), ("u", "VN", 5), ("v", "VN", 3000)]


def test_sliding_sums_by_hand(spark):
    ms = [0, 5, 14, 15, 100, 101, 130, 9_000]
    df = spark.createDataFrame([(m, m % 2 == 1) for m in ms], "event_ms long, is_fraud boolean")
    got = {r.window_ms: (r.fraud, r.total, r.fraud_rate) for r in M.fraud_rate_sliding(df, 30, 10).collect()}
    assert sorted(got) == list(range(-20, 9_001, 10))
    for start, (fraud, total, rate) in got.items():
        own_rows = [m for m in ms if start <= m < start + 30]
        assert total == len(own_rows) and fraud == sum(m % 2 for m in own_rows)
        assert rate is None if not total else rate == pytest.approx(100 * fraud / total)
    assert M.fraud_rate_sliding(df.limit(0), 30, 10).collect() == []
    with pytest.raises(ValueError):
        M.sliding_sums(df, {}, 25, 10)


def test_merged_sketches_keep_the_rank_error(spark):
    df = spark.range(200_000).select((F.col("id") * 3).alias("event_ms"), F.pmod(F.xxhash64("id"), F.lit(100_003)).cast("double").alias("latency_ms"))
    merged = M.merge_sketches(M.latency_sketches(df, 1000), 10**9)
    values = sorted(r.latency_ms for r in df.collect())
    for r in M.sketch_quantiles(merged, (0.1, 0.5, 0.99)).collect():
        assert r.n == 200_000 and abs(sum(v <= r.value for v in values) / len(values) - r.q) < M.RANK_ERROR


def test_slots_follow_the_busiest_chunk(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 5).otherwise(F.col("id") * 10).alias("event_ms"), F.col("id").cast("string").alias("id"))
    assert (busiest_slots(rows, 1000, 100), busiest_slots(rows, 1000), busiest_slots(rows.limit(0), 1000)) == (9, 1, 1)
    versions = log(spark, [("P002", True, 1.0, 0, 0.0, 1), ("P002", False, 1.0, 0, 9.5, 2)])
    counts = {rule_as_of(rows, versions, "P002", 1000, slots).count() for slots in (None, 1, 7)}
    assert counts == {rows.filter("event_ms < 9500").count()}


def test_interleaved_bits(spark):
    pairs = [(a, b) for a in (0, 1, 5, 4095) for b in (0, 2, 7, 4095)]
    df = spark.createDataFrame(pairs, "a int, b int")
    for r in df.withColumn("z", tables.interleaved(F.col("a"), F.col("b"))).collect():
        want = int("".join(x + y for x, y in zip(f"{r.a:012b}", f"{r.b:012b}", strict=True)), 2)
        assert r.z == want


def test_lookups_skip_row_groups(spark, tmp_path):
    rows = spark.range(6000).select(
        F.md5(F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 2 == 0, F.col("id") % 97).cast("string").alias("user_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("detected_at"),
    )
    path = str(tmp_path / "lookups")
    tables.write_for_lookups(rows, path, rows_per_file=200)
    stored = spark.read.parquet(path)
    assert stored.count() == 6000 and len(stored.inputFiles()) >= 25
    key = stored.agg(F.max("id")).first()[0]
    found = tables.lookup_id(stored, key)
    assert [r.id for r in found.collect()] == [key] and tables.rows_scanned(found) <= 600
    mine = tables.lookup_user(stored, "42", "2024-01-02T00:00:00Z", "2024-01-04T00:00:00Z")
    want = rows.filter("user_id = '42' and detected_at >= '2024-01-02T00:00:00Z' and detected_at < '2024-01-04T00:00:00Z'").count()
    assert mine.count() == want > 0 and tables.rows_scanned(mine) <= 1800
    tables.write_for_lookups(rows.limit(0), path)
    assert spark.read.parquet(path).count() == 0
