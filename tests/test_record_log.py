"""The record log: offsets, both starts, restarts, batches that run twice, and what no commit names."""

import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from txnguard.sources import record_log as R


def frame(spark, first, n):
    rows = spark.range(first, first + n)
    return rows.select(F.concat(F.lit("k"), F.col("id") % 40).alias("key"), F.col("id").cast("string").alias("value")).repartition(3)


def stream(spark, path, name, tmp_path, starting):
    rows = R.read_stream(spark, path, starting)
    rows.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(str(tmp_path / name)).collect()


def test_both_starts_over_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    R.append(frame(spark, 0, 500), path)
    early, late = (stream(spark, path, s, tmp_path, s) for s in ("earliest", "latest"))
    assert sorted(int(r.value) for r in early) == list(range(500)) and late == []
    R.append(frame(spark, 500, 300), path)
    early, late = (stream(spark, path, s, tmp_path, s) for s in ("earliest", "latest"))
    assert sorted(int(r.value) for r in early) == list(range(800)) and sorted(int(r.value) for r in late) == list(range(500, 800))
    by_part = {}
    for r in early:
        assert r.partition == zlib.crc32(bytes(r.key)) % R.PARTITIONS
        by_part.setdefault(r.partition, []).append(r.offset)
    assert len(by_part) == R.PARTITIONS and all(sorted(o) == list(range(len(o))) for o in by_part.values())
    assert R.Log(path).end()["ends"] == {str(p): len(o) for p, o in by_part.items()}
    whole = spark.read.format(R.NAME).option("path", path).load()
    assert whole.count() == 800 and stream(spark, path, "earliest", tmp_path, "earliest") is not None


def test_a_stream_is_copied_once(spark, tmp_path):
    source, copy = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(2):
        R.append(frame(spark, 100 * k, 100), source)
        R.write_stream(R.read_stream(spark, source, "earliest"), copy, str(tmp_path / "cp"), "copy").awaitTermination()
    assert sorted(int(r.value) for r in spark.read.format(R.NAME).option("path", copy).load().collect()) == list(range(200))


def test_a_repeated_batch_and_uncommitted_segments(tmp_path):
    path = str(tmp_path / "log")
    log, table = R.Log(path), pa.table({"key": [b"a"], "value": [b"1"], "timestamp": [0]}).cast(R.STORED)
    assert log.end() == {"commit": 0, "ends": {}} and R.segments_between(log, 0, 0) == []
    names = [log.put(table) for _ in range(3)]
    assert log.append("w", 0, [(2, 1, names[0])]) and not log.append("w", 0, [(2, 1, names[1])])
    assert log.append("other", 0, [(2, 1, names[1])]) and log.append("w", 1, [(0, 1, names[0])])
    assert log.end() == {"commit": 3, "ends": {"2": 2, "0": 1}}
    found = R.segments_between(log, 0, 3)
    assert [(s.partition, s.files) for s in found] == [(0, [(names[0], 0)]), (2, [(names[0], 0), (names[1], 1)])]
    assert [b.to_pylist()[0]["offset"] for b in R.records(path, found[1])] == [0, 1]


def test_nulls_and_refusals(spark, tmp_path):
    rows = spark.createDataFrame([(None, "x"), ("k", None)], "key string, value string")
    R.append(rows, f"{tmp_path}/log")
    found = spark.read.format(R.NAME).option("path", f"{tmp_path}/log").load().collect()
    assert {(r.key and bytes(r.key), r.value and bytes(r.value)) for r in found} == {(None, b"x"), (b"k", None)}
    R.append(rows.limit(0), f"{tmp_path}/empty")
    assert spark.read.format(R.NAME).option("path", f"{tmp_path}/empty").load().count() == 0
    with pytest.raises(Exception, match="appended"):
        R.as_records(rows).write.format(R.NAME).mode("overwrite").option("path", f"{tmp_path}/log").save()
