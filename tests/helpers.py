"""Small hand-made tables and a run-by-run matcher to compare with."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

TXN = (
    "id string, arrival long, user_id string, card_number string, amount decimal(38,18), country string, status string, "
    "event_ms long"
)


def txns(spark, rows):
    """Rows of (ms, key, amount, status[, country]); the key is both user and card."""
    data = []
    for i, (ms, key, amount, status, *rest) in enumerate(rows):
        data.append((f"t{i}", i, key, key, str(amount), rest[0] if rest else "VN", status, ms))
    df = spark.createDataFrame(data, TXN.replace("amount decimal(38,18)", "amount string"))
    df = df.withColumn("amount", F.col("amount").cast("decimal(38,18)"))
    return df.withColumn("event_time", F.timestamp_millis("event_ms"))


def random_rows(seed, n=300, keys=3, span_ms=400_000):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        # The first key takes more than a third of all rows; times repeat on purpose.
        key = "k0" if rng.random() < 0.4 else f"k{rng.randrange(keys)}"
        ms = rng.randrange(0, span_ms, 500)
        rows.append((ms, key, rng.choice([5, 20, 49.99, 50, 75, 500, 500.01]), rng.choice(["SUCCESS", "SUCCESS", "FRAUD", "OTHER"])))
    return rows


def brute_force(rows, stages, within_ms):
    """Every run from every first-stage row, always taking the next fitting row. Sorted (first, last) ids."""
    by_key = defaultdict(list)
    for i, row in enumerate(rows):
        by_key[row[1]].append((row[0], i, row))
    found = []
    for items in by_key.values():
        items.sort(key=lambda x: (x[0], x[1]))
        for start, (ms0, i0, row0) in enumerate(items):
            plan = [fits for fits, times in stages for _ in range(times)]
            if not plan[0](row0):
                continue
            step, last = 1, (ms0, i0)
            for ms, i, row in items[start + 1 :]:
                if step == len(plan):
                    break
                if plan[step](row):
                    step, last = step + 1, (ms, i)
            if step == len(plan) and last[0] - ms0 < within_ms:
                found.append((f"t{i0}", f"t{last[1]}"))
    return sorted(found)


def small(row):
    return row[2] < 50 and row[3] == "SUCCESS"


def midrange(row):
    return 50 <= row[2] <= 500 and row[3] == "SUCCESS"


def failed(row):
    return row[3] == "FRAUD"


def success(row):
    return row[3] == "SUCCESS"
