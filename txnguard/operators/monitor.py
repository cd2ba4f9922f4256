"""Monitoring aggregates: exact counts per time window, quantiles, bands. Each works on a stream too unless noted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnguard.operators.ordered import chunk_of, exact_quantiles, previous_value, running_totals
from txnguard.workdir import materialize

# Band limits of the health display.
FRAUD_RATE_BANDS = (5.0, 20.0)
LATENCY_BANDS_MS = (100.0, 500.0)
MALFORMED_BANDS = (1.0, 10.0)
# Usual upper bounds of a latency histogram, in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def windowed(
    df: DataFrame,
    every: str,
    aggs: dict[str, Column],
    keys: Sequence[str] = (),
    ts: str = "event_time",
    slide: str | None = None,
) -> DataFrame:
    """``aggs`` per time window (tumbling, or sliding with ``slide``) and keys; ``window_ms`` is the window's start.

    All aggregates used here combine in the input tasks, so a busy window costs one row per task.
    """
    window = F.window(ts, every, slide) if slide else F.window(ts, every)
    out = df.groupBy(window, *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.unix_millis("window.start").alias("window_ms"), *keys, *aggs)


def fraud_count(log: DataFrame, every: str = "5 minutes", slide: str | None = None) -> DataFrame:
    return windowed(log, every, {"fraud": F.count_if("is_fraud")}, slide=slide)


def ratio_percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole)


def fraud_rate(log: DataFrame, every: str = "5 minutes", slide: str | None = None) -> DataFrame:
    rate = ratio_percent(F.count_if("is_fraud"), F.count("*"))
    return windowed(log, every, {"fraud_rate": rate}, slide=slide)


#: Panes whose running totals one task adds up.
PANES_PER_CHUNK = 4096


def sliding_sums(log: DataFrame, sums: dict[str, Column], window_ms: int, slide_ms: int, ms: str = "event_ms") -> DataFrame:
    """``sums`` over every window of ``window_ms`` that begins on the grid of ``slide_ms`` and meets the rows' time; batch only.

    Rows are added up once, by pane of one slide, with one row per pane and task going to the shuffle. A window is the
    difference of two running totals over the panes, empty ones included, so a row costs the same however long the
    window is. Windows without rows have sums of 0. ``window_ms`` must be a multiple of ``slide_ms``.
    """
    if window_ms % slide_ms:
        raise ValueError("the window must be whole slides long")
    span = window_ms // slide_ms
    panes = log.filter(F.col(ms).isNotNull()).groupBy(F.floor(F.col(ms) / slide_ms).alias("pane")).agg(*[c.alias(n) for n, c in sums.items()])
    panes = materialize(panes, "panes")
    ends = panes.agg(F.min("pane").alias("first"), F.max("pane").alias("last")).filter("first is not null")
    axis = ends.select(F.explode(F.sequence(F.col("first") - span, F.col("last") + span - 1)).alias("pane"))
    whole = axis.join(panes, "pane", "left").fillna(0, list(sums))
    whole = running_totals(whole, chunk_of(F.col("pane"), PANES_PER_CHUNK), ["pane"], {f"_cum_{n}": F.col(n) for n in sums})
    whole = materialize(whole.select("pane", *[f"_cum_{n}" for n in sums]), "pane-totals")
    before = whole.select((F.col("pane") + span).alias("pane"), *[F.col(f"_cum_{n}").alias(f"_from_{n}") for n in sums])
    both = whole.join(before, "pane")
    start = ((F.col("pane") - span + 1) * slide_ms).alias("window_ms")
    return both.select(start, *[(F.col(f"_cum_{n}") - F.col(f"_from_{n}")).alias(n) for n in sums])


def fraud_rate_sliding(log: DataFrame, window_ms: int = 300_000, slide_ms: int = 15_000) -> DataFrame:
    """``fraud``, ``total`` and ``fraud_rate`` (null without rows) per sliding window, empty ones in between included."""
    sums = sliding_sums(log, {"fraud": F.count_if("is_fraud"), "total": F.count("*")}, window_ms, slide_ms)
    return sums.withColumn("fraud_rate", ratio_percent(F.col("fraud"), F.col("total")))


#: Size of the quantile sketches, and the error of a rank, as a share, that they keep nearly always.
SKETCH_K = 400
RANK_ERROR = 0.01


def latency_sketches(log: DataFrame, every_ms: int = 300_000, value: str = "latency_ms", ms: str = "event_ms") -> DataFrame:
    """One mergeable quantile sketch per window: a few kilobytes, whatever the number of rows."""
    start = (F.floor(F.col(ms) / every_ms) * every_ms).alias("window_ms")
    return log.groupBy(start).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_K)).alias("sketch"), F.count(value).alias("n"))


def merge_sketches(sketches: DataFrame, every_ms: int) -> DataFrame:
    """Sketches of longer windows from stored ones; no row is read again."""
    start = (F.floor(F.col("window_ms") / every_ms) * every_ms).alias("window_ms")
    return sketches.groupBy(start).agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"), F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``q`` and ``value`` per sketch."""
    found = [F.struct(F.lit(float(p)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in probs]
    return sketches.withColumn("_q", F.explode(F.array(*found))).select(*[c for c in sketches.columns if c != "sketch"], "_q.*")


def prediction_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("is_fraud").agg(F.count("*").alias("n"))


def prediction_rate(log: DataFrame, seconds: int = 60) -> DataFrame:
    return windowed(
        log,
        f"{seconds} seconds",
        {"fraud_per_s": F.count_if("is_fraud") / float(seconds), "total_per_s": F.count("*") / float(seconds)},
    )


def quality_rate(classified: DataFrame, seconds: int = 60, ts: str = "timestamp") -> DataFrame:
    bad = F.col("reason").isNotNull()
    return windowed(
        classified,
        f"{seconds} seconds",
        {"valid_per_s": F.count_if(~bad) / float(seconds), "malformed_per_s": F.count_if(bad) / float(seconds)},
        ts=ts,
    )


def malformed_count(classified: DataFrame, every: str = "5 minutes", ts: str = "timestamp") -> DataFrame:
    return windowed(classified, every, {"malformed": F.count_if(F.col("reason").isNotNull())}, ts=ts)


def outcome_rate(log: DataFrame, seconds: int = 60) -> DataFrame:
    status = F.col("status_code").cast("string")
    return windowed(
        log,
        f"{seconds} seconds",
        {
            "success_per_s": F.count_if(status.rlike("^2..$")) / float(seconds),
            "error_per_s": F.count_if(status.rlike("^5..$")) / float(seconds),
        },
    )


def alerts_by_pattern(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("source", "pattern_id", "severity").agg(F.count("*").alias("n"))


def alert_rate(alerts: DataFrame, every: str, seconds: int, ts: str = "detected_at") -> DataFrame:
    return windowed(alerts, every, {"per_s": F.count("*") / float(seconds)}, keys=["source"], ts=ts)


def latency_quantiles(log: DataFrame, probs: Sequence[float] = (0.5, 0.95, 0.99), keys: Sequence[str] = ()) -> DataFrame:
    """Exact, from ranks (batch only)."""
    return exact_quantiles(log, "latency_ms", probs, keys)


def latency_quantiles_approx(log: DataFrame, every: str = "5 minutes", probs=(0.5, 0.95, 0.99)) -> DataFrame:
    """Sketch per window, for streams."""
    return windowed(log, every, {"quantiles": F.percentile_approx("latency_ms", list(probs), 10_000)})


def histogram(df: DataFrame, seconds: Column, keys: Sequence[str] = (), bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """Observations per bucket: the smallest bound ``le`` not below the value; infinity above the last bound."""
    le = F.lit(float("inf"))
    for bound in reversed(bounds):
        le = F.when(seconds <= bound, float(bound)).otherwise(le)
    return df.groupBy(*keys, le.alias("le")).agg(F.count("*").alias("n"))


def histogram_quantile(buckets: DataFrame, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """Quantile estimate from bucket counts by linear interpolation; the last finite bound for the open bucket.

    The input has one row per key and bucket, so the windows are short.
    """
    keys = list(keys)
    ordered = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    rows = buckets.withColumns(
        {
            "_cum": F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
            "_rank": F.sum("n").over(whole) * F.lit(q),
        }
    )
    rows = rows.filter((F.col("_cum") >= F.col("_rank")) & (F.col("_cum") - F.col("n") < F.col("_rank")))
    return rows.withColumn("_before", F.col("_cum") - F.col("n"))


def quantile_from_histogram(
    df: DataFrame, seconds: Column, q: float, keys: Sequence[str] = (), bounds: Sequence[float] = LATENCY_BOUNDS
) -> DataFrame:
    hit = histogram_quantile(histogram(df, seconds, keys, bounds), q, keys)
    lower = F.lit(0.0)
    for low, high in zip(bounds, [*bounds[1:], float("inf")]):
        lower = F.when(F.col("le") == float(high), float(low)).otherwise(lower)
    inner = lower + (F.col("le") - lower) * (F.col("_rank") - F.col("_before")) / F.col("n")
    value = F.when(F.col("le") == float("inf"), F.lit(float(bounds[-1]))).otherwise(inner)
    return hit.select(*keys, F.lit(q).alias("q"), value.alias("value"))


def band(value: Column, limits: tuple[float, float]) -> Column:
    return F.when(value >= limits[1], "red").when(value >= limits[0], "yellow").otherwise("green")


def counter_increase(
    readings: DataFrame, series: str, value: str, window_ms: int, order: Sequence[str] = ("event_ms", "arrival")
) -> DataFrame:
    """Increase of running counters per window; a fall is a restart from zero. Batch only.

    The look-back is carried across windows, so one busy series does not end up in one task.
    """
    chunk = chunk_of(F.col(order[0]), window_ms)
    rows = previous_value(readings, [series], chunk, list(order), value, "_before")
    step = F.when(F.col("_before").isNull(), 0.0).when(F.col(value) < F.col("_before"), F.col(value))
    step = step.otherwise(F.col(value) - F.col("_before"))
    rows = rows.withColumns({"window_ms": chunk * window_ms, "_step": step})
    return rows.groupBy(series, "window_ms").agg(F.sum("_step").alias("increase"))
