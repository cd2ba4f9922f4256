"""Behaviour patterns per card or user, as batch DataFrame operators.

Order inside a key is event time in milliseconds, then arrival. A run starts at every row that fits the first
stage and always takes the next fitting row; rows that fit nothing are skipped. A match counts only when the last
row is strictly less than the window after the first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnguard.operators.ordered import chunk_of, spread_chunks

ORDER = ("event_ms", "arrival")


@dataclass(frozen=True)
class PatternRule:
    """One pattern's settings. Amounts are in account currency, the window in seconds."""

    rule_id: str
    name: str
    severity: str
    low: float | None = None
    high: float | None = None
    window_s: int = 60
    times: int = 2

    def __post_init__(self) -> None:
        if self.times < 1 or self.window_s < 1:
            raise ValueError(f"{self.rule_id}: times and window must be positive")

    def with_(self, **changes) -> "PatternRule":
        return replace(self, **changes)


# The built-in rule profile, and the amount limit that differs in the shipped rule file.
BUILTIN = {
    "P001": PatternRule("P001", "Rapid Small Transactions", "HIGH", high=50.0, window_s=60, times=3),
    "P002": PatternRule("P002", "High Value New Location", "CRITICAL", low=200.0),
    "P003": PatternRule("P003", "Multiple Fraud Then Success", "HIGH", window_s=300, times=2),
    "P004": PatternRule("P004", "Mid-Range Velocity", "MEDIUM", low=50.0, high=500.0, window_s=600, times=2),
}
RULES_FILE = {**BUILTIN, "P001": BUILTIN["P001"].with_(high=20.0)}


def decimal(value: float) -> Column:
    return F.lit(str(value)).cast("decimal(38,18)")


def is_success() -> Column:
    return F.col("status") == "SUCCESS"


def is_failed() -> Column:
    return F.col("status") == "FRAUD"


def is_small(rule: PatternRule) -> Column:
    return (F.col("amount") < decimal(rule.high)) & is_success()


def is_midrange(rule: PatternRule) -> Column:
    inside = F.col("amount") >= decimal(rule.low)
    if rule.high is not None:
        inside = inside & (F.col("amount") <= decimal(rule.high))
    return inside & is_success()


def repeated_within(
    df: DataFrame,
    key: str,
    fits: Column,
    times: int,
    window_s: int,
    order: Sequence[str] = ORDER,
    chunk_ms: int | None = None,
) -> DataFrame:
    """Rows that end ``times`` fitting rows of one key in less than ``window_s`` seconds, with ``first_id``.

    Rows that do not fit never matter, so they are dropped before the only shuffle.
    """
    within_ms = window_s * 1000
    rows = df.filter(fits & F.col(key).isNotNull())
    if times > 1:
        rows, chunk_ms = spread_chunks(rows, order[0], within_ms, chunk_ms)
        w = Window.partitionBy(key, "chunk").orderBy(*order)
        rows = rows.withColumn("_first", F.lag(F.struct(F.col(order[0]).alias("ms"), "id"), times - 1).over(w))
        rows = rows.filter(
            (F.col(order[0]) - F.col("_first.ms") < within_ms) & (chunk_of(F.col(order[0]), chunk_ms) == F.col("chunk"))
        )
    else:
        rows = rows.withColumn("_first", F.struct(F.col(order[0]).alias("ms"), "id"))
        rows = rows.withColumn("chunk", F.lit(0))
    return rows.withColumn("first_id", F.col("_first.id")).drop("_first", "chunk")


def repeated_patterns(
    df: DataFrame,
    key: str,
    wanted: Sequence[tuple[PatternRule, Column]],
    order: Sequence[str] = ORDER,
    chunk_ms: int | None = None,
) -> DataFrame:
    """Several "n fitting rows" patterns of one key in one scan, one exchange and one sort.

    One output row per match, on its last row, with ``pattern_id`` and ``first_id``.
    """
    ms = F.col(order[0])
    any_fits = F.lit(False)
    for _, fits in wanted:
        any_fits = any_fits | fits
    rows = df.filter(any_fits & F.col(key).isNotNull())
    rows, chunk_ms = spread_chunks(rows, order[0], max(r.window_s for r, _ in wanted) * 1000, chunk_ms)
    here = F.struct(ms.alias("ms"), "id")
    rows = rows.withColumns({f"_fit{i}": F.when(fits, here) for i, (_, fits) in enumerate(wanted)})
    over = f"over (partition by `{key}`, chunk order by {', '.join(order)})"
    firsts, hits = {}, []
    for i, (rule, _) in enumerate(wanted):
        back = rule.times - 1
        firsts[f"_first{i}"] = F.expr(f"lag(_fit{i}, {back}) ignore nulls {over}") if back else F.col(f"_fit{i}")
        first = F.col(f"_first{i}")
        found = F.col(f"_fit{i}").isNotNull() & (ms - first["ms"] < rule.window_s * 1000)
        hits.append(F.when(found, F.struct(F.lit(rule.rule_id).alias("pattern_id"), first["id"].alias("first_id"))))
    rows = rows.withColumns(firsts).filter(chunk_of(ms, chunk_ms) == F.col("chunk"))
    rows = rows.withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
    return rows.select(*df.columns, "_hit.*")


def rapid_small(df: DataFrame, rule: PatternRule = BUILTIN["P001"], **kw) -> DataFrame:
    return repeated_within(df, "card_number", is_small(rule), rule.times, rule.window_s, **kw)


def midrange_velocity(df: DataFrame, rule: PatternRule = BUILTIN["P004"], **kw) -> DataFrame:
    return repeated_within(df, "card_number", is_midrange(rule), rule.times, rule.window_s, **kw)


def fail_then_success(
    df: DataFrame,
    rule: PatternRule = BUILTIN["P003"],
    key: str = "user_id",
    order: Sequence[str] = ORDER,
    chunk_ms: int | None = None,
    columns: Sequence[str] = ("id", "user_id", "card_number", "amount"),
) -> DataFrame:
    """``times`` failed rows, then the next successful row: one output row per match, on the successful row.

    One window pass: each failed row looks back over failed rows only and forward to the next success, of which it
    takes ``columns`` and the order columns.
    """
    within_ms = rule.window_s * 1000
    rows = df.filter(F.col(key).isNotNull() & (is_failed() | is_success()))
    rows, chunk_ms = spread_chunks(rows, order[0], within_ms, chunk_ms)
    payload = [c for c in dict.fromkeys([*columns, *order]) if c != key]
    rows = rows.withColumns(
        {
            "_failed": F.when(is_failed(), F.struct(F.col(order[0]).alias("ms"), "id")),
            "_success": F.when(is_success(), F.struct(*payload)),
        }
    )
    over = f"over (partition by `{key}`, chunk order by {', '.join(order)})"
    first = F.col("_failed") if rule.times == 1 else F.expr(f"lag(_failed, {rule.times - 1}) ignore nulls {over}")
    rows = rows.withColumns({"_first": first, "_end": F.expr(f"lead(_success) ignore nulls {over}")})
    hit = (
        F.col("_failed").isNotNull()
        & (F.col(f"_end.{order[0]}") - F.col("_first.ms") < within_ms)
        & (chunk_of(F.col(f"_end.{order[0]}"), chunk_ms) == F.col("chunk"))
    )
    return rows.filter(hit).select(key, "_end.*", F.col("_first.id").alias("first_id"))


def match_sequence(
    df: DataFrame,
    key: str,
    stages: Sequence[tuple[str, Column, int]],
    window_s: int,
    order: Sequence[str] = ORDER,
    columns: Sequence[str] = ("id",),
    chunk_ms: int | None = None,
) -> DataFrame:
    """General sequence: ``stages`` of (name, condition, times). One row per match, one struct array per stage.

    Built from the last stage back to the first: every row learns where the rest of the sequence would go from
    it, by looking ahead to the next fitting rows. All passes share one exchange and one sort.
    """
    within_ms = window_s * 1000
    flags = {f"_is_{name}": cond for name, cond, _ in stages}
    rows = df.filter(F.col(key).isNotNull()).withColumns(flags)
    any_stage = F.lit(False)
    for flag in flags:
        any_stage = any_stage | F.coalesce(F.col(flag), F.lit(False))
    kept = list(dict.fromkeys([*order, *columns]))
    rows = rows.filter(any_stage).select(key, *kept, *flags)
    rows, chunk_ms = spread_chunks(rows, order[0], within_ms, chunk_ms)
    over = f"over (partition by `{key}`, chunk order by {', '.join(order)})"
    row = F.struct(*kept)

    rest = None  # column holding, per row, the stage arrays of the stages after the current one
    for depth in range(len(stages) - 1, -1, -1):
        name, _, times = stages[depth]
        here = F.struct(row.alias("row"), *([F.col(rest).alias("rest")] if rest else []))
        rows = rows.withColumn("_fit", F.when(F.col(f"_is_{name}"), here))
        ahead = range(0, times) if depth == 0 else range(1, times + 1)
        picks = [F.col("_fit") if i == 0 else F.expr(f"lead(_fit, {i}) ignore nulls {over}") for i in ahead]
        rows = rows.withColumns({f"_p{j}": p for j, p in enumerate(picks)})
        last = f"_p{times - 1}"
        ok = F.col(last).isNotNull() & F.col("_p0").isNotNull()
        if rest:
            ok = ok & F.col(f"{last}.rest").isNotNull()
        fields = [F.array(*[F.col(f"_p{j}.row") for j in range(times)]).alias(name)]
        if rest:
            fields += [F.col(f"{last}.rest.{later}").alias(later) for later, _, _ in stages[depth + 1 :]]
        rest = f"_rest{depth}"
        rows = rows.withColumn(rest, F.when(ok, F.struct(*fields))).drop(
            "_fit", *[f"_p{j}" for j in range(times)], f"_rest{depth + 1}"
        )
    first_name, last_name = stages[0][0], stages[-1][0]
    found = rows.filter(F.col(rest).isNotNull()).select(key, "chunk", f"{rest}.*")
    start = F.element_at(first_name, 1)[order[0]]
    end = F.element_at(last_name, -1)[order[0]]
    return found.filter((end - start < within_ms) & (chunk_of(end, chunk_ms) == F.col("chunk"))).drop("chunk")


def first_in_country(df: DataFrame, order: Sequence[str] = ("arrival",)) -> DataFrame:
    """The first row, by arrival, of each user in each country, whatever its amount.

    ``row_number() = 1`` is cut down in every input task before the shuffle, so a busy user sends one row per task.
    """
    w = Window.partitionBy("user_id", "country").orderBy(*order)
    rows = df.filter(F.col("user_id").isNotNull() & F.col("country").isNotNull())
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def new_country(df: DataFrame, rule: PatternRule = BUILTIN["P002"], order: Sequence[str] = ("arrival",)) -> DataFrame:
    """High value in a country the user has not been seen in; the amount is tested only after the first-seen step."""
    return first_in_country(df, order).filter(F.col("amount").cast("double") > F.lit(float(rule.low)))
