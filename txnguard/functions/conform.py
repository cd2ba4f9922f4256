"""Casts and constraint checks for the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.functions.once import with_once


def conform(
    df: DataFrame, table: dict, defaults: dict | None = None, keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` for a table of column -> (type, nullable, maximum text length).

    ``defaults`` fill nulls first; columns in ``keep`` that the input has go along with the accepted rows. A rejected row keeps its own values and gets ``reject_reason``: the first broken
    constraint in column order.
    """
    defaults = defaults or {}
    given = {n: F.col(n) if n in df.columns else F.lit(None) for n in table}
    given = {n: F.coalesce(c, defaults[n]) if n in defaults else c for n, c in given.items()}
    typed = {n: c.try_cast(table[n][0]) for n, c in given.items()}
    reason = F.lit(None).cast("string")
    for name, (_, nullable, length) in reversed(table.items()):
        if length is not None:
            reason = F.when(F.length(typed[name]) > length, f"{name}_too_long").otherwise(reason)
        reason = F.when(given[name].isNotNull() & typed[name].isNull(), f"{name}_not_storable").otherwise(reason)
        if not nullable:
            reason = F.when(given[name].isNull(), f"{name}_null").otherwise(reason)
    marked = with_once(df, "reject_reason", reason)
    accepted = marked.filter(F.col("reject_reason").isNull()).select(
        *[c.alias(n) for n, c in typed.items()], *[c for c in keep if c in df.columns]
    )
    return accepted, marked.filter(F.col("reject_reason").isNotNull())
