"""Patterns whose settings change while the stream runs: rule versions and transactions in one stateful stream."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence as Seq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from txnguard.functions import alerts as A
from txnguard.operators.patterns import PatternRule
from txnguard.operators.rules import with_version
from txnguard.streaming import jobs
from txnguard.streaming.processors import Sequence, find_runs, pack, unpack

#: The longest window that a rule may ask for; rows are kept so long.
HORIZON_MS = 86_400_000
#: What the patterns of a key read. Spark hands the state row by row, so each column counts.
LIVE_COLUMNS = {
    "card_number": ["event_ms", "arrival", "id", "user_id", "card_number", "amount", "status"],
    "user_id": ["event_ms", "arrival", "id", "user_id", "amount", "status", "country"],
}
LIVE_SCHEMA = (
    "pattern_id string, pattern_name string, severity string, description string, first_id string, id string, user_id string, "
    "amount double, event_ms long"
)
RULE_FIELDS = ["rule_id", "rule_name", "enabled", "threshold_amount", "threshold_amount_high", "window_seconds", "min_occurrences", "severity"]
KEYS = {"P001": "card_number", "P002": "user_id", "P003": "user_id", "P004": "card_number"}
SUCCESS, FAILED = "SUCCESS", "FRAUD"
FOREVER = 2**62
#: Packed tables that hold a slot's pairs of user and country; a batch opens those of its users. Fixed for a checkpoint's life.
PAIR_BUCKETS = 64
PAIR = ["user_id", "country"]


class Version:
    """A rule's settings from ``since`` on."""

    def __init__(self, since: int, seq: int, body: dict) -> None:
        self.since, self.seq, self.body = since, seq, body


def stage_bits(rule: PatternRule, rows: pd.DataFrame) -> tuple[np.ndarray, Sequence]:
    """Which stages each row fits under these settings, and the sequence of them."""
    ok, amount = (rows["status"] == SUCCESS).to_numpy(), rows["amount"].to_numpy()
    if rule.rule_id == "P003":
        failed = (rows["status"] == FAILED).to_numpy()
        stages, bits = ((0, rule.times), (1, 1)), failed * 1 + ok * 2
    else:
        low, high = rule.low if rule.rule_id == "P004" else None, rule.high
        inside = ok & (amount >= low if low is not None else True)
        if high is not None:
            inside = inside & (amount <= high if rule.rule_id == "P004" else amount < high)
        stages, bits = ((0, rule.times),), inside * 1
    return bits.astype(np.int64), Sequence(rule.rule_id, stages, rule.window_s * 1000)


def description(rule: PatternRule, row) -> str:
    if rule.rule_id == "P001":
        return f"{rule.times} transactions under {A.plain(rule.high)} EUR within {rule.window_s}s on card {row.card_number}"
    if rule.rule_id == "P003":
        return f"{rule.times} fraud attempts followed by success for {row.user_id}"
    if rule.rule_id == "P004":
        span = f"between {A.plain(rule.low)}-{A.plain(rule.high)}" if rule.high is not None else f"from {A.plain(rule.low)}"
        return f"{rule.times} transactions {span} EUR within {rule.window_s}s on card {row.card_number}"
    return f"{row.amount:.2f} EUR in new country '{row.country}' for user {row.user_id}"


class LiveRuleProcessor(StatefulProcessor):
    """Transactions of one slot of keys, and every rule version.

    A transaction is judged when the watermark has passed it, under the version in force at its own event time: a match
    counts under the settings in force at its last row, which all its rows then have to fit. All rows within the longest
    window stay, whether they fit anything now or not, since a later version may ask for them. A version that arrives
    behind the watermark counts for the rows not yet judged.
    """

    def __init__(self, base: dict[str, PatternRule], known: dict[str, PatternRule], key: str, patterns: Seq[str], horizon_ms: int):
        self.base, self.known, self.key, self.patterns, self.horizon_ms = base, known, key, list(patterns), horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "rows binary")
        self.inbox = handle.getListState("inbox", "rows binary")
        self.rules = handle.getMapState("rules", "rule_id string, since long, seq long", "body string")
        if "P002" in self.patterns:
            self.seen = handle.getMapState("pairs", "bucket int", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, parts = timerValues.getCurrentWatermarkInMs(), []
        for pdf in rows:
            for r in pdf[pdf["rule"].notna()].itertuples():
                body = json.loads(r.rule)
                self.rules.updateValue((body["rule_id"], int(r.event_ms), int(r.arrival)), (r.rule,))
            parts.append(pdf[pdf["rule"].isna()])
        txns = pd.concat(parts, ignore_index=True)
        if not len(txns):
            return
        txns["fresh"] = self._first_seen(txns) if "P002" in self.patterns else False
        late = txns["event_ms"] <= watermark
        due = txns.loc[~late, [*LIVE_COLUMNS[self.key], "fresh"]]
        if len(due):
            self.inbox.appendValue((pack(due),))
            self.handle.registerTimer(int(due["event_ms"].min()))
        lost = txns[late & txns["fresh"]]
        if len(lost):  # too late for sequences, but still the first row of its country
            yield from self._new_countries(lost)

    def _first_seen(self, txns: pd.DataFrame) -> np.ndarray:
        """Marks the row of each user and country not met before that arrived first.

        A state call is a round trip to the JVM, so pairs are kept in packed buckets of users: the calls of a batch do not
        grow with its pairs, and a small batch reads only its users' buckets.
        """
        fresh, pairs = np.zeros(len(txns), bool), txns["country"].notna().to_numpy()
        first = txns[pairs].sort_values("arrival", kind="stable").drop_duplicates(PAIR)
        if not len(first):
            return fresh
        new = first[[*PAIR, "event_ms"]].assign(bucket=[zlib.crc32(u.encode()) % PAIR_BUCKETS for u in first["user_id"]], at=first.index)
        known = self._known_pairs(new["bucket"].unique().tolist())
        rows = pd.concat([known, new], ignore_index=True) if len(known) else new
        rows = rows[~rows.duplicated(PAIR).to_numpy()]
        added = rows["at"].to_numpy() >= 0
        fresh[rows["at"].to_numpy()[added]] = True
        changed = rows["bucket"].isin(rows["bucket"][added].unique())
        for bucket, own in rows[changed].groupby("bucket", sort=False):
            self.seen.updateValue((int(bucket),), (pack(own[[*PAIR, "event_ms"]]),))
        return fresh

    def _known_pairs(self, buckets: list[int]) -> pd.DataFrame:
        """The pairs met before of these buckets, ``at`` no row."""
        held = [(b, self.seen.getValue((b,))) for b in buckets] if self.seen.exists() else []
        parts = [unpack(value[0]).assign(bucket=b, at=-1) for b, value in held if value is not None]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()

    def _spans(self, pattern: str) -> list[tuple[int, int, PatternRule]]:
        """(from, until, settings) of the times in which the pattern is on."""
        versions = sorted(
            (Version(since, seq, json.loads(body)) for (rule_id, since, seq), (body,) in self.rules.iterator() if rule_id == pattern),
            key=lambda v: (v.since, v.seq),
        )
        out = [(-FOREVER, versions[0].since if versions else FOREVER, self.base[pattern])] if pattern in self.base else []
        for k, v in enumerate(versions):
            until = versions[k + 1].since if k + 1 < len(versions) else FOREVER
            if v.body.get("enabled") and until > v.since:
                out.append((v.since, until, with_version(self.known[pattern], v.body)))
        return out

    def _new_countries(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for begin, until, rule in self._spans("P002"):
            hit = rows["fresh"] & rows["event_ms"].between(begin, until - 1) & (rows["amount"] > rule.low)
            if hit.any():
                yield self._output(rows[hit], rule, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        parts = [unpack(blob).assign(done=False) for (blob,) in self.inbox.get()]
        if self.kept.exists():
            parts.append(unpack(self.kept.get()[0]))
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        waiting = rows[rows["event_ms"] > watermark]
        seen = rows[rows["event_ms"] <= watermark].sort_values([self.key, "event_ms", "arrival"], kind="stable", ignore_index=True)
        ms, done = seen["event_ms"].to_numpy(), seen["done"].to_numpy(dtype=bool)
        new, keys = ms[~done], pd.factorize(seen[self.key])[0]
        for pattern in self.patterns if len(new) else []:
            if pattern == "P002":
                yield from self._new_countries(seen[~done])
                continue
            for begin, until, rule in self._spans(pattern):
                if until <= new.min() or begin > new.max():
                    continue
                bits, sequence = stage_bits(rule, seen)
                start, end = find_runs(pd.DataFrame({"key": keys, "fits": bits}), sequence)
                s, e = start[end >= 0], end[end >= 0]
                within = min(sequence.within_ms, self.horizon_ms)
                hit = (ms[e] - ms[s] < within) & ~done[e] & (ms[e] >= begin) & (ms[e] < until)
                if hit.any():
                    yield self._output(seen.iloc[e[hit]], rule, seen["id"].to_numpy()[s[hit]])
        seen = seen[seen["event_ms"] + self.horizon_ms > watermark].assign(done=True)
        left = pd.concat([seen, waiting], ignore_index=True)
        self.inbox.clear()
        if len(left):
            self.kept.update((pack(left),))
        else:
            self.kept.clear()
        if len(waiting):
            self.handle.registerTimer(int(waiting["event_ms"].min()))
        elif len(seen):
            self.handle.registerTimer(int(seen["event_ms"].max()) + self.horizon_ms)
        self._forget(watermark)

    def _forget(self, watermark: int) -> None:
        """Of the versions before the watermark only the newest of each rule can still count."""
        newest: dict[str, tuple[int, int]] = {}
        passed = [(rule_id, since, seq) for (rule_id, since, seq), _ in self.rules.iterator() if since <= watermark]
        for rule_id, since, seq in passed:
            newest[rule_id] = max(newest.get(rule_id, (since, seq)), (since, seq))
        for rule_id, since, seq in passed:
            if (since, seq) != newest[rule_id]:
                self.rules.removeKey((rule_id, since, seq))

    @staticmethod
    def _output(rows: pd.DataFrame, rule: PatternRule, first_id) -> pd.DataFrame:
        out = rows[["id", "user_id", "amount", "event_ms"]].reset_index(drop=True)
        out.insert(0, "first_id", pd.Series(first_id if first_id is not None else [None] * len(out), dtype=object))
        out.insert(0, "description", [description(rule, r) for r in rows.itertuples()])
        out.insert(0, "severity", rule.severity)
        out.insert(0, "pattern_name", rule.name)
        out.insert(0, "pattern_id", rule.rule_id)
        return out

    def close(self) -> None:
        pass


def live_matches(
    txns: DataFrame, changes: DataFrame, key: str, base: dict[str, PatternRule], known: dict[str, PatternRule],
    horizon_ms: int = HORIZON_MS, delay: str = jobs.DELAY, slots: int | None = None,
) -> DataFrame:
    """Matches of all patterns of one key, under the rule versions that arrive in ``changes`` meanwhile.

    ``base``: settings before a pattern's first version (without, there are no alerts before it); ``known``: settings
    that a version changes. Each version is copied to every slot, each transaction goes to its key's slot. Versions do
    not move the watermark: a quiet rule topic does not hold the stream up.
    """
    spark = txns.sparkSession
    patterns = [p for p, k in KEYS.items() if k == key and p in known]
    n = slots or jobs.SLOTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names, kinds = LIVE_COLUMNS[key], {"event_ms": "long", "arrival": "long", "amount": "double"}
    known_rows = F.col(key).isNotNull() & F.col("event_ms").isNotNull()
    rows = txns.withWatermark("event_time", delay).filter(known_rows).select(
        jobs.slot_of([key], spark, n).cast("int").alias("slot"), "event_time",
        *[F.col(c).cast("double").alias(c) if c == "amount" else F.col(c) for c in names], F.lit(None).cast("string").alias("rule"),
    )
    body = F.to_json(F.struct(*RULE_FIELDS))
    never_late = F.lit("2261-01-01T00:00:00Z").cast("timestamp")  # Spark drops rows behind the watermark; versions still count
    own = {"event_ms": F.unix_millis("rule_ts"), "arrival": F.col("rule_seq")}
    copies = changes.filter(F.col("rule_id").isin(patterns)).select(
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"), never_late.alias("event_time"),
        *[own.get(c, F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in names], body.alias("rule"),
    )
    return rows.union(copies).groupBy("slot").transformWithStateInPandas(
        LiveRuleProcessor(base, known, key, patterns, horizon_ms), LIVE_SCHEMA, "Append", "EventTime"
    )


def live_alerts(matches: DataFrame) -> DataFrame:
    """Alert rows: a new country's id comes from its row alone, a sequence's from its first and last row."""
    return A.to_alert(matches, F.col("pattern_id"), F.col("pattern_name"), F.col("severity"), F.col("description"), ("first_id", "id"))
