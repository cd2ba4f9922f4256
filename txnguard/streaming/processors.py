"""State for streams. Rows reach these only after everything expressible as columns has been done.

State is kept per *slot*, a hash bucket of many keys, so that a micro-batch costs a few state calls and a few
vector operations per slot, not per card. The number of slots is a setting: more slots mean smaller states.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MATCH_SCHEMA = (
    "kind string, pattern_id string, first_id string, id string, user_id string, card_number string, amount double, "
    "event_ms long, arrival long"
)
ROW_COLUMNS = ["key", "event_ms", "arrival", "id", "user_id", "card_number", "amount", "fits"]


@dataclass(frozen=True)
class Sequence:
    """Stages as (bit in ``fits``, times), to be completed in less than ``within_ms``."""

    pattern_id: str
    stages: tuple[tuple[int, int], ...]
    within_ms: int


def pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_pandas()


def next_fit(fit: np.ndarray, key_end: np.ndarray) -> np.ndarray:
    """For each row the index of the next later row of its key that fits, or -1. Rows are grouped by key."""
    n = len(fit)
    at = np.where(fit, np.arange(n), n)
    upto = np.minimum.accumulate(at[::-1])[::-1]
    after = np.append(upto[1:], n)
    return np.where(after <= key_end, after, -1)


def find_runs(rows: pd.DataFrame, seq: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """``(start, end)`` row indices of every run; ``end`` is -1 while the run is open. Sorted by key and time."""
    codes = pd.factorize(rows["key"])[0]
    last_of = np.flatnonzero(np.append(codes[1:] != codes[:-1], True))
    key_end = last_of[np.searchsorted(last_of, np.arange(len(rows)))]
    fits = rows["fits"].to_numpy()
    start = np.flatnonzero(fits >> seq.stages[0][0] & 1)
    end = start
    for depth, (bit, times) in enumerate(seq.stages):
        following = next_fit((fits >> bit & 1).astype(bool), key_end)
        for _ in range(times - 1 if depth == 0 else times):
            end = np.where(end >= 0, following[end], -1)
    return start, end


class SequenceProcessor(StatefulProcessor):
    """Matches sequences in event-time order for one (slot, time chunk).

    Rows wait until the watermark has passed them. Then all runs are followed at once over the rows kept and the
    rows now due; a match counts when its last row is newly due. Of the rows gone by, only those from the oldest
    run still open are kept. Rows at or behind the watermark are late: dropped, and reported as ``kind = 'late'``
    when asked for.
    """

    def __init__(self, sequences: list[Sequence], chunk_ms: int, report_late: bool = False):
        self.sequences = sequences
        self.chunk_ms = chunk_ms
        self.report_late = report_late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "rows binary")
        self.inbox = handle.getListState("inbox", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            late = pdf["event_ms"] <= watermark
            fresh = pdf.loc[~late, ROW_COLUMNS]
            if len(fresh):
                self.inbox.appendValue((pack(fresh),))
                self.handle.registerTimer(int(fresh["event_ms"].min()))
            if self.report_late and late.any():
                gone = pdf[late & (pdf["event_ms"] // self.chunk_ms == key[1])]
                yield self._output(gone, "late", None, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, chunk = timerValues.getCurrentWatermarkInMs(), key[1]
        parts = [unpack(blob).assign(done=False) for (blob,) in self.inbox.get()]
        if self.kept.exists():
            parts.append(unpack(self.kept.get()[0]))
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        waiting = rows[rows["event_ms"] > watermark]
        seen = rows[rows["event_ms"] <= watermark].sort_values(["key", "event_ms", "arrival"], kind="stable", ignore_index=True)
        needed = np.zeros(len(seen), dtype=bool)
        ms, done = seen["event_ms"].to_numpy(), seen["done"].to_numpy(dtype=bool)
        for seq in self.sequences if len(seen) else []:
            start, end = find_runs(seen, seq)
            closed = end >= 0
            s, e = start[closed], end[closed]
            hit = (ms[e] - ms[s] < seq.within_ms) & ~done[e] & (ms[e] // self.chunk_ms == chunk)
            if hit.any():
                yield self._output(seen.iloc[e[hit]], "match", seq.pattern_id, seen["id"].to_numpy()[s[hit]])
            still_open = start[~closed & (ms[start] + seq.within_ms > watermark + 1)]
            needed |= self._from_oldest(seen, still_open)
        # The chunk is over: later rows belong to the next one, which has its own copy of the rows it needs.
        if (chunk + 1) * self.chunk_ms <= watermark + 1:
            needed[:] = False
        seen = seen[needed].assign(done=True)
        self._store(pd.concat([seen, waiting], ignore_index=True) if len(seen) and len(waiting) else seen if len(seen) else waiting)
        if len(waiting):
            self.handle.registerTimer(int(waiting["event_ms"].min()))
        elif len(seen):
            # Wake up once more to drop what can no longer finish.
            self.handle.registerTimer(int(seen["event_ms"].max()) + max(s.within_ms for s in self.sequences))

    @staticmethod
    def _from_oldest(rows: pd.DataFrame, starts: np.ndarray) -> np.ndarray:
        """Rows of a key from its oldest open run on."""
        if not len(starts):
            return np.zeros(len(rows), dtype=bool)
        codes = pd.factorize(rows["key"])[0]
        oldest = np.full(codes.max() + 1, len(rows))
        np.minimum.at(oldest, codes[starts], starts)
        return np.arange(len(rows)) >= oldest[codes]

    def _store(self, rows: pd.DataFrame) -> None:
        self.inbox.clear()
        if len(rows):
            self.kept.update((pack(rows),))
        else:
            self.kept.clear()

    @staticmethod
    def _output(rows: pd.DataFrame, kind: str, pattern_id: str | None, first_id) -> pd.DataFrame:
        out = rows[["id", "user_id", "card_number", "amount", "event_ms", "arrival"]].reset_index(drop=True)
        out.insert(0, "first_id", pd.Series(first_id if first_id is not None else [None] * len(out), dtype=object))
        out.insert(0, "pattern_id", pattern_id)
        out.insert(0, "kind", kind)
        return out

    def close(self) -> None:
        pass


SEEN_COLUMNS = ["user_id", "country", "id", "amount", "event_ms", "arrival"]
SEEN_SCHEMA = "user_id string, country string, id string, amount double, event_ms long, arrival long"


def first_of_each(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values("arrival", kind="stable").drop_duplicates(["user_id", "country"])


def first_per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The row of each user and country that arrived first in each Arrow batch: only such a row can be the first one seen."""
    for pdf in batches:
        yield first_of_each(pdf)


class FirstSeenProcessor(StatefulProcessor):
    """Emits the first row of each (user, country) pair of a slot and remembers the pair for good, or for ``ttl_ms``. Pairs
    given as initial state count as seen."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "user_id string, country string", "since long", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for user, country, ms in zip(initialState["user_id"], initialState["country"], initialState["event_ms"]):
            self.seen.updateValue((user, country), (int(ms),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame()
        for pdf in rows:
            best = first_of_each(pd.concat([best, pdf[SEEN_COLUMNS]]) if len(best) else pdf[SEEN_COLUMNS])
        fresh, any_known = [], len(best) > 0 and self.seen.exists()
        for user, country, ms in zip(best["user_id"], best["country"], best["event_ms"]):
            known = any_known and self.seen.containsKey((user, country))
            if not known:
                self.seen.updateValue((user, country), (int(ms),))
            fresh.append(not known)
        if any(fresh):
            yield best[fresh]

    def close(self) -> None:
        pass
