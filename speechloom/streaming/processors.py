"""State of the streaming jobs: items that wait for the clock, sequences that wait for a full bucket, offsets of splits.

All three keep their state in RocksDB, which is written to as it changes: a list is appended to and an entry of a map replaced,
while what else a key holds is neither read nor written.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


class _Timed(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _wake(self, at: int | None) -> None:
        """The one timer of this key, or none."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Ripening(_Timed):
    """Items of a lane, each once, when the clock has passed its latest time by min_age: at once if it is old enough when it arrives,
    else by the lane's timer, which is set to the first item that waits. A later time of the same item puts it off. What comes
    after an item was released is passed over. Items that wait and items that were released are entries of two maps, so that a
    timer reads those that wait and no others."""

    def __init__(self, key: str, at: str, kind: str, min_age_ms: int, forget_ms: int | None):
        self.key, self.at, self.kind, self.min_age_ms, self.forget_ms = key, at, kind, min_age_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", f"name {self.kind}", "at long, seen long")
        self.released = handle.getMapState("released", f"name {self.kind}", "at long", self.forget_ms)

    def _keys(self, values: pd.Series) -> list:
        whole = self.kind in ("tinyint", "smallint", "int", "bigint")
        return [None if pd.isna(v) else int(v) if whole else v for v in values.tolist()]  # whole numbers beside nulls are floats in pandas

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now, some_wait, put_off = timerValues.getCurrentProcessingTimeInMs(), self.waiting.exists(), False
        new: dict = {}
        for frame in rows:
            heard = frame.groupby(self.key, dropna=False, sort=False)[self.at].agg(["max", "size"])
            for name, latest, n in zip(self._keys(heard.index), heard["max"].tolist(), heard["size"].tolist(), strict=True):
                at, seen = new.get(name, (None, 0))
                new[name] = (int(latest) if at is None else max(at, int(latest)), seen + n)
        out: list[tuple] = []
        for name, (at, seen) in new.items():
            if self.released.containsKey((name,)):
                if self.forget_ms is not None:
                    self.released.updateValue((name,), (at,))  # heard of again
                continue
            before = self.waiting.getValue((name,)) if some_wait else None
            if before is not None:
                at, seen = max(at, before[0]), seen + before[1]
            if at + self.min_age_ms <= now:
                self.released.updateValue((name,), (at,))
                if before is not None:
                    self.waiting.removeKey((name,))
                    put_off = True
                out.append((name, at, seen))
            else:
                self.waiting.updateValue((name,), (at, seen))
                put_off = True
        if out:
            yield self._rows(out)
        if put_off:
            self._wake(min((v[0] for _, v in self.waiting.iterator()), default=None))

    def _wake(self, first: int | None) -> None:
        super()._wake(None if first is None else first + self.min_age_ms)

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[self.key, self.at, "seen"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, first = timerValues.getCurrentProcessingTimeInMs(), [], None
        for (name,), (at, seen) in self.waiting.iterator():
            if at + self.min_age_ms <= now:
                out.append((name, at, seen))
            else:
                first = at if first is None else min(first, at)
        for name, at, _ in out:
            self.waiting.removeKey((name,))
            self.released.updateValue((name,), (at,))
        if first is not None:
            self.handle.registerTimer(first + self.min_age_ms)
        if out:
            yield self._rows(out)


class Packing(_Timed):
    """A lane's sequences, appended to a list until there is a bucket of them, which is packed; with flush_ms, what a lane holds is
    packed after so long without a new sequence. Sequences of one micro-batch go by key."""

    def __init__(self, plan: Callable, key: str, length: str, kind: str, bucket: int, flush_ms: int | None):
        self.plan, self.key, self.length, self.kind, self.bucket, self.flush_ms = plan, key, length, kind, bucket, flush_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("held", f"id {self.kind}, len long")
        self.counts = handle.getValueState("counts", "held long, made long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held, made = self.counts.get() if self.counts.exists() else (0, 0)
        new = sorted(itertools.chain.from_iterable(zip(f[self.key].tolist(), f[self.length].tolist(), strict=True) for f in rows))
        if held + len(new) < self.bucket:
            self.held.appendList(new)
        else:
            have = [*self.held.get(), *new] if held else new
            while len(have) >= self.bucket:
                plan, made = self.plan(key[0], have[: self.bucket], made)
                yield plan
                have = have[self.bucket :]
            if have:
                self.held.put(have)
            else:
                self.held.clear()
            held, new = 0, have
        self.counts.update((held + len(new), made))
        if self.flush_ms is not None:
            self._wake(timerValues.getCurrentProcessingTimeInMs() + self.flush_ms if held + len(new) else None)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, made = self.counts.get() if self.counts.exists() else (0, 0)
        if held:
            plan, made = self.plan(key[0], list(self.held.get()), made)
            self.held.clear()
            self.counts.update((0, made))
            yield plan


class SplitOffsets(StatefulProcessor):
    """The steps of all splits before each split of a run. A step that raises a split's last one puts out new offsets for those of
    the later splits that are known, and a new split its own."""

    def __init__(self, run: str, split: str, step: str):
        self.run, self.split, self.step = run, split, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "split long", "step long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[int, int] = {}
        for frame in rows:
            for split, step in frame.groupby(self.split)[self.step].max().items():
                arrived[int(split)] = max(arrived.get(int(split), 0), int(step))
        before = {int(k[0]): int(v[0]) for k, v in self.last.iterator()}
        after = before | {s: max(n, before.get(s, 0)) for s, n in arrived.items()}
        for split, step in after.items():
            if before.get(split) != step:
                self.last.updateValue((split,), (step,))
        old, new = _offsets(before), _offsets(after)
        changed = [s for s in new if old.get(s) != new[s]]
        if changed:
            yield pd.DataFrame({self.run: key[0], self.split: changed, "before": [new[s] for s in changed]})

    def close(self) -> None:
        pass


def _offsets(last: dict[int, int]) -> dict[int, int]:
    order = sorted(last)
    return dict(zip(order, itertools.accumulate([0, *(last[s] for s in order[:-1])]), strict=True)) if order else {}
