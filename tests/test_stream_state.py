"""The two stages of the stream threshold against a plain count, on processors with plain state: batches out of order,
equal times, expiry by the watermark, and one hot key."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from vigil.streaming.stateful import TimeCounts, WaitingMatches


class Store:
    """A handle whose state variables are plain dictionaries."""

    def __init__(self):
        self.timers = set()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def getMapState(self, *_):
        d = {}
        return SimpleNamespace(d=d, containsKey=d.__contains__, getValue=d.__getitem__, updateValue=d.__setitem__, removeKey=d.pop)

    def _one(self):
        held = []
        return SimpleNamespace(exists=lambda: bool(held), get=lambda: held[0], update=lambda v: held.__setitem__(slice(None), [v]), clear=held.clear)

    def getValueState(self, *_):
        return self._one()

    def getListState(self, *_):
        s = self._one()
        s.put = s.update
        return s


class Runner:
    """Both stages; state by key, timers fired after each batch as the watermark moves."""

    def __init__(self, w, need):
        self.w, self.need, self.parts, self.mark = w, need, {}, 0

    def processor(self, kind, key):
        if (kind, key) not in self.parts:
            p = kind()
            p.init(Store())
            self.parts[kind, key] = p
        return self.parts[kind, key]

    def batch(self, rows, delay):
        """rows: (key, t, tie) inside the watermark -> {tie: count} of what fires."""
        timer = SimpleNamespace(getCurrentWatermarkInMs=lambda: self.mark)
        waiting, fired = {}, {}
        for k in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == k]
            for _, t, tie in own:
                waiting.setdefault((1, k, t), []).append((tie, f"row {tie}", None))
            df = pd.DataFrame({"ev_us": [r[1] for r in own], "th_need": self.need, "th_window": self.w})
            half = len(df) // 2
            for out in self.processor(TimeCounts, (1, k)).handleInputRows((1, k), iter([df[:half], df[half:]]), timer) or ():
                for t, b in zip(out["ev_us"], out["before"]):
                    waiting.setdefault((1, k, int(t)), []).append((None, None, int(b)))
        for key, items in waiting.items():
            df = pd.DataFrame(items, columns=["ev_tie", "ev_row", "before"], dtype=object).assign(th_need=self.need)
            for out in self.processor(WaitingMatches, key).handleInputRows(key, iter([df]), timer):
                assert (out["ev_row"] == "row " + out["ev_tie"]).all()
                fired |= {tie: int(n) for tie, n in zip(out["ev_tie"], out["match_count"])}
        self.largest = max(map(len, waiting.values()))
        self.mark = max([self.mark, *((r[1] - delay) // 1000 for r in rows)])
        for (kind, key), p in self.parts.items():
            for ms in sorted(x for x in p.handle.timers if x <= self.mark):
                p.handle.timers.remove(ms)
                assert list(p.handleExpiredTimer(key, timer, SimpleNamespace(getExpiryTimeInMs=lambda ms=ms: ms))) == []
        return fired


def plain(rows, w, need):
    out = {}
    for k, t, tie in rows:
        n = sum(k2 == k and t - w <= t2 and (t2, tie2) <= (t, tie) for k2, t2, tie2 in rows)
        if n >= need:
            out[tie] = n
    return out


@pytest.mark.parametrize("seed,w,need", [(1, 5_000_000, 3), (2, 500_000, 2), (3, 60_000_000, 6), (4, 1 << 62, 9)])
def test_final_counts_are_the_batch_counts(seed, w, need):
    r = random.Random(seed)
    rows = [(r.choice("ab"), r.randint(0, 300) * 250_000, f"{i:04d}") for i in range(400)]
    delay = 20_000_000
    arrival = sorted(rows, key=lambda x: x[1] + r.randint(0, delay // 2))  # late by less than the watermark's delay
    runner, fired = Runner(w, need), {}
    for i in range(0, len(arrival), 23):
        for tie, n in runner.batch(arrival[i:i + 23], delay).items():
            assert tie not in fired
            fired[tie] = n
    want = plain(rows, w, need)
    assert set(fired) == set(want) and all(fired[x] <= want[x] for x in want)  # sent alerts keep the count of the moment
    assert runner.mark > 0 and (w > 1 << 60 or all(
        len(p.panes.d) <= (2 * delay + 4 * max(w, 1_000_000)) // max(w, 1_000_000) + 2 for (kind, _), p in runner.parts.items() if kind is TimeCounts))


def test_in_order_counts_are_exact_and_a_hot_key_spreads():
    r = random.Random(5)
    rows = sorted([("hot", r.randint(0, 20_000) * 1000, f"{i:05d}") for i in range(3000)], key=lambda x: x[1:])
    runner = Runner(100_000, 4)
    fired = runner.batch(rows[:2000], 10**9)
    assert runner.largest < 20  # a task group holds one time of the key, not its batch
    fired |= runner.batch(rows[2000:], 10**9)
    assert fired == plain(rows, 100_000, 4)


class Counting(Store):
    """A handle that counts the calls to its map states."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def getMapState(self, *_):
        def counted(f):
            def call(*a):
                self.calls += 1
                return f(*a)
            return call
        d = {}
        return SimpleNamespace(d=d, containsKey=counted(d.__contains__), getValue=counted(d.__getitem__), updateValue=counted(d.__setitem__), removeKey=counted(d.pop))


@pytest.mark.parametrize("batches", [1, 3])
def test_a_backlog_of_months_needs_few_calls_to_the_state(batches):
    """3000 matches of 20 keys over 139 days: buckets hold many keys and times, panes are as wide as the rows are few."""
    r = random.Random(batches)
    w, need, timer = 60_000_000, 3, SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    rows = sorted(((f"k{r.randint(0, 19)}", b * 4_000_000_000 + r.randint(0, 40) * 1_000_000, f"{b}-{i}")
                   for b in range(3000) for i in range(5)), key=lambda x: x[1:])
    kept, fired, handles = {}, {}, []

    def processor(kind, key):
        if (kind, key) not in kept:
            kept[kind, key] = kind()
            handles.append(Counting())
            kept[kind, key].init(handles[-1])
        return kept[kind, key]

    size = -(-len(rows) // batches)
    for at in range(0, len(rows), size):
        part, buckets = rows[at:at + size], {}
        for k, t, tie in part:
            buckets.setdefault((1, t // 1_000_000 % 4), []).append((k, t, tie, f"row {tie}", None))
        for k in {x[0] for x in part}:
            df = pd.DataFrame({"ev_us": [x[1] for x in part if x[0] == k], "th_need": need, "th_window": w})
            for out in processor(TimeCounts, (1, k)).handleInputRows((1, k), iter([df]), timer) or ():
                for t, b in zip(out["ev_us"], out["before"]):
                    buckets.setdefault((1, int(t) // 1_000_000 % 4), []).append((k, int(t), None, None, int(b)))
        for key, items in buckets.items():
            df = pd.DataFrame(items, columns=["group_key", "ev_us", "ev_tie", "ev_row", "before"]).assign(th_need=need)
            for out in processor(WaitingMatches, key).handleInputRows(key, iter([df]), timer):
                assert (out["ev_row"] == "row " + out["ev_tie"]).all() and not fired.keys() & set(out["ev_tie"])
                fired |= {tie: int(n) for tie, n in zip(out["ev_tie"], out["match_count"])}
    own = {}
    for k, t, tie in rows:
        own.setdefault(k, []).append((k, t, tie))
    want = {}
    for k, items in own.items():
        for i, (_, t, tie) in enumerate(items):
            n = sum(1 for x in items[max(0, i - 300):i + 1] if x[1] >= t - w)
            if n >= need:
                want[tie] = n
    assert want and fired == want
    assert sum(h.calls for h in handles) < len(rows) / 2  # one value for each time took several for each row


def test_a_bucket_of_a_backlog_keeps_few_panes():
    """2,300 matches over 139 days, as a bucket holds of 6 million events: panes are not cut at a day while they hold few rows."""
    p, handle, timer = WaitingMatches(), Counting(), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    p.init(handle)
    step = 139 * 86_400_000_000 // 2300
    df = pd.DataFrame([("k", i * step, f"{i}", f"row {i}", None) for i in range(2300)]
                      + [("k", i * step, None, None, 4) for i in range(0, 2300, 3)], columns=["group_key", "ev_us", "ev_tie", "ev_row", "before"])
    fired = [t for out in p.handleInputRows((1, 7), iter([df.assign(th_need=5)]), timer) for t in out["ev_tie"]]
    assert sorted(fired, key=int) == [f"{i}" for i in range(0, 2300, 3)]
    assert handle.calls < 60 and len(handle.timers) < 30
