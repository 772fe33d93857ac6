"""The state of the live monitor without a stream: calls to the store, and long histories in small parts."""

import random
from types import SimpleNamespace

import pytest

from quietwatch.streaming import deadline

DAY = deadline.DAY_MS


class Store:
    """The states and timers of one device; every call counts."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, set(), 0

    def getValueState(self, name, schema):
        def update(value):
            self.calls, self.value = self.calls + 1, value

        def get():
            self.calls += 1
            return self.value

        return SimpleNamespace(get=get, update=update)

    def getMapState(self, name, key_schema, value_schema):
        def call(function):
            self.calls += 1
            return function()

        return SimpleNamespace(
            getValue=lambda k: call(lambda: self.map[k]),
            updateValue=lambda k, v: call(lambda: self.map.update({k: v})),
            removeKey=lambda k: call(lambda: self.map.pop(k)),
        )

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def played(batches, keep_days):
    """The change log of one device after batches of ``(at, deadline)``, and the most calls of a batch."""
    store, monitor, log, clock, most = Store(), deadline.DeadlineMonitor(keep_days), [], 0, 0
    monitor.init(store)
    for batch in [*batches, []]:
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda at=clock: at)
        store.calls = 0
        if batch:
            rows = iter([SimpleNamespace(at_ms=a, deadline_ms=d) for a, d in batch])
            log += monitor.handleInputRows(("a",), rows, now)
        most = max(most, store.calls)
        for timer in sorted(t for t in store.timers if t <= clock):
            fired = SimpleNamespace(getExpiryTimeInMs=lambda at=timer: at)
            log += monitor.handleExpiredTimer(("a",), now, fired)
            store.timers.remove(timer)
        clock = max([clock, *(a for a, _ in batch)])
    return log, most, store


def held(log):
    """What holds after the log: start to end."""
    newest = {r.start_ms: r for r in log if r.action != "too_late"}
    return {r.start_ms: r.end_ms for r in newest.values() if r.action != "withdrawn"}


def silences(reports, clock):
    due = {}
    for at, dl in reports:
        due[at] = max(dl, due.get(at, dl))
    order = sorted(due)
    found = {a: b for a, b in zip(order, order[1:]) if b > due[a]}
    return found | ({order[-1]: None} if due[order[-1]] < clock else {})


def test_a_month_of_late_reports_takes_few_calls_to_the_store():
    rng = random.Random(1)
    reports = [(at := DAY * d + rng.randrange(DAY), at + DAY // 3) for d in range(100, 130) for _ in range(3)]
    rng.shuffle(reports)
    log, most, _ = played([reports[i::4] for i in range(4)], None)
    assert held(log) == silences(reports, max(a for a, _ in reports))
    assert most <= 6  # a call for each day took over 60


@pytest.mark.parametrize("seed", range(20))
def test_histories_in_small_parts_give_the_plain_result(monkeypatch, seed):
    monkeypatch.setattr(deadline, "PART_REPORTS", 3)
    rng = random.Random(seed)
    reports, at = [], DAY * 10
    for _ in range(80):
        at += rng.choice([0, 1000, 60_000, DAY // 3, DAY // 2, 2 * DAY])
        reports.append((at, at + rng.choice([30_000, DAY // 4, DAY])))
    rng.shuffle(reports)
    log, _, store = played([reports[i::7] for i in range(7)], None)
    assert held(log) == silences(reports, max(a for a, _ in reports))
    assert max(len(v[0]) for v in store.map.values()) <= 16 * 3
    assert len(store.map) > 20


@pytest.mark.parametrize("seed", range(5))
def test_parts_before_the_kept_history_go(monkeypatch, seed):
    monkeypatch.setattr(deadline, "PART_REPORTS", 3)
    rng = random.Random(seed)
    reports = [(at := DAY * 10 + k * DAY // 5, at + rng.choice([DAY // 10, DAY])) for k in range(100)]
    order = sorted(reports, key=lambda r: r[0] + rng.random() * DAY)  # a day late at most
    log, _, store = played([order[i : i + 10] for i in range(0, 100, 10)], 3)
    assert not [r for r in log if r.action == "too_late"]
    assert held(log) == silences(reports, max(a for a, _ in reports))
    assert len(store.map) < 20
    kept = min(deadline.np.frombuffer(v[0], deadline.np.int64)[0] for v in store.map.values())
    assert kept >= DAY * 24
