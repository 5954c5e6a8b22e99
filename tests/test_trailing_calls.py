"""A stretch of a key is read and written as a whole: calls of the state store do not grow with its events."""

import pandas as pd

from itemspark.streaming.keyed import _Trailing


class _Value:
    def __init__(self):
        self.row, self.calls = None, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("exists", "containsKey"):
                return self.row is not None
            if name == "get":
                return self.row
            if name in ("update", "updateValue", "clear"):
                self.row = args[0] if name == "update" else None
            return iter(())

        return call


class _Handle:
    def __init__(self):
        self.values, self.timers = [], []

    def getValueState(self, name, schema):  # noqa: N802
        self.values.append(_Value())
        return self.values[-1]

    getMapState = getValueState  # noqa: N815

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.timers = sorted({*self.timers, at})

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class _Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def _rows(times):
    return pd.DataFrame({"us": [t for t, _, _ in times], "row_id": [r for _, r, _ in times], "own": [o for _, _, o in times]})


def _calls(n):
    handle = _Handle()
    judge = _Trailing(["k"], 5_000_000, 3)
    judge.init(handle)
    list(judge.handleInputRows(("k",), iter([_rows([(i * 1000, str(i), True) for i in range(n)])]), _Mark(0)))
    return sum(v.calls for v in handle.values)


def test_calls_do_not_grow_with_events():
    assert _calls(500) == _calls(5)


def test_windows_ties_and_what_is_forgotten():
    handle = _Handle()
    judge = _Trailing(["k"], 5_000_000, 3)
    judge.init(handle)
    s = 1_000_000
    first = _rows([(1 * s, "a", True), (6 * s, "c", True), (1 * s, "b", True), (6 * s, None, False)])
    assert list(judge.handleInputRows(("k",), iter([first]), _Mark(0))) == []
    assert handle.timers == [1001]
    second = _rows([(11 * s, "d", True), (30 * s, "e", True)])
    (got,) = judge.handleInputRows(("k",), iter([second, second[:0]]), _Mark(20_000))
    # both ends of a window count; the event of 30 s is not yet passed, so it stays open
    assert got.values.tolist() == [["c", 4], ["d", 3]]
    assert handle.timers == [30_001]
    assert list(judge.handleExpiredTimer(("k",), _Mark(30_001), None)) == []
    assert handle.timers == [35_002]
    assert list(judge.handleExpiredTimer(("k",), _Mark(40_000), None)) == []
    assert handle.timers == [] and all(v.row is None for v in handle.values)
