"""How often the session gates ask their state."""

from datetime import datetime, timedelta

import pandas as pd
from tidewell.streaming import gates


class _State(dict):
    """A map, list or value state that counts its calls."""

    calls = 0

    def _called(self, found=None):
        _State.calls += 1
        return found

    def containsKey(self, key):
        return self._called(key in self)

    def getValue(self, key):
        return self._called(self[key])

    def updateValue(self, key, value):
        self._called()
        self[key] = value

    def removeKey(self, key):
        self._called()
        del self[key]

    def iterator(self):
        return self._called(iter([*self.items()]))

    def keys(self):
        return self._called(iter([*dict.keys(self)]))

    def exists(self):
        return self._called(bool(self))

    def get(self):
        return self._called(dict.get(self, 0, ()))

    def update(self, value):
        self._called()
        self[0] = value

    put = update


class _Handle:
    def getMapState(self, *_):
        return _State()

    getListState = getValueState = getMapState

    def listTimers(self):
        return iter(())

    def registerTimer(self, at):
        pass


class _Times:
    def getCurrentWatermarkInMs(self):
        return 0


def _run(n):
    kinds = ["failed", "prompt", "remember", "stop", "ok", "offered", "correction", "end", "nudged", "extracted"]
    rows = [
        (k + 1, kinds[k % 10], f"p{k // 10 % 3}", f"r{k % 7}", "proven", True, k % 2 == 0, k % 3 == 0, float(k - 5) if k % 10 == 5 else None, datetime(2026, 1, 1) + timedelta(minutes=k))
        for k in range(n)
    ]
    frame = pd.DataFrame(rows, columns=["seq", "kind", "program", "id", "tier", "eligible", "seen", "answered", "upto", "ts"])
    whole = gates.SessionGates()
    whole.init(_Handle())
    _State.calls = 0
    out = pd.concat(list(whole.handleInputRows(("s",), iter([frame[n // 2 :], frame[: n // 2]]), _Times())))
    return _State.calls, out


def test_calls_of_the_state_grow_with_keys_not_with_events():
    few, _ = _run(500)
    many, out = _run(5000)
    assert many == few < 100
    assert len(out) > 1000 and out["seq"].is_monotonic_increasing
