"""A key costs few calls to the state store, and keeps one timer."""

import pandas as pd

from veristrata.streaming.timers import DAY_MS, Stale, Watch


class Store:
    def __init__(self):
        self.calls, self.state, self.timers = 0, None, set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {"exists": lambda: self.state is not None, "get": lambda: self.state, "listTimers": lambda: list(self.timers), "update": lambda v: setattr(self, "state", v), "registerTimer": self.timers.add, "deleteTimer": self.timers.discard}[name](*args)

        return call


def test_calls_of_a_key():
    w, s = Watch({"a": Stale(10)}), Store()
    w.handle = w.value = s
    rows = lambda day: iter([pd.DataFrame({"at_ms": [day * DAY_MS], "epoch_day": [day]})])
    list(w.handleInputRows(("k", "a"), rows(100), None))
    assert s.calls <= 3 and s.timers == {111 * DAY_MS - 1}
    list(w.handleInputRows(("k", "a"), rows(105), None))
    assert s.calls <= 7 and s.timers == {116 * DAY_MS - 1}
