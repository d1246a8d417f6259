"""What a stream's processors ask of their state; the calls are counted on stand-ins."""

import pandas as pd

from tracelake.streaming import jobs as J


class Stream:
    dtypes = [("user_id", "bigint")]

    def transformWithStateInPandas(self, processor, *rest):
        return processor

    def __getattr__(self, name):
        return lambda *args: self


class State:
    def __init__(self, calls):
        self.kept, self.calls = {}, calls

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            key = args[0] if args and name.endswith(("Key", "getValue")) or name == "updateValue" else None
            if name in ("update", "updateValue"):
                self.kept[key] = args[-1]
            elif name in ("clear", "removeKey"):
                self.kept.pop(key, None)
            return bool(self.kept) if name == "exists" else key in self.kept if name == "containsKey" else self.kept.get(key)

        return call


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getValueState(self, *args):
        return State(self.calls)

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls.append("deleteTimer")
        self.timers.remove(at)

    def listTimers(self):
        self.calls.append("listTimers")
        return iter(list(self.timers))


def test_slices_of_one_batch_do_not_touch_the_state():
    processor, handle = J.release_in_order(Stream(), ["a"]), Handle()
    processor.init(handle)
    rows = pd.DataFrame({"arrival": range(500), "t_us": [i * J.SLICE_US for i in range(500)], "ordinal": range(500), "lane": "a", "end": False})
    out = pd.concat(list(processor.handleInputRows(("s",), iter([rows]), None)))
    assert list(out["ordinal"]) == list(range(500)) and handle.calls.count("removeKey") == 0


def test_a_silent_key_asks_little():
    processor, handle = J.silent_keys(Stream(), ["user_id"], "1 minute"), Handle()
    processor.init(handle)
    batches = [([1000, 2000], False), ([3000], False), ([9000], True)]
    out, asked = [], []
    for times, end in batches:
        rows = pd.DataFrame({"t_us": [t * 1000 for t in times], "end": end, "period_ms": 1000})
        before = len(handle.calls)
        out += [tuple(r) for x in processor.handleInputRows((7,), iter([rows]), None) for r in x.itertuples(index=False)]
        asked.append(len(handle.calls) - before)
    assert out == [(7, 3000, 6000)] and handle.timers == [] and max(asked) <= 4
