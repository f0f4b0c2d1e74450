"""Task runs without a stream: the processor over a store that counts its calls."""

import random

import pandas as pd

from quillgrid.streaming import runs


class Store:
    def __init__(self):
        self.calls, self.timers, self.states = 0, set(), {}

    def of(self, name, empty):
        store = self

        class State:
            def exists(self):
                store.calls += 1
                return name in store.states

            def get(self):
                store.calls += 1
                return iter(store.states.get(name, [])) if empty == [] else store.states.get(name)

            def update(self, value):
                store.calls += 1
                store.states[name] = value

            put = update

            def appendValue(self, value):
                store.calls += 1
                store.states.setdefault(name, []).append(value)

            def clear(self):
                store.calls += 1
                store.states.pop(name, None)

        return State()

    def getValueState(self, name, _):
        return self.of(name, None)

    def getListState(self, name, _):
        return self.of(name, [])

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def told(events, cuts):
    """The last word on each run, the store, and the most calls of a batch."""
    store, p, out, most = Store(), runs.TaskRuns(), {}, 0
    p.init(store)
    for a, b in zip([0, *cuts], [*cuts, len(events)], strict=True):
        if a == b:
            continue
        store.calls = 0
        shuffled = random.Random(a).sample(events[a:b], b - a)
        frame = pd.DataFrame(shuffled, columns=["ts", "event_id", "kind", "name"])
        for got in p.handleInputRows((7,), iter([frame[: (b - a) // 2], frame[(b - a) // 2 :]]), None):
            out |= {row[1]: tuple(row) for row in got.itertuples(index=False)}
        most = max(most, store.calls)
    return out, store, most


def test_calls_do_not_grow_with_events():
    r = random.Random(4)
    at, events = pd.Timestamp("2024-01-01"), []
    for k in range(600):
        at += pd.Timedelta(seconds=r.choice([1, 60, 90_000]))
        events.append((at, k, r.choice(["step", "step", "step", "done", "fail", "cancel"]), r.choice("abcd")))
    whole, store, calls = told(events, [])
    assert calls < 12
    parts, again, _ = told(events, sorted(r.sample(range(600), 40)))
    assert parts == whole and again.states == store.states and again.timers == store.timers
    assert len(store.timers) == (1 if "open" in store.states else 0)
    assert {x[2] for x in whole.values()} >= {"done", "failed", "cancelled", "expired"}
