"""Stream twins of joins by turns and of samples of point processes.

Each key is a state of its own; rows that come in one trigger are taken in their
order. States are kept by the query's checkpoint, so a query that is
started again goes on where it ended, and the results do not depend on how the
rows were cut into triggers as long as a key's rows come in order.
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a key that may wait, for the joins by turns.
WAITING = 100_000


def _held(state, fresh):
    return pickle.loads(state.get[0]) if state.exists else fresh


def _folded(stream: DataFrame, part: list[str], columns: list[str], order: str, fresh, step, schema: str, limit: int) -> DataFrame:
    """``step(held, rows)`` of each key's new rows in order: rows to send, and how many items wait."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(key, batches, state):
        import pandas as pd

        held = _held(state, fresh())
        rows = pd.concat(list(batches)).sort_values("_o", kind="stable")
        out, waiting = step(held, zip(*(rows[c].tolist() for c in columns)))
        if waiting > limit:
            raise RuntimeError(f"{waiting} items of {key} wait for a turn; the limit is {limit}")
        state.update((pickle.dumps(held),))
        yield pd.DataFrame([(*key, *x) for x in out], columns=names)

    chosen = stream.select(*part, *columns, F.col(order).alias("_o"))
    return chosen.groupBy(*part).applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.NoTimeout)


def round_robin(stream: DataFrame, part: list[str], source: str, order: str, value: str, sources: list, limit: int = WAITING) -> DataFrame:
    """(part, source, value, seq): items in strict turns of ``sources``, each sent as soon as it is its turn.

    Items of sources whose turn has not come wait; more than ``limit`` of a key
    stop the query. Other sources' items are left out.
    """
    kinds = dict(stream.dtypes)
    sources = sorted(sources)

    def step(held, rows):
        queues, out = held["queues"], []
        for s, v in rows:
            if s in queues:
                queues[s].append(v)
        while queues[s := sources[held["seq"] % len(sources)]]:
            out.append((s, queues[s].pop(0), held["seq"]))
            held["seq"] += 1
        return out, sum(map(len, queues.values()))

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*part, source, value]) + ", seq long"
    return _folded(stream, part, [source, value], order, lambda: {"queues": {s: [] for s in sources}, "seq": 0}, step, schema, limit)


def accumulate_slots(stream: DataFrame, part: list[str], tag: str, order: str, value: str, tags: list, limit: int = WAITING) -> DataFrame:
    """(part, bundle, tag, items): bundles that close when every tag has an item, with the items since the last close.

    An open bundle of more than ``limit`` items stops the query.
    """
    kinds = dict(stream.dtypes)
    tags = sorted(tags)

    def step(held, rows):
        out = []
        for t, v in rows:
            if t in held["open"]:
                held["open"][t].append(v)
                if all(held["open"].values()):
                    out += [(held["bundle"], k, held["open"][k]) for k in tags]
                    held["open"], held["bundle"] = {k: [] for k in tags}, held["bundle"] + 1
        return out, sum(map(len, held["open"].values()))

    schema = ", ".join(f"{c} {kinds[c]}" for c in part) + f", bundle int, {tag} {kinds[tag]}, items array<{kinds[value]}>"
    return _folded(stream, part, [tag, value], order, lambda: {"open": {t: [] for t in tags}, "bundle": 0}, step, schema, limit)


def sampling_windows(stream: DataFrame, part: list[str], ts: str, value: str, interval: int, length: int, late: str) -> DataFrame:
    """(part, sample, at, n, sum): samples of a point process in event time, times in milliseconds.

    A sample at t0 + k * interval holds the events with at - length <= ts <= at,
    that at t0 none. It fires once a later event has come and the watermark,
    ``late`` behind the latest event of all keys, has passed it: a timer waits for that where
    no event of the key does. Rows may come in any order until the watermark; those
    behind it are dropped, and a key's t0 is its first time when its first sample fires.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    if interval > length:
        raise ValueError("interval is longer than the window")
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in part) + ", sample int, at long, n long, sum double"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(key, batches, state):
        import bisect

        import pandas as pd

        held, passed = _held(state, {"t0": None, "next": 0, "events": [], "last": -1}), state.getCurrentWatermarkMs()
        for pdf in batches:  # none where a timer fired
            rows = [(t, v) for t, v in zip(pdf["_ms"].tolist(), pdf[value].tolist()) if t >= passed]
            held["events"] = sorted(held["events"] + rows)
            held["last"] = max([held["last"], *(t for t, _ in rows)])
        out, events = [], held["events"]
        t0 = held["t0"] if held["t0"] is not None else events[0][0] if events else None
        if t0 is not None:
            while (at := t0 + held["next"] * interval) < held["last"] and at < passed:
                held["t0"] = t0
                lo, hi = bisect.bisect_left(events, (at - length, float("-inf"))), bisect.bisect_right(events, (at, float("inf")))
                inside = events[lo:hi] if held["next"] else []
                out.append((held["next"], at, len(inside), float(sum(v for _, v in inside))))
                held["next"] += 1
            first = bisect.bisect_left(events, (t0 + held["next"] * interval - length, float("-inf")))
            held["events"] = events[first:]
            if at < held["last"]:  # the sample waits for the watermark only
                state.setTimeoutTimestamp(max(at, passed) + 1)
        state.update((pickle.dumps(held),))
        yield pd.DataFrame([(*key, *x) for x in out], columns=names)

    rows = stream.withWatermark(ts, late).select(*part, ts, F.unix_millis(ts).alias("_ms"), value)
    return rows.groupBy(*part).applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
