"""Structured Streaming: tumbling epochs, contact sessions and the cool-down filter over unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def epoch_counts(events: DataFrame, step: str, late: str) -> DataFrame:
    """(epoch, node, events) of events (ts, node) in tumbling windows; what comes later than `late` is dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", step).alias("w"), "node").agg(F.count("*").alias("events"))
    return w.select(F.col("w.start").alias("epoch"), "node", "events")


def contact_sessions(contacts: DataFrame, gap: str, late: str) -> DataFrame:
    """(node1, node2, start, end, contacts) of contacts (ts, node1, node2) that follow one another within gap."""
    s = contacts.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "node1", "node2").agg(F.count("*").alias("contacts"))
    return s.select("node1", "node2", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "contacts")


def cooldown(contacts: DataFrame, transition_seconds: float) -> DataFrame:
    """Contacts (t, node1, node2) of which each comes at least so long after the pair's last accepted one; the last
    accepted time is the state of a pair. A micro-batch is taken in order of t."""

    def accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("t")
        kept = []
        for t in rows["t"]:
            if last is None or t - last >= transition_seconds:
                last = float(t)
                kept.append(last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"node1": [key[0]] * len(kept), "node2": [key[1]] * len(kept), "t": kept})

    return contacts.groupBy("node1", "node2").applyInPandasWithState(accept, "node1 long, node2 long, t double", "last double", "append", GroupStateTimeout.NoTimeout)


def ordered_cooldown(contacts: DataFrame, transition_seconds: float, late: str) -> DataFrame:
    """cooldown() of contacts (ts, t, node1, node2; ts is t as a timestamp) in order of time over all micro-batches.

    A contact waits in the state of its pair until the watermark has passed it, so that contacts that come out of order, by up
    to `late`, are judged in order; what comes later still is dropped. The state of a pair ends when nothing waits and the
    watermark has passed the last accepted contact by the transition time, from where on it would decide nothing.
    """

    def accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        waiting = sorted([float(t) for t in waiting or []] + [float(t) for rows in batches for t in rows["t"]])
        mark = state.getCurrentWatermarkMs() / 1000
        ready = [t for t in waiting if t <= mark]
        kept = []
        for t in ready:
            if last is None or t - last >= transition_seconds:
                last = t
                kept.append(t)
        waiting = waiting[len(ready) :]
        until = waiting[0] if waiting else (last or 0.0) + transition_seconds
        if waiting or until > mark:
            state.update((last, waiting))
            state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"node1": [key[0]] * len(kept), "node2": [key[1]] * len(kept), "t": kept})

    marked = contacts.withWatermark("ts", late).groupBy("node1", "node2")
    return marked.applyInPandasWithState(accept, "node1 long, node2 long, t double", "last double, waiting array<double>", "append", GroupStateTimeout.EventTimeTimeout)
