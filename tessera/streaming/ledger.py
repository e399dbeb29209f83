"""The ledger over a stream of task events: sessions, duplicates within a watermark, and tasks kept as state.

The fold is the batch one (`tessera.operators.linking.Ledger`); its state is one JSON text per meeting, which holds what a ledger
holds: tasks and the events that found none. An event waits in the state until the watermark has passed its time, so events
of several files are applied in their order if none is later than the watermark allows (later ones are dropped); a meeting
ends a while after its last event (a timer): then deadlines said before their task are bound, and the state is removed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.linking import TASK, Ledger, applied, plain_event, prepared

def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Rows and sums of each user's sessions, complete once the watermark has passed."""
    found = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", "session_window.start", "session_window.end", "n", "total")


def submitted_once(jobs: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of the jobs with one idempotency key within the watermark."""
    return jobs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["idempotency_key"])


def tasks(events: DataFrame, end_after: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tasks of each meeting whenever some of its events are applied, and finally end_after its last event. `events` has a
    column ts and those of the batch fold."""
    delay = int(pd.Timedelta(end_after).total_seconds() * 1000)

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        ledger, waiting, last_ms = Ledger(held.get("ledger")), held.get("waiting", []), held.get("last_ms", 0)
        if not state.hasTimedOut:
            for batch in batches:
                for ts, event in zip(batch["ts"], batch["event"], strict=True):
                    waiting.append([int(ts.timestamp() * 1000), plain_event(event)])
                    last_ms = max(last_ms, waiting[-1][0])
        watermark = state.getCurrentWatermarkMs()
        over = state.hasTimedOut and watermark >= last_ms + delay
        due = [event for ts, event in waiting if over or ts <= watermark]
        waiting = [] if over else [[ts, event] for ts, event in waiting if ts > watermark]
        applied(ledger, due)
        if over:
            ledger.settle()
            state.remove()
        else:
            state.update((json.dumps({"ledger": ledger.state(), "waiting": waiting, "last_ms": last_ms}),))
            state.setTimeoutTimestamp(max(watermark + 1, min([ts for ts, _ in waiting], default=last_ms + delay)))
        if due or over:
            yield pd.DataFrame(ledger.rows(int(key[0])), columns=[x.split(" ")[0] for x in TASK.split(", ")])

    ready = events.withWatermark("ts", late)
    own = prepared(ready, "ts")
    return own.groupBy("meeting_id").applyInPandasWithState(update, TASK, "state string", "update", "EventTimeTimeout")
