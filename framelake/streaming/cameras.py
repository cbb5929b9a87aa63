"""Camera states, detection counts and expiry over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

INITIAL, LEARNING, ACTIVE = "INITIAL", "LEARNING", "ACTIVE"

STATE = "state string, learning_since timestamp, width int, height int"
OUT = "camera_id string, state string, learning_since timestamp, width int, height int, transitions long"


def step(now: tuple | None, event: str, ts, width, height) -> tuple:
    """One event on (state, learning_since, width, height).

    A camera starts LEARNING at its first event; the first known frame size stays. ``frame`` moves INITIAL to LEARNING;
    ``learned`` moves LEARNING to ACTIVE and keeps the start; ``reset_initial`` clears the start, ``reset_learning`` sets it."""
    state, since, w, h = now if now is not None else (LEARNING, ts, None, None)
    w, h = (width if w is None else w), (height if h is None else h)
    if event == "frame" and state == INITIAL:
        state, since = LEARNING, ts
    elif event == "learned" and state == LEARNING:
        state = ACTIVE
    elif event == "reset_initial":
        state, since = INITIAL, None
    elif event == "reset_learning":
        state, since = LEARNING, ts
    return state, since, w, h


def camera_states(events: DataFrame) -> DataFrame:
    """Events (camera_id, ts, seq, event, width, height) to a row per camera and micro-batch with its state after the batch.
    Within a batch events go by (ts, seq); a batch is one job, so its frames see the state as it was before."""

    def fold(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(held.get) if held.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        moved = 0
        for r in rows.itertuples(index=False):
            none = lambda v: None if pd.isna(v) else int(v)
            new = step(now, r.event, r.ts, none(r.width), none(r.height))
            moved += now is not None and new[0] != now[0]
            now = new
        held.update(now)
        yield pd.DataFrame([[key[0], *now, moved]], columns=["camera_id", "state", "learning_since", "width", "height", "transitions"])

    return events.select("camera_id", "ts", "seq", "event", "width", "height").groupBy("camera_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def detection_counts(detections: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Detections and mean confidence per camera and window of event time; later ones than ``late`` are left out."""
    return detections.withWatermark("captured_at", late).groupBy("camera_id", F.window("captured_at", window)).agg(F.count(F.lit(1)).alias("detections"), F.avg("confidence").alias("confidence"))


def live(detections: DataFrame, now, days: int) -> DataFrame:
    """Detections not older than so many days at ``now``: the rule of the expiry of stored ones."""
    return detections.where(F.col("captured_at") >= F.lit(now) - F.make_dt_interval(F.lit(days)))
