"""Structured Streaming: a stream of messages joined with a static model."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import canonical_key, mask, strip_text
from ..operators.replay import UNKNOWN_EVENT, UNKNOWN_TEMPLATE
from ..plans.mining import Model
from ..plans.staging import dimension


def replay_stream(lines: DataFrame, model: Model, content: str = "Content") -> DataFrame:
    """lines with masked, event_id and event_template: exact, else canonical lookups; unknown messages get the unknown event.

    Both lookups are broadcast joins with the model's bounded tables, so the stream keeps no state.
    """
    keys = model.strings.select(canonical_key(F.col("masked")).alias("k"), "event_id", "cluster_id").groupBy("k").agg(F.min_by("event_id", "cluster_id").alias("e2"))
    cache = model.strings.select(F.col("masked").alias("t"), F.col("event_id").alias("e1"))
    names = model.events.select(F.col("event_id").alias("e"), "event_template")
    r = lines.withColumn("masked", mask(strip_text(F.coalesce(F.col(content), F.lit(""))), model.settings.format))
    r = r.join(dimension(cache), F.col("masked") == F.col("t"), "left").join(dimension(keys), canonical_key(F.col("masked")) == F.col("k"), "left")
    r = r.withColumn("event_id", F.coalesce("e1", "e2", F.lit(UNKNOWN_EVENT))).drop("t", "k", "e1", "e2")
    r = r.join(dimension(names), F.col("event_id") == F.col("e"), "left").drop("e")
    return r.withColumn("event_template", F.coalesce("event_template", F.lit(UNKNOWN_TEMPLATE)))


def dedupe_unseen(replayed: DataFrame, timeout_ms: int = 86_400_000) -> DataFrame:
    """(canonical, masked, seen) of messages the model does not know, once for each canonical key: the stateful memo.

    State is one flag per key and ends `timeout_ms` after the key was last seen.
    """
    unseen = replayed.where(F.col("event_id") == UNKNOWN_EVENT).select(canonical_key(F.col("masked")).alias("canonical"), "masked")

    def first(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        masked, n = None, 0
        for part in rows:
            n += len(part)
            if len(part) and (masked is None or part["masked"].min() < masked):
                masked = part["masked"].min()
        known = state.exists
        state.update((1,))
        state.setTimeoutDuration(timeout_ms)
        if not known and masked is not None:
            yield pd.DataFrame({"canonical": [key[0]], "masked": [masked], "seen": [n]})

    return unseen.groupBy("canonical").applyInPandasWithState(first, "canonical string, masked string, seen long", "flag int", "append", GroupStateTimeout.ProcessingTimeTimeout)
