"""Streams that remember what came before: keyed state on the RocksDB store.

Each operator reads the rows of a key piece by piece, keeps what later rows can
still depend on, and lets the watermark clear it.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructField, StructType

from commentguard import fixed_values as fv
from commentguard.functions import text as tx

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _on_rocksdb(stream: DataFrame) -> DataFrame:
    """Keyed state with timers needs this store; streams that are running keep theirs."""
    session: SparkSession = stream.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream


# --- Repeats -----------------------------------------------------------------


class _FirstInSpan(StatefulProcessor):
    """Lets a key's row pass when the last one that passed is ``ttl`` seconds old or older."""

    def __init__(self, ttl: int, order: str, names: list[str]):
        self.ttl, self.order, self.names = ttl, order, names

    def init(self, handle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "second long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Only the first row of a second can pass, so one is kept of each, however many there are.
        firsts = None
        for part in rows:
            part.columns = [*self.names, "_second"]  # names with a leading underscore do not arrive
            timeless = part["_second"].isna()
            if timeless.any():
                yield part.loc[timeless, self.names]
                part = part[~timeless]
            part = part if firsts is None else pd.concat([firsts, part])
            firsts = part.sort_values(["_second", self.order], kind="stable").drop_duplicates("_second")
        seconds = firsts["_second"].to_numpy(np.int64)
        before = self.passed.get()[0] if self.passed.exists() else None
        last, fresh = before, []
        while (at := 0 if last is None else int(np.searchsorted(seconds, last + self.ttl))) < len(seconds):
            fresh.append(at)
            last = int(seconds[at])
        if fresh:
            self.passed.update((last,))
            if before is not None:
                self.handle.deleteTimer(1000 * (before + self.ttl))
            self.handle.registerTimer(1000 * (last + self.ttl))
            yield firsts.iloc[fresh][self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.passed.clear()
        return iter(())

    def close(self) -> None:
        pass


def dedupe_stream(stream: DataFrame, ts: str = "ts", ttl_seconds: int = fv.CACHE_TTL_SECONDS, order: str = "comment_id") -> DataFrame:
    """Drop repeats of a text in the same context within the time to live, which counts from the write.

    The state of a key is the second of its last write; a timer clears it when
    the watermark has passed the time to live.  In a micro-batch the rows of a
    key are taken in time order, equal seconds by ``order``: a worker holds one
    row for each second that a key has in it, not all its rows, so the trigger
    bounds memory by the time a micro-batch spans.  Rows without a time are
    repeats of nothing and stay.
    """
    keyed = stream.withColumn("cache_key", tx.cache_key("text", "context_type")).withColumn("_second", F.unix_timestamp(ts))
    schema = StructType([f for f in keyed.schema if f.name != "_second"])
    grouped = _on_rocksdb(keyed).withWatermark(ts, f"{ttl_seconds} seconds").groupBy("cache_key")
    return grouped.transformWithStateInPandas(_FirstInSpan(ttl_seconds, order, schema.names), schema, "append", "eventTime")


# --- Feedback ----------------------------------------------------------------


class _LatestBefore(StatefulProcessor):
    """Gives each feedback the latest decision of its key that is not later."""

    def __init__(self, within: int):
        self.within = within

    def init(self, handle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at long, id long, action string")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        decided, asked = [pd.DataFrame([tuple(r) for r in self.recent.get()] if self.recent.exists() else [], columns=["at", "id", "action"])], []
        for part in rows:
            is_feedback = part["is_feedback"].to_numpy(bool)
            decided.append(part.loc[~is_feedback, ["at", "id", "action"]])
            asked.append(part.loc[is_feedback, ["id", "at", "action"]])
        known = pd.concat(decided).sort_values(["at", "id"], kind="stable")
        at, ids, actions = known["at"].to_numpy(np.int64), known["id"].to_numpy(np.int64), known["action"].to_numpy(object)
        for part in asked:
            when = part["at"].to_numpy(np.int64)
            place = np.searchsorted(at, when, "right") - 1
            found = place >= 0
            found[found] = when[found] - at[place[found]] <= self.within
            spot = place[found]
            out = {name: pd.array([pd.NA] * len(part), dtype=kind) for name, kind in (("decision_id", "Int64"), ("decided_at", "Int64"))}
            out["decision_id"][found], out["decided_at"][found] = ids[spot], at[spot]
            decision = np.full(len(part), None, object)
            decision[found] = actions[spot]
            yield pd.DataFrame({
                "text_hash": key[0], "feedback_id": part["id"].to_numpy(np.int64), "feedback_at": when, "human_action": part["action"].to_numpy(object),
                **out, "predicted_action": decision,
            })
        self._keep(at, ids, actions, timerValues.getCurrentWatermarkInMs())

    def _keep(self, at, ids, actions, watermark: int) -> None:
        """The decisions that feedback may still be about: those after the watermark, and the last one before it."""
        first = max(0, int(np.searchsorted(at, 1000 * watermark, "right")) - 1)
        if not len(at) or at[-1] + self.within < 1000 * watermark:
            self.recent.clear()
            return
        self.recent.put(list(zip(at[first:].tolist(), ids[first:].tolist(), actions[first:].tolist(), strict=True)))
        due = -(-(int(at[-1]) + self.within) // 1000) + 1
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_feedback_join(
    decisions: DataFrame, feedback: DataFrame, ts: str = "ts", key: str = "comment_id", watermark: str = "1 hour", within_days: float = 7,
) -> DataFrame:
    """Each feedback with the latest decision on its text that was made before it, as ``attach_feedback`` gives it.

    ``decisions`` has text_hash, predicted_action, ``ts`` and an integer
    ``key``; ``feedback`` has feedback_id, text_hash, human_action and
    timestamp.  A feedback is answered in the micro-batch it comes in: decisions
    come before what is said about them.  One that comes late, but within the
    watermark, still finds the decision of its time.  The state of a text is its
    decisions after the watermark and one before.
    """
    sides = (
        decisions.select("text_hash", F.col(ts).alias("_ts"), F.lit(False).alias("is_feedback"), F.col(key).alias("id"), F.col("predicted_action").alias("action")),
        feedback.select("text_hash", F.col("timestamp").alias("_ts"), F.lit(True).alias("is_feedback"), F.col("feedback_id").alias("id"), F.col("human_action").alias("action")),
    )
    both = sides[0].withWatermark("_ts", watermark).unionByName(sides[1].withWatermark("_ts", watermark))
    both = both.withColumn("at", F.unix_micros(F.col("_ts").cast("timestamp_ltz")))
    fields = {f.name: f for f in both.schema}
    schema = StructType([
        fields["text_hash"], StructField("feedback_id", fields["id"].dataType), StructField("feedback_at", fields["at"].dataType),
        StructField("human_action", fields["action"].dataType), StructField("decision_id", fields["id"].dataType),
        StructField("decided_at", fields["at"].dataType), StructField("predicted_action", fields["action"].dataType),
    ])
    within = round(within_days * 86_400_000_000)
    found = _on_rocksdb(both).groupBy("text_hash").transformWithStateInPandas(_LatestBefore(within), schema, "append", "eventTime")
    times = {c: F.timestamp_micros(c) for c in ("feedback_at", "decided_at")}
    return found.withColumns(times).withColumnRenamed("decision_id", key)
