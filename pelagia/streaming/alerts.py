"""Positions and acknowledgements in, proximities and alerts out, as Structured Streaming jobs.

Stage one checks every micro-batch of positions against the fences and writes the
proximities of each tick; acknowledgements are landed beside them. Stage two reads both as one stream and keeps a small
state per alert key. Sinks live in the shared folder.

What is landed carries ``seen_at``, the newest event time met until then. The watermark runs on it, so a row that comes
late is not dropped by the engine but told by the state, and leaves as ``late``.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pelagia.functions import marine
from pelagia.operators import fences as fence_ops
from pelagia.plans.ordered import EPOCH, balanced
from pelagia.session import cut_lineage

PROXIMITY_SCHEMA = ("vessel_id BIGINT, tick BIGINT, tick_start TIMESTAMP_NTZ, layer STRING, fkey INT, level_rank INT, "
                    "distance_nm DOUBLE, event_id BIGINT, hazards_checked BOOLEAN, seen_at TIMESTAMP_NTZ")
ACK_SCHEMA = "vessel_id BIGINT, layer STRING, fkey INT, tick BIGINT, seen_at TIMESTAMP_NTZ"
ACTION_SCHEMA = "vessel_id BIGINT, layer STRING, fkey INT, tick BIGINT, level_rank INT, action STRING"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ["vessel_id", "layer", "fkey"]


def latest_version(fences: DataFrame, version: str = "version") -> DataFrame:
    """Replace-all dimension: only the rows of each layer's newest version."""
    newest = fences.groupBy("layer").agg(F.max(version).alias(version))
    return fences.join(newest, ["layer", version])


class Clock:
    """The newest event time landed so far, over all inputs of a job; never goes back.

    A restarted job gives the folders it had written, so that it goes on where it was.
    """

    def __init__(self, spark: SparkSession | None = None, *folders: str):
        self.now = None
        for folder in folders:
            self.reach(spark.read.schema("seen_at TIMESTAMP_NTZ").parquet(folder).agg(F.max("seen_at")).first()[0])

    def reach(self, time) -> None:
        if time is not None and (self.now is None or time > self.now):
            self.now = time

    def stamp(self, rows: DataFrame, time: str) -> DataFrame:
        """``rows`` with ``seen_at``, after the newest of their ``time`` is taken in."""
        self.reach(rows.agg(F.max(F.col(time).cast("timestamp_ntz"))).first()[0])
        return rows.withColumn("seen_at", F.lit(self.now).cast("timestamp_ntz"))


def land_acknowledgements(batch: DataFrame, sink: str, clock: Clock, tick_s: int) -> None:
    """Append acknowledgements (vessel_id, layer, fkey, tick; an alert is acknowledged after that tick) to ``sink``."""
    timed = batch.select(*KEY, "tick", tick_time("tick", tick_s).alias("_t"))
    clock.stamp(timed, "_t").drop("_t").write.mode("append").parquet(sink)


def land_time(spark: SparkSession, sink: str, clock: Clock, time) -> None:
    """Tell the stream that ``time`` has come though no position did, so that open alerts can be cleared."""
    clock.reach(time)
    spark.createDataFrame([(None, None, None, None, clock.now)], ACK_SCHEMA).write.mode("append").parquet(sink)


def proximity_batches(positions: DataFrame, segments: DataFrame, fences: DataFrame, tick_s: int, sink: str,
                      hazards: Callable[[], tuple[DataFrame, DataFrame] | None] | None = None, clock: Clock | None = None):
    """Start-ready writer: per micro-batch, latest position per vessel and tick against all fences.

    ``hazards`` is called per batch for the current hazard (segments, fences), None for no hazard; every zone is
    checked on its own. When it fails the static fences are still checked. ``hazards_checked`` is false on the rows of
    such a batch, and null without ``hazards``. ``clock`` is shared by the inputs of a job. Each batch writes its own folder, so a replay overwrites instead of
    repeating.
    """
    clock = clock or Clock()

    def one(batch: DataFrame, batch_id: int) -> None:
        extra, checked = None, None
        if hazards is not None:
            try:
                extra = hazards()
                if extra is not None:
                    extra = tuple(x.persist() for x in extra)
                    for x in extra:  # read here, so that a failure is the loader's
                        x.count()
                checked = True
            except Exception:
                logging.getLogger(__name__).exception("batch %d: hazards not checked", batch_id)
                extra, checked = None, False
        ticks = cut_lineage(balanced(fence_ops.latest_per_tick(batch, tick_s)))
        rows = fence_ops.with_levels(fence_ops.nearest_features(ticks, segments), fences)
        if extra is not None:
            rows = rows.unionByName(fence_ops.hazard_proximities(ticks, *extra))
        clock.reach(batch.agg(F.max(F.col("ts").cast("timestamp_ntz"))).first()[0])
        rows.where("level_rank > 0").withColumn("hazards_checked", F.lit(checked).cast("boolean")) \
            .select("vessel_id", "tick", "tick_start", "layer", "fkey", "level_rank", "distance_nm", "event_id", "hazards_checked",
                    F.lit(clock.now).cast("timestamp_ntz").alias("seen_at")) \
            .write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        for x in extra or ():
            x.unpersist()

    return positions.writeStream.foreachBatch(one)


class AlertState(StatefulProcessor):
    """One alert key: the last tick it was seen in, and the acknowledgements that wait for their tick.

    A sighting is emitted when the key was not active or its rank rose, else suppressed; a gap clears the alert in the
    tick after its last sighting, as does a timer once the time of that tick is over; an acknowledged alert is neither held nor
    cleared. A sighting or acknowledgement for a tick that is already decided leaves as ``late`` or ``late_ack``.
    """

    def __init__(self, tick_ms: int, keep_ticks: int):
        self.tick_ms, self.keep_ticks = tick_ms, keep_ticks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "tick BIGINT, rank INT")  # a null rank: cleared, kept to tell late rows
        self.acks = handle.getMapState("acks", "tick BIGINT", "acked BOOLEAN")

    def _acked(self, tick: int) -> bool:
        return self.acks.containsKey((tick,))

    def _forget(self, upto: int) -> None:
        for (tick,) in [k for k in self.acks.keys() if k[0] <= upto]:
            self.acks.removeKey((tick,))

    def _time(self, tick: int) -> None:
        """Wake up when ``tick`` is over."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, (tuple, list)) else t)
        self.handle.registerTimer((tick + 1) * self.tick_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):  # only told the time
            return
        events = pd.concat(list(rows)).groupby(["tick", "kind"], as_index=False)["level_rank"].max().sort_values(["tick", "kind"], ascending=[True, False])
        last, rank = self.last.get() if self.last.exists() else (None, None)
        out, seen = [], False
        for tick, kind, level in zip(events["tick"].tolist(), events["kind"], events["level_rank"]):
            if last is not None and (tick < last or (kind == "seen" and tick == last)):
                out.append((*key, tick, None if kind == "ack" else int(level), "late_ack" if kind == "ack" else "late"))
            elif kind == "ack":
                self.acks.updateValue((tick,), (True,))
            else:
                held = None if last is None or self._acked(last) else rank
                if held is not None and tick > last + 1:
                    out.append((*key, last + 1, held, "clear"))
                    held = None
                out.append((*key, tick, int(level), "emit" if held is None or level > held else "suppress"))
                self._forget(tick - 1)
                last, rank, seen = tick, int(level), True
        if seen:
            self.last.update((last, rank))
            self._time(last + 1)
        elif last is None:  # only acknowledgements, of an alert not seen yet: they wait as long as late rows are told
            self._time(int(events["tick"].max()) + self.keep_ticks)
        yield _actions(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, rank = self.last.get() if self.last.exists() else (None, None)
        out = []
        if rank is not None:
            if not self._acked(last):
                out.append((*key, last + 1, rank, "clear"))
            self.last.update((last, None))
            self._time(last + 1 + self.keep_ticks)
        else:
            self.last.clear()
            self._forget(1 << 60)
        yield _actions(out)

    def close(self) -> None:
        pass


def _actions(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*KEY, "tick", "level_rank", "action"]).astype({"level_rank": "Int32"})


def alert_actions(proximities: DataFrame, delay: str = "2 hours", tick_s: int = 3600, acknowledgements: DataFrame | None = None,
                  keep_ticks: int = 24) -> DataFrame:
    """emit / suppress / clear / late / late_ack per alert key, from streams of ``PROXIMITY_SCHEMA`` and ``ACK_SCHEMA``.

    ``tick_s`` is the length of a tick, as given to ``proximity_batches``. An alert not seen again is cleared in the tick
    after its last, once ``delay`` has passed; a row that comes later than that for a decided tick is told as late for
    ``keep_ticks`` ticks more, then the key's state goes. Acknowledgements of a tick count from the next tick on and may come before the
    sighting they belong to. Rows without ``seen_at`` count by their own tick's time. The state needs the RocksDB store, which is set on the session.
    """
    proximities.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = proximities.select(*KEY, "tick", "level_rank", F.coalesce("seen_at", "tick_start").alias("seen_at"), F.lit("seen").alias("kind"))
    if acknowledgements is not None:
        rows = rows.unionByName(acknowledgements.select(*KEY, "tick", F.lit(None).cast("int").alias("level_rank"), "seen_at", F.lit("ack").alias("kind")))
    stamped = rows.withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", delay)
    return stamped.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=AlertState(1000 * tick_s, keep_ticks), outputStructType=ACTION_SCHEMA, outputMode="append", timeMode="EventTime")


def split_late(rows: DataFrame, event_time: str, as_of: Column, max_age_s: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late): rows older than the state can take are kept apart, not dropped silently."""
    age = F.timestamp_diff("SECOND", F.col(event_time), as_of)
    late = F.coalesce(age > max_age_s, F.lit(True))
    return rows.where(~late), rows.where(late)


def graded(rows: DataFrame, as_of: Column) -> DataFrame:
    """Adds the freshness of each row, so stale rows are shown as such."""
    return rows.withColumn("freshness", marine.freshness_grade(as_of, "acquired_at", "issued_at", "valid_from", "valid_to"))


def current_alerts(log: DataFrame, key: str = "alert_id", order: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Newest row per alert of an append-only log: what a reader that replaces by id would hold."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(
        key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def tick_time(tick: str, seconds: int) -> Column:
    return F.timestamp_add("SECOND", F.col(tick) * seconds, F.expr(EPOCH))
