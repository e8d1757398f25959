"""The scoring loop as a ``foreachBatch`` function over the telemetry stream."""

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlag import settings as S
from fleetlag.operators import alerts as AL
from fleetlag.plans import live as L
from fleetlag.streaming.processors import plain

_STATE = T.StructType(
    [
        T.StructField("clock", T.DoubleType()),
        T.StructField("last_tick", T.DoubleType()),
        T.StructField("observed_since", T.DoubleType()),
        T.StructField("seq", T.LongType()),
        T.StructField("tick_batch", T.LongType()),  # the batch of the last tick
        T.StructField("held", T.ArrayType(T.StructType([T.StructField("batch", T.LongType()), T.StructField("newest", T.DoubleType())]))),
    ]
)
_STEPS = T.StructType([*AL.CHANGES.fields, T.StructField("state", T.StringType())])
HOUR_S = 3_600


class ArrivalLog:
    """Arrivals in folders by hour, to which other jobs append; a reader opens only the hours of its span."""

    def __init__(self, path: str):
        self.path = path

    def append(self, events: DataFrame, batch_id: int) -> None:
        """Add the arrivals of one batch; the same batch again replaces itself."""
        hour = F.floor(F.col("time_fact") / HOUR_S).cast("bigint")
        rows = events.where(F.col("time_fact").isNotNull()).withColumns({"hour": hour, "batch": F.lit(batch_id)})
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("hour", "batch").parquet(self.path)

    def __call__(self, spark: SparkSession, since: float, until: float) -> DataFrame | None:
        hours = range(int(since // HOUR_S), int(until // HOUR_S) + 1)
        try:
            rows = spark.read.option("basePath", self.path).parquet(f"{self.path}/hour={{{','.join(map(str, hours))}}}")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" in str(exc):
                return None
            raise
        return rows.where(F.col("time_fact").between(since, until)).drop("hour", "batch")


class LiveLoop:
    """Event clock, scoring ticks, stored predictions, alerts and view changes, one micro-batch at a time.

    Everything a batch writes goes to its own ``batch=N`` folder and depends only on folders of
    earlier batches, so a batch repeated after a failure writes the same again. A tick happens when
    the clock is a full period past the last one; its moment is the clock itself.

    What a batch reads does not grow with the age of the stream: the state row names the batches whose points still reach
    into the window and the batch of the last tick, whose folders hold the newest forecast of every vehicle, the published
    view and the open alerts. ``events`` is a table of arrivals, or a function of ``(spark, since, until)`` that is asked
    again at every tick (:class:`ArrivalLog`), for the last ``back_s`` seconds.
    """

    def __init__(
        self, root: str, plan: DataFrame, events, period_s: float = S.SCORING_PERIOD_S, forecast=None,
        back_s: float = S.SCHEDULE_BACK_S,
    ):
        self.root, self.plan, self.events = root, plan, events
        self.period_s, self.forecast, self.back_s = period_s, forecast, back_s

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self._write(batch, "telemetry", batch_id)
        mine = spark.read.schema(batch.schema).parquet(f"{self.root}/telemetry/batch={batch_id}")
        before = self.state(spark, batch_id)
        seen = mine.agg(F.max("t").alias("newest"), F.min("t").alias("oldest")).first()
        clock = _max(before.clock if before else None, seen.newest)
        since = _min(before.observed_since if before else None, seen.oldest)
        last, seq, tick = (before.last_tick, before.seq, before.tick_batch) if before else (None, 0, None)
        held = [(h.batch, h.newest) for h in before.held] if before else []
        if seen.newest is not None:
            held.append((batch_id, seen.newest))
        held = [(b, newest) for b, newest in held if newest >= clock - S.TELEMETRY_WINDOW_S]
        if clock is not None and (last is None or clock - last >= self.period_s):
            last = clock
            window = L.in_window(spark.read.schema(batch.schema).parquet(*self._folders("telemetry", held)), clock)
            known = self._known(spark, clock)
            self._tick(spark, window, known, clock, since, batch_id, tick)
            self._alerts(spark, known, batch_id, tick)
            seq = self._publish(spark, window, known, clock, batch_id, tick, seq)
            tick = batch_id
        self._write(spark.createDataFrame([(clock, last, since, seq, tick, held)], _STATE), "state", batch_id)

    def state(self, spark: SparkSession, before_batch: int):
        """State after the batch before this one (one row), or None."""
        table = self._of_batch(spark, "state", before_batch - 1) if before_batch > 0 else None
        return None if table is None else table.first()

    def table(self, spark: SparkSession, name: str, before_batch: int | None = None) -> DataFrame | None:
        """What all earlier batches wrote under ``name``, for readers of the whole history."""
        try:
            df = spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
                return None
            raise
        df = df.withColumnRenamed("batch", "__batch")  # the partition folder's number
        if before_batch is not None:
            df = df.where(F.col("__batch") < before_batch)
        return None if df.isEmpty() else df

    def alerts(self, spark: SparkSession) -> DataFrame | None:
        """Every alert so far in its last state."""
        changes = self.table(spark, "alert_changes")
        return None if changes is None else AL.current_alerts(changes.drop("__batch"))

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")

    def _folders(self, name, held):
        return [f"{self.root}/{name}/batch={b}" for b, _ in held]

    def _of_batch(self, spark, name, batch_id) -> DataFrame | None:
        """What one batch wrote; None without such a batch."""
        if batch_id is None:
            return None
        try:
            return spark.read.parquet(f"{self.root}/{name}/batch={batch_id}")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" in str(exc):
                return None
            raise

    def _known(self, spark, clock) -> DataFrame:
        """Arrivals up to the clock, as they are stored now."""
        found = self.events(spark, clock - self.back_s, clock) if callable(self.events) else self.events
        if found is None:
            found = spark.createDataFrame([], _ARRIVALS)
        return found.where(F.col("time_fact") <= clock)

    def _tick(self, spark, window, known, clock, since, batch_id, tick):
        rows = L.score_at(window, self.plan, known, clock, self.forecast)
        warm = F.lit(since is not None and since <= clock - S.TELEMETRY_WINDOW_S)
        # the window alone cannot tell how long the stream has been watched
        own = F.col("degraded_reason") == "warming_up"
        rows = rows.withColumn("degraded", F.col("degraded") & ~(own & warm)).withColumn(
            "degraded_reason", F.when(~(own & warm), F.col("degraded_reason"))
        )
        earlier = self._of_batch(spark, "newest", tick)
        self._write(rows, "predictions", batch_id)
        newest = self._of_batch(spark, "predictions", batch_id)
        if earlier is not None:
            newest = earlier.unionByName(newest)
        self._write(L.latest_predictions(newest), "newest", batch_id)

    def _alerts(self, spark, known, batch_id, tick):
        """Apply new arrivals, then this tick's forecasts, to the open alerts.

        Arrivals only matter to vehicles with open alerts. Which of theirs the last tick knew is kept beside the alerts,
        so an arrival that is stored late is still applied once.
        """
        told = self._of_batch(spark, "predictions", batch_id)
        opened = self._of_batch(spark, "open_alerts", tick)
        if opened is None:
            opened = spark.createDataFrame([], "tr_id bigint, state string")
        keys = ["tr_id", "stop_id", "time_fact"]
        new = known.join(opened, "tr_id", "left_semi")
        heard = self._of_batch(spark, "heard", tick)
        if heard is not None:
            new = new.join(heard, keys, "left_anti")
        log = AL.alert_log(told, self.plan, known).where("kind = 1").unionByName(AL.arrival_log(new))
        steps = log.groupBy("tr_id").cogroup(opened.groupBy("tr_id")).applyInPandas(_react, _STEPS)
        self._write(steps, "alert_steps", batch_id)
        steps = self._of_batch(spark, "alert_steps", batch_id)
        self._write(steps.where("state IS NULL").drop("state"), "alert_changes", batch_id)
        self._write(steps.where("state IS NOT NULL").select("tr_id", "state"), "open_alerts", batch_id)
        opened = self._of_batch(spark, "open_alerts", batch_id)
        self._write(known.join(opened, "tr_id", "left_semi").select(*keys), "heard", batch_id)

    def _publish(self, spark, window, known, clock, batch_id, tick, seq) -> int:
        """Changed and removed vehicles since the last publication, with the next number."""
        view = L.fleet_snapshot(window, self._of_batch(spark, "newest", batch_id), known, self.plan, clock)
        flat = view.select("tr_id", "lat", "lon", "last_t", "freshness", "prediction.sample_id", "prediction.risk_level")
        self._write(flat, "views", batch_id)
        now = self._of_batch(spark, "views", batch_id)
        earlier = self._of_batch(spark, "views", tick)
        changes = L.view_diff(now.limit(0) if earlier is None else earlier, now).withColumn("seq", F.lit(seq + 1).cast("bigint"))
        if changes.isEmpty():
            return seq
        self._write(changes, "changes", batch_id)
        return seq + 1


_ARRIVALS = "tr_id bigint, stop_id bigint, time_plan double, time_fact double, delay_s double"


def _react(key, log: pd.DataFrame, opened: pd.DataFrame) -> pd.DataFrame:
    """Changes of one vehicle's alerts, and what is open afterwards as a row with ``state``."""
    alerts = json.loads(opened["state"].iloc[0]) if len(opened) else {}
    out = []
    for row in log.sort_values(["t", "kind", "sample_id"], kind="stable").to_dict("records"):
        row = {k: plain(v) for k, v in row.items()}
        row["stop_id"] = int(row["stop_id"])
        row["seg_from"] = None if row["seg_from"] is None else int(row["seg_from"])
        out += [(key[0], *c, None) for c in AL.react(alerts, row)]
    if alerts:
        out.append((key[0], *[None] * (len(AL.CHANGES) - 1), json.dumps(alerts, sort_keys=True)))
    return pd.DataFrame({f.name: pd.Series([r[i] for r in out], dtype=object) for i, f in enumerate(_STEPS.fields)})


def _max(a, b):
    return b if a is None else a if b is None else max(a, b)


def _min(a, b):
    return b if a is None else a if b is None else min(a, b)


def run_loop(records: DataFrame, loop: LiveLoop, checkpoint: str, once: bool = True):
    """Start the loop on a record stream."""
    writer = records.writeStream.foreachBatch(loop).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
