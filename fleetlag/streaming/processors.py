"""Keyed state machines on a stream: stop detector, alerts, the sliding telemetry window and the last event of each stop.

Detector and alerts keep one JSON value per vehicle and apply the same step functions as the batch
folds. Rows of a micro-batch are applied in the order of their stream position, as they would be one by one; only
streams without a position are put in time order.
"""

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from fleetlag import settings as S
from fleetlag.functions import scalars as X
from fleetlag.operators import alerts as AL
from fleetlag.operators import detector as DT

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = T.StructType([T.StructField("value", T.StringType())])


def plain(value):
    """pandas and NumPy cells as plain Python values, missing ones as None."""
    if value is None or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        return plain(value.item())
    return value


class JsonState(StatefulProcessor):
    """One JSON value per key, advanced row by row."""

    order: list[str] = []
    schema: T.StructType

    def init(self, handle):
        self.handle = handle
        self.cell = handle.getValueState("state", _STATE)

    def load(self):
        return json.loads(self.cell.get()[0]) if self.cell.exists() else None

    def store(self, state):
        if state is None:
            self.cell.clear()
        else:
            self.cell.update((json.dumps(state, sort_keys=True),))

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        if self.order:
            pdf = pdf.sort_values(self.order, kind="stable")
        records = [{k: plain(v) for k, v in r.items()} for r in pdf.to_dict("records")]
        out, state = self.advance(key, records, self.load(), timerValues)
        self.store(state)
        yield self.frame(out)

    def handleInitialState(self, key, initialState, timerValues):
        value = initialState["state"].iloc[0]
        if value:
            self.cell.update((value,))

    def frame(self, out):
        columns = {
            f.name: pd.Series([r[i] for r in out], dtype=object) for i, f in enumerate(self.schema.fields)
        }
        return pd.DataFrame(columns)

    def close(self):
        pass


class StopDetector(JsonState):
    """Emits the event log of :mod:`fleetlag.operators.detector`."""

    schema = DT.EVENTS

    def __init__(self, settings, order=("t",)):
        self.settings, self.order = settings, list(order)

    def advance(self, key, records, state, timers):
        state = state or DT.new_state()
        out = []
        for tick in records:
            out += [(key[0], *e) for e in DT.feed(state, tick, self.settings)]
        return out, DT.forget_old(state, self.settings)


class AlertKeeper(JsonState):
    """Emits the change log of :mod:`fleetlag.operators.alerts`."""

    schema = AL.CHANGES

    def __init__(self, order=("t", "kind", "sample_id")):
        self.order = list(order)

    def advance(self, key, records, state, timers):
        alerts = state or {}
        out = []
        for row in records:
            out += [(key[0], *c) for c in AL.react(alerts, row)]
        return out, alerts or None


class TelemetryWindow(StatefulProcessor):
    """Keeps a vehicle's points not older than the window before the fleet's clock, each as one entry of a list state.

    The stream's watermark trails the newest event time over all records by the window, so the rows that Spark drops as
    late are those outside it. Every change gives the whole window of the vehicle. A timer drops points as the fleet's clock
    passes them, and forgets a vehicle with none left.
    """

    def __init__(self, records: T.StructType, window_s=S.TELEMETRY_WINDOW_S):
        self.window_s = window_s
        self.point = T.StructType([f for f in records.fields if f.name not in ("tr_id", "event_time")])
        self.at = self.point.fieldNames().index("t")

    @property
    def schema(self):
        return T.StructType(
            [
                T.StructField("tr_id", T.LongType()),
                T.StructField("points", T.LongType()),
                T.StructField("first_t", T.DoubleType()),
                T.StructField("last_t", T.DoubleType()),
                T.StructField("held", T.ArrayType(self.point)),
            ]
        )

    def init(self, handle):
        self.handle = handle
        self.cell = handle.getListState("points", self.point)

    def handleInputRows(self, key, rows, timerValues):
        came = [typed(r, self.point) for pdf in rows for r in pdf[self.point.fieldNames()].to_dict("records")]
        yield self._evict(key, came, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._evict(key, [], timerValues)

    def _evict(self, key, came, timers):
        stored = [tuple(p) for p in self.cell.get()] if self.cell.exists() else []
        points = [*stored, *came]
        time = lambda p: p[self.at]
        mark = timers.getCurrentWatermarkInMs()
        clock = max([*map(time, points), *([(mark + 1) / 1000 + self.window_s] if mark > 0 else [])], default=0.0)
        held = [p for p in points if time(p) >= clock - self.window_s]
        if not held:
            self.cell.clear()
        elif held[: len(stored)] == stored:
            self.cell.appendList(held[len(stored) :]) if came else None
        else:
            self.cell.put(held)
        held.sort(key=time)
        due = int(time(held[0]) * 1000) - 1 if held else None
        for old in list(self.handle.listTimers()):
            if old != due:
                self.handle.deleteTimer(old)
        if held:
            self.handle.registerTimer(due)
        ends = (time(held[0]), time(held[-1])) if held else (None, None)
        names = self.point.fieldNames()
        row = (key[0], len(held), *ends, [dict(zip(names, p)) for p in held])
        return pd.DataFrame({f.name: pd.Series([v], dtype=object) for f, v in zip(self.schema.fields, row)})

    def close(self):
        pass


class LastEvents(StatefulProcessor):
    """The last event of each stop of a vehicle, by its place in the stream.

    One entry of a map state for a stop, so a batch reads and writes the stops it names alone. The watermark trails the
    newest event by the time an event is kept; once it passes the end of an hour, a timer drops that hour's events. (A
    time to live would need processing time, under which an ``availableNow`` run never ends.)
    """

    def __init__(self, events: T.StructType, order: str):
        self.schema, self.order = events, order
        self.value = T.StructType([f for f in events.fields if f.name not in ("tr_id", "stop_id")])
        self.names = self.value.fieldNames()
        self.time = self.names.index("time_fact")

    def init(self, handle):
        self.handle = handle
        self.cell = handle.getMapState("events", "stop_id bigint", self.value)

    def handleInputRows(self, key, rows, timerValues):
        at = self.names.index(self.order)
        newest = {}
        for pdf in rows:
            for r in pdf[self.schema.fieldNames()].to_dict("records"):
                stop, value = int(r["stop_id"]), typed(r, self.value)
                if stop not in newest or value[at] >= newest[stop][at]:
                    newest[stop] = value
        out = []
        for stop, value in newest.items():
            known = self.cell.getValue((stop,))
            if known is None or value[at] >= known[at]:
                self.cell.updateValue((stop,), value)
                self.handle.registerTimer((int(value[self.time] // 3_600) + 1) * 3_600_000)
                out.append({"tr_id": key[0], "stop_id": stop, **dict(zip(self.names, value))})
        yield pd.DataFrame({f.name: pd.Series([r[f.name] for r in out], dtype=object) for f in self.schema.fields})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = expiredTimerInfo.getExpiryTimeInMs() / 1000
        for stop in [k for k, v in self.cell.iterator() if v[self.time] < mark]:
            self.cell.removeKey(stop)
        yield pd.DataFrame({f.name: pd.Series([], dtype=object) for f in self.schema.fields})

    def close(self):
        pass


def typed(record: dict, schema: T.StructType) -> tuple:
    """A record of a pandas frame as a row of ``schema``; whole numbers that came as floats are whole again."""
    values = ((f, plain(record[f.name])) for f in schema.fields)
    return tuple(int(v) if v is not None and isinstance(f.dataType, T.IntegralType) else v for f, v in values)


def check_saved_settings(spark, path: str, settings: dict) -> None:
    """Remember the detector settings next to its checkpoint; refuse other ones later."""
    text = json.dumps(DT.check_settings(settings), sort_keys=True)
    try:
        saved = spark.read.text(path).first()
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        saved = None
    if saved is None:
        spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(path)
    elif saved.value != text:
        raise ValueError("the stored detector state was made with other settings")


def detect_stream(ticks: DataFrame, plan: DataFrame, settings: dict = S.DETECTOR, initial: DataFrame | None = None) -> DataFrame:
    """Event log of a tick stream. ``initial`` (``tr_id, state``) restores saved states.

    ``position`` is a tick's place in the stream (an offset or row number). With it a tick that is late in the stream
    stays late however the stream is cut into batches."""
    rows = DT.with_candidates(ticks, plan, settings)
    order = ["position"] if "position" in ticks.columns else ["t"]
    return rows.groupBy("tr_id").transformWithStateInPandas(
        StopDetector(settings, order), DT.EVENTS, "Append", "None",
        initialState=initial.groupBy("tr_id") if initial is not None else None,
    )


def alert_stream(log: DataFrame) -> DataFrame:
    """Alert changes from a stream shaped like :func:`fleetlag.operators.alerts.alert_log`."""
    keeper = AlertKeeper(["position"]) if "position" in log.columns else AlertKeeper()
    return log.groupBy("tr_id").transformWithStateInPandas(keeper, AL.CHANGES, "Append", "None")


def window_stream(records: DataFrame, window_s: float = S.TELEMETRY_WINDOW_S) -> DataFrame:
    """Held points per vehicle of a record stream with ``tr_id, t, event_time`` and any other columns."""
    late = f"{int(window_s * 1000) + 1} milliseconds"
    clocked = records.withWatermark("event_time", late).where("tr_id IS NOT NULL AND t IS NOT NULL")
    window = TelemetryWindow(clocked.schema, window_s)
    return clocked.groupBy("tr_id").transformWithStateInPandas(window, window.schema, "Update", "EventTime")


def last_events_stream(events: DataFrame, order: str = "row_id", keep_s: float = 2 * 86_400) -> DataFrame:
    """Every event that becomes the last one of its (vehicle, stop); ``order`` is its place in the stream.

    ``events`` have ``tr_id, stop_id, time_fact, event_time`` and any other columns; an event more than ``keep_s`` behind the
    newest one is dropped as late.
    """
    late = f"{int(keep_s * 1000)} milliseconds"
    known = events.withWatermark("event_time", late).dropna(subset=["tr_id", "stop_id", "time_fact", order])
    schema = T.StructType([f for f in known.schema.fields if f.name != "event_time"])
    return known.groupBy("tr_id").transformWithStateInPandas(LastEvents(schema, order), schema, "Update", "EventTime")


def verify_batches(events: DataFrame, read_predictions, write):
    """A stream writer that checks stored forecasts against arrivals. ``read_predictions()`` is called for every
    micro-batch, so forecasts stored after the start are checked too; ``write(errors, batch_id)`` keeps the result."""
    return events.writeStream.foreachBatch(lambda batch, i: write(verified_stream(batch, read_predictions()), i))


def verified_stream(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """Errors of the given stored predictions for a batch (or a stream) of arrivals."""
    stored = predictions.select("sample_id", "target_stop_id", "prediction_s")
    facts = events.select(F.col("stop_id").alias("target_stop_id"), F.col("delay_s").alias("actual_delay_s"))
    return facts.join(stored, "target_stop_id").select(
        "sample_id", "actual_delay_s", F.abs(X.col("prediction_s") - F.col("actual_delay_s")).alias("abs_error_s")
    )


def verified_pairs(
    events: DataFrame, predictions: DataFrame, horizon_s: float = S.SCHEDULE_BACK_S, late_s: float = S.TELEMETRY_WINDOW_S
) -> DataFrame:
    """Errors of a stream of forecasts for a stream of arrivals.

    ``events`` have ``event_time``, ``predictions`` have ``made_time`` (timestamps). A forecast is checked by the arrivals at
    its target stop from its own moment until ``horizon_s`` later; either side may come up to ``late_s`` late. The watermarks
    and the horizon bound what both sides keep. A repeated forecast or an equal arrival is checked once, a corrected
    arrival again.
    """
    late = f"{int(late_s * 1000)} milliseconds"
    facts = events.withWatermark("event_time", late).select(
        F.col("stop_id").alias("fact_stop_id"), F.col("delay_s").alias("actual_delay_s"), "event_time"
    )
    told = predictions.withWatermark("made_time", late).select("sample_id", "target_stop_id", "prediction_s", "made_time")
    facts = facts.dropDuplicates(["fact_stop_id", "actual_delay_s", "event_time"])
    told = told.dropDuplicates(["sample_id", "made_time"])
    horizon = F.expr(f"INTERVAL {int(horizon_s)} SECONDS")
    met = (F.col("fact_stop_id") == F.col("target_stop_id")) & F.col("event_time").between(
        F.col("made_time"), F.col("made_time") + horizon
    )
    return facts.join(told, met).select(
        "sample_id", "target_stop_id", "made_time", "actual_delay_s",
        F.abs(X.col("prediction_s") - F.col("actual_delay_s")).alias("abs_error_s"),
    )
