"""Counters of running jobs: rejected rows, rows and lag, without a second scan."""

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

# Reasons for which rows are refused.
PLAN_REASONS = ("id", "geom", "time_begin")
STREAM_REASONS = ("malformed",)


def reject_metrics(reasons, appended: Column | None = None) -> list[Column]:
    """Aggregates for ``observe``: rows, rejected rows by reason, and the newest append time (epoch seconds)."""
    reason = F.col("reject_reason")
    counts = [F.count_if(F.coalesce(reason == r, F.lit(False))).alias(r) for r in reasons]
    other = F.count_if(F.coalesce(~reason.isin(*reasons), F.lit(False))).alias("other")
    newest = [] if appended is None else [F.max(appended.cast("double")).alias("newest")]
    return [F.count(F.lit(1)).alias("rows"), *counts, other, *newest]


def observed_rejects(df: DataFrame, reasons=PLAN_REASONS) -> tuple[DataFrame, Observation]:
    """``df`` with an observation whose ``get`` gives the counts of the first action that reads all of it."""
    seen = Observation()
    return df.observe(seen, *reject_metrics(reasons)), seen


def observed_stream(df: DataFrame, name: str, reasons=STREAM_REASONS, appended: Column | None = None) -> DataFrame:
    """A stream whose batches report their counts under ``name`` to :class:`StreamCounters`."""
    return df.observe(name, *reject_metrics(reasons, appended))


def unread_entries(source: dict) -> int | None:
    """Entries behind a source's newest offset, from its progress; None where the source does not tell.

    Offsets are one number, or numbers by topic and partition; a partition not begun counts from zero.
    """
    end, latest = (_offset(source.get(k)) for k in ("endOffset", "latestOffset"))
    if latest is None:
        return None
    return sum(max(0, n - (end or {}).get(at, 0)) for at, n in latest.items())


def _offset(value) -> dict | None:
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return None
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return {(): int(value)}
    out = {}
    for name, part in value.items():
        for at, n in (_offset(part) or {}).items():
            out[(name, *at)] = n
    return out


class StreamCounters(StreamingQueryListener):
    """Adds up what the batches of the queries report: rows and rejects by name, unread entries and lag of the last batch.

    A batch that is reported again after a restart from its checkpoint counts once: the number of the last counted batch is
    kept by query id and may be given back with ``restore``.
    """

    def __init__(self, clock=None):
        self.clock = clock
        self.totals, self.unread, self.lag_s, self.last_batch = {}, {}, {}, {}

    def restore(self, totals: dict, last_batch: dict) -> None:
        self.totals, self.last_batch = {k: dict(v) for k, v in totals.items()}, dict(last_batch)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.take(json.loads(event.progress.json))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def take(self, progress: dict) -> None:
        query, batch = progress["id"], progress["batchId"]
        known = [n for n in (unread_entries(s) for s in progress.get("sources", [])) if n is not None]
        if known:
            self.unread[query] = sum(known)
        if batch <= self.last_batch.get(query, -1):
            return
        self.last_batch[query] = batch
        for name, metrics in progress.get("observedMetrics", {}).items():
            total = self.totals.setdefault(name, {})
            for metric, value in metrics.items():
                if metric != "newest":
                    total[metric] = total.get(metric, 0) + (value or 0)
                elif value is not None and self.clock is not None:
                    self.lag_s[name] = max(0.0, self.clock() - value)
