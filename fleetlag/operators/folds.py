"""Exact sequential folds over long per-key histories, run in parallel by segments.

Some rules need the outcome of the previous row (an arrival bounds the next search). Folding a
whole vehicle in one task would not scale, so each (key, segment) is folded on its own from the
empty state; then every segment whose true incoming state differs from the one it was folded with
is folded again, until none is left. The result equals one long fold. States settle quickly,
because what leaves a segment rarely depends on what came in: normally one extra round, over the
affected segments only. Every round is written to the shared folder, so a lost executor costs a
task, not the history.
"""

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlag.session import cut_lineage


def segmented_fold(
    rows: DataFrame,
    keys: list[str],
    seg: str,
    order: list[str],
    step: Callable,
    out_schema: T.StructType,
    until: Callable | None = None,
) -> DataFrame:
    """Fold ``rows`` of each key in (``seg``, ``order``) and return the emitted rows.

    ``step(records, state)`` gets the rows of one segment in order and the incoming state, a JSON
    value or None for none; it returns ``(emitted tuples, outgoing state)``. States must be plain
    JSON values, equal states must dump equally. ``seg`` must be coarse enough to be worth a task
    and fine enough to fit one. ``until(state)`` may give the last value of ``order[0]`` for which a
    state still matters: segments that start later need no second fold for it.
    """
    rows = cut_lineage(rows)
    args = (keys, seg, order, step, out_schema, until)
    first = _fold(rows.withColumn("__in", F.lit(None).cast("string")), *args)
    result = cut_lineage(first)
    in_order = Window.partitionBy(*keys).orderBy(seg)
    while True:
        before, ends = F.lag("__state").over(in_order), F.lag("__until").over(in_order)
        states = result.where("__is_state").select(
            *keys, seg, "__used",
            F.when(ends.isNull() | (ends >= F.col("__first")), before).alias("__in"),
        )
        dirty = states.where(~F.col("__used").eqNullSafe(F.col("__in"))).select(*keys, seg, "__in")
        if dirty.isEmpty():
            break
        dirty = cut_lineage(dirty)
        again = _fold(rows.join(dirty, [*keys, seg]), *args)
        settled = result.join(dirty.select(*keys, seg), [*keys, seg], "left_anti")
        result = cut_lineage(settled.unionByName(again))
    return result.where("NOT __is_state").select("__out.*")


def _fold(rows, keys, seg, order, step, out_schema, until=None) -> DataFrame:
    key_fields = [rows.schema[k] for k in [*keys, seg]]
    schema = T.StructType(
        [
            *key_fields,
            T.StructField("__is_state", T.BooleanType()),
            T.StructField("__used", T.StringType()),
            T.StructField("__state", T.StringType()),
            T.StructField("__first", T.DoubleType()),
            T.StructField("__until", T.DoubleType()),
            T.StructField("__out", out_schema),
        ]
    )
    names, fields = [*keys, seg], out_schema.fieldNames()
    arrow = to_arrow_schema(schema)

    def run(key, table):
        key = tuple(k.as_py() for k in key)
        used = table.column("__in")[0].as_py()
        table = table.drop_columns([seg, "__in"])
        records = table.sort_by([(c, "ascending") for c in order]).to_pylist()
        start = float(records[0][order[0]])
        emitted, state = step(records, json.loads(used) if used else None)
        after = None if state is None else json.dumps(state, sort_keys=True)
        head = dict(zip(names, key, strict=True))
        out = [
            {**head, "__is_state": False, "__out": dict(zip(fields, e, strict=True))} for e in emitted
        ]
        end = until(state) if until and state is not None else None
        out.append(
            {**head, "__is_state": True, "__used": used, "__state": after, "__first": start, "__until": end}
        )
        return pa.Table.from_pylist(out, schema=arrow)

    return rows.groupBy(*names).applyInArrow(run, schema)
