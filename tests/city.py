"""A straight street with known answers, as plain rows."""

STEP_DEG = 0.005
LAT, LON = 55.75, 37.60


def plan_rows(tr_id=1, n=20, every=60.0, layovers=None, start=0.0, row=0):
    """Stops 0.005 degrees apart, one a minute; ``layovers`` adds a pause after a stop index."""
    out, t = [], start
    for i in range(n):
        out.append((tr_id * 1000 + i, tr_id, t, LAT + 0.01 * row, LON + STEP_DEG * i))
        t += every + (layovers or {}).get(i, 0.0)
    return out


PLAN = "stop_id bigint, tr_id bigint, t_plan double, lat double, lon double"
FIX = "tr_id bigint, t double, ok boolean, lat double, lon double, speed double, row_id bigint"


def track_rows(plan, delays, dwell=20.0, step=10.0, skip=()):
    """Fixes of a bus that reaches stop k at plan + delays[k] and stands there for ``dwell``."""
    knots = []
    for k, (_, tr, t, lat, lon) in enumerate(plan):
        knots += [(t + delays[k], lat, lon), (t + delays[k] + dwell, lat, lon)]
    out, t, i = [], knots[0][0], 0
    while t <= knots[-1][0]:
        while i + 1 < len(knots) and knots[i + 1][0] < t:
            i += 1
        (t0, a0, o0), (t1, a1, o1) = knots[i], knots[min(i + 1, len(knots) - 1)]
        f = 0.0 if t1 == t0 else min(max((t - t0) / (t1 - t0), 0.0), 1.0)
        moving = (a0, o0) != (a1, o1)
        if not any(lo <= t <= hi for lo, hi in skip):
            out.append((plan[0][1], t, True, a0 + (a1 - a0) * f, o0 + (o1 - o0) * f, 20.0 if moving else 0.0, len(out)))
        t += step
    return out
