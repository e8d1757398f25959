"""Column expressions: parsing, geometry, clocks, labels. Everything stays in the JVM."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlag import settings as S

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- numbers and ids -------------------------------------------------------------------------


def integral_id(text) -> Column:
    """A 64-bit id from text; ``123.0`` is fine, fractions, blanks and other text are NULL.

    Read through DECIMAL: ids exceed 2^53 and a DOUBLE would lose their last digits.
    """
    number = F.trim(col(text)).try_cast("decimal(38,18)")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def finite(text) -> Column:
    """A finite number from text, else NULL."""
    number = (F.trim(col(text)) if isinstance(text, str) else col(text)).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def flag(text) -> Column:
    """Live spelling of a boolean: true, 1 and yes."""
    return F.lower(F.trim(col(text).cast("string"))).isin("true", "1", "yes")


def flag_offline(text) -> Column:
    """Offline spelling of a boolean: only ``true``."""
    return F.lower(col(text).cast("string")).eqNullSafe("true")


# --- time ------------------------------------------------------------------------------------

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?)?"
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def iso_time(text, zone: str) -> Column:
    """UTC timestamp of an ISO text; a text without offset is in ``zone``. NULL when malformed."""
    value = F.trim(col(text))
    parsed = value.try_cast("timestamp")
    return F.when(
        value.rlike(_ISO + "(" + _OFFSET[:-1] + ")?$"),
        F.when(value.rlike(r"[T ].*" + _OFFSET), parsed).otherwise(
            F.to_utc_timestamp(parsed, zone)
        ),
    )


def plan_time(text, zone: str) -> Column:
    """Timetable time: fractions beyond microseconds cut, texts carrying an offset refused."""
    value = F.regexp_replace(F.trim(col(text)), r"(\.\d{6})\d+$", "$1")
    return F.when(value.rlike(_ISO + "$"), F.to_utc_timestamp(value.try_cast("timestamp"), zone))


def unambiguous_time(text, zone: str) -> Column:
    """As :func:`iso_time`, but NULL for a local time that occurs twice (clocks set back)."""
    naive = F.trim(col(text)).try_cast("timestamp")
    utc = iso_time(text, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    repeated = (F.from_utc_timestamp(utc + hour, zone) == naive) | (
        F.from_utc_timestamp(utc - hour, zone) == naive
    )
    has_offset = F.trim(col(text)).rlike(r"[T ].*" + _OFFSET)
    return F.when(has_offset | ~repeated, utc)


def epoch_s(ts) -> Column:
    """Seconds since the epoch as DOUBLE."""
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(1e6)


def local_hour(t) -> Column:
    return F.pmod(col(t) + S.LOCAL_OFFSET_S, F.lit(86400)) / F.lit(3600.0)


def entry_ms(entry_id) -> Column:
    """Milliseconds in the id of a stream entry, ``<ms>-<sequence>``."""
    return F.split(col(entry_id), "-")[0].cast("bigint")


# --- geometry --------------------------------------------------------------------------------

# How strictly each reader accepts ``POINT (lon lat)``.
_POINT = {
    "loose": r"POINT\s*\(\s*([-\d.eE]+)\s+([-\d.eE]+)\s*\)",
    "plain": r"^\s*POINT\s*\(\s*(-?\d+(?:\.\d+)?)\s+(-?\d+(?:\.\d+)?)\s*\)\s*$",
    "signed": r"(?i)^\s*POINT\s*\(\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s+([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s*\)\s*$",
}


def wkt_point(text, strictness: str = "plain") -> tuple[Column, Column]:
    """``(lon, lat)`` of a WKT point, NULLs where the text is not one."""
    pattern = _POINT[strictness]
    return tuple(F.regexp_extract(col(text), pattern, i).try_cast("double") for i in (1, 2))


def haversine_m(lat1, lon1, lat2, lon2, radius: float = S.EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    capped = F.when(a > 1.0, F.lit(1.0)).otherwise(a)
    return F.lit(2 * radius) * F.asin(F.sqrt(capped))


def stop_key(lat, lon) -> Column:
    """Integer key of a physical stop: both coordinates at five decimals, half to even."""
    lat_e5 = F.bround(col(lat) * 100000).cast("bigint")
    lon_e5 = F.bround(col(lon) * 100000).cast("bigint")
    return lon_e5 * F.lit(100_000_000).cast("bigint") + lat_e5


def has_position(valid, lat, lon) -> Column:
    return col(valid) & col(lat).isNotNull() & col(lon).isNotNull()


# --- labels ----------------------------------------------------------------------------------


def is_synthetic(tr_id) -> Column:
    return col(tr_id) >= S.SYNTHETIC_FROM


def risk_level(seconds) -> Column:
    """Green inside the normal range, red when very late, yellow for the rest (early too)."""
    low, high = S.GREEN_RANGE_S
    s = col(seconds)
    return (
        F.when(s.between(low, high), "green").when(s > S.RED_ABOVE_S, "red").otherwise("yellow")
    )


def delay_class(seconds) -> Column:
    low, high = S.GREEN_RANGE_S
    s = col(seconds)
    return F.when(s < low, "early").when(s > high, "late").when(s.isNotNull(), "ontime")


def freshness(last_seen, clock) -> Column:
    """Both bounds belong to the fresher class."""
    silence = col(clock) - col(last_seen)
    return (
        F.when(silence <= S.STALE_AFTER_S, "active")
        .when(silence <= S.DROP_AFTER_S, "stale")
        .otherwise("offline")
    )


def degraded_reason(fallback, stale, warming_up) -> Column:
    return (
        F.when(col(fallback), "predictor_unavailable")
        .when(col(stale), "stale_telemetry")
        .when(col(warming_up), "warming_up")
    )


def sample_id(tr_id, t) -> Column:
    return F.concat_ws("_", col(tr_id).cast("string"), F.floor(col(t)).cast("bigint").cast("string"))


def delay_text(seconds) -> Column:
    """Signed minutes with at most one decimal, halves away from zero."""
    s = col(seconds)
    minutes = F.round(F.abs(s) / 60, 1)
    digits = F.regexp_replace(F.format_string("%.1f", minutes), r"\.0$", "")
    sign = F.when(s > 0, "+").when(s < 0, "-").otherwise("")
    return F.concat(sign, digits, F.lit(" min"))


# --- probabilities ---------------------------------------------------------------------------


def clip(x, low: float, high: float) -> Column:
    """NULL stays NULL, unlike with ``least`` and ``greatest``."""
    c = col(x)
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def logit(p) -> Column:
    clipped = clip(p, 1e-9, 1 - 1e-9)
    return F.ln(clipped / (F.lit(1.0) - clipped))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


# --- reasons ---------------------------------------------------------------------------------


def reason_codes(reasons) -> Column:
    """Stored codes of model reasons, each once; ``unknown`` only when nothing else is there."""
    from fleetlag.settings import REASON_CODES

    table = F.create_map(*[F.lit(x) for pair in REASON_CODES.items() for x in pair])
    codes = F.array_distinct(F.transform(col(reasons), lambda r: table[r]))
    known = F.filter(codes, lambda c: c != "unknown")
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("unknown")))


def with_stale_signal(reasons, age_s) -> Column:
    """Model reasons plus ``signal`` when the position is older than allowed or missing."""
    fresh = F.coalesce(col(age_s) <= S.STALE_AFTER_S, F.lit(False))
    return F.when(fresh, col(reasons)).otherwise(
        F.concat(col(reasons), F.array(F.lit("signal")))
    )


def with_stale_code(codes, stale) -> Column:
    """Stored codes with ``stale_telemetry`` added once for a stale vehicle."""
    return F.when(
        col(stale) & ~F.array_contains(col(codes), "stale_telemetry"),
        F.concat(col(codes), F.array(F.lit("stale_telemetry"))),
    ).otherwise(col(codes))


def top_reasons(contribution: dict[str, Column]) -> Column:
    """At most three reasons adding at least 15 s, the largest first."""
    order = list(contribution)
    items = F.array(
        *[
            F.struct((-contribution[k]).alias("neg"), F.lit(i).alias("i"), F.lit(k).alias("k"))
            for i, k in enumerate(order)
        ]
    )
    first = F.slice(F.array_sort(items), 1, S.MAX_REASONS)
    kept = F.filter(first, lambda x: -x["neg"] >= S.REASON_MIN_S)
    return F.transform(kept, lambda x: x["k"])


def main_reason(contribution: dict[str, Column]) -> Column:
    """``struct(reason, seconds)``: the largest push to late, or the largest pull to early."""
    pairs = [
        F.struct(v.alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k"))
        for i, (k, v) in enumerate(contribution.items())
    ]
    lows = [
        F.struct(v.alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k"))
        for i, (k, v) in enumerate(contribution.items())
    ]
    top, bottom = F.array_max(F.array(*pairs)), F.array_min(F.array(*lows))
    late = top["s"] > 0
    return F.struct(
        F.when(late, top["k"]).otherwise(bottom["k"]).alias("reason"),
        F.when(late, top["s"]).otherwise(bottom["s"]).alias("seconds"),
    )


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
