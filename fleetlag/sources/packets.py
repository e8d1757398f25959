"""Binary terminal frames in a BINARY column → navigation rows with a reject reason.

Fields are read with column expressions. Only the checksum and the walk over auxiliary cells, which
depend on every byte, run as an Arrow batch function.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frame layout, identifiers and the known auxiliary cell sizes (all little-endian).
OUTER_BYTES, INNER_BYTES, NAV_BYTES = 15, 10, 26
SIGNATURE = 0x7E7E
PACKET_TYPE = 2
HANDSHAKE = (0, 100)
REALTIME = (1, 101)
CELL_BYTES = {0: 26, 2: 26, 8: 6, 10: 37, 15: 50, 16: 8}


def little_endian(frame: str, offset: int, size: int) -> Column:
    """Unsigned integer of ``size`` bytes at a 0-based offset."""
    raw = F.hex(F.substring(F.col(frame), offset + 1, size))
    pairs = [F.substring(raw, 2 * i + 1, 2) for i in reversed(range(size))]
    return F.conv(F.concat(*pairs), 16, 10).try_cast("bigint")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint16)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ 0xA001, table >> 1).astype(np.uint16)
    return table


def checksum(data: bytes, table=_crc_table()) -> int:
    """MODBUS CRC-16 (reflected polynomial 0xA001, start 0xFFFF)."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc >> 8) ^ int(table[(crc ^ byte) & 0xFF])
    return crc


def _walk_cells(body: bytes):
    """Where the walk over the cells after the navigation stops: (reason, type, offset)."""
    at = 2 + NAV_BYTES
    while at < len(body):
        kind = body[at]
        size = CELL_BYTES.get(kind)
        if len(body) - at < 2:
            return "short_cell_header", kind, at
        if not kind or size is None:
            return "unknown_cell", kind, at
        if at + 2 + size > len(body):
            return "short_cell", kind, at
        at += 2 + size
    return None, None, None


def _whole_frame_checks(batches):
    for batch in batches:
        frames = batch.column("frame").to_pylist()
        crc, stop = [], []
        for frame in frames:
            payload = (frame or b"")[OUTER_BYTES:]
            value = checksum(payload)
            crc.append((value & 0xFF) << 8 | value >> 8)
            stop.append(_walk_cells(payload[INNER_BYTES:]))
        arrays = [
            *batch.columns,
            pa.array(crc, pa.int64()),
            pa.array([s[0] for s in stop], pa.string()),
            pa.array([s[1] for s in stop], pa.int64()),
            pa.array([s[2] for s in stop], pa.int64()),
        ]
        names = [*batch.schema.names, "crc_seen", "stop_reason", "stop_cell", "stop_offset"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def decode_frames(frames: DataFrame, max_frame_bytes: int = 4096) -> DataFrame:
    """Frames (``row_id, frame`` and optionally ``expected_unit_id``) to decoded rows.

    Output: ``row_id, unit_id, message`` (handshake or realtime), the navigation fields of a
    realtime frame, where its cell walk stopped, and ``reject_reason``.
    """
    if "expected_unit_id" not in frames.columns:
        frames = frames.withColumn("expected_unit_id", F.lit(None).cast("bigint"))
    base = frames.select("row_id", "frame", "expected_unit_id")
    schema = (
        "row_id bigint, frame binary, expected_unit_id bigint, crc_seen bigint, stop_reason string,"
        " stop_cell bigint, stop_offset bigint"
    )
    checked = base.mapInArrow(_whole_frame_checks, schema)
    body = OUTER_BYTES + INNER_BYTES
    nav = body + 2

    def u(offset, size):
        return little_endian("frame", offset, size)

    fields = checked.select(
        "*",
        F.length("frame").alias("size"),
        u(0, 2).alias("signature"),
        u(2, 2).alias("data_size"),
        u(4, 2).alias("outer_flags"),
        u(6, 2).alias("crc"),
        u(8, 1).alias("packet_type"),
        u(9, 4).alias("unit_id"),
        u(15, 2).alias("service"),
        u(17, 2).alias("kind"),
        u(19, 2).alias("inner_flags"),
        *[u(body + o, n).alias(f"h{i}") for i, (o, n) in enumerate([(0, 2), (2, 2), (4, 2), (6, 4), (10, 4), (14, 4)])],
        u(body, 2).alias("cell_head"),
        u(nav, 4).alias("timestamp"),
        u(nav + 4, 4).alias("longitude"),
        u(nav + 8, 4).alias("latitude"),
        u(nav + 12, 1).alias("extra_dop"),
        u(nav + 14, 2).alias("speed_avg"),
        u(nav + 18, 2).alias("course"),
    )
    c = F.col
    is_hello = (c("service") == HANDSHAKE[0]) & (c("kind") == HANDSHAKE[1])
    is_real = (c("service") == REALTIME[0]) & (c("kind") == REALTIME[1])
    body_size = c("size") - body
    hello_fields = (
        (c("h0") == 6) & (c("h1") == 2) & (c("h2") == 0) & (c("h5") == 0) & (c("h4") != 0)
    )
    reason = (
        F.when(c("size").isNull() | (c("size") < OUTER_BYTES), "short_npl")
        .when(c("signature") != SIGNATURE, "signature")
        .when((c("packet_type") != PACKET_TYPE) | (c("outer_flags") != 0), "npl_type_or_flags")
        .when(
            (c("data_size") < INNER_BYTES) | (c("data_size") + OUTER_BYTES > max_frame_bytes),
            "frame_size",
        )
        .when(c("size") - OUTER_BYTES != c("data_size"), "short_payload")
        .when(c("crc") != c("crc_seen"), "crc")
        .when(c("inner_flags").bitwiseAND(1) == 0, "nph_flags")
        .when(is_hello & (body_size != 18), "handshake_size")
        .when(is_hello & ~hello_fields, "handshake_fields")
        .when(is_hello & (c("h3") != c("unit_id")), "handshake_address")
        .when(~is_hello & ~is_real, "expected_realtime")
        .when(is_real & (c("expected_unit_id") != c("unit_id")), "peer_address")
        .when(is_real & ((body_size < 2 + NAV_BYTES) | (c("cell_head") != 0)), "missing_nav")
    )
    named = fields.withColumn("reject_reason", reason)
    ok_nav = is_real & c("reject_reason").isNull()
    nav_columns = ["timestamp", "longitude", "latitude", "extra_dop", "speed_avg", "course"]
    return named.select(
        "row_id",
        "unit_id",
        F.when(is_hello, "handshake").when(is_real, "realtime").alias("message"),
        *[F.when(ok_nav, c(n)).alias(n) for n in nav_columns],
        *[F.when(ok_nav, c(n)).alias(n) for n in ("stop_reason", "stop_cell", "stop_offset")],
        "reject_reason",
    )
