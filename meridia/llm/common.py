"""Shared helpers: tables, shared-folder materialisation, code points, hashes."""

from __future__ import annotations

import sys
import types

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from meridia.sources.staging import discard, shared_dir, stored, trim_driver

__all__ = ["MULT", "code_points", "discard", "held", "limit_batches", "materialise", "maybe_in", "mix64", "shared_dir", "shuffle_partitions", "small", "sql_unit", "table", "text_chunks"]
MULT = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage at a copy that every executor can read, so a lost executor
    costs its running tasks only. ``discard`` deletes it, the application's end at the latest.
    What the driver's JVM has freed by then goes back to the system.
    """
    out = stored(df, what)
    trim_driver(df.sparkSession)
    return out


def small(table: DataFrame, limit: int = 8_000_000) -> DataFrame:
    """``table`` (a materialised frame of narrow rows), marked for broadcast if its rows take at most ``limit`` bytes.

    Beyond that the join that uses it shuffles both sides.
    """
    width = 16 + sum(8 if f.dataType.typeName() not in ("string", "binary", "array") else 0 for f in table.schema)
    size = F.count(F.lit(1)) * width
    for f in table.schema:
        if f.dataType.typeName() in ("string", "binary"):
            size = size + F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0))
        elif f.dataType.typeName() == "array":
            size = size + F.coalesce(F.sum(F.size(f.name)), F.lit(0)) * 16 + F.count(F.lit(1)) * 16
    return F.broadcast(table) if (table.agg(size.alias("n")).first()["n"] or 0) <= limit else table


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one uint32 array, and each text's start (n + 1 offsets)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def limit_batches(spark: SparkSession) -> None:
    """From here on the session passes rows to Python workers in batches of at most about ``BATCH_BYTES``.

    Both sides of the pipe hold whole batches, and 10,000 texts take tens of MB on each. A row goes
    whole whatever its size; a lower limit that the session has already stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def held(key: str | None, build=None):
    """What ``build`` made for ``key``, kept in the worker for its next tasks; what it has for other keys goes."""
    own = sys.modules.setdefault("meridia_held", types.ModuleType("meridia_held")).__dict__.setdefault("held", {})
    for other in own.keys() - {key}:
        del own[other]
    if build is not None and key not in own:
        own[key] = build()
    return own.get(key)


def text_chunks(batches, column: str = "text", limit: int = 4_000_000, keep: str | None = None):
    """(batch slice, list of texts) pairs of at most about ``limit`` characters; null is empty.

    Only the texts of one chunk are Python strings at a time. What the worker holds for tasks of
    other operators, under keys other than ``keep``, goes first. At the end of a task the worker's
    free memory goes back to the system, as the worker stays for other operators' tasks.
    """
    held(keep)
    for batch in batches:
        cells = batch.column(batch.schema.get_field_index(column))
        start, size, texts = 0, 0, []
        for i in range(0, len(cells), 64):
            for t in cells.slice(i, 64).to_pylist():
                t = t or ""
                if size and size + len(t) > limit:
                    yield batch.slice(start, len(texts)), texts
                    start, size, texts = start + len(texts), 0, []
                texts.append(t)
                size += len(t)
        if texts:
            yield batch.slice(start), texts
    release()


def release() -> None:
    """Give free memory of this process back to the system where its C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # no such function here


def maybe_in(df: DataFrame, key: str, wanted: DataFrame, bits: int = 20) -> DataFrame:
    """``df`` without most rows whose ``key`` isn't among ``wanted``'s: a map of 2 ** bits bits goes with the
    scan, so that the join that follows shuffles little. Where keys fill the map, it lets all rows pass."""
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    at = (place + 1).cast("long")
    rows = wanted.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect()  # 2 ** bits / 32768 rows
    marks = np.zeros((max(1, (1 << bits) >> 15), 4096), np.uint8)
    for r in rows:
        marks[r["b"] - 1] = np.frombuffer(r["m"], np.uint8)
    byte = F.substring(F.lit(bytearray(marks.tobytes())), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), ((place % 8) + 1).cast("int"))
    return df.where(F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(bit) != 0)


def sql_unit(column):
    """A uniform number in [0, 1) from the SHA-256 of a value's text; DuckDB can repeat it."""
    return F.conv(F.substring(F.sha2(column.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
