"""Greedy sequential decisions in one walk over sorted rows.

Whether a row is taken depends on the last one taken, so a key's candidates are walked in
order. Keys are spread over tasks; a task holds the last decision of one key and nothing
else, so a long history costs time in proportion and no memory. Candidates are windows of
a symbol: there is at most one a window, however many trades a busy symbol has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def _walk(rows: DataFrame, keys: list[str], at: str, busy_until: Column, strict: bool, out: str) -> DataFrame:
    """``rows`` with ``out``: those taken greedily of each key by ``at``.

    A taken row blocks until its ``busy_until``; the next one starts there at the earliest, or with ``strict`` after it.
    """
    key = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"}) if keys else F.lit("")
    ready = rows.withColumns({"_key": key, "_from": F.col(at).cast("long"), "_until": busy_until.cast("long")})
    schema = StructType([*rows.schema.fields, StructField(out, BooleanType())])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = until = None
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            taken = []
            for k, start, end in zip(*(column(c).to_pylist() for c in ("_key", "_from", "_until"))):
                free = k != here or (start > until if strict else start >= until)
                if free:
                    here, until = k, end
                taken.append(free)
            yield pa.RecordBatch.from_arrays([*map(column, names), pa.array(taken, pa.bool_())], [*names, out])

    return ready.repartition("_key").sortWithinPartitions("_key", "_from", "_until").mapInArrow(run, schema)


def greedy_cooldown(candidates: DataFrame, keys: list[str], at: str, cooldown_ns: int | str) -> DataFrame:
    """``candidates`` with ``fires``: false within the cooldown after the last one that fired.

    ``cooldown_ns`` may name a column (the same for all rows of a key).
    """
    cool = F.col(cooldown_ns) if isinstance(cooldown_ns, str) else F.lit(cooldown_ns)
    return _walk(candidates, keys, at, F.col(at) + cool, False, "fires")


def non_overlapping(entries: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Entries taken one after another: one is skipped while ``start`` <= the ``end`` of the last taken."""
    return _walk(entries, keys, start, F.col(end), True, "_taken").where("_taken").drop("_taken")


def first_delivery(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First delivery of each key in ``order``: what a set of recent keys without a bound keeps."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def bounded_fifo_dedup(rows: DataFrame, keys: list[str], partition: str, order: str, capacity: int = 100_000) -> DataFrame:
    """Rows whose key is not among the last ``capacity`` keys let through before them, by ``partition`` in ``order``.

    A partition of the log is walked once by one task, as its consumer would, holding ``capacity`` keys
    and no rows. ``first_delivery`` needs no walk and is the same while no key comes back after so many others.
    """
    capacity = max(capacity, 1)
    ready = rows.withColumn("_key", F.to_json(F.struct(*keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, {}  # a dictionary keeps the order of insertion
        for batch in batches:
            at, kept = batch.schema.get_field_index, []
            for p, k in zip(batch.column(at(partition)).to_pylist(), batch.column(at("_key")).to_pylist()):
                if p != here:
                    here, held = p, {}
                kept.append(k not in held)
                if kept[-1]:
                    if len(held) == capacity:
                        del held[next(iter(held))]
                    held[k] = None
            yield batch.filter(pa.array(kept, pa.bool_())).drop_columns(["_key"])

    return ready.repartition(partition).sortWithinPartitions(partition, order).mapInArrow(run, rows.schema)
