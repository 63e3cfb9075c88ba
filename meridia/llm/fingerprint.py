"""Document fingerprints by locally consistent parsing.

A text is parsed in levels. At each level, runs of one symbol become one symbol, then
deterministic coin tossing labels every symbol from itself and its left neighbour (twice
the lowest differing bit, plus that bit), repeated until labels are below six; symbols
whose label is a local maximum start phrases, and a phrase's name is a hash of its
symbols. Names of one level are the symbols of the next. A boundary depends on a few
neighbours only, so equal substrings share their interior phrases wherever they stand.

The fingerprint keeps, in each of ``BINS`` classes, the least hash of the names of levels
two and up, or the name of a text that is one phrase at level one (one-permutation
min-hash), as four hex digits, ``ffff`` where a class has no
name. The likeness of two fingerprints is the share of equal entries among classes that
either fills; it estimates the Jaccard likeness of the two name sets.

Edge cases: null and empty texts have the all-``ffff`` fingerprint and likeness 1 with one
another; a single document is its own next document; documents are ordered by doc_id
descending (null ids last), ties by text; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meridia.llm.common import MULT, code_points, mix64, shuffle_partitions

BINS = 64
EMPTY = 0xFFFF
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_POWERS = np.cumprod(np.full(512, MULT, np.uint64), dtype=np.uint64)


def _coin_table(size: int) -> np.ndarray:
    """label(left, own) for small labels."""
    left, own = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    differing = left ^ own
    low = np.zeros_like(differing)
    for bit in range(size.bit_length(), -1, -1):
        low = np.where(differing >> bit & 1, bit, low)
    return (2 * low + (own >> low & 1)).astype(np.uint8).ravel()


_ROUNDS = [(64, _coin_table(128), 128), (16, _coin_table(16), 16), (8, _coin_table(8), 8)]


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six; equal neighbours never occur within a text. ``first`` marks a text's first symbol."""
    differing = np.empty_like(symbols)
    differing[1:] = symbols[1:] ^ symbols[:-1]
    differing[:1] = 1
    differing[first] = symbols[first] | np.uint64(1 << 62)  # as if an unlike symbol stood before
    low = (differing & (~differing + np.uint64(1))).astype(np.float64).view(np.int64)
    low = ((low >> 52) - 1023).astype(np.uint64)
    label = (2 * low + (symbols >> low & np.uint64(1))).astype(np.uint8)
    for _, coins, size in _ROUNDS:
        key = label.astype(np.int32)
        key[1:] += label[:-1].astype(np.int32) * size
        key[first] = label[first]  # left label 0
        label = coins[key]
    return label


def parse_level(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of one level and the text each belongs to."""
    new_run = np.empty(len(symbols), bool)
    new_run[:1] = True
    new_run[1:] = (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new_run)
    runs = np.diff(np.append(at, len(symbols)))
    symbols, owner = symbols[at], owner[at]
    long_runs = runs > 1
    symbols = symbols.copy()
    symbols[long_runs] = mix64(symbols[long_runs] + runs[long_runs].astype(np.uint64) * MULT)
    first = np.empty(len(symbols), bool)
    first[:1] = True
    first[1:] = owner[1:] != owner[:-1]
    label = _labels(symbols, first)
    start = first.copy()
    if len(symbols) > 2:
        start[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:]) & ~first[2:]
    begins = np.flatnonzero(start)
    lengths = np.diff(np.append(begins, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(begins, lengths)
    terms = (symbols + np.uint64(1)) * _POWERS[place % len(_POWERS)]
    return mix64(np.add.reduceat(terms, begins) ^ lengths.astype(np.uint64)), owner[begins]


def sketches(texts: list[str]) -> np.ndarray:
    """A (texts, BINS) uint16 array of fingerprints."""
    points, offsets = code_points(texts)
    out = np.full((len(texts), BINS), EMPTY, np.uint16)
    if not len(points):
        return out
    least = np.full(len(texts) * BINS, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    symbols = points.astype(np.uint64)
    level = 0
    while len(symbols):  # a level has fewer symbols than the one before; the last phrase of a text leaves
        level += 1
        symbols, owner = parse_level(symbols, owner)
        more = np.bincount(owner, minlength=len(texts)) > 1  # a text that is one phrase is done
        going_on = more[owner]
        named = ~going_on if level == 1 else slice(None)  # at level one, of texts that have no higher level
        np.minimum.at(least, owner[named] * BINS + (symbols[named] >> np.uint64(58)).astype(np.int64), symbols[named] & np.uint64((1 << 58) - 1))
        symbols, owner = symbols[going_on], owner[going_on]
    kept = least != np.iinfo(np.uint64).max
    out.reshape(-1)[kept] = (mix64(least[kept]) % np.uint64(EMPTY)).astype(np.uint16)
    return out


def to_text(sketch: np.ndarray) -> list[str]:
    hexed = sketch.astype(">u2").tobytes().hex()
    width = BINS * 4
    return [hexed[i : i + width] for i in range(0, len(hexed), width)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    either = ((a != EMPTY) | (b != EMPTY)).sum(1)
    equal = ((a == b) & (a != EMPTY)).sum(1)
    return np.where(either == 0, 1.0, equal / np.maximum(either, 1))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint) of each row; no shuffle."""

    def run(batches):
        for b in batches:
            out = to_text(sketches([t or "" for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (p, carried, key, doc_id, text): ranges of doc_id, each followed by the row that comes after its last.

    The text is shuffled once. Ranges are cut at quantiles; only two numbers a range reach
    the driver.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    share = [i / n for i in range(1, n)] or [0.5]
    cuts = keyed.agg(F.percentile_approx("key", share, max(10_000, 20 * n)).alias("c")).first()["c"] or []
    cuts = np.unique(np.array(cuts, np.int64))
    last = len(cuts)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:  # descending, so range 0 has the largest ids
        return pd.Series(last - np.searchsorted(cuts, key.to_numpy(np.int64), side="left"), dtype="int32")

    ranged = keyed.withColumn("own", range_of("key"))
    tops = sorted((r["own"], r["top"]) for r in keyed.select("key").withColumn("own", range_of("key")).groupBy("own").agg(F.max("key").alias("top")).collect())
    # the first row of each range also goes to the range before it (of the first, to the last)
    to = {tops[i][1]: tops[i - 1][0] for i in range(len(tops))}
    top_keys = np.array(sorted(to), np.int64)
    targets = np.array([to[k] for k in sorted(to)], np.int32)

    @F.pandas_udf("int")
    def carried_to(key: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        i = np.searchsorted(top_keys, k)
        hit = (i < len(top_keys)) & (top_keys[np.minimum(i, len(top_keys) - 1)] == k)
        return pd.Series(np.where(hit, targets[np.minimum(i, len(targets) - 1)], -1), dtype="int32")

    places = F.filter(F.array(F.struct(F.col("own").alias("p"), F.lit(False).alias("carried")), F.struct(F.col("to").alias("p"), F.lit(True).alias("carried"))), lambda x: x["p"] >= 0)
    rows = ranged.withColumn("to", carried_to("key")).select("key", "doc_id", "text", F.explode(places).alias("at")).select("at.p", "at.carried", "key", "doc_id", "text")
    return rows, last + 1


def _next_pairs(rows):
    """(doc_id, text, next text) from rows sorted by range; each range ends with the row carried over."""
    held = None
    group, group_done = None, True
    for p, carried, doc, text in rows:
        if p != group:
            group, group_done, held = p, False, None
        if group_done:
            continue  # further rows with the carried row's id
        if held is not None:
            yield (*held, text)
        held = (doc, text)
        if carried:
            group_done = True


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows, n = with_next(docs)
    placed = rows.repartitionById(n, F.col("p")).sortWithinPartitions("p", "carried", F.col("key").desc(), "text")

    def run(batches):
        stream = chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()) for b in batches)
        ids, texts, following, size = [], [], [], 0

        def flush():
            new = [edited(t, f) for t, f in zip(texts, following)]
            known = {t: i for i, t in enumerate(dict.fromkeys(chain(texts, following)))}
            own = sketches(list(known))
            index = lambda xs: own[[known[x] for x in xs]]
            a, nxt, ed = index(texts), index(following), sketches(new)
            sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(sha), pa.array(to_text(a)), pa.array(to_text(ed)), pa.array(likeness(a, ed)), pa.array(likeness(a, nxt))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for doc, text, nxt in _next_pairs(stream):
            ids.append(doc), texts.append(text), following.append(nxt)
            size += len(text)
            if size > 1_500_000:
                yield flush()
                ids, texts, following, size = [], [], [], 0
        if ids:
            yield flush()

    return placed.mapInArrow(run, RESULT)
