"""Best-fit-decreasing packing of token pieces into sequences.

The order of best-fit decreasing depends only on the multiset of piece lengths, and a
length is at most ``capacity``. So the corpus is reduced to a histogram of at most
``capacity`` rows, the packing is decided once over that histogram (runs of equal pieces
fill runs of equal bins; a segment tree over remaining capacities finds the tightest open
bin), and each piece then finds its place from its rank among pieces of its length. The
outcome is that of best-fit decreasing over all pieces one by one, yet nothing that
grows with the corpus reaches the driver or a single task.

Edge cases: null text is empty and has one token (the end mark); documents with more than
``capacity`` tokens are cut, with the short piece first; repeated rows are packed as
often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meridia.llm.common import held, limit_batches, materialise, text_chunks

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SPECIAL = "<|endoftext|>"
CACHED = 250_000  # words that make a generation of the encoder's cache
MERGED_BYTES = 48  # longer words are left to the tokenizer one by one
GROUP_ROWS = 1_000  # pieces of one length that are ranked together
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Words in the tokenizer's own sense, the commonest kinds first (no other kind can start as they do).
# The patterns say the same with the standard library for ASCII texts, and for texts of the
# characters that UNUSUAL leaves; other texts take the tokenizer.
ASCII_WORDS = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
WORDS = re.compile(r" ?[^\W\d_]+| ?\d+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
UNUSUAL = re.compile("[^\t-\r -~¡-±´-¸º»¿-ɏ‐-‧‰-⁞₠-₿Ͱ-ͳͶͷͻ-ͽΆ-ϿЀ-ҁҊ-ԯ]")


class Merges:
    """The tokenizer's byte pair merges, applied to many words at a time.

    Words of as many ids stand in one matrix. In each row the pair of least rank, the leftmost of
    equals, becomes one id, as in the tokenizer, and the row goes on with one id less; rows
    without a pair that merges are done.
    """

    NONE = np.uint32(0xFFFFFFFF)
    BITS = 18  # of the pairs' table

    def __init__(self, model: dict):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary shows as they are
        names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)}.difference(shown)))}
        vocab = model["vocab"]
        self.first = np.array([vocab[names[b]] for b in range(256)], np.uint32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.result = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        keys = self._keys(*(np.array([vocab[p[i]] for p in pairs], np.uint32) for i in (0, 1)))
        self.table = np.full(1 << self.BITS, self.NONE, np.uint64)  # key and rank; a rank of NONE marks a free slot
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist())):
            while self.table[slot] != self.NONE:
                slot = (slot + 1) % len(self.table)
            self.table[slot] = key << 32 | rank

    @staticmethod
    def fits(spec: dict) -> bool:
        """Whether a tokenizer file says nothing that these merges don't do."""
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        bytewise = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        return model["type"] == "BPE" and plain and bytewise and not spec["normalizer"] and len(model["vocab"]) < 1 << 16 and len(model["merges"]) < 1 << Merges.BITS - 1

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left << np.uint32(16) | right

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS)

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours in a row, or NONE."""
        keys = self._keys(ids[:, :-1], ids[:, 1:]).ravel()
        slots = self._slots(keys)
        found = self.table[slots]
        ranks = found.astype(np.uint32)  # the lower half
        other = np.flatnonzero(((found >> np.uint64(32)).astype(np.uint32) != keys) & (ranks != self.NONE))
        while other.size:  # another pair has the slot: on to the next
            slots[other] = (slots[other] + np.uint32(1)) & np.uint32(len(self.table) - 1)
            found = self.table[slots[other]]
            ranks[other] = found
            other = other[((found >> np.uint64(32)).astype(np.uint32) != keys[other]) & (ranks[other] != self.NONE)]
        return ranks.reshape(len(ids), ids.shape[1] - 1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts, data = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(words), np.uint8)
        out = [b""] * len(words)
        ids, who = np.zeros((0, 0), np.uint32), np.zeros(0, np.int64)
        for n in range(int(lengths.max(initial=0)), 0, -1):
            fresh = np.flatnonzero(lengths == n)
            ids = np.concatenate([ids.reshape(-1, n), self.first[data[starts[fresh, None] + np.arange(n)]]])
            who = np.concatenate([who, fresh])
            ranks = self.ranks(ids) if n > 1 else np.full((len(ids), 1), self.NONE)
            at = ranks.argmin(1)
            least = ranks[np.arange(len(ids)), at]
            done = least == self.NONE
            ended = ids[done].astype("<u4").tobytes()
            for k, i in enumerate(who[done].tolist()):
                out[i] = ended[4 * n * k : 4 * n * (k + 1)]
            ids, who, at, rows = ids[~done], who[~done], at[~done], np.arange(len(ids) - int(done.sum()))
            ids[rows, at] = self.result[least[~done]]
            left = np.ones(ids.shape, bool)
            left[rows, at + 1] = False
            ids = ids[left]
        return out


class Encoder:
    """Token ids as little-endian uint32 bytes, with a cache of words in two generations.

    Byte-level BPE never merges across words, so a text's ids are its words' ids in turn. When
    the younger generation has ``cached`` words it becomes the elder and the elder goes; words
    in use move over, so common words stay and memory is bounded.
    """

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.tokenizer, self.cached, self.young, self.elder = Tokenizer.from_file(path), cached, {}, {}
        spec = json.loads(self.tokenizer.to_str())
        self.merges = Merges(spec["model"]) if Merges.fits(spec) else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word."""
        raw = {w: b for w in words if len(b := w.encode()) <= MERGED_BYTES} if self.merges else {}
        out = dict(zip(raw, self.merges.encode(list(raw.values())))) if raw else {}
        rest = [w for w in words if w not in raw]
        out.update((w, array("I", e.ids).tobytes()) for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Words new to the cache are encoded together first."""
        plain = [SPECIAL not in t and (t.isascii() or not UNUSUAL.search(t)) for t in texts]
        words = [(ASCII_WORDS if t.isascii() else WORDS).findall(t) if p else () for t, p in zip(texts, plain)]
        if len(self.young) > self.cached:
            self.young, self.elder = {}, self.young
        cache, elder = self.young, self.elder
        new = set().union(*words).difference(cache)
        known = new & elder.keys()
        cache.update((w, elder[w]) for w in known)
        cache.update(self.words(list(new - known)))
        return [b"".join(map(cache.__getitem__, w)) if p else self.whole(t) for t, w, p in zip(texts, words, plain)]


def encoder(path: str) -> Encoder:
    """The process' encoder for a tokenizer file; tasks that a worker runs one after another share its words."""
    return held(path, lambda: Encoder(path))


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: its document, number, start, length and CRC-32 of its ids."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    limit_batches(docs.sparkSession)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        own = encoder(path)
        for batch, texts in text_chunks(batches, limit=1_000_000, keep=path):
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode(texts)):
                ids = ids + END_ID.to_bytes(4, "little")
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = (n % capacity or capacity) if k == 0 else capacity
                    out.append((doc, k, at, size, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, PIECES)


class CapacityTree:
    """A segment tree over remaining capacities: how many open bins have each, and the least capacity of at least x."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.tree[i] += n
            i //= 2

    def tightest(self, least: int) -> int:
        """The least remaining capacity >= ``least`` that an open bin has, or -1."""
        i = self.leaves + least
        if self.tree[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i + (0 if self.tree[2 * i] else 1)
                return i - self.leaves
            i //= 2
        return -1


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over (length -> count): runs (length, first rank, pieces a bin, first bin, offset in it)."""
    tree, open_bins, bins, runs = CapacityTree(capacity), {}, 0, []

    def put_back(left: int, first: int, n: int) -> None:
        if left and n:
            open_bins.setdefault(left, []).append((first, n))
            tree.add(left, n)

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            room = tree.tightest(length)
            if room < 0:
                room = capacity
                each = room // length
                first, n = bins, -(-(count - rank) // each)
                bins += n
            else:
                each = room // length
                first, n = open_bins[room].pop()
                tree.add(room, -n)
            full = min(n, (count - rank) // each)
            rest = min(count - rank - full * each, each) if full < n else 0
            runs.append((length, rank, each, first, capacity - room))
            rank += full * each + rest
            put_back(room - each * length, first, full)
            used = full + (rest > 0)
            if rest:
                put_back(room - rest * length, first + full, 1)
            put_back(room, first + used, n - used)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` must be a stored table (it is read three times)."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = plan_bins(counts, capacity)
    table = np.array(runs, np.int64).reshape(-1, 5)
    top = max(counts.values(), default=0) + 1
    keys = table[:, 0] * top + table[:, 1]
    order = np.argsort(keys, kind="stable")
    keys, table = keys[order], table[order]

    # each length has as many groups as it needs, so a length with a third of all pieces is spread like the rest
    shares = pieces.sparkSession.createDataFrame([(k, -(-n // group_rows)) for k, n in counts.items()], "length long, _groups long")
    salted = pieces.join(F.broadcast(shares), "length")  # at most `capacity` rows are broadcast
    salted = salted.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_groups")).cast("int")).drop("_groups")
    sizes = salted.groupBy("length", "_g").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_g").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    placed = ranked.join(before, ["length", "_g"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    def place(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False), np.int64) for c in ("length", "_rank"))
            run = table[np.searchsorted(keys, length * top + rank, side="right") - 1]
            k = rank - run[:, 1]
            arrays = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(run[:, 3] + k // run[:, 2]), pa.array(run[:, 4] + k % run[:, 2] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_rank").cast("long").alias("_rank")).mapInArrow(place, PIECES + ", sequence_id long, offset long")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(materialise(pieces_of(docs), "pieces"))
