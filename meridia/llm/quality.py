"""Quality rules: plain counts, and an n-gram perplexity model with language-specific bands.

The model is an interpolated modified Kneser-Ney model of characters, one per language.
Spark counts every n-gram of every text: tasks count their own n-grams, a shuffle adds
them up by n-gram, and the lower orders' continuation counts, the discounts and the
probabilities are DataFrame queries over those tables. The result is stored as arrays of
hashes in order: an n-gram packs into 60 bits. A language's alphabet is its ``ALPHABET`` most
used characters, counted over all texts; its rarer ones are one unknown symbol, as are
those that another language's texts bring.

Scoring: while the model has at most ``BROADCAST_ENTRIES`` entries (96 MB), tasks hold the
arrays and look n-grams up by binary search; a larger model stays distributed, and texts'
n-gram counts are joined with it instead. Log-probabilities are stored in units of
2 ** -20 and added as whole numbers, so both ways give the same scores to the last bit.

A text's score is its log-perplexity a letter: the negated log-probability of all its
characters over the number of its letters, so that symbols cost and earn nothing. For each
language, the band around the median reaches ``BAND_LOW`` times the distance from the lower
quartile downwards and ``BAND_HIGH`` times that from the upper quartile upwards (of the
texts that pass the plain rules; ``LEAST_SPREAD`` at least); texts outside are rejected.

Edge cases: null or empty texts have no words (``base_failed``); a null language counts as
one language of its own; ``lang`` alone decides which model scores a text; repeated rows
count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meridia.llm.common import code_points, limit_batches, materialise, small, text_chunks

ORDER = 5
BITS = 12
ALPHABET = 4094  # of a language's alphabet; symbol 0 stands before a text, the last one is unknown
UNKNOWN = ALPHABET + 1
UNIT = 1 << 20  # of a stored log-probability of 1
BROADCAST_ENTRIES = 6_000_000
CHUNK = 250_000  # characters that a task works on at a time
TASK_ENTRIES = 3_000_000  # distinct n-grams a task holds before it passes them on
BAND_LOW, BAND_HIGH = 8.0, 6.0
LEAST_SPREAD = 0.02
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


# -- plain counts ---------------------------------------------------------------------


def repeated_words(words: list[str]) -> int:
    """Words in three-word windows that are found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    n, covered_to = 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            n += i + 3 - max(i, covered_to)
            covered_to = i + 3
    return n


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(words, their characters, symbols, repeated lines, repeated words)."""
    words = WORD.findall(text)
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        full = [x for x in lines if WORD.search(x)]
        dup = len(full) - len(set(full))
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), dup, repeated_words(words)


def letters(points: np.ndarray) -> np.ndarray:
    """Which code points count as letters: A-Z, a-z, and those from U+00C0 on but for signs and punctuation."""
    low = points | np.uint32(0x20)
    high = (points >= 0xC0) & (points != 0xD7) & (points != 0xF7) & ~((points >= 0x2000) & (points < 0x3040))
    return ((low >= 0x61) & (low <= 0x7A)) | high


def letter_counts(texts: list[str]) -> np.ndarray:
    points, offsets = code_points(texts)
    total = np.concatenate([[0], np.cumsum(letters(points))])
    return np.maximum(total[offsets[1:]] - total[offsets[:-1]], 1)


# -- alphabets ------------------------------------------------------------------------


def alphabets(docs: DataFrame) -> dict[str, np.ndarray]:
    """For each language, the symbol of each code point up to its alphabet's last (numbers of a symbol at most a language)."""

    def count(batches):
        for batch, texts in text_chunks(batches, limit=CHUNK):
            langs = np.array(batch.column(1).to_pylist(), object)
            points, offsets = code_points(texts)
            for lang in set(langs):
                mine = np.repeat(langs == lang, np.diff(offsets))
                n = np.bincount(points[mine]) if mine.any() else np.zeros(0, np.int64)
                some = np.flatnonzero(n)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(n[some])], ["lang", "point", "n"])

    counted = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang")).mapInArrow(count, "lang string, point int, n long").groupBy("lang", "point").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "point"))  # there are 1.1 million code points
    found: dict[str, list[int]] = {}
    for r in counted.withColumn("k", rank).where(F.col("k") <= ALPHABET).select("lang", "point").collect():
        found.setdefault(r["lang"], []).append(r["point"])
    out = {}
    for lang, points in found.items():
        table = np.full(max(points) + 1, UNKNOWN, np.uint16)
        table[sorted(points)] = np.arange(1, len(points) + 1)
        out[lang] = table
    return out


def fold(points: np.ndarray, alphabet: np.ndarray | None) -> np.ndarray:
    """Code points as symbols of an alphabet."""
    if alphabet is None:
        return np.full(len(points), UNKNOWN, np.uint64)
    out = alphabet[np.minimum(points, len(alphabet) - 1)].astype(np.uint64)
    out[points >= len(alphabet)] = UNKNOWN
    return out


# -- n-grams --------------------------------------------------------------------------


def grams(texts: list[str], alphabet: np.ndarray | None, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character (padded before the text), and text offsets."""
    points, offsets = code_points(texts)
    out = fold(points, alphabet)
    symbols, at = out.copy(), np.arange(len(points)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order):
        before = np.zeros_like(symbols)
        before[k:] = symbols[:-k]
        before[at < k] = 0
        out |= before << np.uint64(BITS * k)
    return out, offsets


def count_grams(docs: DataFrame, tables: dict[str, np.ndarray]) -> DataFrame:
    """(lang, gram, n): how often each n-gram of the highest order occurs; nothing is left out."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)  # up to ALPHABET entries a language

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            counts = np.concatenate([c for _, c in parts])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[at], np.add.reduceat(counts, at)

        def flush():
            for lang, parts in held.items():
                keys, counts = merged(parts)
                for i in range(0, len(keys), 100_000):
                    k = keys[i : i + 100_000].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(counts[i : i + 100_000])], ["lang", "gram", "n"])
            held.clear()

        for batch, texts in text_chunks(batches, limit=CHUNK):
            langs = batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang and t]
                if own:
                    keys, counts = np.unique(grams(own, shared.value.get(lang))[0], return_counts=True)
                    parts = held.setdefault(lang, [])
                    parts.append((keys, counts.astype(np.int64)))
                    if len(parts) == 32:
                        held[lang] = [merged(parts)]
            if sum(len(k) for parts in held.values() for k, _ in parts) > TASK_ENTRIES:
                held = {lang: [merged(parts)] for lang, parts in held.items()}
                if sum(len(p[0][0]) for p in held.values()) > TASK_ENTRIES:
                    yield from flush()
        yield from flush()

    mapped = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang")).mapInArrow(run, "lang string, gram long, n long")
    return mapped.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _mask(order: int) -> int:
    return (1 << (BITS * order)) - 1


def model_tables(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, k, gram, logp, logb) of all orders, in whole ``UNIT``s: log-probability of a gram given its context,
    and the log back-off weight of a gram as the context of the next order (0 where it is none).

    Modified Kneser-Ney: counts of the highest order, continuation counts below; three
    discounts an order and language from the counts of counts; the lowest order backs off
    to an even share among the language's symbols and one unknown symbol.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        lower_counts = levels[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels[k] = materialise(lower_counts, f"counts{k}")  # read four times below
    lower, parts = None, []
    for k in range(1, order + 1):
        c = levels[k]
        n = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        d = c.groupBy("lang").agg(*n)
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        between = lambda x, i: F.greatest(F.lit(0.1 * i), F.least(x, F.lit(0.9 * i)))
        d = d.select("lang", *[between(F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0)), i).alias(f"d{i}") for i in (1, 2, 3)])
        # small tables are stored, as each level's plan reads them twice
        c = c.join(F.broadcast(materialise(d, f"discounts{k}")), "lang")  # a row a language
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = c.withColumn("ctx", F.shiftright("gram", BITS)).withColumn("cut", cut)
        context = materialise(c.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"), F.count(F.lit(1)).alias("kinds")), f"contexts{k}")
        c = c.join(context, ["lang", "ctx"])
        if k == 1:
            c = c.withColumn("plow", 1.0 / (F.col("kinds") + 1))
        else:
            c = c.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(_mask(k - 1)))).join(lower, ["lang", "suffix"])
        p = ((F.col("n") - F.col("cut")) + F.col("freed") * F.col("plow")) / F.col("total")
        # a stored level is read by the next one and by the output
        own = materialise(c.select("lang", "gram", p.alias("p")), f"lm{k}")
        back = context.select("lang", F.col("ctx").alias("gram"), F.log(F.col("freed") / F.col("total")).alias("logb"), F.log(F.lit(1.0) / (F.col("kinds") + 1)).alias("even"))
        if k == 1:
            # gram 0 of order 0: its back-off weight; its log-probability is the unknown symbol's share
            parts.append(back.select("lang", F.lit(0).alias("k"), F.lit(0).cast("long").alias("gram"), F.col("even").alias("logp"), "logb"))
        else:
            parts.append(back.select("lang", F.lit(k - 1).alias("k"), "gram", F.lit(None).cast("double").alias("logp"), "logb"))
        parts.append(own.select("lang", F.lit(k).alias("k"), "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("logb")))
        lower = own.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("plow"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    whole = lambda c: F.round(F.max(c) * UNIT).cast("long")
    return out.groupBy("lang", "k", "gram").agg(whole("logp").alias("logp"), F.coalesce(whole("logb"), F.lit(0)).alias("logb"))


class Model:
    """Sorted hash arrays: (keys, log-probabilities, back-off weights) by language and order."""

    def __init__(self, arrays: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]], order: int = ORDER):
        self.arrays, self.order = arrays, order

    @classmethod
    def collect(cls, tables: DataFrame, orders: int = ORDER) -> Model:
        """To the driver, packed by tasks to 16 bytes an entry; callers have checked the number of entries."""

        def pack(batches):
            for b in batches:
                lang, k = b.column(0).to_pylist(), b.column(1).to_numpy()
                gram = b.column(2).to_numpy()
                logp, logb = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype("<i4") for c in (3, 4))  # no text has a gram without logp
                of = np.array(lang, object)
                for x in set(lang):
                    for o in set(k[of == x].tolist()):
                        at = np.flatnonzero((of == x) & (k == o))
                        cells = [gram[at].astype("<u8").tobytes(), logp[at].tobytes(), logb[at].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([o], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["lang", "k", "gram", "logp", "logb"])

        parts: dict[tuple[str, int], list] = {}
        for r in tables.select("lang", "k", "gram", "logp", "logb").mapInArrow(pack, "lang string, k int, gram binary, logp binary, logb binary").toLocalIterator():
            parts.setdefault((r["lang"], r["k"]), []).append((r["gram"], r["logp"], r["logb"]))
        arrays = {}
        for key in list(parts):
            cells = list(zip(*parts.pop(key)))
            gram = np.frombuffer(b"".join(cells[0]), "<u8")
            order = np.argsort(gram)
            arrays[key] = gram[order], *(np.frombuffer(b"".join(c), "<i4")[order] for c in cells[1:])
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        return cls({(x, o): arrays.get((x, o), none) for x in {x for x, _ in arrays} for o in range(orders + 1)}, orders)

    def _find(self, lang: str, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.arrays[lang, k][0]
        i = np.searchsorted(own, keys)
        if not len(own):
            return i, np.zeros(len(keys), bool)
        i[i == len(own)] = 0
        return i, own[i] == keys

    def log_probabilities(self, lang: str, g: np.ndarray) -> np.ndarray:
        """Of each n-gram's last symbol given the others, in whole units."""
        out = np.zeros(len(g), np.int64)
        rest = np.arange(len(g))
        for k in range(self.order, 0, -1):
            keys = g[rest] & np.uint64(_mask(k))
            i, hit = self._find(lang, k, keys)
            out[rest[hit]] += self.arrays[lang, k][1][i[hit]]
            rest, keys = rest[~hit], keys[~hit]
            if not len(rest):
                return out
            i, hit = self._find(lang, k - 1, keys >> np.uint64(BITS))
            out[rest[hit]] += self.arrays[lang, k - 1][2][i[hit]]
        out[rest] += self.arrays[lang, 0][1][0]
        return out


def score_held(docs: DataFrame, model: Model, tables: dict[str, np.ndarray]) -> DataFrame:
    """Base counts and log-perplexity with the model held by every task; the rows are stored, then the model goes."""
    shared = docs.sparkSession.sparkContext.broadcast((model.arrays, tables))
    order = model.order

    def run(batches):
        arrays, folds = shared.value
        m = Model(arrays, order)
        for batch, texts in text_chunks(batches, limit=CHUNK):
            langs = batch.column(2).to_pylist()
            logppl: list[float | None] = [None] * len(texts)
            for lang in set(langs):
                at = [i for i, x in enumerate(langs) if x == lang and texts[i]]
                if at:
                    own = [texts[i] for i in at]
                    g, offsets = grams(own, folds.get(lang))
                    sums = np.add.reduceat(m.log_probabilities(lang, g), offsets[:-1])
                    for i, v in zip(at, -sums / UNIT / letter_counts(own)):
                        logppl[i] = float(v)
            counts = list(zip(*map(base_counts, texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(langs), pa.array(logppl, pa.float64())], [x.split()[0] for x in BASE.split(", ")] + ["lang", "logppl"])

    out = materialise(_inputs(docs).mapInArrow(run, BASE + ", lang string, logppl double"), "scored")
    shared.destroy()
    return out


def score_joined(docs: DataFrame, tables: DataFrame, folds: dict[str, np.ndarray], order: int = ORDER) -> DataFrame:
    """The same with the model left distributed: the corpus' distinct n-grams are scored by joins,
    order by order, then each text's n-gram counts are joined with the scores."""

    def base(batches):
        for batch, texts in text_chunks(batches):
            counts = list(zip(*map(base_counts, texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), batch.column(2), batch.column(3), pa.array(letter_counts(texts))], [x.split()[0] for x in BASE.split(", ")] + ["lang", "row", "letters"])

    shared = docs.sparkSession.sparkContext.broadcast(folds)

    def own_grams(batches):
        for batch, texts in text_chunks(batches, limit=500_000):
            langs = np.array(batch.column(2).to_pylist(), object)
            rows = batch.column(3).to_numpy()
            for lang in set(langs):
                at = np.flatnonzero(langs == lang)
                g, offsets = grams([texts[i] for i in at], shared.value.get(lang))
                row = np.repeat(rows[at], np.diff(offsets))
                order = np.lexsort((g, row))
                g, row = g[order], row[order]
                new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (row[1:] != row[:-1]))) if len(g) else np.zeros(0, np.int64)
                counts = np.diff(np.append(new, len(g)))
                yield pa.RecordBatch.from_arrays([pa.array(row[new]), pa.array([lang] * len(new), pa.string()), pa.array(g[new].astype(np.int64)), pa.array(counts)], ["row", "lang", "gram", "n"])

    numbered = materialise(_inputs(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    texts_grams = materialise(numbered.mapInArrow(own_grams, "row long, lang string, gram long, n long"), "grams")
    todo = texts_grams.select("lang", "gram").distinct().withColumn("sum", F.lit(0).cast("long"))
    done = None
    for k in range(order, 0, -1):
        p = tables.where(F.col("k") == k).select("lang", F.col("gram").alias("key"), "logp")
        b = tables.where(F.col("k") == k - 1).select("lang", F.col("gram").alias("ctx"), "logb")
        tried = todo.withColumn("key", F.col("gram").bitwiseAND(F.lit(_mask(k)))).join(p, ["lang", "key"], "left")
        hit = tried.where("logp is not null").select("lang", "gram", (F.col("sum") + F.col("logp")).alias("sum"))
        done = hit if done is None else done.unionByName(hit)
        missed = tried.where("logp is null").withColumn("ctx", F.shiftright("key", BITS)).join(b, ["lang", "ctx"], "left")
        todo = missed.select("lang", "gram", (F.col("sum") + F.coalesce("logb", F.lit(0))).alias("sum"))
    unknown = tables.where("k = 0").select("lang", "logp")
    done = done.unionByName(todo.join(F.broadcast(unknown), "lang").select("lang", "gram", (F.col("sum") + F.col("logp")).alias("sum")))
    score = texts_grams.join(done, ["lang", "gram"]).groupBy("row").agg((-F.sum(F.col("sum") * F.col("n"))).alias("total"))
    based = numbered.mapInArrow(base, BASE + ", lang string, row long, letters long")
    return based.join(score, "row", "left").withColumn("logppl", F.col("total") / F.lit(UNIT) / F.col("letters")).drop("row", "letters", "total")


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang"))


def bands(scored: DataFrame) -> DataFrame:
    """(lang, low, high), a row a language, from all texts that pass the plain rules."""
    # rounding bounds the number of distinct values that exact percentiles keep
    counted = scored.where(~F.col("base_failed") & F.col("logppl").isNotNull()).groupBy("lang", F.round("logppl", 4).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    q = counted.groupBy("lang").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"))
    spread = lambda i, j: F.greatest(F.col("q")[j] - F.col("q")[i], F.lit(LEAST_SPREAD))
    return q.select("lang", (F.col("q")[1] - BAND_LOW * spread(0, 1)).alias("low"), (F.col("q")[1] + BAND_HIGH * spread(1, 2)).alias("high"))


def score(docs: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Base columns, lang, logppl, base_failed, low, high and kept; one row per input row."""
    limit_batches(docs.sparkSession)
    folds = alphabets(docs)
    tables = materialise(model_tables(materialise(count_grams(docs, folds), "counts")), "model")
    if tables.count() <= broadcast_entries:
        scored = score_held(docs, Model.collect(tables), folds)
    else:
        scored = materialise(score_joined(docs, tables, folds), "scored")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    within = F.col("logppl").between(F.col("low"), F.col("high"))
    return scored.join(F.broadcast(bands(scored)), "lang", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return score(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "logppl", "low", "high")


def stage(docs: DataFrame) -> DataFrame:
    """``docs`` without those that the rules reject. Rows with one doc_id stay if any of them is good."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    good = score(docs).groupBy(key.alias("_id")).agg(F.max("kept").alias("_kept"))
    bad = small(materialise(good.where(~F.col("_kept")).select("_id"), "rejected"))
    return docs.join(bad, F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))) == bad["_id"], "left_anti")
