"""Toxicity of documents behind a noisy-channel deobfuscator.

Writers disguise words: digits and signs for letters (leetspeak), signs or spaces between
letters, repeated letters. A suspect token or spaced-out run, however long, spans a lattice
of the letters each character may stand for, with a channel cost for each kind of change; a
sign or space may also part words. The ``READINGS`` likeliest readings under a character
trigram model are found by exact Viterbi search (states: position and last two letters, each
with its best different readings as back-pointers), and their words join the text's. The score is a logistic regression over the words, plain and
restored, that labelled rows associate with toxic texts.

Fitting uses a bounded sample of labelled rows: at most about ``TRAIN_ROWS`` documents,
chosen by a hash of doc_id among those with crc32(doc_id) mod 5 <> 0; repeated texts count
once. The trigrams come from all documents, labelled or not: each task counts a table of
fixed size, which Spark sums. Words are counted by Spark over the sample; the driver gets
those that tell toxic rows apart (``EVIDENCE``), the trigram table and the sampled rows' words. Scoring reads every whole
text and holds nothing that grows with the corpus.

Edge cases: null and empty texts get the intercept's score; a null id is held out (its
crc32 is undefined); without labelled rows every score is the prior 0.25; repeated rows
give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meridia.llm.common import code_points, materialise, table, text_chunks

TRAIN_ROWS = 20_000
EVIDENCE = 6.0  # twice the log-likelihood ratio that a word must have
LEAST_TOXIC = 3
READINGS = 4
CACHED = 40  # characters; readings of longer tokens are not kept

# The letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = "._-*~/\\ '`^,;:#%&="
COST = {"same": 0.0, "leet": -1.0, "skip": -0.7, "repeat": -0.5, "break": -0.7}
LETTERS = re.compile(r"[^\W\d_]+")
EDGE = "\"'.,;:?()[]{}<>*#%&|~-_=/\\"
# A suspect token has signs or digits between letters, before or after them, or a letter three times.
SIGNS = re.escape("".join(c for c in dict.fromkeys([*LEET, *SEPARATORS]) if c != " " and not c.isdigit()))
SUSPECT = re.compile(rf"[^\W\d_][\d{SIGNS}]+[^\W\d_]|^[\d@$!|+(€£¡]+[^\W\d_]|[^\W\d_][$@!|+\d]+$|([^\W\d_])\1\1")
SPACED_HINT = re.compile(r"(?:^|\s)\S \S \S ")
SPACED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
SIZE = 28  # boundary, a-z, any other letter


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def trigram_counts(words) -> np.ndarray:
    """Counts of (two symbols before, symbol) over words, with two boundaries before each and one after."""
    known = Counter(words)
    if not known:
        return np.zeros(SIZE**3, np.int64)
    points, offsets = code_points(["\n\n", *(w + "\n\n" for w in known)])
    symbols = np.where((points >= 97) & (points <= 122), points.astype(np.int64) - 96, np.where(points == 10, 0, 27))
    times = np.repeat(np.fromiter(known.values(), float, len(known)), np.diff(offsets)[1:])
    codes = (symbols[:-2] * SIZE + symbols[1:-1]) * SIZE + symbols[2:]
    times[(symbols[1:-1] == 0) & (symbols[2:] == 0)] = 0  # the second boundary after a word
    return np.bincount(codes, times, SIZE**3).astype(np.int64)


class CharacterModel:
    """Interpolated trigram log-probabilities."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        uni = (c.sum((0, 1)) + 1) / (c.sum() + SIZE)
        pair = c.sum(0)
        bi = (pair + 5 * uni) / (pair.sum(1, keepdims=True) + 5)
        self.logp = np.log((c + 5 * bi[None]) / (c.sum(2, keepdims=True) + 5)).tolist()


class Decoder:
    def __init__(self, model: CharacterModel):
        self.logp = [row for table in model.logp for row in table]  # by the last two symbols
        self._cached = lru_cache(200_000)(self._read)

    def read(self, token: str) -> tuple[str, ...]:
        return self._cached(token) if len(token) <= CACHED else self._read(token)

    def _options(self, token: str, i: int):
        """(letters, cost) that character i may stand for; '' means nothing."""
        c = token[i]
        if c.isalpha():
            yield c, COST["same"]
            if i and token[i - 1] == c:
                yield "", COST["repeat"]
        for x in LEET.get(c, ""):
            yield x, COST["leet"]
        if c in SEPARATORS or c in LEET:
            yield "", COST["skip"] - 0.8 * (c in LEET and c not in SEPARATORS)
        if not c.isalpha() and c not in LEET and c not in SEPARATORS:
            yield "", 2 * COST["skip"]

    def _read(self, token: str) -> tuple[str, ...]:
        """The likeliest readings; words of one reading are parted by spaces."""
        logp = self.logp
        nodes: list[tuple[int, str]] = [(0, "")]  # (node before, letter); equal readings are one node
        known: dict[tuple[int, str], int] = {}
        last = max((i for i, c in enumerate(token) if c not in SEPARATORS), default=0)
        layer = {0: {0: 0.0}}  # state -> node -> score
        for i, c in enumerate(token):
            options = [(x, symbol(x) if x else 0, cost) for x, cost in self._options(token, i)]
            if c in SEPARATORS and i < last:
                options.append((" ", 0, COST["break"]))
            following: dict[int, dict[int, float]] = {}
            for state, readings in layer.items():
                row, b = logp[state], state % SIZE
                for x, s, cost in options:
                    if x == " " and not b:
                        continue  # no empty words
                    to = state if not x else 0 if x == " " else b * SIZE + s
                    into = following.setdefault(to, {})
                    step = cost + row[s] if x else cost
                    for node, p in readings.items():
                        if x:
                            at = known.get((node, x))
                            if at is None:
                                at = known[node, x] = len(nodes)
                                nodes.append((node, x))
                            node = at
                        q = p + step
                        if q > into.get(node, -math.inf):
                            into[node] = q
            layer = {k: r if len(r) <= READINGS else dict(sorted(r.items(), key=lambda t: -t[1])[:READINGS]) for k, r in following.items()}
        ends = sorted(((p + (logp[state][0] if state % SIZE else 0.0), node) for state, r in layer.items() for node, p in r.items() if node), reverse=True)
        return tuple(dict.fromkeys(self._text(nodes, node) for _, node in ends[: 2 * READINGS]))[:READINGS]

    @staticmethod
    def _text(nodes: list[tuple[int, str]], node: int) -> str:
        out = []
        while node:
            node, x = nodes[node]
            out.append(x)
        return "".join(reversed(out)).strip()

    def words(self, text: str) -> set[str]:
        """All words of a text, and the readings of its suspect tokens."""
        text = text.lower()
        found = set(LETTERS.findall(text))
        tokens = [t for t in set(text.split()) if SUSPECT.search(t)]
        if SPACED_HINT.search(text):
            tokens += SPACED.findall(text)
        for t in tokens:
            token = t.strip(EDGE)
            if len(token) >= 3:
                found.update(w for reading in self.read(token) for w in reading.split())
        return found


def _held_out(column):
    return F.coalesce(F.crc32(column.cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic): at most about ``bound`` labelled rows with different texts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~_held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n = known.count()
    kept = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, bound / max(n, 1))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(kept), "doc_id")  # about `bound` rows of two numbers
    return materialise(texts.where(F.length("text") > 0).dropDuplicates(["text"]), "labelled")


def character_model(docs: DataFrame) -> CharacterModel:
    """Trigrams of all texts, each text's different words once."""

    def count(batches):
        total = np.zeros(SIZE**3, np.int64)
        for _, texts in text_chunks(batches):
            total += trigram_counts(chain.from_iterable(set(LETTERS.findall(t.lower())) for t in texts))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["code", "n"])

    total = np.zeros(SIZE**3, np.int64)
    for r in docs.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # SIZE**3 rows at most
        total[r["code"]] = r["n"]
    return CharacterModel(total)


def _word_rows(sample: DataFrame, model: CharacterModel) -> DataFrame:
    def run(batches):
        decoder = Decoder(model)
        for batch, texts in text_chunks(batches, limit=500_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(decoder.words(t)) for t in texts]), batch.column(2)], ["doc_id", "words", "toxic"])

    return sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "doc_id long, words array<string>, toxic int")


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> tuple[CharacterModel, dict[str, float], float]:
    """The character model, word weights and the intercept."""
    sample = labelled_sample(docs, labels, bound)
    model = character_model(docs)
    rows = materialise(_word_rows(sample, model), "words")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, t = int(totals["n"]), int(totals["t"])
    prior = (t + 0.5) / (n + 2)
    bias = float(np.log(prior / (1 - prior)))
    if not 0 < t < n:
        return model, {}, bias
    # log-likelihood ratio of a word's presence against toxicity
    by_word = rows.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("m"))
    a, m = F.col("a").cast("double"), F.col("m").cast("double")
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g = term(a, m * t / n) + term(m - a, m * (n - t) / n)
    chosen = by_word.where((F.col("a") >= min(LEAST_TOXIC, t)) & (a / m > 2 * t / n)).where(2 * g >= EVIDENCE).orderBy("word").collect()  # no more words than the bounded sample has
    number = {r["word"]: i for i, r in enumerate(chosen)}
    if not number:
        return model, {}, bias
    lookup = rows.sparkSession.createDataFrame(list(number.items()), "word string, k int")
    pairs = rows.select("doc_id", "toxic", F.explode("words").alias("word")).join(F.broadcast(lookup), "word").groupBy("doc_id", "toxic").agg(F.collect_list("k").alias("k")).collect()  # the bounded sample's few chosen words
    held = [(r["toxic"], r["k"]) for r in sorted(pairs, key=lambda r: r["doc_id"])]
    bare = Counter({0: n - t, 1: t}) - Counter(toxic for toxic, _ in held)  # rows without a chosen word
    y = np.array([toxic for toxic, _ in held] + [0, 1], float)
    times = np.array([1.0] * len(held) + [bare[0], bare[1]])
    row = np.repeat(np.arange(len(held)), [len(k) for _, k in held])
    column = np.array([i for _, k in held for i in k])
    w, b, speed = np.zeros(len(number)), bias, 4.0
    for _ in range(400):
        z = 1 / (1 + np.exp(-(np.bincount(row, w[column], len(y)) + b)))
        e = times * (z - y) / n
        w -= speed * 10 * (np.bincount(column, e[row], len(w)) + 2e-5 * w)
        b -= speed * e.sum()
    return model, {k: float(w[i]) for k, i in number.items()}, float(b)


def score(docs: DataFrame, model: CharacterModel, weights: dict[str, float], bias: float) -> DataFrame:
    """(doc_id, score) of each row."""

    def run(batches):
        decoder, chosen = Decoder(model), weights.keys()
        for batch, texts in text_chunks(batches, limit=1_000_000):
            sums = [bias + sum(weights[w] for w in decoder.words(t) & chosen) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.array(sums, float))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, *fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
