import random
import re
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest
from hypothesis import given, strategies as st

from meridia.llm import quality


def brute_repeated(words):
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words(words):
    assert quality.repeated_words(words) == brute_repeated(words)


def test_base_counts():
    assert quality.base_counts("a b c a b c\n\nx $\nx $\n \na b c") == (12, 14, 2, 1, 6)
    assert quality.base_counts("") == (0, 0, 0, 0, 0)


def brute_model(texts, order, alphabet):
    """Interpolated modified Kneser-Ney, one language, written out plainly."""
    counts = {order: Counter()}
    for t in texts:
        s = [0] * (order - 1) + quality.fold(np.array([ord(c) for c in t], np.uint32), alphabet).tolist()
        counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables, cuts = {}, {}
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        y = n[1] / max(n[1] + 2 * n[2], 1)
        cuts[k] = [max(0.1 * i, min(i - (i + 1) * y * n[i + 1] / max(n[i], 1), 0.9 * i)) for i in (1, 2, 3)]
        by = defaultdict(dict)
        for g, c in counts[k].items():
            by[g[:-1]][g[-1]] = c
        tables[k] = by

    def p(g, k):
        if k == 0:
            return 1 / (len(tables[1][()]) + 1)
        low = p(g[1:], k - 1)
        own = tables[k].get(g[:-1])
        if own is None:
            return low
        cut = lambda c: cuts[k][min(c, 3) - 1]
        total = sum(own.values())
        c = own.get(g[-1], 0)
        return ((c - cut(c)) if c else 0) / total + sum(map(cut, own.values())) / total * low

    return p


def test_model_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab c.é") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    alphabet = quality.alphabets(docs)["en"]
    tables = quality.model_tables(quality.count_grams(docs, {"en": alphabet}))
    model = quality.Model.collect(tables)
    p = brute_model(texts, quality.ORDER, alphabet)
    for t in ("abc a é", "zz ab", texts[0]):
        g, _ = quality.grams([t], alphabet)
        s = [0] * (quality.ORDER - 1) + quality.fold(np.array([ord(c) for c in t], np.uint32), alphabet).tolist()
        want = [log(p(tuple(s[i : i + quality.ORDER]), quality.ORDER)) for i in range(len(t))]
        assert (model.log_probabilities("en", g) / quality.UNIT).tolist() == pytest.approx(want, abs=1e-4)


def test_alphabets_tell_all_scripts_apart(spark, monkeypatch):
    texts = ["漢字仮名交じり文", "한국어 문장", "ქართული ენა", "plain words", None, ""]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    table = quality.alphabets(docs)["xx"]
    known = sorted({ord(c) for t in texts if t for c in t})
    assert quality.fold(np.array(known, np.uint32), table).tolist() == list(range(1, len(known) + 1))
    assert quality.fold(np.array([0x10FFFF, ord("z")], np.uint32), table).tolist() == [quality.UNKNOWN] * 2
    monkeypatch.setattr(quality, "ALPHABET", 3)
    few = quality.alphabets(docs)["xx"]
    assert (few[few != quality.UNKNOWN]).tolist() == [1, 2, 3] and few[ord(" ")] == 1


def test_both_ways_agree_and_odd_rows(spark, odd, nothing):
    docs = odd.union(odd.withColumn("lang", odd["source"]))
    held = sorted(quality.score(docs).drop("low", "high").collect(), key=str)
    joined = sorted(quality.score(docs, broadcast_entries=0).drop("low", "high").collect(), key=str)
    assert len(held) == docs.count()
    key = lambda r: (str(r.doc_id), r.n_words, r.lang, r.logppl or 0)
    for a, b in zip(sorted(held, key=key), sorted(joined, key=key)):
        assert a.n_words == b.n_words and a.kept == b.kept
        assert (a.logppl is None) == (b.logppl is None) and (a.logppl is None or a.logppl == b.logppl)
    assert all(r.base_failed and not r.kept for r in held if r.n_words == 0)
    assert quality.query(spark, nothing).count() == 0


def test_bands_reject_junk_and_keep_prose(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality.query(spark, documents).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert np.mean(good) > 0.97
    words = re.compile(r"[^\x20\x09-\x0D]+")
    for d, r in zip(documents.orderBy("doc_id").collect(), quality.query(spark, documents).orderBy("doc_id").collect()):
        assert r.n_words == len(words.findall(d.text or "")) and r.n_repeat_words == brute_repeated(words.findall(d.text or ""))
