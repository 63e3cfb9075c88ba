import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st

from meridia.llm import fingerprint, packing, sharding

TEXT = st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from("ab 12\n'st.")), max_size=60)


def test_sharding_table_is_even_and_stable():
    owner = sharding.fill_table()
    sizes = Counter(owner)
    assert len(sizes) == 32 and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 31)
    assert moved < 0.15 * len(owner)
    double = Counter(sharding.fill_table(weights={"shard-000": 2}))
    assert 1.9 < double[0] / double[1] < 2.1


def test_sharding_rows(spark, odd, nothing):
    rows = sharding.query(spark, odd).collect()
    assert len(rows) == odd.count() and sharding.query(spark, nothing).count() == 0
    owner = sharding.fill_table()
    for r in rows:
        digest = hashlib.sha256(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()
        assert r.slot == int(digest[:12], 16) % sharding.TABLE_SIZE and r["shard"] == owner[r.slot]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoder_equals_the_tokenizer(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    global _t, _e
    try:
        _t
    except NameError:
        _t, _e = Tokenizer.from_file(path), packing.Encoder(path, cached=50)
    assert np.frombuffer(_e.encode([text, "a"])[0], "<u4").tolist() == _t.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_histogram_packing_equals_best_fit_decreasing(histogram):
    bins: list[int] = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [b for b in range(len(bins)) if bins[b] >= length]
            if fits:
                bins[min(fits, key=lambda b: bins[b])] -= length
            else:
                bins.append(64 - length)
    runs = packing.plan_bins(histogram, 64)
    used = defaultdict(list)
    for (length, rank, each, first, offset), after in zip(runs, [*runs[1:], (0, 0, 0, 0, 0)]):
        end = after[1] if after[0] == length else histogram[length]
        for k in range(end - rank):
            used[first + k // each].append((offset + k % each * length, length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(64 - sum(n for _, n in p) for p in used.values()) == sorted(bins)


def _check_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = packing.query(spark, docs).collect()
    want = Counter()
    for d in docs.collect():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        cut = len(ids) % 2048 or 2048
        for k, (a, b) in enumerate([(0, cut), *((i, i + 2048) for i in range(cut, len(ids), 2048))]):
            want[d.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 2048) * 1.05 + 3


def test_packing_documents(spark, documents):
    _check_packing(spark, documents)


def test_packing_odd_rows(spark, odd, nothing):
    _check_packing(spark, odd)
    assert packing.query(spark, nothing).count() == 0


def _check_fingerprints(spark, docs):
    rows = packing_rows = fingerprint.query(spark, docs).collect()
    order = sorted(docs.collect(), key=lambda d: (d.doc_id is None, -(d.doc_id or 0), d.text or ""))
    want = Counter()
    for i, d in enumerate(order):
        new = fingerprint.edited(d.text or "", order[(i + 1) % len(order)].text or "")
        want[d.doc_id, len(d.text or ""), hashlib.sha256(new.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in packing_rows) == want
    by_text = defaultdict(set)
    texts = {d.doc_id: d.text or "" for d in order}
    for r in rows:
        by_text[texts[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in by_text.values())
    return rows


def test_fingerprints(spark, documents, odd, nothing):
    rows = _check_fingerprints(spark, documents)
    long_rows = [r for r in rows if r.n_chars > 500]
    assert np.mean([r.near_edited > r.near_next for r in long_rows]) > 0.9
    _check_fingerprints(spark, odd)
    assert fingerprint.query(spark, nothing).count() == 0


def test_short_texts_have_names():
    texts = ["", "A.", "Re.", "a", "b", "a" * 2, "a" * 5000, "word"]
    own = fingerprint.sketches(texts)
    assert len({x.tobytes() for x in own}) == len(texts)
    assert (own[0] == fingerprint.EMPTY).all() and (fingerprint.sketches(["Re.", ""])[0] == own[2]).all()
    assert fingerprint.likeness(own[:-1], own[1:]).max() == 0


def test_equal_substrings_share_phrases():
    rng = np.random.default_rng(1)
    core = "".join(rng.choice(list("abcdefgh "), 4000))
    names = []
    for lead in ("", "x" * 7, "some other words 123 "):
        points = np.array([ord(c) for c in lead + core], np.uint64)
        level, owner = fingerprint.parse_level(points, np.zeros(len(points), np.int64))
        level, _ = fingerprint.parse_level(level, owner)
        names.append(set(level.tolist()))
    assert len(names[0] & names[1]) > 0.95 * len(names[0]) and len(names[0] & names[2]) > 0.95 * len(names[0])


def test_words_are_merged_together_as_the_tokenizer_does():
    rng = np.random.default_rng(5)
    letters = list("abcdeinorst éßñαд漢😀.,!019'")
    texts = ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 200, 300)]
    texts += [x * n for x in ("a", "ab", "=", " =-", "0", "é") for n in range(1, 80)]
    own = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    words = list(dict.fromkeys(w for t in texts for w in packing.WORDS.findall(t)))
    tokenizer, asked = own.tokenizer, []

    class Counting:
        def encode_batch_fast(self, batch, **options):
            asked.extend(batch)
            return tokenizer.encode_batch_fast(batch, **options)

    own.tokenizer = Counting()
    got = own.words(words)
    assert got == {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, tokenizer.encode_batch_fast(words, add_special_tokens=False))}
    assert asked and all(len(w.encode()) > packing.MERGED_BYTES for w in asked)  # only long words go to the tokenizer
    own.merges = None
    assert own.words(words) == got and own.words([]) == {}


def test_merges_refuse_other_tokenizers():
    spec = json.loads(packing.Encoder(public_tokenizers.path(packing.TOKENIZER)).tokenizer.to_str())
    assert packing.Merges.fits(spec)
    assert not packing.Merges.fits(spec | {"normalizer": {"type": "Lowercase"}})
    assert not packing.Merges.fits(spec | {"model": spec["model"] | {"ignore_merges": True}})
    assert not packing.Merges.fits(spec | {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}})
