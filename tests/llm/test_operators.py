import gc
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import html_text, jaccard, linededup, mixing, pii, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- personal data ------------------------------------------------------------------------


def luhn(x):
    total = 0
    for i, c in enumerate(reversed(x)):
        n = int(c)
        total += n if i % 2 == 0 else n * 2 - (9 if n > 4 else 0)
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]


TRICKY = [
    "a@b.c_d@e.f x..y@z.q @a.b a@b a@b. a@-.- é.a@b.co.uk.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.2.3", "4111 1111-1111 1111 4111  1111 1111 1111 0000-0000-0000-0000-1 -4111111111111111-",
    "+1 (017) 555-7713. ++12345678 +1 2345678901234567 +()12345678", "\U0001f600 x@y.zz \U0001f600 1.1.1.1", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "1 " * 9000, "a." * 9000 + "@b" + ".c" * 9000,
]


def test_base_spans_and_odd_rows(spark, documents, odd, nothing):
    extra = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(extra)
    want = Counter()
    for d in docs.collect():
        s = base_spans(d.text or "")
        n = Counter(x.split(":")[0] for x in s)
        want[d.doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(s).encode()).hexdigest()] += 1
    rows = pii.query(spark, docs).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
    for r in rows:
        base = [x for x in r.spans.split(",") if not x.startswith("ctx")]
        assert hashlib.sha256(",".join(filter(None, base)).encode()).hexdigest() == r.base_sha256
    assert pii.query(spark, nothing).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(i, f"words here password = {hashlib.sha1(str(i).encode()).hexdigest()} and more") for i in range(20)]
    unseen = [(100, "then password = k9-zebra-17x was used"), (101, "about 300 people came")]
    rows = {r.doc_id: r.spans for r in pii.query(spark, spark.createDataFrame(seeds + unseen, "doc_id long, text string")).collect()}
    assert rows[100] == "ctx:16:28" and rows[101] == ""
    masked = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(seeds + unseen, "doc_id long, text string")).collect()}
    assert masked[100] == "then password = <ctx> was used" and masked[101] == unseen[1][1]


def test_identifiers_of_several_tokens(spark):
    seeds = [(i, f"my phone number is +1 (017) 555-77{i:02} thank you") for i in range(20)]
    texts = ["my phone number is (555) 123 4567, thank you", "my phone number is GB82 WEST 1234 5698 thank you", "my phone number is 555 - 123 (44) thank you", "items: 300, 400 and 500\n600 more"]
    docs = spark.createDataFrame(seeds + [(100 + i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[100] == "my phone number is <ctx>, thank you"
    assert masked[101] == masked[102] == "my phone number is <ctx> thank you"
    assert masked[103] == texts[3]
    found = pii.candidates(docs.where("doc_id = 103").selectExpr("doc_id AS row", "text")).count()
    assert found == 0  # no run goes over a comma, word or line
    assert pii.candidates(spark.createDataFrame([(1, "1 " * 20_000)], "row long, text string")).select("start", "end").collect() == [(0, 39_999)]


def test_masking_goes_by_row(spark):
    rows = [(1, "write to a.b@example.org now"), (1, "nothing to see here, friend q@rr.ss"), (None, "card 4111 1111 1111 1111"), (None, None), (1, "write to a.b@example.org now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in pii.mask(docs).collect())
    assert got == Counter([(1, "write to <email> now"), (1, "write to <email> now"), (1, "nothing to see here, friend <email>"), (None, "card <card>"), (None, "")])
    counts = pii.query(spark, docs).collect()
    assert len(counts) == 5 and sum(r.n_email for r in counts) == 3 and all(r.n_ctx == r.spans.count("ctx:") for r in counts)


def test_three_certain_instances_are_reliable(spark):
    rows = [(i, i, [7], True) for i in range(pii.MIN_INSTANCES)] + [(i, i, [8], True) for i in range(pii.MIN_INSTANCES - 1)]
    found = spark.createDataFrame(rows, "row long, instance long, patterns array<long>, seed boolean")
    assert [r.pattern for r in pii.reliable_patterns(found).collect()] == [7]


def test_pii_stores_only_what_is_read_again(spark, monkeypatch):
    stored, keep = [], pii.materialise
    monkeypatch.setattr(pii, "materialise", lambda df, what: stored.append(what) or keep(df, what))
    docs = spark.createDataFrame([(i, f"your badge number is X{i}Y-77 and key {i:032x} now") for i in range(5)], "doc_id long, text string")
    assert pii.query(spark, docs).count() == 5
    assert Counter(stored) == Counter(["rows", "base", "seeded", "edges", "graph", *["instances"] * (pii.ROUNDS - 1), "reliable", "more"])


# -- near duplicates -----------------------------------------------------------------------


def brute_components(rows):
    sets = defaultdict(list)
    for d, text in rows:
        w = WORD.findall((text or "").translate(jaccard.LOWER))
        sets[jaccard.NONE_ID if d is None else d].append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    flat = [(i, s) for i in ids for s in sets[i] if s]
    where = defaultdict(list)
    for k, (_, s) in enumerate(flat):
        for g in s:
            where[g].append(k)
    for k, (i, s) in enumerate(flat):
        for j, o in Counter(x for g in s for x in where[g] if x < k).items():
            if 100 * o >= 80 * (len(s) + len(flat[j][1]) - o):
                a, b = root(i), root(flat[j][0])
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components_equal_brute_force(spark, documents, odd, nothing):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 400, 300)]
    near = []
    for k in range(60):
        w = list(base)
        for i in rng.integers(0, 300, int(rng.integers(0, 14))):
            w[i] = f"x{k}"
        near.append((10_000 + k, " ".join(w)))
    docs = documents.select("doc_id", "text").unionByName(odd.where("doc_id IS NULL OR doc_id <> 10").select((odd.doc_id + 5_000_000).alias("doc_id"), "text")).unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    back = lambda x: None if x == jaccard.NONE_ID else x
    rows = jaccard.query(spark, docs).collect()
    assert len(rows) == docs.count()
    assert all(back(want[jaccard.NONE_ID if r.doc_id is None else r.doc_id]) == r.component_id for r in rows)
    blocks = {r._id: r.component_id for r in jaccard.components_of(docs, block_chars=20_000).collect()}
    assert blocks == want
    assert jaccard.query(spark, nothing).count() == 0


def test_rows_with_one_id_and_odd_columns(spark, odd):
    docs = odd.select("doc_id", "text")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    back = lambda x: None if x == jaccard.NONE_ID else x
    rows = jaccard.query(spark, docs).collect()
    assert len(rows) == docs.count() and all(back(want[jaccard.NONE_ID if r.doc_id is None else r.doc_id]) == r.component_id for r in rows)
    kept = jaccard.stage(odd)
    assert kept.columns == odd.columns and sorted(r.text or "" for r in kept.collect()) == sorted(r.text or "" for r in odd.where("doc_id IS NULL OR doc_id <> 11").collect())


def test_trie_leaves_pruned_subtrees_unread():
    """Walks of groups of random sets read a share of the trie that falls as groups are added."""
    rng, reads = np.random.default_rng(1), []
    for groups in (20, 40, 80):
        pool = [np.sort(rng.choice(500_000, 100, False)) for _ in range(groups)]
        sets = [np.unique(np.concatenate([g[rng.permutation(100)[:95]], [0, 1, 2]])).astype(np.int32) for g in pool for _ in range(5)]
        sizes = np.array([len(s) for s in sets])
        trie = jaccard.Trie(sets, sizes)
        plain = [set(s.tolist()) for s in sets]
        for i in range(0, len(sets), 7):
            want = {j for j in range(len(sets)) if 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j])}
            assert set(trie.links(i).tolist()) == want
        reads.append(trie.read / len(range(0, len(sets), 7)) / sum(sizes))
    assert reads[2] < 0.5


def test_link_sets_in_blocks_of_random_sets():
    rng = np.random.default_rng(0)
    for _ in range(20):
        base = [np.unique(rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(30):
            b = base[rng.integers(4)]
            b = b[rng.permutation(len(b))[: max(1, len(b) - rng.integers(0, len(b) // 5 + 1))]]
            sets.append(np.unique(np.concatenate([b, rng.integers(0, 2**63, rng.integers(0, 3)).astype(np.uint64)])))
        plain = [set(s.tolist()) for s in sets]
        linked = {(i, j) for i in range(30) for j in range(30) if i != j and 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j])}
        found = jaccard.link_sets(list(range(30)), sets)
        assert all(x in linked for x in found)
        own = list(range(30))
        for pairs, labels in ((found, own), (linked, list(range(30)))):
            for a, b in list(pairs) * 30:
                labels[a] = labels[b] = min(labels[a], labels[b])
            if labels is not own:
                assert labels == own


# -- lines, mixing -----------------------------------------------------------------------------


OWN = ["red dogs ran over the hill", "we like to eat ripe plums", "rain fell on old grey roofs", "my aunt has a wooden boat", "no one saw her leave early", "trains stop here at noon daily", "bread and salt for every guest", "cold wind came off the sea"]


def test_recurring_lines(spark, odd, nothing):
    notice = "This page was served {} times since the year {} by us"
    rows = [(i, f"{OWN[i]}\n{notice.format(i * 7, 1990 + i)}\nshort line", "en", "s", 1) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in linededup.stage(docs).collect()}
    assert out[0][0] == rows[0][1]
    for i in range(1, 8):
        want = f"{OWN[i]}\nshort line"
        assert out[i] == (want, len(want))
    assert linededup.query(spark, nothing).count() == 0
    texts = Counter((r.doc_id, r.text) for r in odd.collect())
    kept = linededup.drop_recurring(odd)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == texts and "shard" in kept.columns


def test_dropping_lines_keeps_clashing_columns(spark):
    line = "one line that is found in more than enough documents of the table and has twenty words or even more of them"
    docs = spark.createDataFrame([(i, f"text {i}\n{line}", "k", 7, [1]) for i in range(6)], "doc_id long, text string, _key string, _dropped int, _gone array<int>")
    rows = linededup.stage(docs).orderBy("doc_id").collect()
    assert [(r._key, r._dropped, r._gone) for r in rows] == [("k", 7, [1])] * 6
    assert [r.text for r in rows] == [f"text 0\n{line}", *[f"text {i}" for i in range(1, 6)]]


def test_positions_go_by_document_at_every_size(spark, documents, monkeypatch):
    marked, own = [], linededup.small
    monkeypatch.setattr(linededup, "small", lambda table, *limit: marked.append(table.columns) or own(table, *limit))
    out = linededup.query(spark, documents)
    assert out.where("n_dropped > 0").count() > 0 and not any("_gone" in c for c in marked)


def test_lines_that_two_documents_share(spark):
    passage = "The committee met in the old town hall and agreed that the bridge over the river should be mended before winter came"
    near = passage.replace("old", "new")
    exact, dated = "All of these words are shared", "Sold {} pairs of shoes here"
    texts = [f"{OWN[0]}\n{passage}", f"{OWN[1]}\n{exact}\n{dated.format(3)}", f"{OWN[2]}\n{near}", f"{OWN[3]}\n{exact}\n{dated.format(4)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in linededup.stage(docs).collect()}
    assert out == {0: texts[0], 1: texts[1], 2: OWN[2], 3: f"{OWN[3]}\n{dated.format(4)}"}


def test_leaf_with_several_families(spark, monkeypatch):
    names = "Ann Bob Cem Dee Eva Fay Gus Hal".split()
    texts = [f"{OWN[i]}\nthis page was sent to you by {x}" + (f"\nthis page was made for all who {x}" if i < 6 else "") for i, x in enumerate(names)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for top in (32, 1):  # 1: a round for each family
        monkeypatch.setattr(linededup, "TOP", top)
        assert {r.doc_id: r.text for r in linededup.stage(docs).collect()} == {i: t if i == 0 else OWN[i] for i, t in enumerate(texts)}


def test_groups_equal_greedy_assignment(spark):
    rng = np.random.default_rng(3)
    lines = {(int(rng.integers(3)), int(n), " ".join(rng.choice(["a", "b", "c"], n, p=[0.8, 0.1, 0.1]))) for n in rng.choice([5, 10], 400)}
    rows = [(leaf * 100 + n, i, x, int(rng.integers(1, 9))) for i, (leaf, n, x) in enumerate(sorted(lines))]
    want, heads = {}, defaultdict(list)
    for leaf, i, x, _ in sorted(rows, key=lambda r: (r[3], r[2]), reverse=True):
        w = x.split()
        near = [h for h, v in heads[leaf] if sum(a == b for a, b in zip(v, w)) >= 0.8 * len(w)]
        want[i] = near[0] if near else i
        heads[leaf] += [] if near else [(i, w)]
    assert max(map(len, heads.values())) > 3
    for top in (2, 32):
        linededup.TOP, kept = top, linededup.TOP
        got = {r.line_hash: r.template for r in linededup.all_groups(spark.createDataFrame(rows, "leaf long, line_hash long, masked string, uses long")).collect()}
        linededup.TOP = kept
        assert got == {i: h for i, h in want.items() if i != h}


def test_mixing_meets_margins(spark, documents, odd, nothing):
    mixed = mixing.mix(documents, temper=0.5, rounds=12).select("source", "lang", "tokens", "weight", "probability", "kept").toPandas()
    w = mixed.tokens * mixed.weight
    share = mixed.groupby("source").tokens.sum() ** 0.5
    got = w.groupby(mixed.source).sum() / w.sum()
    assert abs(got - share / share.sum()).max() < 0.02
    assert mixed.probability.between(0, 1).all() and mixed.probability.max() == 1
    assert mixing.query(spark, odd).count() == odd.count() and mixing.query(spark, nothing).count() == 0


def test_stage_meets_its_own_targets(spark, documents):
    hot = documents.where("doc_id % 3 = 0").withColumn("source", F.lit("hot"))
    docs = documents.where("doc_id % 3 <> 0").unionByName(hot)
    mixed = mixing.mix(docs, temper=mixing.TEMPER, tolerance=mixing.TOLERANCE).toPandas().fillna({"source": "", "lang": ""})
    w = mixed.tokens * mixed.weight
    for m in mixing.MARGINS:
        own = mixed.groupby(m).tokens.sum()
        share = own**mixing.TEMPER
        assert abs(w.groupby(mixed[m]).sum() / w.sum() - share / share.sum()).max() < 2 * mixing.TOLERANCE
    before = mixed.tokens[mixed.source == "hot"].sum() / mixed.tokens.sum()
    assert w[mixed.source == "hot"].sum() / w.sum() < before - 0.02
    assert sorted(r.doc_id for r in mixing.stage(docs).select("doc_id").collect()) == sorted(mixed.doc_id[mixed.kept])


def test_production_parameters_rake_and_keep_columns(spark, documents, odd, nothing):
    raked = mixing.rake(mixing.cells_of(mixing.keyed(documents)))
    assert mixing.margin_error(raked) < mixing.TOLERANCE
    reached = mixing.margins(raked).toPandas()
    assert abs(reached.target - reached.reached).max() < mixing.TOLERANCE and set(reached.margin) == set(mixing.MARGINS)
    clashing = odd.withColumns({c: F.lit("own") for c in ("topic", "tokens", "weight", "probability", "kept", "_mix_topic", "_source")})
    kept = mixing.stage(clashing, temper=1.0)
    assert kept.columns == clashing.columns and kept.count() > 0
    assert {tuple(r) for r in kept.select("topic", "tokens", "weight", "probability", "kept", "_mix_topic", "_source").collect()} == {("own",) * 7}
    assert mixing.stage(nothing).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_few_cells_are_raked_without_exchanges(spark, documents, monkeypatch, few):
    plans, own = [], mixing.materialise
    monkeypatch.setattr(mixing, "FEW_CELLS", few)
    monkeypatch.setattr(mixing, "materialise", lambda df, what: plans.append((what, df._jdf.queryExecution().executedPlan().toString())) or own(df, what))
    cells = own(mixing.cells_of(mixing.keyed(documents)), "cells")
    raked = mixing.rake(cells)
    assert raked.count() == cells.count() and mixing.margin_error(raked) < 1e-6
    assert ["Exchange hashpartitioning" in p for what, p in plans if what == "raked"] == [few == 0] * 3


def test_raking_ends_where_targets_clash(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10, 1), ("b", "y", "t", 10, 1)], "source string, lang string, topic string, tokens long, docs long")
    share = lambda m, p, q, n: spark.createDataFrame([(p, n), (q, 1 - n)], f"{m} string, target_{m} double")
    raked = mixing.rake(cells, {"source": share("source", "a", "b", 0.9), "lang": share("lang", "x", "y", 0.5)}, tolerance=1e-6)
    assert raked.count() == 2 and mixing.margin_error(raked) > 0.1


# -- toxicity, pages ---------------------------------------------------------------------------


def test_decoder_restores_words():
    model = toxicity.CharacterModel(toxicity.trigram_counts(["idiot", "moron", "stupid", "the", "this", "that"] * 5))
    d = toxicity.Decoder(model)
    for text, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("s.t.u.p.i.d", "stupid"), ("stuuupid", "stupid"), ("so i d i o t yes", "idiot")):
        assert word in d.words(text), text


def test_decoder_reads_long_and_spaced_runs():
    model = toxicity.CharacterModel(toxicity.trigram_counts(["you", "are", "a", "stupid", "moron", "idiot", "this", "that", "the"] * 20))
    d = toxicity.Decoder(model)
    run = " ".join("youarestupidyouareamoron")
    assert len(run) > 40 and {"you", "are", "stupid", "moron"} <= d.words(f"so {run}")
    assert "stupid" in d.words("this-that-this-that-this-that-this-that-s.t.u.p.i.d")
    for sign in toxicity.SEPARATORS.replace(" ", ""):
        assert "idiot" in d.words(f"an {sign.join('idiot')} here"), sign


def test_readings_are_the_likeliest():
    rng = np.random.default_rng(5)
    model = toxicity.CharacterModel(rng.integers(0, 40, toxicity.SIZE**3))
    d, logp = toxicity.Decoder(model), model.logp
    for _ in range(150):
        token = "".join(rng.choice(list("aabc1058.* "), int(rng.integers(2, 7)))).strip()
        last = max((i for i, c in enumerate(token) if c not in toxicity.SEPARATORS), default=0)
        paths = {((), 0, 0): 0.0}
        for i, c in enumerate(token):
            options = [*d._options(token, i), *([(" ", toxicity.COST["break"])] if c in toxicity.SEPARATORS and i < last else [])]
            step = {}
            for (out, a, b), p in paths.items():
                for x, cost in options:
                    if x == " " and not b:
                        continue
                    s = toxicity.symbol(x) if x.strip() else 0
                    key = (out, a, b) if not x else ((*out, x), 0, 0) if x == " " else ((*out, x), b, s)
                    step[key] = max(step.get(key, -1e9), p + cost + (logp[a][b][s] if x else 0))
            paths = step
        ends = defaultdict(lambda: -1e9)
        for (out, a, b), p in paths.items():
            if out:
                text = "".join(out).strip()
                ends[text] = max(ends[text], p + (logp[a][b][0] if b else 0))
        assert d.read(token) == tuple(sorted(ends, key=lambda x: -ends[x])[: toxicity.READINGS]), token


def test_character_model_counts_all_documents(spark):
    texts = ["You moron are a fool", "a plain text of words", None, "", "żółć świeża i gęś", "xylem xylem qwerty über"]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 6 == 0) for i in range(18) if i % 6 < 2], "doc_id long, toxic boolean").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    want = Counter()
    for x in texts * 3:
        for w in set(toxicity.LETTERS.findall((x or "").lower())):
            symbols = [0, 0, *map(toxicity.symbol, w), 0]
            want.update(zip(symbols, symbols[1:], symbols[2:]))
    counts = np.zeros((toxicity.SIZE,) * 3, np.int64)
    for at, n in want.items():
        counts[at] = n
    assert toxicity.fit(docs, labels)[0].logp == toxicity.CharacterModel(counts.ravel()).logp


def test_toxicity_on_held_out_rows(spark, odd, nothing):
    from meridia.llm.common import table

    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    fitted = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, *fitted).join(labels, "doc_id").toPandas()
    assert ((rows.score >= 0.5) & (rows.toxic == 0)).sum() <= 3
    assert (rows[rows.toxic == 1].score >= 0.5).mean() > 0.6
    got = toxicity.score(odd, *fitted).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(nothing, *fitted).count() == 0
    assert toxicity.fit(docs, labels.limit(0))[1] == {}


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav>
<article><h1>A  title &amp; more</h1><p>First   paragraph, with <b>bold</b> and a <a href=x>link</a>.<p>Second one<br>with a break.</article>
<footer>&copy; us</footer></body></html>"""


def test_blocks_and_training(spark):
    texts = [b[0] for b in html_text.blocks_of(PAGE)]
    assert texts == ["Home", "About", "A title & more", "First paragraph, with bold and a link.", "Second one with a break.", "© us"]
    assert html_text.blocks_of("<!-- open <p>x") == [] and html_text.blocks_of("plain") == [("plain", (), 0)]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    net = html_text.fit(pages, 40)
    rows = pages.unionByName(spark.createDataFrame([(900, "u", None), (901, "u", ""), (902, "u", PAGE)], pages.schema))
    got = {r.page_id: r for r in html_text.extract(rows, net).collect()}
    assert got[900].text == got[901].text == "" and got[902].text == "\n".join(texts[2:5])
    for p in pages.collect():
        body = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        want = [re.sub(r"\s+", " ", html_text.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        assert got[p.page_id].text == "\n".join(filter(None, want)) and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_embedded_elements_hide_no_more_than_they_hold(spark, nothing):
    texts = lambda h: [b[0] for b in html_text.blocks_of(h)]
    for tag in html_text.EMBEDDED_TAGS.split():
        assert texts(f"<p>a one</p><{tag} x='1'/><p>b two</p>") == ["a one", "b two"], tag
        assert texts(f"<p>a one</p><{tag}><p>b two</p>") == ["a one", "b two"], tag
        assert texts(f"<p>a one</p><{tag} x='1'>hidden</{tag}><p>b two</p>") == ["a one", "b two"], tag
    assert texts("<article><p>sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> done</p></article>") == ["sum x+y done"]
    assert texts("<p>a</p><script>if (a < b) x</script><p>b</p>") == ["a", "b"]
    pages = spark.createDataFrame([(1, "u", "<article><p>Words of one page stand here.</p></article>", "x")] * 2 + [(2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<article>" + "<p>A long page has many blocks.</p>" * 20_000 + "</article>", "x")], "page_id long, url string, html string, text string")
    rows = html_text.query(spark, pages).collect()
    assert len(rows) == 5 and len({r.text for r in rows if r.page_id == 1}) == 1 and all(r.text == "" for r in rows if r.page_id in (2, None))
    assert html_text.query(spark, pages.limit(0)).count() == 0


def test_vectors_see_all_words_and_classes():
    many = " ".join(f"u{i}" for i in range(12))
    (block,) = html_text.blocks_of(f"<div class='{many} cookie'>some text</div>")
    assert ".cookie" in block[1] and html_text.convention(block[1], block[0], block[2]) == 0
    words = [f"w{i}" for i in range(300)]
    (row,) = html_text.vectors([(" ".join(words), (), 0)], ({}, {}))
    want = np.zeros(html_text.WORD_DIMS)
    for w in words:
        want[html_text._place(w, html_text.WORD_DIMS, {})] += 1 / 300
    assert row[html_text.PATH_DIMS : html_text.PATH_DIMS + html_text.WORD_DIMS] == pytest.approx(want, abs=1e-6)


def test_lstm_gradients():
    rng = np.random.default_rng(2)
    net = html_text.Labeller.new(dims=5, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, mask = rng.normal(size=(2, 4, 5)), rng.integers(0, 2, (2, 4)).astype(float), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]])
    _, g = net.gradients(x, y, mask)
    for k in net.p:
        at = tuple(rng.integers(0, n) for n in net.p[k].shape)
        before = net.p[k][at]
        net.p[k][at] = before + 1e-3
        up, _ = net.gradients(x, y, mask)
        net.p[k][at] = before - 1e-3
        down, _ = net.gradients(x, y, mask)
        net.p[k][at] = before
        assert (up - down) / 2e-3 == pytest.approx(g[k][at], abs=2e-3)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "pack_sequences":
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            assert docs.count() > 20
    assert out.select("doc_id").distinct().count() == docs.count()


def test_driver_holds_no_stored_frames(spark):
    from meridia.llm.common import discard, materialise
    from meridia.sources import staging

    first, second = materialise(spark.range(3), "held"), materialise(spark.range(4), "held")
    path = staging._paths[second]
    assert staging._file_system(spark, path)[0].exists(staging._file_system(spark, path)[1])
    before = len(staging._paths)
    del first
    gc.collect()
    assert len(staging._paths) == before - 1  # its plan and settings go with it
    discard(second)
    assert not staging._file_system(spark, path)[0].exists(staging._file_system(spark, path)[1])
    assert staging.trim_driver(spark) in (True, False)


def test_whole_line_query_finds_every_family(spark, documents, nothing):
    from meridia.llm import queries

    names = "Ann Bob Cem Dee Eva Fay Gus Hal".split()
    texts = [f"{OWN[i]}\nthis page was sent to you by {x}\nthis page was made for all who {x}" for i, x in enumerate(names)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    part = {r.doc_id: r.n_dropped for r in linededup.query(spark, docs).collect()}
    rows = {r.doc_id: (r.n_dropped, r.n_left, r.text_sha256) for r in linededup.query(spark, docs, whole=True).collect()}
    want = {i: (2 if i else 0, len(t := OWN[i] if i else texts[0]), hashlib.sha256(t.encode()).hexdigest()) for i in range(8)}
    assert rows == want and sum(part.values()) == 7  # the SQL's rule has one reference a leaf
    assert linededup.query(spark, nothing, whole=True).count() == 0
    assert {"op7_line_templates", "op7_line_templates_whole"} <= queries.queries().keys() and "op7_line_templates_whole" not in queries.oracle_sql()
