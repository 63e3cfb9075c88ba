"""Personal data: fixed patterns, and contextual extraction bootstrapped from seeds.

Seeds are the matches of fixed patterns: e-mail addresses, IPv4 addresses, card numbers
(Luhn) and telephone numbers, as base spans; and long hexadecimal keys, which only seed.
Extraction then looks at *candidates*: white-space delimited tokens that hold a digit or
``@``, stripped of brackets and punctuation; adjacent groups of digits and signs, or of
capitals and digits, that only spaces part (and single signs or short words in capitals
between two of them) are one candidate, as in ``(555) 123 4567``. A candidate's *patterns* are the two words
before it, the word before and after it, and the last word before it with the candidate's
shape (letters, digits and signs by class and length band). Patterns and candidate
instances form a bipartite graph, whose edges Spark weighs by documents. Scoring repeats:
an instance is as likely identifying as its patterns say (noisy or), a pattern as reliable
as its instances are likely, with a prior that holds patterns of few instances down.
Instances of patterns with at least ``MIN_INSTANCES`` distinct instances and reliability
``RELIABLE`` become spans of kind ``ctx`` where they lie in such a pattern and no base
span overlaps them.

The main path is DataFrame expressions only. Edges are aggregated before the graph is
shuffled, so a context that a third of all documents share is one row a task; one pattern
row is kept per distinct context, and candidates join it by hash.

Edge cases: null text is empty; repeated rows and rows with one doc_id are treated one by
one; a row without spans has zero counts, the digest of the empty string and empty spans;
an empty table gives no rows. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meridia.llm.common import materialise, small

ROUNDS = 3
RELIABLE = 0.8
MIN_INSTANCES = 3
PRIOR_FALSE = MIN_INSTANCES * (1 / RELIABLE - 1)  # unlikely instances that every pattern is held to have: MIN_INSTANCES certain ones just do

# Fixed patterns. The base patterns are anchored where a run starts (or the last match
# ended) and possessive, which gives the same leftmost matches in linear time.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_DOT = r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])"  # no part of a domain name
LOOSE_GAP = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"  # not between two digits
TOKEN = r"[^\x20\x09-\x0D]++"
# Runs of groups that are one identifier; possessive, and each group is a whole token but for closing signs.
GROUP_END = r"(?=[^\x20\x09-\x0D\p{L}\p{N}@]*+(?:[\x20\x09-\x0D]|\z))"
GROUP = rf"(?:[(.-]*+[0-9](?:[0-9()+./-]*[0-9)])?|(?=[A-Z]*[0-9])[A-Z0-9]{{2,8}}){GROUP_END}"
RUN = rf"(?<![^\x20\x09-\x0D])\+?+{GROUP}(?:\x20++(?:(?:[A-Z]{{1,4}}|[-/])\x20++)?{GROUP})++[^\x20\x09-\x0D\p{{L}}\p{{N}}@]*+"
CANDIDATE = rf"{RUN}|{TOKEN}"
KEY = r"^[0-9A-Fa-f]{32,}$"
EDGE = r"[\[\](){}<>\"'`,;:!?.*#$%&|=]"

SPAN = "struct<kind:string,start:int,end:int>"


def _spans(text, kind: str, pattern: str, keep):
    """Spans of a pattern's matches: the pieces between matches give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # a running sum over (gap, match) lengths; matches have no more than a text's length
    zipped = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    start = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.length(x["m"])).alias("at"),
            F.when(keep(x["m"]), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), (acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + F.length(x["m"])).alias("end"))))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return start["out"]


def _digits(x):
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits):
    """The check sum of a digit string is a multiple of ten."""
    reverse = F.reverse(digits)
    doubled = F.transform(F.split(reverse, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def _parts_fit(x):
    return F.forall(F.split(x, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(x, r"\."), lambda p: F.substring(F.concat(F.lit("000"), F.regexp_replace(p, "^0+", "")), -3, 3) <= "255")


def base_spans(text):
    """All base spans of a text, by kind as listed, then start."""
    empty = F.array().cast(f"array<{SPAN}>")
    has_digit = text.rlike("[0-9]")
    email = F.when(F.contains(text, F.lit("@")), _spans(F.regexp_replace(text, LOOSE_DOT, "%"), "email", EMAIL, lambda m: F.lit(True))).otherwise(empty)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), _spans(text, "ip", IP, _parts_fit)).otherwise(empty)
    sized = lambda m, a, b: F.length(_digits(m)).between(a, b)
    card = F.when(has_digit & text.rlike(r"(?:[0-9][\x20-]?){16}"), _spans(F.regexp_replace(text, LOOSE_GAP, "_"), "card", CARD, lambda m: sized(m, 16, 19) & _luhn(_digits(m)))).otherwise(empty)
    phone = F.when(F.contains(text, F.lit("+")), _spans(text, "phone", PHONE, lambda m: sized(m, 8, 15))).otherwise(empty)
    return F.concat(email, ip, card, phone)


def _shape(x):
    """A token's classes in order, runs as one sign with a length band."""
    s = F.regexp_replace(x, r"[0-9A-Fa-f]{16,}", "H")
    s = F.regexp_replace(s, r"[A-Z]+", "A")
    s = F.regexp_replace(s, r"[^\x00-@\[-`{-\x7f]+", "a")
    return F.regexp_replace(s, r"[0-9]+", "9")


def candidates(rows: DataFrame) -> DataFrame:
    """(row, start, end, instance, pattern hashes) of candidate tokens; ``rows``: (row, text)."""
    tokens = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    gaps = F.split("text", CANDIDATE, -1)
    cut = rows.where(F.col("text").rlike("[0-9@]")).select("row", tokens.alias("t"), gaps.alias("g"))
    # token lengths add up to positions; only tokens with a digit or @ are kept
    with_at = F.aggregate(
        F.zip_with("t", F.slice("g", 1, F.size("t")), lambda t, g: F.struct(t.alias("t"), F.length(g).alias("g"), t.rlike("[0-9@]").alias("hit"))),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<i:int,start:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.length(x["t"])).alias("at"),
            (acc["i"] + 1).alias("i"),
            F.when(x["hit"], F.concat(acc["out"], F.array(F.struct(acc["i"].alias("i"), (acc["at"] + x["g"]).alias("start"))))).otherwise(acc["out"]).alias("out"),
        ),
    )["out"]
    hits = cut.withColumn("hit", F.explode(with_at))
    word = lambda k: F.lower(F.coalesce(F.get("t", F.col("hit.i") + k), F.lit("^")))
    token = F.get("t", F.col("hit.i"))
    run = F.contains(token, F.lit(" "))
    # a run keeps a group in brackets at either end
    lead = F.when(run & token.rlike(r"^\([^() ]*\)"), 0).otherwise(F.length(F.regexp_replace(token, rf"(?s)^({EDGE}*).*$", "$1")))
    core = F.expr("substring(token, lead + 1)")
    core = F.when(run & core.rlike(r"\([^() ]*\)$"), core).otherwise(F.regexp_replace(core, rf"{EDGE}+$", ""))
    hits = hits.withColumn("token", token).withColumn("lead", lead)
    out = hits.select("row", (F.col("hit.start") + F.col("lead")).alias("start"), core.alias("instance"), word(-1).alias("w1"), word(-2).alias("w2"), word(1).alias("next"))
    out = out.where((F.length("instance") >= 4) | F.contains("instance", F.lit(" ")))
    shape = _shape(F.col("instance"))
    patterns = F.array(F.xxhash64(F.lit("two"), "w2", "w1"), F.xxhash64(F.lit("around"), "w1", "next"), F.xxhash64(F.lit("shape"), "w1", shape))
    return out.select("row", "start", (F.col("start") + F.length("instance")).alias("end"), F.xxhash64("instance").alias("instance"), F.col("instance").rlike(KEY).alias("key"), patterns.alias("patterns"))


def reliable_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern): those that the bootstrapping settles on. ``found``: candidates with ``seed``."""
    edges = found.select("instance", F.explode("patterns").alias("pattern"), "row", F.col("seed").cast("int").alias("seed"))
    edges = materialise(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    # a pattern with a single instance can neither be reliable nor inform its instance
    wide = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_INSTANCES).select("pattern")
    edges = materialise(edges.join(wide, "pattern", "left_semi"), "graph")
    likely = seeds = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("p"))
    for k in range(rounds):
        scored = edges.join(likely, "instance").groupBy("pattern").agg(F.sum("p").alias("true"), F.count(F.lit(1)).alias("n"))
        patterns = scored.select("pattern", (F.col("true") / (F.col("n") + F.lit(PRIOR_FALSE))).alias("r"), "n")
        if k == rounds - 1:
            return patterns.where((F.col("r") >= RELIABLE) & (F.col("n") >= MIN_INSTANCES)).select("pattern")
        by_instance = edges.join(patterns.where(F.col("r") > 0), "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("r"), F.lit(1e-6)))))).alias("q"))
        # a seed stays certain; the rest have what their patterns say
        likely = materialise(seeds.join(by_instance, "instance", "left").select("instance", F.greatest("p", F.coalesce("q", F.lit(0.0))).alias("p")), "instances")


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, spans): arrays of the base spans and of all spans, a row for each row of ``docs``."""
    return find_in(numbered(docs), rounds).drop("row")


def numbered(docs: DataFrame) -> DataFrame:
    """A stored (row, doc_id, text): each row of ``docs`` has a number of its own, whatever its id and text."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialise(keyed.withColumn("row", F.monotonically_increasing_id()), "rows")


def find_in(keyed: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(row, doc_id, base, spans) of a table that ``numbered`` stored."""
    based = keyed.select("doc_id", "row", base_spans(F.col("text")).alias("base"))
    based = materialise(based, "base")
    by_row = based.where(F.size("base") > 0).select("row", "base")
    overlapping = F.exists("base", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"]))
    seeded = candidates(keyed).join(by_row, "row", "left").withColumn("inside", F.coalesce(overlapping, F.lit(False))).drop("base")
    seeded = materialise(seeded.withColumn("seed", F.col("inside") | F.col("key")), "seeded")
    good = small(materialise(reliable_patterns(seeded, rounds), "reliable"))
    outside = seeded.where(~F.col("inside")).select("row", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern", "left_semi")
    more = outside.select("row", "start", "end").distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.lit("ctx").alias("kind"), "start", "end"))).alias("more"))  # of one text
    more = small(materialise(more, "more"))
    return based.join(more, "row", "left").select("row", "doc_id", "base", F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))).alias("spans"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in angle brackets, a row for each row of ``docs``."""
    keyed = numbered(docs)
    found = find_in(keyed).select("row", "spans")
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["end"] - b["end"]))
    out = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"))
        ),
    )
    whole = keyed.join(found, "row").select("doc_id", "text", out.alias("o"))
    return whole.select("doc_id", F.when(F.col("o").isNull(), F.col("text")).otherwise(F.concat("o.out", F.expr("substring(text, o.at + 1)"))).alias("text"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs).select("doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_ctx"))
