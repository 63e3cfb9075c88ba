"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) by tokens. Raking then scales
the cells' weights so that the weighted tokens match target shares of the sources, of the
languages and of the topics in turn: ``ROUNDS`` times in the query, whose SQL says so, and in
the pipeline's stage until the largest error of a margin's shares is at most ``TOLERANCE``
(or, for targets that no weights meet together, until three rounds lower it by less than a
thousandth). A document's probability of
being kept is its cell's weight over the largest weight, so that all of the cell with the
largest weight stays; documents are sampled by a hash of their id, so a run repeats.

Targets by default temper the corpus' own margins: a share in proportion to the tokens to
the power ``TEMPER`` (1 leaves the mixture as it is, 0 makes all parts equal). Explicit
targets may be given for any margin; parts without a target keep none of their weight.
``margins`` reports what shares the weights reach.

Texts are read once: their topics and tokens are stored with the documents' ids (the stage
stores the documents with them), and cells and sampling read that table. Cells are aggregated
with partial sums before any shuffle, so a source with a third of all rows costs a row a task
and cell. Raking runs over the cells only, and as DataFrame windows; the driver gets one
number, the largest error, each three rounds.

Edge cases: null source, language or text count as '', '' and no tokens; documents without
tokens follow their cell; a cell without tokens has weight 1; repeated rows with one
doc_id are kept or dropped together; an empty table gives no rows; ``mix`` replaces columns of
the input that clash with those it adds, the stage returns the input's own columns.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meridia.llm.common import materialise, small, sql_unit

MARGINS = ("source", "lang", "topic")
ROUNDS = 9
TEMPER = 0.9
TOLERANCE = 1e-6
FEW_CELLS = 100_000  # so many rows of three short names and a few numbers are raked by one task

# Topics by the plainest sign of a text's form, first match wins.
TOPICS = (("tabular", "|", 20), ("promotional", "!", 20), ("symbolic", "&", 40), ("numeric", "0", 400))


def _less(text, part: str, by: str = ""):
    return F.replace(text, F.lit(part), F.lit(by))


def topic_of(text):
    """A coarse topic: a text with at least one sign in so many characters has the sign's topic, else 'prose'."""
    text = F.coalesce(text, F.lit(""))
    out = F.lit("prose")
    for name, sign, one_in in reversed(TOPICS):
        n = F.octet_length(text) - F.octet_length(_less(text, sign))  # signs are of one byte
        out = F.when(n * one_in > F.length(text), F.lit(name)).otherwise(out)
    return out


def tokens_of(text):
    """White-space separated tokens, counted without splitting; plain replacements squeeze all but the longest runs."""
    text = F.coalesce(text, F.lit(""))
    for c in "\n\t\r\f\x0b":
        text = _less(text, c, " ")
    for run in (8, 4, 2, 2):
        text = _less(text, " " * run, " ")
    text = F.trim(text)
    text = F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, "  +", " ")).otherwise(text)
    return F.when(text == "", F.lit(0)).otherwise(F.octet_length(text) - F.octet_length(_less(text, " ")) + 1).cast("long")


def keyed(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with source, lang, topic and tokens as the cells have them; ``prefix`` parts their names from the input's."""
    text = F.col("text")
    return docs.withColumns({f"{prefix}source": F.coalesce("source", F.lit("")), f"{prefix}lang": F.coalesce("lang", F.lit("")), f"{prefix}topic": topic_of(text), f"{prefix}tokens": tokens_of(text)})


def cells_of(counted: DataFrame, prefix: str = "") -> DataFrame:
    """(source, lang, topic, tokens, docs) of a frame that ``keyed`` made."""
    cells = counted.groupBy(*[F.col(f"{prefix}{m}").alias(m) for m in MARGINS])
    return cells.agg(F.sum(f"{prefix}tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def targets_of(cells: DataFrame, margin: str, temper: float = TEMPER) -> DataFrame:
    """(margin, target share)."""
    own = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("_t"))
    everything = own.agg(F.sum("_t").alias("_all"))
    return own.join(F.broadcast(everything)).select(margin, (F.col("_t") / F.when(F.col("_all") > 0, F.col("_all"))).alias(f"target_{margin}"))  # one row is broadcast


def margin_error(raked: DataFrame) -> float:
    """The largest difference between a part's weighted share and its target, over all margins."""
    share = F.sum(F.col("tokens") * F.col("weight")) / F.when(F.max("_total") > 0, F.max("_total"))
    errors = [raked.groupBy(m).agg(F.abs(share - F.max(f"target_{m}")).alias("e")).agg(F.max("e").alias("e")) for m in MARGINS]
    return reduce(DataFrame.union, errors).agg(F.max("e")).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, temper: float = TEMPER, tolerance: float | None = None) -> DataFrame:
    """``cells`` (a stored table) with ``weight``: a document's tokens count that many times.

    With ``tolerance``, as many rounds as the margins need to hold; else ``rounds``.
    """
    # few cells are raked by one task, without an exchange a margin and round, whose plans and threads fill the driver
    few = cells.count() <= FEW_CELLS
    whole = lambda stored: stored.coalesce(1) if few else stored
    cells = whole(cells)
    total = cells.agg(F.sum("tokens").cast("double").alias("_total"))
    raked = cells.join(F.broadcast(total))  # one row
    for m in MARGINS:
        raked = raked.join((targets or {}).get(m) or targets_of(cells, m, temper), m, "left").fillna({f"target_{m}": 0.0})
    raked = whole(materialise(raked.withColumn("weight", F.lit(1.0)), "cells"))
    k, error = 0, math.inf
    while tolerance is not None or k < rounds:
        for m in MARGINS:
            have = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(m))
            raked = raked.withColumn("_have", have).withColumn("weight", F.when(F.col("_have") > 0, F.col("weight") * F.col(f"target_{m}") * F.col("_total") / F.col("_have")).otherwise(F.col("weight"))).drop("_have")
        k += 1
        if k % 3 == 0:
            raked = whole(materialise(raked, "raked"))
            if tolerance is not None:
                before, error = error, margin_error(raked)
                if error <= tolerance or error > 0.999 * before:
                    break
    return raked


def margins(raked: DataFrame) -> DataFrame:
    """(margin, part, target, reached): a row a part of each margin."""
    share = F.sum(F.col("tokens") * F.col("weight")) / F.when(F.max("_total") > 0, F.max("_total"))
    return reduce(DataFrame.union, [raked.groupBy(F.col(m).alias("part")).agg(F.max(f"target_{m}").alias("target"), share.alias("reached")).select(F.lit(m).alias("margin"), "part", "target", "reached") for m in MARGINS])


def chances_of(raked: DataFrame) -> DataFrame:
    """(source, lang, topic, weight, probability) of the cells."""
    top = raked.where("tokens > 0").agg(F.max("weight").alias("_top"))
    p = F.least(F.lit(1.0), F.when(F.col("tokens") > 0, F.col("weight") / F.col("_top")).otherwise(F.lit(1.0)))
    return raked.join(F.broadcast(top)).select(*MARGINS, "weight", F.round(p, 9).alias("probability"))  # one row is broadcast


def _sampled(counted: DataFrame, raked: DataFrame, prefix: str) -> DataFrame:
    """``counted`` with weight, probability and kept, all named with ``prefix``."""
    chances = small(materialise(chances_of(raked), "chances")).select(*[F.col(m).alias(f"{prefix}{m}") for m in MARGINS], F.col("weight").alias(f"{prefix}weight"), F.col("probability").alias(f"{prefix}probability"))
    unit = sql_unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return counted.join(chances, [f"{prefix}{m}" for m in MARGINS], "left").withColumn(f"{prefix}kept", unit < F.col(f"{prefix}probability"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, temper: float = TEMPER, tolerance: float | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability, kept), a row a document; source and lang are never null."""
    counted = materialise(keyed(docs.select("doc_id", "source", "lang", "text")).drop("text"), "counted")
    raked = rake(materialise(cells_of(counted), "cells"), targets, rounds, temper, tolerance)
    return _sampled(counted, raked, "").select("doc_id", *MARGINS, "tokens", "weight", "probability", "kept")


def stage(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, tolerance: float = TOLERANCE) -> DataFrame:
    """The sampled rows of ``docs``, with all its columns."""
    prefix = "_mix_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    counted = materialise(keyed(docs, prefix), "counted")
    raked = rake(materialise(cells_of(counted, prefix), "cells"), targets, temper=temper, tolerance=tolerance)
    return _sampled(counted, raked, prefix).where(F.col(f"{prefix}kept")).select(*docs.columns)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def oracle() -> str:
    cases = " ".join(f"WHEN (length(t) - length(replace(t, '{sign}', ''))) * {n} > length(t) THEN '{name}'" for name, sign, n in TOPICS)
    steps, last = [], "cells0"
    for k in range(ROUNDS * len(MARGINS)):
        m = MARGINS[k % len(MARGINS)]
        steps.append(f"""cells{k + 1} AS MATERIALIZED (
          SELECT c.* REPLACE (CASE WHEN have > 0 THEN weight * target * total / have ELSE weight END AS weight)
          FROM {last} c JOIN (SELECT {m}, sum(tokens * weight) AS have FROM {last} GROUP BY {m}) USING ({m}) JOIN target_{m} USING ({m}))""")
        last = f"cells{k + 1}"
    targets = ", ".join(f"""target_{m} AS (
        SELECT {m}, t / sum(t) OVER () AS target FROM (SELECT {m}, pow(CAST(sum(tokens) AS DOUBLE), {TEMPER}) AS t FROM cells0 GROUP BY {m}))""" for m in MARGINS)
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
    keyed AS (
      SELECT doc_id, source, lang, CASE {cases} ELSE 'prose' END AS topic, trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS s FROM texts),
    docs AS (SELECT doc_id, source, lang, topic, CASE WHEN s = '' THEN 0 ELSE length(s) - length(replace(s, ' ', '')) + 1 END AS tokens FROM keyed),
    cells0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(sum(tokens)) OVER () AS DOUBLE) AS total, CAST(1 AS DOUBLE) AS weight FROM docs GROUP BY source, lang, topic),
    {targets}, {", ".join(steps)},
    chances AS (
      SELECT source, lang, topic, weight, round(least(1.0, CASE WHEN tokens > 0 THEN weight / (SELECT max(weight) FROM {last} WHERE tokens > 0) ELSE 1.0 END), 9) AS probability FROM {last})
    SELECT doc_id, topic, CAST(tokens AS BIGINT) AS tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
           ('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0 < probability AS kept
    FROM docs JOIN chances USING (source, lang, topic)"""
