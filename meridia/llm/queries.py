"""Queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridia.llm import fingerprint, html_text, jaccard, linededup, mixing, packing, pii, quality, sharding, toxicity
from meridia.llm.common import table


def _over(module, name: str = "documents", **options):
    return lambda spark, sf_dir: module.query(spark, table(spark, sf_dir, name), **options)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_perplexity": _over(quality),
        "op2_contextual_pii": _over(pii),
        "op3_mixing": _over(mixing),
        "op4_toxicity": toxicity.query,
        "op5_html_blocks": _over(html_text, "pages"),
        "op6_ngram_jaccard": _over(jaccard),
        "op7_line_templates": _over(linededup),
        "op7_line_templates_whole": _over(linededup, whole=True),  # no line is left without its group; no SQL
        "op8_best_fit_packing": _over(packing),
        "op9_sharding": _over(sharding),
        "pipeline": _pipeline,
        "op10_fingerprints": _over(fingerprint),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.oracle(), "op7_line_templates": linededup.oracle(), "op9_sharding": sharding.oracle()}
