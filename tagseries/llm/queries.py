"""Registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagseries.llm import (
    decontaminate,
    hash_forest,
    jaccard_join,
    line_dedup,
    lm_score,
    mixing,
    repeats,
    secret_scan,
    spelling,
    token_align,
    token_counts,
    toxicity,
    url_filter,
)
from tagseries.llm.common import table


def op1_secret_scan(spark, sf_dir):
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_lm_score(spark, sf_dir):
    return lm_score.lm_score(table(spark, sf_dir, "documents"))


def op4_section_tokens(spark, sf_dir):
    return token_counts.section_tokens(table(spark, sf_dir, "documents")).drop("section_tokens")


def op5_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_remove_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op9_nearest(spark, sf_dir):
    return hash_forest.nearest(table(spark, sf_dir, "embeddings"))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op11_spelling_groups(spark, sf_dir):
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_token_links(spark, sf_dir):
    return token_align.token_links(table(spark, sf_dir, "documents")).withColumnRenamed("groups", "groups_sha256")


def op13_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).withColumn(
        "kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_jaccard_join, op3_lm_score, op4_section_tokens, op5_mix_sources, op6_url_filter,
                                   op7_toxicity, op8_remove_repeats, op9_nearest, op10_decontaminate, op11_spelling_groups, op12_token_links,
                                   op13_line_dedup)}
SQL = {"op5_mix_sources": mixing.mixing_sql(), "op6_url_filter": url_filter.url_sql(), "op13_line_dedup": line_dedup.line_sql()}
