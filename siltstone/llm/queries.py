"""The queries of this subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import factorisation, gumbel, html_text, mixing, pii, pseudo_likelihood, quality_rules, simhash, syncmers, token_counts
from .common import read


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", "votes")


def op1_gumbel_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gumbel.sample(read(spark, sf_dir, "documents"), k=2)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone count the base spans; the columns n_email_all to n_phone_all add the disguised ones, which spans lists too."""
    return pii.find_all(read(spark, sf_dir, "documents"))


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(read(spark, sf_dir, "documents"))


def op4_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return factorisation.score(docs, factorisation.fit(docs, read(spark, sf_dir, "labels")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_all(read(spark, sf_dir, "pages"))


#: Wanted weights of the languages, the domains that labelled rows name.
TARGETS = {"en": 0.6, "fr": 0.15, "de": 0.15, "es": 0.1}


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), TARGETS)


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_gumbel_sampling": op1_gumbel_sampling,
    "op2_pii": op2_pii,
    "op3_pseudo_likelihood": op3_pseudo_likelihood,
    "op4_factorisation": op4_factorisation,
    "op5_html_text": op5_html_text,
    "op6_soft_mixing": op6_soft_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_syncmers": op8_syncmers,
    "op9_token_counts": op9_token_counts,
    "op10_simhash": op10_simhash,
}

#: DuckDB SQL of the queries that SQL can express whole.
ORACLES: dict[str, str] = {}
