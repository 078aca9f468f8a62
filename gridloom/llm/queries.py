"""The registered queries of the operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import make_importable
from .decontaminate import contamination
from .fingerprint_chain import fingerprint_chain
from .importance import importance_ranks
from .jaccard_join import jaccard_components
from .language_id import fit_languages, identify_languages
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .packing import pack, token_pieces
from .phrases import mine_phrases
from .quality_rules import quality_rules
from .substring_dedup import dedup_substrings
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return make_importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(id_column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(folds))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scorer = fit_toxicity(docs, labels.where(_fold("doc_id", 4) != 2))
    scored = score_toxicity(docs, scorer)
    held_out = F.coalesce(_fold("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(token_pieces(_table(spark, sf_dir, "documents")))
    return packed.select(F.col("id").alias("doc_id"), "piece", F.col("start").alias("start"), "length", "ids_crc32", "sequence_id", "offset")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("lines_total").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    langs, table = fit_languages(docs.where(_fold("doc_id", 5) != 0))
    held_out = F.coalesce(_fold("doc_id", 5) == 0, F.lit(False))
    return identify_languages(docs, langs, table).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_chain(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents"), with_bytes=False)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))  # the example list; a deployment gives its table of rules


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = importance_ranks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_fingerprint": op7_fingerprint,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_url_filter": op10_url_filter,
    "op11_quality_rules": op11_quality_rules,
    "op12_phrases": op12_phrases,
    "op13_importance": op13_importance,
}
