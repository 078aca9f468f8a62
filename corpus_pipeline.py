"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a
DataFrame; all but the last return the columns of documents. SQL cannot express the first and
last stage, so ORACLE_SQL is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import packing
from gridloom.llm.decontaminate import contamination
from gridloom.llm.jaccard_join import jaccard_components
from gridloom.llm.line_dedup import dedup_lines
from gridloom.store import cut, free_name
from gridloom.llm.toxicity import fit_toxicity, score_toxicity
from gridloom.session import make_importable

#: Score from which a document is rejected as toxic.
TOXIC = 0.3
#: The near-duplicate stage compares sets of five-word shingles at a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_importable(spark).read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below TOXIC by the model fitted on the labelled documents; null and empty texts stay."""
    scorer = fit_toxicity(docs, _labels(spark, sf_dir))
    name = free_name(docs, "toxicity")
    scored = score_toxicity(docs, scorer, keep=name)
    return scored.where((F.col(name) < TOXIC) | (F.length(F.coalesce("text", F.lit(""))) == 0)).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, later occurrences of repeated three-line windows taken out; n_chars is the new text's length."""
    make_importable(spark)
    done = dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the group's smallest id. Rows without id or words stay.

    Of several rows with the smallest id that with the least hash of its text stays, so a repeated task keeps the same one.
    """
    make_importable(spark)
    groups = jaccard_components(docs, k=SHINGLE, percent=PERCENT)
    others = groups.where((F.col("doc_id") != F.col("component_id")) & (F.col("n_shingles") > 0)).select("doc_id").distinct()
    judged = F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = docs.where(judged).join(others, "doc_id", "left_anti").select(*docs.columns)
    one = kept.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row")).select("row.*")
    return one.unionByName(docs.where(~judged | F.col("text").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item."""
    items = make_importable(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = contamination(docs, items).where("n_hit > 0").select("doc_id", "th").distinct()
    same = F.expr("d.doc_id <=> h.doc_id and xxhash64(d.text) = h.th")
    return docs.alias("d").join(cut(hit).alias("h"), same, "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    make_importable(spark)
    packed = packing.pack(packing.token_pieces(docs))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written as Parquet and read again."""
    docs = make_importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
