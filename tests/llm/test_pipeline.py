"""The pipeline's stages, each against a plain version on its own input."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

from gridloom.store import cut

from . import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("toxicity", F.lit("extra")).withColumn("id", F.lit(1))
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None, "extra", 1), (-5, "", "en", "s", 0, "extra", 1)], docs.schema))
    columns, stages = docs.columns, dict(cp.STAGES)
    assert [k for k, _ in cp.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]

    kept = cut(stages["toxicity"](spark, docs, sf_dir))
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    clean = [i for i, y in labels.items() if y == 0]
    assert kept.columns == columns and {None, -5} <= left and sum(i in left for i in clean) >= 0.95 * len(clean)

    lines = cut(stages["line dedup"](spark, kept, sf_dir))
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want = brute.line_windows_removed(rows)
    assert lines.columns == columns and {r["doc_id"]: r["text"] for r in lines.collect()} == want
    assert lines.where("n_chars != length(text)").count() == 0

    single = cut(stages["n-gram Jaccard join"](spark, lines, sf_dir))
    known = [(i, t) for i, t in want.items() if i is not None]
    groups = brute.components(known, 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {i for i, _ in known if groups[i] == i} | {None} and single.columns == columns

    pure = cut(stages["benchmark decontamination"](spark, single, sf_dir))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in pure.collect()} == {r["doc_id"] for r in single.collect() if not brute.contaminated(r["text"], items)[1]}
    assert pure.columns == columns

    packed = stages["best-fit packing"](spark, pure, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in pure.collect()}
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
