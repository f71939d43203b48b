"""The pipeline's stages on the small tables: columns, what stays, what goes."""

import corpus_pipeline as cp
from revkit.llm import near_dedup, packing, pii
from revkit.llm.common import materialize
from revkit.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept[name] = docs
    ids = {k: {r.doc_id for r in v.collect()} for k, v in kept.items()}
    assert ids["quality_rules"] > ids["exact_dedup"] >= ids["near_dedup"] == ids["pii"]
    assert near_dedup.components(kept["near_dedup"]).where("NOT kept").count() == 0
    assert not any(pii.base_spans(r.text or "") for r in kept["pii"].collect())
    packed = cp.pack(spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids["pii"]
    assert packed.count() == packing.pieces(docs, tokenizer_path()).count()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0
