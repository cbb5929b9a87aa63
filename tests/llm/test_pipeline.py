import re

import corpus_pipeline as pipeline
from framelake.llm import decontaminate, queries
from framelake.llm.common import table
from tests.llm.test_operators import empty, odd_rows, plain_components

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.count())
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == before.columns
        if name == "near_duplicates":
            rows = before.orderBy("doc_id").select("doc_id", "text").collect()
            groups = plain_components([r.text for r in rows], 5, 8, 10)
            assert {r.doc_id for r in docs.collect()} == {rows[c].doc_id for _, c in groups.values()}
        if name == "decontamination":
            assert decontaminate.report(docs, table(spark, SF, "benchmark")).where("contaminated").count() == 0
    assert kept == sorted(kept, reverse=True) and kept[-1] == kept[-2] > 0


def test_run(spark):
    assert pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_on_odd_rows(spark):
    """Null ids, null texts and repeated rows; then no rows at all."""
    for name, stage in pipeline.STAGES:
        got = stage(spark, odd_rows(spark), SF)
        ids = sorted(str(r.doc_id) for r in got.collect())
        if name in ("near_duplicates", "decontamination", "tokens"):
            assert ids == ["4", "4", "5", "None", "None"], name
        else:
            assert set(ids) <= {"4", "5", "None"}, name
        assert stage(spark, empty(spark), SF).count() == 0, name


def test_names():
    assert len({re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES if n != "pipeline"}) == 10
