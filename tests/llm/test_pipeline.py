"""The pipeline's stages on odd rows: null ids and texts, repeated rows, an empty benchmark, empty documents, clashing columns."""

import pytest

pytest.importorskip("netmetrics.llm")
pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, gone int, component_id long, K string"


def text(name, n=60):
    return " ".join(f"{name}{k}" for k in range(n))


def test_stages_of_odd_rows(spark, tmp_path):
    rows = [(None, text("a")), (1, text("b")), (1, text("b")), (2, None), (3, ""), (4, text("c")), (5, text("c")), (6, text("d", 3000)), (7, None)]
    docs = spark.createDataFrame([(k, t, None, "s", len(t or ""), "x", 1, 9, None) for k, t in rows], SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(None, text("a")), (1, text("b")), (1, text("b")), (4, text("c")), (5, ""), (6, text("d", 3000))]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")], name
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=key) == kept
    packed = pipeline.STAGES[-1][1](spark, docs, f"file://{tmp_path}")
    assert sorted((r["doc_id"] for r in packed.where("piece = 0").collect()), key=lambda x: (x is not None, x or 0)) == [None, 1, 1, 4, 5, 6]


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text("a"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}").count() == 0
