import corpus_pipeline as cp
import pytest
from saiflow.llm.common import table


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, sf):
    docs = table(spark, sf, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    toxic = cp.drop_toxic(spark, docs, sf)
    near = cp.drop_near_copies(spark, docs, sf)
    cut = cp.cut_repeats(spark, docs, sf)
    clean = cp.drop_benchmark(spark, docs, sf)
    for step in (toxic, near, cut, clean):
        assert step.columns == docs.columns and step.dtypes == docs.dtypes
    assert {r.doc_id for r in toxic.collect()} <= set(before)
    assert 0 < near.count() < len(before)
    for r in cut.collect():
        assert r.n_chars == len(r.text) <= len(before[r.doc_id].text)
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    left = {r.doc_id for r in clean.collect()}
    assert left == {d for d, r in before.items() if not any(i in r.text for i in items)}


def test_run_equals_its_stages(spark, sf):
    docs = table(spark, sf, "documents")
    for _, step in cp.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, sf).collect(), docs.schema)
    packed = cp.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096


def test_edge_rows(spark, sf, edge_docs, no_docs):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, no_docs.select(*docs.columns)):
        now = start
        for _, step in cp.STAGES:
            out = step(spark, now, sf).collect()
            now = spark.createDataFrame(out, docs.schema) if out and len(out[0]) == 5 else now
        assert (len(out) == 0) == (start is not docs)


def test_columns_of_any_name_are_carried(spark, sf):
    """Columns that operators add by the same name stay the document's own; a null text stays null."""
    names = ["score", "predicted", "kept", "spans", "n_bytes", "component_id", "_doc"]
    docs = table(spark, sf, "documents").limit(40).unionByName(spark.createDataFrame([(9001, None, "en", "s", None)], table(spark, sf, "documents").schema))
    for c in names:
        docs = docs.withColumn(c, cp.F.concat(cp.F.lit(c), cp.F.col("doc_id").cast("string")))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for _, step in cp.STAGES[:-1]:
        out = step(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
        assert [r.text for r in rows if r.doc_id == 9001] == [None]
