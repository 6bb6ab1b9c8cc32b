import corpus_pipeline
from findery.llm import decontaminate, jaccard
from findery.llm.common import stage
from findery.session import table


def test_stages_hand_on_documents(spark, sf01):
    docs = table(spark, sf01, "documents")
    labels = table(spark, sf01, "labels").toPandas()
    columns, sizes = docs.columns, [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, sf01), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "quality":
            kept = labels.doc_id.isin({r["doc_id"] for r in docs.select("doc_id").collect()})
            assert kept[labels.quality == 1].mean() > 0.98
        if name == "exact_dedup":
            assert docs.select("text").distinct().count() == sizes[-1]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
    groups = jaccard.jaccard_groups(docs).collect()
    assert all(r["doc_id"] == r["component_id"] for r in groups)
    assert decontaminate.find_leaks(docs, table(spark, sf01, "benchmark")).count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf01)
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in mixed.select("doc_id").distinct().collect()} <= ids
    assert mixed.columns == ["shard", "slot", "part", "source", "doc_id", "text"]
