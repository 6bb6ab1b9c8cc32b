from pyspark.sql import functions as F

from findery.llm import quality
from findery.session import table


def test_good_documents_stay_and_bad_ones_go(spark, sf01):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    drawn = quality.resample(docs, labels).toPandas()
    assert drawn.doc_id.is_unique and sorted(drawn["rank"]) == list(range(1, len(drawn) + 1))
    marked = labels.toPandas()
    kept = marked.doc_id.isin(set(drawn.doc_id))
    assert kept[marked.quality == 1].mean() > 0.995 and kept[marked.quality == 0].mean() < 0.1
    kept_docs = quality.keep_drawn(docs, labels)
    assert kept_docs.columns == docs.columns and kept_docs.count() == len(drawn)


def test_labels_carry_over_to_documents_without_one(spark, sf01):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    half = labels.where(F.col("doc_id") % 2 == 0)
    drawn = {r["doc_id"] for r in quality.resample(docs, half).collect()}
    rest = labels.where(F.col("doc_id") % 2 == 1).toPandas()
    kept = rest.doc_id.isin(drawn)
    assert kept[rest.quality == 1].mean() > 0.99 and kept[rest.quality == 0].mean() < 0.15


def test_gumbel_top_k_draws_in_proportion(spark):
    # two texts, so weights differ by a constant: the heavier is drawn first more often
    docs = spark.createDataFrame([(i, "aaa bbb" if i % 2 else "xyz zyx") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40)], "doc_id long, quality int")
    drawn = quality.resample(docs, labels, k=1000).toPandas()
    assert len(drawn) == 1000 and (drawn.doc_id % 2 == 1).mean() > 0.9
    flat = quality.resample(docs, labels.where("quality > 5"), k=1000).toPandas()
    assert abs((flat.doc_id % 2).mean() - 0.5) < 0.08
    again = quality.resample(docs.repartition(3), labels, k=1000).toPandas()
    assert set(again.doc_id) == set(drawn.doc_id)


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, "t"), (1, 1, "t"), (7, 0, "t"), (None, 1, "t"), (10, None, "t"), (12, 5, "t")],
                                   "doc_id long, quality int, text string")
    for own in (labels, labels.where("doc_id = -1")):
        rows = quality.resample(odd_docs, own).collect()
        assert 0 < len(rows) <= odd_docs.count()
        assert quality.resample(no_docs, own).count() == 0
        assert quality.keep_drawn(odd_docs, own).columns == odd_docs.columns
    assert quality.resample(odd_docs, labels.where("doc_id = -1")).count() == odd_docs.count()


def test_conflicting_labels_teach_nothing(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    assert sorted(tuple(r) for r in quality._sample(labels, "doc_id").collect()) == [(2, 1), (3, 0)]
