import zlib

from findery.llm import langid
from findery.session import table


def test_held_out_accuracy(spark, sf01):
    docs = table(spark, sf01, "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))
    wordy = got[got.held_out & (got.text.str.len() > 20)]
    assert (wordy.lang == wordy.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_held_out_rows_teach_nothing(spark, sf01):
    docs = table(spark, sf01, "documents").select("doc_id", "text", "lang")
    from pyspark.sql import functions as F
    lied = docs.withColumn("lang", F.when(langid.id_crc() % 3 == 1, F.lit("xx")).otherwise(F.col("lang")))
    a = {tuple(r) for r in langid.identify(docs).collect()}
    assert a == {tuple(r) for r in langid.identify(lied).collect()}


def test_odd_tables(spark, odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0.0 for i in (7, 8, 9, 14))
    assert {r["lang_pred"] for r in rows} <= {"en", "de", "und"}
    assert langid.identify(no_docs).count() == 0
    untaught = odd_docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.identify(untaught).collect()} == {"und"}
