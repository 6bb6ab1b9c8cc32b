import zlib

from pyspark.sql import functions as F

from findery.llm import toxicity
from findery.session import table
from tests.llm.conftest import make_docs


def test_held_out_labels(spark, sf01):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = toxicity.score(docs, labels).join(labels, "doc_id", "left").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    test = got[got.held_out & got.toxic.notna()]
    right = ((test.predicted == 1) & (test.toxic == 1)).sum()
    assert right / (test.predicted == 1).sum() > 0.9 and right / (test.toxic == 1).sum() > 0.85


def test_held_out_labels_teach_nothing(spark, sf01):
    docs, labels = table(spark, sf01, "documents"), table(spark, sf01, "labels")
    lied = labels.withColumn("toxic", F.when(toxicity.id_crc() % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lied).collect()}
    assert a == b


def test_folding():
    fold = toxicity.Folder().fold
    assert fold("1d1ot, Stuріd CⅼOWN pa7het1c").split() == ["idiot", "stupid", "clown", "pathetic"]
    assert fold("L0ser! 2024 and 10") == " loser and "
    assert fold("") == " " and fold("ＭＯＲＯＮ") == " moron "


def test_matches_exceptions_and_words():
    m = toxicity.Matcher({" clown": 2.0, " idiot ": 3.0, " id": 1.0})
    assert m.measure("A CLOWN, clowns and an idiot") == (7.0, 3, 6)
    assert m.measure("the clown fish swims, idiots too") == (1.0, 1, 6)
    assert m.measure("nonclown") == (0.0, 0, 1) and m.measure("") == (0.0, 0, 0)


def test_odd_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    odd = spark.createDataFrame([(1, 1, "t"), (1, 0, "t"), (None, 1, "t"), (10, None, "t"), (99, 1, "t"), (3, 0, "t")],
                                "doc_id long, toxic int, text string")
    for labels in (none, odd):
        rows = toxicity.score(odd_docs, labels).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert toxicity.score(no_docs, labels).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.score(odd_docs, none).collect())
    bad = make_docs(spark, [(i, f"you {'stupid' if i % 2 else 'lovely'} thing number {i}") for i in range(80)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    rows = toxicity.score(bad, labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows)


def test_rare_words_enter_the_lexicon_and_copies_do_not(spark):
    counts = spark.createDataFrame([("", 10_000, 10_000), (" scumbag ", 0, 40), (" chance ", 0, 6), (" both ", 50, 60)],
                                   toxicity.STEM_DOCS)
    assert set(toxicity._lexicon(counts)) == {" scumbag "}
    rows = [(i, f"you {'stupid' if i % 2 else 'lovely'} thing number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}")
            for i in range(100)] + [(i, "ZEBRA, of one text.") for i in range(100, 160)]
    labels = spark.createDataFrame([(i, 1 if i >= 100 else i % 2) for i in range(160)], "doc_id long, toxic int")
    lexicon = toxicity.fit(make_docs(spark, rows), labels).lexicon
    assert any(x.startswith(" stup") for x in lexicon) and not any(x.startswith(" zebr") for x in lexicon)


def test_conflicting_labels_teach_nothing(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:3]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1), (ids[0], 0), (ids[1], 1), (ids[1], 1), (ids[2], 0)], "doc_id long, toxic int")
    got = sorted(tuple(r) for r in toxicity.labelled(docs, labels, "doc_id", "text").collect())
    assert got == [(0, f"text {ids[2]}"), (1, f"text {ids[1]}")]
