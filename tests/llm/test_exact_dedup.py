import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from findery.llm import exact_dedup


def groups_of(docs, keep):
    by_text = defaultdict(list)
    for r in docs.collect():
        by_text[r["text"] or ""].append(r["doc_id"])
    out = []
    for text, ids in by_text.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        free = True
        for i in ids:
            kept = i == best and free
            free = free and not kept
            out.append((i, best, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups_equal_brute_force(odd_docs, keep):
    got = exact_dedup.duplicate_groups(odd_docs, keep=keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == groups_of(odd_docs, keep)


def test_one_text_over_many_runs(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("x" * 500)).otherwise(
        F.concat(F.lit("x" * 40), F.col("id").cast("string"))).alias("text"))
    got = exact_dedup.duplicate_groups(docs.repartition(7), keep="largest").where("group_size > 1").toPandas()
    assert len(got) == 2000 and set(got.keep_id) == {2999} and got.kept.sum() == 1


def test_normalised_copies(spark, odd_docs):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    kept = exact_dedup.drop_duplicates(docs, normalise=F.lower)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_drop_keeps_columns_and_one_of_each(odd_docs, no_docs):
    kept = exact_dedup.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert sorted((r["doc_id"] for r in rows), key=repr) == sorted([1, 7, 9, 10, 12, 13, None], key=repr)
    assert exact_dedup.drop_duplicates(no_docs).count() == 0
    assert exact_dedup.duplicate_groups(no_docs).count() == 0


def test_no_python_and_no_second_exchange_before_the_comparison(spark, odd_docs):
    plan = exact_dedup.drop_duplicates(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
