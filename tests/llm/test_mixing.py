import re

import pytest
from pyspark.sql import functions as F

from findery.llm import mixing
from findery.session import table
from tests.llm.conftest import make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Deal by weight, cap, deal the excess again, until nothing is above a cap."""
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, left, out = set(order), share * sum(sizes.values()), {}
    while free:
        total = sum(w[s] for s in free)
        full = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not full:
            return out | {s: left * w[s] / total for s in free}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        free -= full
    return out


def check(spark, docs, near):
    got = mixing.taken_words(docs).toPandas()
    texts = docs.select("doc_id", "source", "text").toPandas()
    want = sorted(len(WORD.findall(t or "")) for t in texts.text)
    assert sorted(got["size"]) == want
    sizes = {}
    for s, t in zip(texts.source, texts.text):
        s = s if isinstance(s, str) else None
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    goal = targets(sizes)
    assert (got.taken <= 2 * got["size"]).all()
    for s, size in sizes.items():
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert set(own.source_size) == {size}
        assert own.target.tolist() == pytest.approx([goal[s]] * len(own))
        assert abs(own.taken.sum() - goal[s]) <= near(goal[s])
    return got


def test_targets_and_taken_words(spark, sf01):
    docs = table(spark, sf01, "documents")
    got = check(spark, docs, lambda goal: 0.01 * goal + 2 * mixing.BLOCK_WORDS)
    again = mixing.taken_words(docs.repartition(5)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_text_holds_the_words_taken(spark, sf01):
    docs = table(spark, sf01, "documents")
    text = mixing.mixed_text(docs).toPandas()
    taken = mixing.taken_words(docs).where("taken > 0").toPandas().set_index("doc_id").taken.sort_index()
    words = text.text.map(lambda t: len(WORD.findall(t))).groupby(text.doc_id).sum().sort_index()
    assert words.to_dict() == taken.to_dict()
    whole = {r["doc_id"]: " ".join(WORD.findall(r["text"])) for r in docs.collect()}
    assert all(t in whole[i] for i, t in zip(text.doc_id, text.text))
    # a slot is one block: full unless the last of its source
    per_slot = text.text.map(lambda t: len(WORD.findall(t))).groupby(text.slot).sum()
    assert per_slot.max() == mixing.BLOCK_WORDS and sorted(per_slot.index) == list(range(len(per_slot)))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_one_to_one(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("k")).alias("p")).toPandas().p
    assert sorted(got) == list(range(n))
    assert n < 90 or (got == range(n)).sum() < n / 10


def test_shards_follow_the_weights(spark):
    docs = make_docs(spark, [(i, "w " * 600, "en", "abc"[i % 3]) for i in range(900)])
    mix = mixing.Mix(docs)
    per = mix.slots.groupBy((F.col("slot") / 1000).cast("int").alias("s"), "source").count().toPandas()
    shares = per.pivot(index="s", columns="source", values="count").iloc[:5]
    expected = mix.sources.toPandas().set_index("source").slots
    for s in "abc":
        share = expected[s] / expected.sum()
        assert (abs(shares[s] / 1000 - share) < 5 * (share * (1 - share) / 1000) ** 0.5 + 1e-9).all()


def test_odd_tables(spark, odd_docs, no_docs):
    got = check(spark, odd_docs, lambda goal: 0.01 * goal + 2 * mixing.BLOCK_WORDS)
    assert len(got) == odd_docs.count()
    assert mixing.taken_words(no_docs).count() == 0 and mixing.mixed_text(no_docs).count() == 0
    blank = make_docs(spark, [(1, None), (2, ""), (2, "")])
    assert [r["taken"] for r in mixing.taken_words(blank).collect()] == [0, 0, 0]
    assert mixing.mixed_text(blank).count() == 0
    text = mixing.mixed_text(odd_docs).toPandas()
    want = got.groupby(got.doc_id.fillna(-1)).taken.sum()
    words = text.text.map(lambda t: len(WORD.findall(t))).groupby(text.doc_id.fillna(-1)).sum()
    assert words.to_dict() == want[want > 0].to_dict()


def test_no_python_in_the_plan(odd_docs):
    for plan in (mixing.taken_words(odd_docs), mixing.mixed_text(odd_docs)):
        shape = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in shape and "Arrow" not in shape and "Cartesian" not in shape and "NestedLoop" not in shape


def test_slots_are_made_by_many_tasks(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "repeat('word ', 60) as text", "cast(id % 3 as string) as source")
    slots = mixing.Mix(docs).slots
    used = slots.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(used) > 2 and "REPARTITION_BY_NUM" in slots._jdf.queryExecution().executedPlan().toString()
