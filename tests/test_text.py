"""Text and context rules on hand-made cases."""

import hashlib
import json
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from findery.functions import text as T
from findery.functions.context import canonical_context, context_hash
from findery.functions.qa import exact_match, has_answer, token_f1, token_line
from findery.functions.vectors import cosine, half_precision, is_finite, unit


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw", ["  A b\t\nC ", " x\x1cy\x0bz", "", "ÉCOLE  Straße", "one"])
def test_normalize_query(spark, raw):
    want = " ".join(raw.strip().lower().split())
    assert one(spark, T.normalize_query(F.col("q")), q=raw) == want
    assert one(spark, T.query_hash(F.col("q")), q=raw) == hashlib.sha1(want.encode()).hexdigest()


def test_missing_query_is_empty(spark):
    assert spark.range(1).select(T.normalize_query(F.lit(None).cast("string"))).first()[0] == ""


@pytest.mark.parametrize("ctx", [
    {}, {"nprobe": 32, "exact_search": False, "diverse_search": True, "lambda": 0.5},
    {"nprobe": 8, "exact_search": True, "diverse_search": False, "lambda": 0.7},
    {"diverse_search": True, "lambda": 1.0}, {"exact_search": True},
])
def test_context_hash(spark, ctx):
    kept = {k: v for k, v in ctx.items() if k != "lambda" or ctx.get("diverse_search")}
    want = hashlib.sha1(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    lit = lambda k, t: F.lit(ctx.get(k)).cast(t)
    c = canonical_context(lit("nprobe", "int"), lit("exact_search", "boolean"), lit("diverse_search", "boolean"),
                          lit("lambda", "double"))
    assert spark.range(1).select(context_hash(c)).first()[0] == want


@pytest.mark.parametrize("raw, want", [
    ("a‑b—c−d", "a-b-c-d"), ("“x” ‘y’ `z´", "\"x\" 'y' 'z'"), ("5′ 6″ 7‴ 8⁗", "5' 6'' 7''' 8''''"),
    ("wait… . . . end", "wait... ... end"), ("1⁄2∕3", "1/2/3"), ("so­ft\u0007\u001a", "soft"),
    ("a\u000bb\u000cc\u0085d", "a b c d"), ("~˜", "~˜"), ("\u0010\u0000", "\u0010\u0000"),
])
def test_normalize_punctuation(spark, raw, want):
    assert one(spark, T.normalize_punctuation(F.col("t")), t=raw) == want


def test_answers(spark):
    assert one(spark, T.normalize_answer(F.col("t")), t=" The  Cat's, a hat (an) éa") == "cats hat éa"
    assert one(spark, T.drop_articles(F.col("t")), t="The cat, A hat") == "cat, hat"
    assert one(spark, exact_match(F.col("p"), F.array(F.col("t"))), p="the Cat!", t="cat")
    f1 = one(spark, token_f1(F.col("p"), F.array(F.lit("x y"), F.col("t"))), p="red red cat", t="red cat cat")
    assert f1 == pytest.approx(2 / 3)
    assert one(spark, token_f1(F.col("p"), F.array(F.col("t"))), p="one", t="two") == 0.0


def test_token_f1_of_odd_bags(spark):
    long = " ".join(f"w{i % 700}" for i in range(3000))
    cases = [
        ("red red cat", ["red cat cat", "red red red cat"]), ("a b a", ["b", None, ""]), ("the", ["an"]), ("", [""]), (None, ["x"]), ("x", []),
        ("x", None), ("one two", ["three"]), ("b a c c", ["c b c b c"]), ("x\u00011 x", ["x x", "x\u00011"]), (long, [long + " w1", "w3 w3 w3 w3 w3 w3"]),
    ]

    def expected(prediction, truths):
        best, mine = 0.0, Counter(w for w in (prediction or "").split() if w not in ("a", "an", "the"))
        for truth in truths or []:
            theirs = Counter(w for w in (truth or "").split() if w not in ("a", "an", "the"))
            if same := (mine & theirs).total():
                p, r = same / mine.total(), same / theirs.total()
                best = max(best, 2 * p * r / (p + r))
        return best

    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p string, t array<string>")
    got = {r["i"]: r["f1"] for r in rows.select("i", token_f1(F.col("p"), F.col("t")).alias("f1")).collect()}
    assert got == {i: expected(*c) for i, c in enumerate(cases)}


def test_token_f1_makes_each_bag_once(spark):
    rows = spark.createDataFrame([("x", ["x"])], "p string, t array<string>").select(token_f1(F.col("p"), F.col("t")).alias("f1"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(lower(") == 2  # of the prediction and of a truth
    assert "array_append" not in plan  # copies what it has so far for each word


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t"), True), t="GPT-3 costs 5€\n​Été") == ["gpt", "-", "3", "costs", "5", "€", "été"]
    assert one(spark, T.extract_keywords(F.col("t")), t="Tell me about smart-home, What is GPT-3? GPT-3!") == [
        "smart-home", "gpt-3", "gpt-3"]


def test_has_answer(spark):
    ask = lambda answer, text: one(spark, has_answer(F.array(token_line(F.col("a"))), token_line(F.col("t"))), a=answer, t=text)
    assert ask("New York", "in new   york city")
    assert not ask("York New", "in new york city")
    assert not ask("ork", "new york")
    assert ask(unicodedata.normalize("NFD", "café"), "Le CAFÉ noir")
    assert ask("  ", "anything")  # an answer without tokens matches


def test_labels_and_titles(spark):
    assert one(spark, T.source_label(F.col("f")), f="wiki--raw_passages_0-1-of-2.jsonl") == "wiki"
    assert one(spark, T.source_label(F.col("f"), strict=True), f="wiki.jsonl") == "unknown"
    assert one(spark, T.title_text(F.col("a"), F.col("b")), a="", b="text") == "text"
    assert one(spark, T.has_min_words(F.col("t"), F.lit(3)), t=" a  b ") is False
    assert one(spark, T.has_min_words(F.col("t"), F.lit(0)), t="") is True


def test_vector_edges(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([float("nan"), 1.0], [3.0, 4.0]), ([1e-8, 65504.0], [0.1, -2.5])],
                               "a array<double>, b array<double>")
    got = df.select(cosine(F.col("a"), F.col("b")).alias("c"), is_finite(F.col("a")).alias("f"),
                    unit(F.col("b")).alias("u"), half_precision(F.col("b").cast("array<float>")).alias("h")).collect()
    assert got[0]["c"] == 0.0 and got[0]["f"] and not got[1]["f"]
    assert got[1]["u"] == pytest.approx([0.6, 0.8])
    assert got[2]["h"] == pytest.approx([0.0999755859375, -2.5])
