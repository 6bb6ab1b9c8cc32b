"""Prefix sums, reranking, expansion, ranks and training rules against plain Python."""

import random
import re
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from findery.operators import containment
from findery.operators import passages as passages_module
from findery.operators import rerank as rerank_module
from findery.operators import prefix, ranks, training
from findery.operators.metrics import evaluate_run, without_self
from findery.operators.passages import expand_context
from findery.operators.rerank import drop_redundant, rerank_exact, rerank_mmr
from findery.plans import search as S


@pytest.fixture(scope="module")
def hot(spark):
    """300 rows, two thirds in one group, ids with holes."""
    return spark.createDataFrame(
        [("hot" if i % 3 else f"g{i % 5}", i * 7, (i * 37) % 11) for i in range(300)], "g string, id long, v long").repartition(6)


def test_blocked_numbers_and_sums(hot):
    pdf = hot.toPandas().sort_values(["g", "id"])
    df = hot.withColumn("b", prefix.id_block("id", 100))
    got = prefix.blocked_row_number(df, ["g"], "b", ["id"], "n")
    got = prefix.blocked_running_sum(got, ["g"], "b", ["id"], F.col("v"), "before").toPandas().sort_values(["g", "id"])
    assert (got["n"].to_numpy() == pdf.groupby("g").cumcount().to_numpy() + 1).all()
    assert (got["before"].to_numpy() == (pdf.groupby("g")["v"].cumsum() - pdf["v"]).to_numpy()).all()


def test_ranked_rows_spread_a_hot_group(hot):
    got = prefix.ranked_rows(hot, ["g"], [F.col("v").desc(), F.col("id").asc()], "n").toPandas()
    want = hot.toPandas().sort_values(["g", "v", "id"], ascending=[True, False, True])
    want["n"] = want.groupby("g").cumcount() + 1
    assert got.set_index("id")["n"].to_dict() == want.set_index("id")["n"].to_dict()


def test_inversions_without_pairs(spark):
    rng = np.random.default_rng(3)
    lists = {0: rng.permutation(120), 1: np.arange(9)[::-1], 2: np.arange(5), 3: np.array([0])}
    ranking = spark.createDataFrame(
        [(k, p, int(v)) for k, x in lists.items() for p, v in enumerate(x)], "list long, pos long, val long")
    got = {r["list"]: r["inversions"] for r in ranks.inversions(ranking, "list").collect()}
    assert got == {k: sum(int(a > b) for i, a in enumerate(x) for b in x[i + 1:]) for k, x in lists.items()}


def test_inversions_of_long_lists_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    lists = {0: rng.permutation(9000), 1: rng.permutation(4097), 2: rng.permutation(4096), 3: np.array([4096, 1, 8191, 4095]), 4: np.array([7])}
    rows = [(k, p, int(v)) for k, x in lists.items() for p, v in enumerate(x)]
    odd = [(None, 0, 5), (None, 1, 4), (4, None, 0), (4, 1, None), (5, None, 1), (6, 0, 3), (6, 1, 3), (6, 2, 1), (6, 2, 1)]
    ranking = spark.createDataFrame(rows + odd, "list long, pos long, val long")
    got = {r["list"]: r["inversions"] for r in ranks.inversions(ranking, "list").collect()}
    assert got == {k: int(sum((x[i + 1:] < x[i]).sum() for i in range(len(x)))) for k, x in lists.items()} | {6: 4}


def test_inversions_move_rows_before_they_get_bits(spark):
    ranking = spark.createDataFrame([(0, p, 99 - p) for p in range(100)], "list long, pos long, val long")
    plan = ranks.inversions(ranking, "list")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("_bit" in line for line in dealt) and "Join" not in plan


def test_inversions_of_a_long_list_leave_one_task(spark):
    ranking = spark.createDataFrame([(0, p, 4999 - p) for p in range(5000)], "list long, pos long, val long")
    plan = ranks.inversions(ranking, "list")._jdf.queryExecution().executedPlan().toString()
    dealt = [re.sub(r"#\d+L?", "", line) for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("(list, _bit, _high, _b, 8), REPARTITION_BY_COL" in line for line in dealt)


def test_running_sum_by_block_as_key(spark):
    rows = spark.createDataFrame([(0, 0, 1, 5), (0, 0, 2, 6), (0, 1, 3, 7), (None, 0, 1, 8), (0, None, 1, 9)], "g int, b int, i int, v int")
    got = prefix.blocked_running_sum(rows, ["g", "b"], "b", ["i"], F.col("v"), "before").orderBy("i").collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, 5, 0), (0, 0, 2, 6, 5), (0, 1, 3, 7, 0)]


def test_rank_agreement(spark):
    x = [2, 0, 5, 1, 3, 4]
    ranking = spark.createDataFrame([(0, p, v) for p, v in enumerate(x)], "list long, pos long, val long")
    got = {r["k"]: r for r in ranks.evaluate_ranking(ranking, "list", [2, 10]).collect()}
    assert got[2]["overlap"] == 0.5 and got[2]["depth"] == 4
    assert got[10]["overlap"] == 1.0 and got[10]["depth"] == 6


def candidates(spark):
    rng = np.random.default_rng(5)
    return [(q, i, i + 1, float(1 - i / 40), rng.normal(size=6).tolist()) for q in range(3) for i in range(30)]


def python_mmr(rows, lam, n):
    mat = np.array([r[4] for r in rows])
    mat /= np.linalg.norm(mat, axis=1, keepdims=True)
    rel, chosen = np.array([r[3] for r in rows]), []
    while len(chosen) < n:
        best = max((i for i in range(len(rows)) if i not in chosen),
                   key=lambda i: (lam * rel[i] - (1 - lam) * max(mat[i] @ mat[j] for j in chosen), -i) if chosen else (rel[i], -i))
        chosen.append(best)
    return chosen


@pytest.mark.parametrize("lam", [0.0, 0.3, 1.0, 7.0])
def test_mmr(spark, lam):
    rows = candidates(spark)
    df = spark.createDataFrame(rows, "query_id long, vec_id long, rank long, score double, embedding array<double>")
    got = rerank_mmr(df, "embedding", "score", lam, limit=8).orderBy("query_id", "rank").collect()
    for q in range(3):
        mine = [r["vec_id"] for r in got if r["query_id"] == q]
        assert mine == python_mmr([r for r in rows if r[0] == q], min(1.0, lam), 8)
        if lam >= 1:
            assert mine == list(range(8))  # all weight on relevance keeps its order


def test_lazy_picks_equal_the_plain_loop():
    rng = np.random.default_rng(12)
    for n, weight in ((1, 0.5), (40, 0.0), (40, 0.2), (40, 1.0), (300, 0.5), (300, 0.8)):
        mat = rng.normal(size=(n, 8))
        mat[n // 2:] = mat[: n - n // 2] + 0.01 * mat[n // 2:]  # near copies
        mat /= np.linalg.norm(mat, axis=1, keepdims=True)
        relevance = np.sort(rng.random(n))[::-1].copy()
        picks, values, products = rerank_module.mmr_order(mat, relevance, weight, n)
        score, closest, open_rows, want = relevance.copy(), np.full(n, -np.inf), np.ones(n, bool), []
        for _ in range(n):
            at = int(np.argmax(np.where(open_rows, np.round(score, 9), -np.inf)))
            want.append((at, score[at]))
            open_rows[at] = False
            closest = np.maximum(closest, mat @ mat[at])
            score = weight * relevance - (1 - weight) * closest
        assert picks == [a for a, _ in want]
        np.testing.assert_allclose(values, [v for _, v in want], atol=1e-12)
    few = rerank_module.mmr_order(mat, relevance, 0.8, 10)
    assert len(few[0]) == 10 and few[2] < 10 * len(mat) / 4  # the plain loop takes picks x candidates
    assert rerank_module.mmr_order(mat[:0], relevance[:0], 0.5, 0) == ([], [], 0)


def test_redundancy_in_tiles():
    mat = np.random.default_rng(2).normal(size=(57, 5))
    mat /= np.linalg.norm(mat, axis=1, keepdims=True)
    whole = rerank_module.redundancy(mat)
    sims = np.round(mat @ mat.T, 9)
    np.testing.assert_allclose(whole[2], sims.mean(axis=1))
    np.fill_diagonal(sims, -np.inf)
    assert (whole[0] == sims.max(axis=1)).all()
    assert (whole[1] == np.where(np.tri(57, k=-1, dtype=bool), sims, -np.inf).max(axis=1)).all()
    for cells in (1, 100, 1000):
        for a, b in zip(rerank_module.redundancy(mat, cells), whole):
            np.testing.assert_allclose(a, b, atol=2e-9)


def test_tiles_bound_the_memory():
    mat = np.random.default_rng(2).normal(size=(20_000, 8))
    mat /= np.linalg.norm(mat, axis=1, keepdims=True)
    tracemalloc.start()
    rerank_module.redundancy(mat)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_containment_index_equals_all_pairs():
    rng = random.Random(4)
    for alphabet, most in (("ab", 9), ("abc", 40), ("abcdefgh é", 120)):
        for _ in range(60):
            texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(most))) for _ in range(rng.randrange(1, 25))]
            for _ in range(10):
                outer = rng.choice(texts)
                a, b = sorted((rng.randrange(len(outer) + 1), rng.randrange(len(outer) + 1)))
                texts.append(outer[a:b])
            rng.shuffle(texts)
            named = sorted(set(texts) - {""})
            pairs = {(i, o) for i, t in enumerate(named) for o, s in enumerate(named) if i != o and t in s}
            assert set(containment.contained_pairs(named)) == pairs
            kept: list[int] = []
            for at, text in enumerate(texts):
                if not any(text in texts[k] or texts[k] in text for k in kept):
                    kept.append(at)
            assert containment.first_apart(texts) == kept


def test_containment_of_many_long_texts():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=800)) for _ in range(1000)]
    texts[500] = texts[3][100:2000]
    texts[700] = "x" + texts[8] + "y"
    start = time.time()
    kept = containment.first_apart(texts)
    assert set(range(1000)) - set(kept) == {500, 700} and time.time() - start < 60


def test_exact_rerank_is_stable_and_survives_nan(spark):
    df = spark.createDataFrame([
        (0, 10, 1, [float("nan"), 1.0]), (0, 11, 2, [1.0, 0.0]), (0, 12, 3, [2.0, 0.0]), (0, 13, 4, [0.0, 1.0]),
    ], "query_id long, vec_id long, rank long, e array<double>").withColumn("q", F.array(F.lit(1.0), F.lit(0.0)))
    got = rerank_exact(df, "q", "e").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [11, 12, 13, 10] and got[-1]["exact_score"] == -1.0


def test_redundant_texts_are_dropped_in_rank_order(spark):
    texts = ["a cat sat", "cat", "dog", "a cat sat down", "the dog", "bird"]
    df = spark.createDataFrame([(0, i, i + 1, t) for i, t in enumerate(texts)], "query_id long, vec_id long, rank long, text string")
    assert [r["vec_id"] for r in drop_redundant(df).orderBy("rank").collect()] == [0, 2, 5]


def test_expansion_edges(spark):
    corpus = spark.createDataFrame(
        [(0, " a ", "s--x"), (1, "", "s--x"), (2, "c", "s--x"), (3, "d", "t--y")], "index_id long, text string, filename string"
    ).withColumn("position", F.lit(0).cast("long"))
    hits = corpus.select(F.lit(1).cast("long").alias("query_id"), "index_id")
    got = {r["index_id"]: r for r in expand_context(hits, corpus, 1).collect()}
    assert {k: r["text"] for k, r in got.items()} == {0: "a", 1: "a   c", 2: "c d", 3: "c d"}
    assert got[0]["original_text"] == "a" and got[3]["source"] == "t"
    near = {r["index_id"]: r["text"] for r in expand_context(hits, corpus, 2, within="filename").collect()}
    assert near == {0: "a  c", 1: "a   c", 2: "a  c", 3: "d"}
    assert expand_context(spark.createDataFrame([(1, 99)], "query_id long, index_id long"), corpus, 1).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_expansion_over_block_borders(spark, monkeypatch, few):
    """Gaps, hot passages, mixed offsets and sides against a plain loop; blocks of eight ids, cells of three hits."""
    monkeypatch.setattr(passages_module, "HALO_IDS", 8)
    monkeypatch.setattr(passages_module, "HALO_HITS", 3)
    if not few:
        monkeypatch.setattr(passages_module, "_few", lambda *_: None)
    rng = np.random.default_rng(8)
    ids = sorted(rng.choice(120, 90, replace=False).tolist())
    rows = [(i, None if i % 13 == 0 else "" if i % 7 == 0 else f"t{i}", ["f--a", "f--b", None][i // 40], i) for i in ids]
    corpus = spark.createDataFrame(rows, "index_id long, text string, filename string, position long").repartition(5)
    asked = [(q, int(rng.choice([*ids, 7, 300])) if q % 3 else ids[17], q % 4) for q in range(120)] + [(500, None, 1)]
    hits = spark.createDataFrame(asked, "query_id long, index_id long, o int")

    def plain(centre, o, within):
        at = {r[0]: r for r in rows}
        near = [at[i] for i in range(centre - o, centre + o + 1) if i in at and (i == centre or at[i][1])]
        if within:
            near = [r for r in near if r[2] is not None and r[2] == at[centre][2]]
        return " ".join(r[1] or "" for r in near).strip()

    present = set(ids)
    for within in (None, "filename"):
        fixed = {r["query_id"]: r["text"] for r in passages_module.expand_context(hits.drop("o"), corpus, 2, within=within).collect()}
        assert fixed == {q: plain(i, 2, within) for q, i, _ in asked if i in present}
        varied = passages_module.expand_context(hits, corpus, "o", within=within).collect()
        assert {r["query_id"]: r["text"] for r in varied} == {q: plain(i, o, within) for q, i, o in asked if i in present}
        assert all((r["original_text"] is None) == (r["o"] != 1 or dict((x[0], x[1]) for x in rows)[r["index_id"]] is None) for r in varied)
    plan = passages_module.expand_context(hits.drop("o"), corpus, 2)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in x for x in plan.split("\n")) == (1 if not few else 2)  # few: ids alone


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "x", 3), (2, "c", 1)], "query_id long, doc_id string, rank long")
    qrels = spark.createDataFrame([(1, "b", 2), (1, "z", 1), (1, "a", 0), (3, "q", 1)], "query_id long, doc_id string, rel int")
    got = {(r["query_id"], r["k"]): r for r in evaluate_run(run, qrels, [1, 3]).collect()}
    assert set(got) == {(1, 1), (1, 3), (3, 1), (3, 3)}
    r = got[1, 3]
    assert r["ndcg"] == pytest.approx((2 / np.log2(3)) / (2 + 1 / np.log2(3)))
    assert (r["map"], r["recall"], r["mrr"]) == (0.25, 0.5, 0.5)
    assert r["precision"] == pytest.approx(1 / 3) and r["recall_cap"] == 0.5 and r["hole"] == pytest.approx(1 / 3)
    assert got[3, 3]["ndcg"] == 0.0 and got[1, 1]["recall_cap"] == 0.0
    own = spark.createDataFrame([(1, "1", 1), (1, "b", 2)], "query_id long, doc_id string, rank long")
    assert [(x["doc_id"], x["rank"]) for x in without_self(own).collect()] == [("b", 1)]


def test_chunks_cross_documents(spark):
    docs = [("a", i, list(range(100 * i, 100 * i + n))) for i, n in enumerate([5, 0, 13, 1, 9, 40])]
    df = spark.createDataFrame(docs, "dataset string, doc_id long, tokens array<int>").repartition(3)
    offset = df.select(training.dataset_offset(F.lit("a"), 8, "s")).first()[0]
    stream = [t for _, _, x in docs for t in x][offset:]
    got = {r["chunk_id"]: r["tokens"] for r in training.token_chunks(df, 8, "s").collect()}
    assert got == {i: stream[i * 8:i * 8 + 8] for i in range(len(stream) // 8)}


def test_token_rules(spark):
    df = spark.range(200).withColumn("t", F.transform(F.sequence(F.lit(0), F.lit(49)), lambda x: x.cast("int")))
    key = F.col("id")
    out = df.select(
        training.delete_words(F.col("t"), 0.2, "d", key).alias("d"), training.mask_words(F.col("t"), -1, 0.2, "m", key).alias("m"),
        training.replace_words(F.col("t"), 100, 109, 0.2, "r", key).alias("r"),
        training.shuffle_words(F.col("t"), 0.2, "s", key).alias("s"),
        training.random_crop(F.col("t"), 0.1, 0.5, "c", key).alias("c"), training.add_ends(F.col("t"), None, 7).alias("e"),
    ).toPandas()
    share = lambda f: np.mean([f(x) for x in out.itertuples()])
    assert 0.75 < share(lambda x: len(x.d) / 50) < 0.85
    assert 0.15 < share(lambda x: np.mean(np.array(x.m) == -1)) < 0.25
    changed = [v for x in out.r for v in x if v >= 100]
    assert 0.15 < len(changed) / 10000 < 0.25 and set(changed) == set(range(100, 110))
    assert all(sorted(x) == list(range(50)) for x in out.s) and any(list(x) != list(range(50)) for x in out.s)
    for c in out.c:
        assert 5 <= len(c) <= 25 and list(c) == list(range(c[0], c[0] + len(c)))
    assert list(out.e[0]) == [*range(50), 7]


def test_array_split_equals_numpy(spark):
    for n, world in ((10, 3), (3, 5), (12, 4)):
        got = training.array_split(spark.range(n).withColumnRenamed("id", "index_id"), world).toPandas().sort_values("index_id")
        want = np.concatenate([[i] * len(p) for i, p in enumerate(np.array_split(np.arange(n), world))])
        assert (got["part"].to_numpy() == want).all()


def test_weights_and_mix(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, "big").otherwise("small").alias("dataset"),
                                    F.when(F.col("id") < 900, F.col("id")).otherwise(F.col("id") - 900).alias("chunk_id"))
    even = {r["dataset"]: r["weight"] for r in training.sampling_weights(rows, "dataset", 0.0).collect()}
    assert even == {"big": 0.5, "small": 0.5}
    mixed = training.mix_datasets(rows, spark.range(4000).withColumnRenamed("id", "sample_id"), 0.0, "m").toPandas()
    assert len(mixed) == 4000 and 0.45 < (mixed["dataset"] == "small").mean() < 0.55


def test_examples(spark):
    schema = "example_id long, question string, positive_ctxs array<struct<title:string,text:string>>, " \
             "negative_ctxs array<struct<title:string,text:string>>, hard_negative_ctxs array<struct<title:string,text:string>>"
    ctx = lambda *xs: [("T" if i % 2 else "", x) for i, x in enumerate(xs)]
    df = spark.createDataFrame([(i, "q…", ctx("p0", "p1"), ctx("n0", "n1", "n2"), ctx("h0", "h1", "h2")) for i in range(60)], schema)
    rows = training.training_examples(df, 4, 0.5, 1, "x", normalize=True).collect()
    assert {r["gold"] for r in rows} == {"p0", "T p1"} and {r["query"] for r in rows} == {"q..."}
    for r in rows:
        hard = [x for x in r["negatives"] if "h" in x]
        assert len(set(r["negatives"])) == len(r["negatives"]) and "h0" not in hard and len(hard) <= 2
        assert len(r["negatives"]) - len(hard) <= 3
    first = training.training_examples(df, 4, 0.5, 1, "x", training=False).first()
    assert (first["gold"], first["negatives"]) == ("p0", ["n0"])


def test_pad_batch(spark):
    df = spark.createDataFrame([(0, [1, 2]), (0, [3]), (1, [4])], "b long, tokens array<int>")
    got = {tuple(r["ids"]): r["mask"] for r in training.pad_batch(df, ["b"]).collect()}
    assert got == {(1, 2): [True, True], (3, 0): [True, False], (4,): [True]}


def test_inbatch_by_numpy(spark):
    rng = np.random.default_rng(1)
    q, k = rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    df = spark.createDataFrame(pd.DataFrame({"batch_id": 0, "pair_id": range(6), "q": q.tolist(), "k": k.tolist()}))
    got = training.inbatch_stats(df, 0.5).first()
    s = q @ k.T / 0.5
    log_p = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
    assert got["loss"] == pytest.approx(-np.diag(log_p).mean())
    assert got["accuracy"] == pytest.approx(100 * (s.argmax(axis=1) == np.arange(6)).mean())


def test_an_answer_does_not_depend_on_its_batch(spark):
    rng = np.random.default_rng(11)
    vecs, asked = rng.normal(size=(300, 8)), rng.normal(size=(4, 8))
    texts = [f"passage {i} " + "word " * (i % 7) for i in range(300)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    passages = spark.createDataFrame(
        [(i, str(i), t, "f--raw_passages_0-0-of-1.jsonl", i) for i, t in enumerate(texts)],
        "index_id long, passage_id string, text string, filename string, position long")
    requests = spark.createDataFrame([
        (0, "plain", 5, None, False, False, None, 4, asked[0].tolist()),
        (1, "deep", 60, None, False, False, None, None, asked[1].tolist()),
        (2, "exact", 5, None, True, False, None, None, asked[2].tolist()),
        (3, "diverse", 5, None, False, True, 0.5, None, asked[3].tolist()),
    ], "query_id long, query string, n_docs int, nprobe int, exact_search boolean, diverse_search boolean, lambda double, "
       "min_words int, query_emb array<double>")
    valid, rejected = S.split_requests(requests)
    assert rejected.count() == 0
    second = vectors.where("vec_id % 3 <> 0")  # a third of the hits has no vector

    def answer(rows):
        found = S.search(rows, S.FlatIndex(vectors), second, passages, fetch_k=20).collect()
        return {(r["query_id"], r["rank"], r["index_id"], r["exact_score"]) for r in found}

    whole = answer(valid)
    alone = [answer(valid.where(F.col("query_id") == i)) for i in range(4)]
    assert whole == set().union(*alone) and [len(a) for a in alone] == [5, 60, 5, 5]


def test_a_fetch_reads_only_the_blocks_of_its_hits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(passages_module, "BLOCK_IDS", 50)
    rows = spark.range(1000).select(F.col("id").alias("index_id"), F.concat(F.lit("text "), "id").alias("text"))
    passages_module.write_blocks(rows, str(tmp_path / "blocks"), "index_id")
    stored = spark.read.parquet(str(tmp_path / "blocks"))
    hits = spark.createDataFrame([(1, 3), (1, 49), (2, 870)], "query_id long, index_id long")
    kept = passages_module.in_blocks(stored, hits, "index_id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [id_block" in plan
    assert kept.count() == 100 and kept.columns == rows.columns
    assert passages_module.in_blocks(rows, hits, "index_id") is rows


def test_requests_beyond_the_limits_are_rejected(spark):
    rows = spark.createDataFrame(
        [(1, "a", 0, None, None), (2, "b", 10**6, None, None), (3, "c", 5, 7, 10**6), (4, "d", 5, 7, 3), (5, "e", None, None, None)],
        "query_id long, query string, n_docs int, expand_index_id long, expand_offset int")
    rows = rows.selectExpr("*", "cast(null as int) as nprobe", "cast(null as boolean) as exact_search",
                           "cast(null as boolean) as diverse_search", "cast(null as double) as lambda")
    valid, rejected = S.split_requests(rows)
    assert {r["query_id"]: r["error"] for r in rejected.collect()} == {1: "bad_n_docs", 2: "bad_n_docs", 3: "bad_expand_offset"}
    assert {r["query_id"] for r in valid.collect()} == {4, 5}


def test_running_sums_over_sparse_ids(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("id"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5).alias("g"),
                                    (F.col("id") % 7).alias("n"))
    got = prefix.ranged_running_sum(rows, ["g"], [F.col("id")], F.col("n"), "at").toPandas().sort_values(["g", "id"])
    want = got.groupby("g").n.cumsum() - got.n
    assert len(got) == 5000 and (got["at"] == want).all()


def test_shuffled_tokens_are_moved_but_never_compared(spark):
    rows = spark.range(20).select("id", F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.create_map(i, i)).alias("t"))
    moved = training.shuffle_words(F.col("t"), 0.5, "s", F.col("id"))
    out = rows.select("id", F.transform(moved, lambda m: F.map_keys(m)[0]).alias("t"))
    plain = rows.select("id", F.transform("t", lambda m: F.map_keys(m)[0]).alias("t"))
    plain = plain.select("id", moved.alias("t"))
    got = {r["id"]: r["t"] for r in out.collect()}
    assert got == {r["id"]: r["t"] for r in plain.collect()}
    assert all(sorted(t) == list(range(30)) for t in got.values()) and sum(t != list(range(30)) for t in got.values()) > 15
