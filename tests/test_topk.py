"""The nearest-neighbour plans against brute force, hot groups included."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from findery.operators import ivf, kmeans, pq, rerank, topk
from findery.operators.kmeans import group_means


def frame(spark, ids, mat, id_col, vec_col, **extra):
    return spark.createDataFrame(pa.table({id_col: ids, vec_col: mat.tolist(), **extra}))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(600, 16))
    vecs[300:320] = vecs[0]  # copies tie with the original
    qs = rng.normal(size=(9, 16))
    return vecs, qs


def brute(qs, vecs, k, allowed=None):
    scores = np.round(qs @ vecs.T, 9)
    out = set()
    for q in range(len(qs)):
        ids = np.arange(len(vecs)) if allowed is None else np.array(sorted(allowed[q]))
        order = sorted(ids, key=lambda i: (-scores[q, i], i))[:k]
        out |= {(q, r + 1, int(i)) for r, i in enumerate(order)}
    return out


def rows(df, id_col="vec_id"):
    return {(r["query_id"], r["rank"], r[id_col]) for r in df.collect()}


@pytest.mark.parametrize("budget_q, budget_v", [(1 << 20, 1 << 20), (2000, 1 << 20), (2000, 1), (1, 1)])
def test_flat_strategies_agree(spark, data, monkeypatch, budget_q, budget_v):
    vecs, qs = data
    q = frame(spark, range(9), qs, "query_id", "query_emb")
    v = frame(spark, range(600), vecs, "vec_id", "embedding").repartition(5)
    real = topk.pack_if_small
    monkeypatch.setattr(topk, "pack_if_small", lambda df, i, c, _: real(df, i, c, budget_v))
    assert rows(topk.knn_flat(q, v, 25, max_bytes=budget_q)) == brute(qs, vecs, 25)


def test_many_blocks_of_queries_ship_no_more_rows(spark, data):
    vecs, qs = data
    q = frame(spark, range(9), qs, "query_id", "query_emb")
    blocks = list(topk.query_blocks(q, "query_id", "query_emb", 25, max_bytes=2000))
    assert [b.rows for b in blocks] == [3, 3, 3] and [list(b.ids) for b in blocks][1] == [3, 4, 5]
    assert [b.rows for b in topk.query_blocks(q.where("query_id < 0"), "query_id", "query_emb", 25)] == [0]


@pytest.mark.parametrize("size", [1e-9, 1e-6, 1.0, 1e6])
def test_lengths_do_not_change_the_order(data, size):
    vecs, qs = data
    order = lambda best: best[2].reshape(len(qs), -1).tolist()
    whole = topk.RunningTopK(topk.lengths(qs), 25)
    whole.offer(np.arange(9), qs @ vecs.T, np.arange(600), topk.lengths(vecs))
    small, running = vecs * size, topk.RunningTopK(topk.lengths(qs * size), 25)
    for at in range(0, 600, 37):
        part = small[at: at + 37]
        running.offer(np.arange(9), (qs * size) @ part.T, np.arange(at, at + len(part)), topk.lengths(part))
    assert order(running.best()) == order(whole.best())
    assert {(q, r + 1, i) for q, ids in enumerate(order(whole.best())) for r, i in enumerate(ids)} == brute(qs, vecs, 25)


def test_entry_bars_change_nothing_but_the_traffic(spark, data):
    vecs, qs = data
    v = frame(spark, range(600), vecs, "vec_id", "embedding").repartition(36)
    packed = topk.Packed(np.arange(9), qs)
    bar = topk.entry_bars(v, packed, 5, "vec_id", "embedding")
    assert bar is not None and np.isfinite(bar).all()
    plain = topk.scan_topk(v, packed, 5, "vec_id", "embedding")
    barred = topk.scan_topk(v, packed, 5, "vec_id", "embedding", bar=bar)
    assert barred.count() < plain.count()
    assert rows(topk.best_per_query(barred, 5, "query_id", "vec_id")) == brute(qs, vecs, 5)


def test_ragged_vectors_are_refused(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 2.0])], "query_id long, query_emb array<double>")
    with pytest.raises(Exception, match="one dimension"):
        topk.knn_flat(q, v.coalesce(1), 1).collect()


@pytest.fixture(scope="module")
def index(spark, data):
    vecs, _ = data
    v = frame(spark, range(600), vecs, "vec_id", "embedding")
    return ivf.build_index(v, n_lists=12, sample_size=400, iterations=3)


def test_full_probe_equals_flat(spark, data, index):
    vecs, qs = data
    q = frame(spark, range(9), qs, "query_id", "query_emb")
    assert rows(ivf.knn_ivf(q, index.postings, index.centroids, 20, nprobe=12)) == brute(qs, vecs, 20)


def test_partial_probe_sees_its_lists_only(spark, data, index):
    vecs, qs = data
    q = frame(spark, range(9), qs, "query_id", "query_emb", n=[1, 2, 3] * 3)
    own = {r["vec_id"]: r["list_id"] for r in index.postings.collect()}
    order = np.argsort(-np.round(qs @ index.centroids.matrix.T, 9), axis=1, kind="stable")
    allowed = {i: {v for v, one in own.items() if one in order[i, : [1, 2, 3][i % 3]]} for i in range(9)}
    want = brute(qs, vecs, 10, allowed)
    assert rows(ivf.knn_ivf(q, index.postings, index.centroids, 10, nprobe="n")) == want
    beyond = ivf.knn_ivf(q, index.postings, index.centroids, 10, nprobe="n", max_bytes=1000)
    assert rows(beyond) == want  # the plan for many queries


def test_recall_grows_with_nprobe(spark, data, index):
    vecs, qs = data
    q, best = frame(spark, range(9), qs, "query_id", "query_emb"), {(a, c) for a, _, c in brute(qs, vecs, 20)}
    found = [len({(a, c) for a, _, c in rows(ivf.knn_ivf(q, index.postings, index.centroids, 20, n))} & best)
             for n in (1, 3, 6, 12)]
    assert found == sorted(found) and found[-1] == len(best)


def test_code_search_is_exact_on_decoded_vectors(spark, data, index):
    _, qs = data
    q = frame(spark, range(9), qs, "query_id", "query_emb")
    books = pq.train_codebooks(index.postings, index.centroids, 4, 16, 3)
    codes = pq.encode(index.postings, index.centroids, books)
    looked = pq.knn_ivfpq(q, codes, index.centroids, books, 10, nprobe=4)
    decoded = pq.decode(codes, index.centroids, books)
    assert rows(looked) == rows(ivf.knn_ivf(q, decoded, index.centroids, 10, 4, vec_col="approx"))
    assert rows(pq.knn_ivfpq(q, codes, index.centroids, books, 10, nprobe=4, max_bytes=20_000)) == rows(looked)


def test_codes_keep_most_neighbours(spark, data, index):
    vecs, qs = data
    q, best = frame(spark, range(9), qs, "query_id", "query_emb"), {(a, c) for a, _, c in brute(qs, vecs, 30)}
    books = pq.train_codebooks(index.postings, index.centroids, 8, 64, 5)
    codes = pq.encode(index.postings, index.centroids, books)
    got = {(a, c) for a, _, c in rows(pq.knn_ivfpq(q, codes, index.centroids, books, 30, nprobe=12))}
    assert len(got & best) >= 0.6 * len(best)


def test_training_lowers_the_gap(spark, data):
    vecs, _ = data
    v = frame(spark, range(600), vecs, "vec_id", "embedding")
    fit = lambda n: (vecs @ ivf.train_coarse(v, 12, n).matrix.T).max(axis=1).mean()
    assert fit(0) < fit(2) <= fit(6) + 1e-6


def test_sample_takes_its_share_of_a_hot_shard(spark):
    v = spark.range(900).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 800, 0).otherwise(F.col("id") % 4).alias("shard_id"))
    got = {r["shard_id"]: r["count"] for r in ivf.train_sample(v, 120, 4).groupBy("shard_id").count().collect()}
    assert got == {0: 30, 1: 25, 2: 25, 3: 25}


def test_group_means_over_many_batches(spark, data):
    vecs, _ = data
    v = frame(spark, range(600), vecs, "vec_id", "embedding").withColumn("g", F.when(F.col("vec_id") < 400, 0).otherwise(F.col("vec_id") % 7))
    got = {r["g"]: (r["n"], np.array(r["mean"])) for r in group_means(v.repartition(9), "g", "embedding").collect()}
    groups = np.where(np.arange(600) < 400, 0, np.arange(600) % 7)
    for g in range(7):
        n, mean = got[g]
        assert n == (groups == g).sum() and np.allclose(mean, vecs[groups == g].mean(axis=0))


def test_a_probe_reads_only_the_folders_of_its_lists(spark, data, index, tmp_path, monkeypatch):
    _, qs = data
    monkeypatch.setattr(ivf, "GROUP_LISTS", 2)
    path = str(tmp_path / "lists")
    ivf.write_postings(index.postings, path)
    ivf.write_centroids(spark, index.centroids, f"{path}-centroids")
    centroids = ivf.read_centroids(spark, f"{path}-centroids")
    assert np.array_equal(centroids.matrix, index.centroids.matrix)
    q = frame(spark, range(2), qs[:2], "query_id", "query_emb")
    found = ivf.knn_ivf(q, ivf.read_postings(spark, path), centroids, 10, nprobe=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list_group" in plan or "PartitionFilters: [list_group" in plan
    assert "PushedFilters: [In(list_id" in plan or "PushedFilters: [Or(" in plan
    assert rows(found) == rows(ivf.knn_ivf(q, index.postings, index.centroids, 10, nprobe=2))


def test_stored_codes_answer_like_fresh_ones(spark, data, index, tmp_path):
    vecs, qs = data
    q = frame(spark, range(9), qs, "query_id", "query_emb")
    books = pq.train_codebooks(index.postings, index.centroids, 4, 16, 3)
    path = str(tmp_path / "codes")
    old, new = index.postings.where("vec_id < 400"), frame(spark, range(400, 600), vecs[400:], "vec_id", "embedding")
    codes = pq.append_codes(pq.encode(old, index.centroids, books), new, index.centroids, books)
    ivf.write_postings(codes, path)
    pq.write_codebooks(spark, books, f"{path}-books")
    back = pq.read_codebooks(spark, f"{path}-books")
    assert np.array_equal(back.words, books.words)
    whole = pq.encode(index.postings, index.centroids, books)
    assert rows(pq.knn_ivfpq(q, ivf.read_postings(spark, path), index.centroids, back, 10, 4)) == rows(
        pq.knn_ivfpq(q, whole, index.centroids, books, 10, 4))


def test_twenty_query_blocks_share_one_scan(spark, data, tmp_path, monkeypatch):
    vecs, _ = data
    rng = np.random.default_rng(3)
    qs = rng.normal(size=(60, 16))
    frame(spark, range(600), vecs, "vec_id", "embedding").repartition(6).write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    q = frame(spark, range(60), qs, "query_id", "query_emb")
    monkeypatch.setattr(topk, "pack_if_small", lambda *_: None)
    budget = 3 * (8 * 16 + 8 + 16 * 25)
    found = topk.knn_flat(q, v, 25, max_bytes=budget)
    assert len(list(topk.query_blocks(q, "query_id", "query_emb", 25, budget))) == 20
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert rows(found) == brute(qs, vecs, 25)
    monkeypatch.setattr(topk, "CHUNK_BYTES", 40 * 16 * 8)  # several chunks of vectors in a task
    assert rows(topk.knn_flat(q, v.coalesce(1), 25, max_bytes=budget)) == brute(qs, vecs, 25)
    several = topk.knn_flat(q, v, 25, max_bytes=budget, scan_bytes=15 * 16 * 8)
    assert several._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 4
    assert rows(several) == brute(qs, vecs, 25)


def test_bars_of_many_blocks(spark, data, monkeypatch):
    vecs, _ = data
    qs = np.random.default_rng(4).normal(size=(30, 16))
    v = frame(spark, range(600), vecs, "vec_id", "embedding").repartition(25)
    q = frame(spark, range(100, 130), qs, "query_id", "query_emb")
    monkeypatch.setattr(topk, "pack_if_small", lambda *_: None)
    found = {(a - 100, b, c) for a, b, c in rows(topk.knn_flat(q, v, 5, max_bytes=4 * (8 * 16 + 8 + 16 * 5)))}
    assert found == brute(qs, vecs, 5)


def test_list_join_with_hot_lists(spark, data, index, monkeypatch):
    """Many queries meet their lists in cells; nothing about them is worked out on the driver."""
    vecs, _ = data
    qs = np.random.default_rng(5).normal(size=(200, 16))
    q = frame(spark, range(200), qs, "query_id", "query_emb", n=[1, 2, 3, None] * 50)
    own = {r["vec_id"]: r["list_id"] for r in index.postings.collect()}
    order = np.argsort(-np.round(qs @ index.centroids.matrix.T, 9), axis=1, kind="stable")
    allowed = {i: {v for v, one in own.items() if one in order[i, : [1, 2, 3, 32][i % 4]]} for i in range(200)}
    monkeypatch.setattr(ivf, "probes_of", None)
    for budget in (5_000, 30_000):  # lists of one cell and of many
        found = ivf.knn_ivf(q, index.postings, index.centroids, 10, nprobe="n", max_bytes=budget)
        assert rows(found) == brute(qs, vecs, 10, allowed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_cells_of_a_list_are_not_as_small_as_a_block(spark, data, index, monkeypatch):
    vecs, _ = data
    qs = np.random.default_rng(6).normal(size=(200, 16))
    q = frame(spark, range(200), qs, "query_id", "query_emb")
    real, grids = ivf.bounded, []
    monkeypatch.setattr(ivf, "bounded", lambda df, most: real(grids.append(df) or df, most))
    whole = rows(ivf.knn_ivf(q, index.postings, index.centroids, 10, nprobe=4, max_bytes=2_000))
    assert {(r["_rows"], r["_cols"]) for r in grids[-1].collect()} == {(1, 1)}
    cut = rows(ivf.knn_ivf(q, index.postings, index.centroids, 10, nprobe=4, max_bytes=2_000, cell_bytes=2_000))
    assert max(r["_rows"] * r["_cols"] for r in grids[-1].collect()) > 4
    assert whole == cut == rows(ivf.knn_ivf(q, index.postings, index.centroids, 10, nprobe=4))


def test_list_join_prunes_stored_folders(spark, data, tmp_path):
    vecs, _ = data
    index = ivf.build_index(frame(spark, range(600), vecs, "vec_id", "embedding"), n_lists=130, sample_size=600, iterations=1)
    ivf.write_postings(index.postings, str(tmp_path / "p"))
    stored = ivf.read_postings(spark, str(tmp_path / "p"))
    qs = np.repeat(vecs[:1], 50, axis=0)
    q = frame(spark, range(50), qs, "query_id", "query_emb")
    found = ivf.knn_ivf(q, stored, index.centroids, 3, nprobe=1, max_bytes=2_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_group" in plan.replace("PartitionFilters: [isnotnull(list_group", "PartitionFilters: [list_group")
    assert rows(found) == rows(ivf.knn_ivf(q, index.postings, index.centroids, 3, nprobe=1))


def test_centroids_in_blocks_are_the_same(spark, data):
    vecs, _ = data
    v = frame(spark, range(600), vecs, "vec_id", "embedding").repartition(5)
    whole = ivf.train_coarse(v, 24, 3)
    for size in (16 * 8, 7 * 16 * 8):  # one and seven centroids a block
        parts = ivf.train_coarse(v, 24, 3, max_bytes=size)
        np.testing.assert_allclose(parts.matrix, whole.matrix, atol=1e-9)
        near = topk.row_topk(v, "vec_id", "embedding", whole, 3, "list_id", ["embedding"], max_bytes=size)
        want = topk.row_topk(v, "vec_id", "embedding", whole, 3, "list_id", ["embedding"])
        assert sorted(near.drop("embedding").collect()) == sorted(want.drop("embedding").collect())


def test_folds_in_two_levels_are_the_same(spark, data, monkeypatch):
    vecs, _ = data
    v = frame(spark, range(600), vecs, "vec_id", "embedding", g=[i % 3 if i < 500 else 0 for i in range(600)]).repartition(20)
    want = {r["g"]: (r["n"], r["mean"]) for r in group_means(v, "g", "embedding").collect()}
    folds = []
    real = kmeans._folded
    monkeypatch.setattr(kmeans, "_folded", lambda *a: folds.append(a[1]) or real(*a))
    monkeypatch.setattr(kmeans.fold_means, "__defaults__", (4,))
    got = {r["g"]: (r["n"], r["mean"]) for r in group_means(v, "g", "embedding").collect()}
    assert folds == [False, True] and got.keys() == want.keys()
    for g in want:
        assert got[g][0] == want[g][0]
        np.testing.assert_allclose(got[g][1], want[g][1])


@pytest.mark.parametrize("budget_q, budget_v", [(1 << 20, 1 << 20), (100, 1 << 20), (100, 1)])
def test_with_digits_scores_tie_that_sql_rounds_to_the_same(spark, monkeypatch, budget_q, budget_v):
    first = np.array([0.3, 0.3 + 3e-10, 0.3 - 2e-10, 0.3 + 2e-9, 2.0 ** -10, 2.0 ** -10 + 4e-10])  # 2^-10: half a billionth
    vecs = np.stack([first, np.zeros(6)], axis=1)
    q = frame(spark, [0, 1], np.array([[1.0, 0.0], [1.0, 0.0]]), "query_id", "query_emb")
    v = frame(spark, range(6), vecs, "vec_id", "embedding").repartition(3)
    real = topk.pack_if_small
    monkeypatch.setattr(topk, "pack_if_small", lambda df, i, c, _: real(df, i, c, budget_v))
    best = topk.knn_flat(q, v, 6, max_bytes=budget_q, digits=9).collect()
    for one in (0, 1):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in best if r["query_id"] == one)
        assert [i for _, i, _ in mine] == [3, 0, 1, 2, 4, 5]
        assert [s for *_, s in mine] == [0.300000002, 0.3, 0.3, 0.3, 0.000976563, 0.000976563]


def test_with_digits_a_diverse_order_ties_by_place():
    mat = np.eye(3)
    assert rerank.mmr_order(mat, np.array([0.5, 0.5 + 3e-10, 0.2]), 0.5, 3, digits=9)[0] == [0, 1, 2]
    assert rerank.mmr_order(mat, np.array([0.5, 0.5 + 6e-9, 0.2]), 0.5, 3, digits=9)[0] == [1, 0, 2]


def test_choosing_the_best_holds_little_beside_the_vectors():
    rng = np.random.default_rng(1)
    qs, vecs = rng.normal(size=(400, 8)), rng.normal(size=(10_000, 8))
    running = topk.RunningTopK(topk.lengths(qs), 100)
    tracemalloc.start()
    for part in topk.row_blocks(len(vecs), len(qs)):
        running.offer(np.arange(400), qs @ vecs[part].T, np.arange(10_000)[part], topk.lengths(vecs[part]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 160 << 20
    assert running.best()[2].reshape(400, 100).tolist() == np.argsort(-(qs @ vecs.T), axis=1)[:, :100].tolist()


def test_small_blocks_of_queries_are_read_together(spark, data, monkeypatch):
    vecs, _ = data
    q = frame(spark, range(60), vecs[:60], "query_id", "query_emb").repartition(4)
    real, reads = topk.pack, []
    monkeypatch.setattr(topk, "pack", lambda *a: reads.append(real(*a)) or reads[-1])
    budget = 3 * (8 * 16 + 8 + 16 * 25)
    for read, sizes in ((topk.BROADCAST_BYTES, [60]), (7 * (8 * 16 + 8), [6] * 10)):  # whole blocks of a read
        monkeypatch.setattr(topk, "BROADCAST_BYTES", read)
        reads.clear()
        blocks = list(topk.query_blocks(q, "query_id", "query_emb", 25, budget))
        assert [r.rows for r in reads] == sizes
        assert [b.rows for b in blocks] == [3] * 20
        assert np.array_equal(np.concatenate([b.ids for b in blocks]), np.arange(60))
        assert np.array_equal(np.concatenate([b.matrix for b in blocks]), vecs[:60])


@pytest.fixture
def deep(spark, data, tmp_path, monkeypatch):
    """Vectors in a file of six parts, and small cells: six at least, so that their tasks are as many."""
    vecs, _ = data
    frame(spark, range(600), vecs, "vec_id", "embedding").repartition(6).write.parquet(str(tmp_path / "v"))
    monkeypatch.setattr(topk, "pack_if_small", lambda *_: None)
    monkeypatch.setattr(topk, "CELL_QUERIES", 7)
    return spark.read.parquet(str(tmp_path / "v")), 3 * (8 * 16 + 8 + 16 * 100)


def test_deep_answers_are_finished_where_they_are_found(spark, data, deep, monkeypatch):
    vecs, (v, budget) = data[0], deep
    qs = np.random.default_rng(8).normal(size=(60, 16))
    q = frame(spark, range(60), qs, "query_id", "query_emb")
    monkeypatch.setattr(topk, "TILE", 4)
    found = topk.knn_flat(q, v, 100, max_bytes=budget)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("FileScan parquet") == 1
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert rows(found) == brute(qs, vecs, 100)
    monkeypatch.setattr(topk, "CHUNK_BYTES", 40 * 16 * 8)  # best rows are kept from chunk to chunk
    assert rows(topk.knn_flat(q, v.repartition(6), 100, max_bytes=budget, digits=9)) == brute(qs, vecs, 100)
    several = topk.knn_flat(q, v, 100, max_bytes=budget, scan_bytes=15 * 16 * 8)
    assert several._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 4
    assert rows(several) == brute(qs, vecs, 100)


def test_a_large_block_is_cut_for_the_cores(spark, data, deep, monkeypatch):
    vecs, (v, _) = data[0], deep
    qs = np.random.default_rng(11).normal(size=(60, 16))
    real, sizes = topk.dealt_topk, []
    monkeypatch.setattr(topk, "dealt_topk", lambda v, cells, *a: sizes.extend(len(c.value[0]) for c in cells) or real(v, cells, *a))
    found = topk.knn_flat(frame(spark, range(60), qs, "query_id", "query_emb"), v, 100, max_bytes=30 * (8 * 16 + 8 + 16 * 100))
    assert sizes == [7, 7, 7, 7, 2] * 2
    assert rows(found) == brute(qs, vecs, 100)


def test_rows_of_one_query_id_share_its_deep_answer(spark, data, deep):
    vecs, (v, budget) = data[0], deep
    qs = np.random.default_rng(9).normal(size=(60, 16))
    ids = sorted([0, 0, 0, 0, 0, 1, 2, 3] + list(range(4, 30)) * 2)  # some come twice, one fills more than a block
    got = topk.knn_flat(frame(spark, ids, qs, "query_id", "query_emb"), v, 100, max_bytes=budget, digits=9)
    want = []
    scores = topk.rounded(qs @ vecs.T, 9)
    for one in set(ids):
        mine = sorted((-s, i) for at, other in enumerate(ids) if other == one for i, s in enumerate(scores[at]))
        want += [(one, n + 1, i) for n, (_, i) in enumerate(mine[:100])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("digits", [None, 9])
def test_the_first_bar_of_a_block_loses_no_row(digits):
    rng = np.random.default_rng(10)
    vecs = rng.integers(-2, 3, size=(500, 4)) / 7.0  # few scores, so ties at every depth
    qs = rng.integers(-2, 3, size=(20, 4)) / 3.0
    scores, sizes = qs @ vecs.T, topk.lengths(vecs)
    spoiled = scores.copy()
    spoiled[:, ::9] = np.nan  # sorted above all numbers, but never among the best
    for given in (scores, spoiled):
        running = topk.RunningTopK(topk.lengths(qs), 30, digits=digits)
        running.offer(np.arange(20), given, np.arange(500), sizes)
        q, s, i = running.best()
        for one in range(20):
            near = topk.comparable(given[one], topk.lengths(qs)[one], sizes, digits)
            left = [x for x in range(500) if not np.isnan(near[x])]
            want = sorted(left, key=lambda x: (-near[x], x))[:30]
            assert i[q == one].tolist() == want and s[q == one].tolist() == near[want].tolist()
