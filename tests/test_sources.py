"""Files: numbering over several splits, tolerant scans, conversion, caches, streams."""

import gzip
import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from findery.operators import cache as cache_module
from findery.operators.cache import embed_with_cache, merge_cache
from findery.operators.encode import embed_texts, encoded_rows, hashed_words
from findery.plans import search as S
from findery.sources import lines as L
from findery.sources import passages as P
from findery.sources import ranges as R
from findery.sources import vectors as V

NAMES = ["late--raw_passages_0-0-of-1.jsonl", "b--raw_passages_10-0-of-1.jsonl", "b--raw_passages_2-0-of-1.jsonl",
         "a--raw_passages_0-1-of-2.jsonl", "bad--raw_passages_0-0-of-1.jsonl"]


@pytest.fixture()
def corpus(tmp_path):
    written = {}
    for n, name in enumerate(NAMES):
        rows = [json.dumps({"id": f"{n}-{i}", "text": "é" * (i % 50) + f" text {i}"}, ensure_ascii=False) for i in range(400)]
        if name.startswith("bad"):
            rows[1] = "{broken"
        if name.startswith("a--"):
            rows[250] = '{"id": "cut'
        written[name] = rows
        (tmp_path / name).write_text("\n".join(rows) + "\n", encoding="utf-8")
    return str(tmp_path), written


def test_numbering_over_many_splits(spark, corpus):
    path, written = corpus
    staged = L.scan_text(spark, path, range_bytes=4096)
    assert staged.select("path", "block").distinct().count() > len(NAMES) * 2
    splits = L.split_table(staged)
    validity = L.file_validity(splits)
    assert {r["filename"] for r in validity.where("NOT valid").collect()} == {NAMES[4]}
    assert {r["valid"]: r["n_files"] for r in L.valid_counts(validity).collect()} == {True: 4, False: 1}
    numbered = L.corpus_ids(staged, splits, ["late"])
    rows = P.parse_passages(numbered).join(L.line_offsets(numbered).select("index_id", "position"), "index_id")
    got = rows.orderBy("index_id").collect()
    order = [NAMES[3], NAMES[2], NAMES[1], NAMES[0]]
    want, at = [], 0
    for name in order:
        place = 0
        for i, line in enumerate(written[name]):
            good = not line.endswith("cut")
            record = json.loads(line) if good else {"id": None, "text": None}
            want.append((at, name, i, place, record["id"], record["text"]))
            at, place = at + 1, place + len(line.encode()) + 1
    assert [(r["index_id"], r["filename"], r["line_no"], r["position"], r["passage_id"], r["text"]) for r in got] == want


def test_text_is_never_stored_or_shuffled_to_be_numbered(spark, corpus, monkeypatch):
    path, _ = corpus
    monkeypatch.setattr(L, "stage", None)
    monkeypatch.setattr(L, "scratch_path", None)
    lines = L.scan_text(spark, path, range_bytes=4096)
    offsets = L.line_offsets(L.corpus_ids(lines, L.split_table(lines))).select("index_id", "position")
    plan = offsets._jdf.queryExecution().executedPlan().toString()
    assert "text_ranges" in plan and "Exchange hashpartitioning" not in plan
    assert offsets.count() == 1600


@pytest.mark.parametrize("end", ["", "\n"])
def test_ranges_hold_every_line_once(tmp_path, end):
    body = "\n".join(["a", "", "bb" * 40, "", "", "é" * 9, "c"] * 7) + end
    (tmp_path / "x.txt").write_text(body, encoding="utf-8")
    data = body.encode()
    want = [x for x in (body[:-1] if end else body).encode().split(b"\n")]
    for size in (1, 2, 3, 7, 50, 1000):
        for read in (1, 5, 64, 4096):
            got = []
            for r in R.planned(R.listed(str(tmp_path)), size):
                with open(r.path, "rb") as f:
                    for first, lines in R.lines_of(f, r.start, r.length, read):
                        for line in lines:
                            assert r.start <= first < r.start + r.length
                            assert data[first: first + len(line)] == line
                            got.append(line)
                            first += len(line) + 1
            assert got == want


def test_ranges_of_odd_files(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"ok\n\xff\xfe\nend")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "_hidden.txt").write_bytes(b"no\n")
    (tmp_path / "part").mkdir()
    with gzip.open(tmp_path / "part" / "z.gz", "wb") as f:
        f.write(b"one\ntwo\n")
    rows = R.read_ranges(spark, f"file://{tmp_path}", 4).orderBy("path", "offset").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["offset"], r["n_bytes"], r["value"]) for r in rows] == [
        ("bad.txt", 0, 3, "ok"), ("bad.txt", 3, 3, "\ufffd\ufffd"), ("bad.txt", 6, 4, "end"),
        ("z.gz", 0, 4, "one"), ("z.gz", 4, 4, "two")]
    (tmp_path / "none").mkdir()
    assert R.read_ranges(spark, str(tmp_path / "none")).count() == 0
    assert not R.readable("viewfs://store/x") and not R.readable(str(tmp_path / "missing"))


def test_staged_lines_give_the_same_offsets(spark, corpus, monkeypatch):
    path, _ = corpus
    columns = ["filename", "line_no", "position", "index_id"]
    ranged = L.scan_text(spark, path, 4096)
    want = sorted(map(tuple, L.line_offsets(L.corpus_ids(ranged, L.split_table(ranged))).select(columns).collect()))
    monkeypatch.setattr(L, "readable", lambda _: False)
    staged = L.scan_text(spark, path)
    assert sorted(map(tuple, L.line_offsets(L.corpus_ids(staged, L.split_table(staged))).select(columns).collect())) == want


def test_tsv_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "p.tsv").write_text('id\ttext\ttitle\n1\t"say ""hi""\nthere"\tT\n2\t plain \t\n', encoding="utf-8")
    got = {r["id"]: (r["text"], r["title"]) for r in P.read_tsv(spark, str(tmp_path)).collect()}
    assert got == {"1": ('say "hi"\nthere', "T"), "2": (" plain ", "")}


def test_example_arrays_and_strides(spark, tmp_path):
    for n in range(2):
        rows = [{"question": f"{n}-{i}", "positive_ctxs": [{"title": "", "text": "x"}]} for i in range(7)]
        (tmp_path / f"part{n}.json").write_text(json.dumps(rows))
    staged = P.stage_examples(spark, str(tmp_path), array=True)
    numbered = L.attach(staged, L.with_starts(L.split_table(staged)))
    share = P.stride(numbered, 4, 1).orderBy("counter").collect()
    assert [(r["counter"], r["question"]) for r in share] == [(1, "0-0"), (5, "0-4"), (9, "1-1"), (13, "1-5")]
    assert P.stride(numbered, 4, -1, maxload=5).count() == 5


def test_query_lines(spark, tmp_path):
    lines = ['{"query": "one"}', "", '{"query": "", "full_text": "two"}', '{"query": 5, "question": "x"}', "plain ",
             '{"question": "three"}', '{"query": [], "question": "four"}', '{"a": 1}', '"text"']
    (tmp_path / "q.jsonl").write_text("\n".join(lines) + "\n")
    numbered = L.number_lines(L.scan_text(spark, str(tmp_path)))
    got = [r["query"] for r in P.load_queries(numbered).orderBy("line_no").collect()]
    assert got == ["one", "two", '{"query": 5, "question": "x"}', "plain", "three", "four", '{"a": 1}', '"text"']
    assert P.load_queries(numbered, 3).count() == 2
    assert P.load_queries(numbered, json_lines=False).first()["query"] == lines[0]


def test_one_shard_keeps_global_ids(spark, tmp_path):
    rows = spark.range(30).select(F.col("id").alias("vec_id"), (F.col("id") % 3).cast("int").alias("shard_id"),
                                  F.array(F.col("id").cast("float")).alias("embedding"))
    V.write_shards(V.chunk_ids(rows), str(tmp_path / "s"))
    got = V.load_shards(spark, str(tmp_path / "s"), "chunk_id", shard_id=1)
    assert sorted((r["index_id"], r["vec_id"]) for r in got.collect()) == [(10 + i, 1 + 3 * i) for i in range(10)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "passages_01" in plan.split("PartitionFilters")[1] or plan.count("passages_01") > 0


def test_missing_chunk_is_an_error(spark, tmp_path):
    rows = spark.range(50).withColumnRenamed("id", "index_id")
    meta = V.split_metadata(rows, 20, 4, "Flat")
    V.write_chunks(V.split_vectors(rows, 20), meta, str(tmp_path / "ok"))
    assert V.combine_chunks(spark, str(tmp_path / "ok")).count() == 50
    V.write_chunks(V.split_vectors(rows.where("index_id < 20 OR index_id >= 40"), 20), meta, str(tmp_path / "short"))
    with pytest.raises(ValueError, match="incomplete"):
        V.combine_chunks(spark, str(tmp_path / "short"))


def test_conversion_fails_whole_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("b", 2, [float("inf"), 0.0]), ("b", 3, [1.0, 1.0]), ("d", 4, [0.5, 0.25])],
                                 "file string, vec_id long, embedding array<double>")
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "file string")
    report = V.conversion_report(rows, files, spark.createDataFrame([("d",)], "file string"))
    got = {r["file"]: (r["ok"], r["message"]) for r in report.collect()}
    assert got == {"a": (True, "ok (rows=1)"), "b": (False, "error: Non-finite value (NaN/Inf) in b"), "c": (False, "no rows"),
                   "d": (True, "skip (exists) d")}
    V.write_converted(rows, report, str(tmp_path / "out"))
    back = V.read_converted(spark, str(tmp_path / "out"))
    assert [(r["id"], r["embedding"]) for r in back.collect()] == [("1", [1.0, 2.0])]
    off = back.withColumn("embedding", F.transform("embedding", lambda x: x + 1))
    first = rows.where("file = 'a'")
    assert V.verify_prefix(first, back, 5).first()["ok"] and not V.verify_prefix(first, off, 5).first()["ok"]


class Counting:
    """Encoder that marks its texts; an empty text gives a vector that is not finite."""

    def __call__(self, texts):
        return np.array([[len(t), float("nan") if not t else 1.0] for t in texts])


def test_cache_encodes_only_what_is_new(spark, tmp_path):
    docs = spark.createDataFrame([("a", "xx"), ("b", "yyy"), ("c", "")], "passage_id string, text string")
    cache = str(tmp_path / "cache")
    first = {r["passage_id"]: r["cached"] for r in embed_with_cache(docs.where("passage_id <> 'b'"), cache, Counting).collect()}
    assert first == {"a": False}  # the vector of the empty text is dropped
    second = {r["passage_id"]: (r["cached"], r["embedding"]) for r in embed_with_cache(docs, cache, Counting).collect()}
    assert second == {"a": (True, [2.0, 1.0]), "b": (False, [3.0, 1.0])}
    assert spark.read.parquet(cache).count() == 2


def test_misses_are_found_from_ids_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w" * (i % 9)) for i in range(1, 60)], "passage_id long, text string").repartition(4)
    cache = str(tmp_path / "cache")
    embed_with_cache(docs.where("passage_id < 30"), cache, Counting).count()
    known = cache_module.read_cache(spark, cache, "passage_id", "bigint")
    ids = cache_module.known_ids(docs, known, "passage_id")
    plan = ids._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange" in line]
    assert moved and "text" not in "".join(moved) and "embedding" not in "".join(moved)
    absent = ids.where("stored = 0")
    texts = cache_module.with_ids(docs, absent, "passage_id", absent.count(), 1)
    above = texts._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in above and "hashpartitioning" not in above
    assert sorted(r["passage_id"] for r in texts.collect())[0] >= 1


def test_merged_batches_hold_every_vector_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    for n in range(9):
        docs = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(3 * n, 3 * n + 5)], "passage_id long, text string")
        embed_with_cache(docs, cache, Counting).count()
        merge_cache(spark, cache, fanout=2)
    # an overlapping run stored ids again
    spark.createDataFrame([(0, [1.0, 1.0])], "passage_id long, embedding array<double>").write.parquet(f"{cache}/generation=0/batch=again")
    stored = spark.read.parquet(cache)
    assert stored.count() == 30 and stored.select("passage_id").distinct().count() == 29
    assert stored.select("generation", "batch").distinct().count() <= 4
    docs = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(30)] + [(3, "twice"), (None, "no id")], "passage_id long, text string")
    got = embed_with_cache(docs, cache, Counting).collect()
    assert sorted((r["passage_id"], r["cached"]) for r in got) == [(i, i < 29) for i in range(30)]
    assert merge_cache(spark, str(tmp_path / "none")) == 0


def test_encoder_options(spark):
    docs = spark.createDataFrame([(1, "AB"), (2, None)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in embed_texts(docs, "id", "text", Counting, instruction="ask: ", lower=True, normalize=True).collect()}
    assert got[1] == pytest.approx([7 / np.hypot(7, 1), 1 / np.hypot(7, 1)]) and len(got) == 2
    assert np.linalg.norm(hashed_words(8)(["a b a"])) == pytest.approx(1.0)


def test_request_checks(spark):
    rows = [(1, "q", None, None, None, None, None, None), (2, "q", 3, 8, True, True, None, 5), (3, None, 1, 1, False, False, None, None)]
    requests = spark.createDataFrame(rows, "query_id long, query string, n_docs int, nprobe int, exact_search boolean, "
                                           "diverse_search boolean, lambda double, min_words int")
    valid, rejected = S.split_requests(requests)
    assert valid.first()["n_docs"] == 1 and valid.first()["nprobe"] == 32 and valid.count() == 1
    assert {r["query_id"]: r["error"] for r in rejected.collect()} == {2: "missing_lambda", 3: "missing_query"}


def test_lines_of_a_passage_file_follow_the_ids_whatever_the_scan_order(spark, tmp_path):
    docs = spark.range(4000).repartition(7).withColumn("passage_file", F.concat(
        F.lit("d"), F.pmod("id", F.lit(3)).cast("string"), F.lit("--raw_passages_0-0-of-1.jsonl")))
    out = str(tmp_path / "passages")
    P.write_passages(docs.select("passage_file", F.to_json(F.struct("id")).alias("value"), "id"), out, order_col="id")
    lines = L.number_lines(L.scan_text(spark, out, range_bytes=2048)).select("filename", "line_no", "value").collect()
    assert sorted((r["filename"], r["line_no"], json.loads(r["value"])["id"]) for r in lines) == sorted(
        (f"d{i % 3}--raw_passages_0-0-of-1.jsonl", i // 3, i) for i in range(4000))


def test_an_encoder_holds_few_texts_of_a_batch(spark):
    texts = pa.array([f"{i} " * 10_000 for i in range(1500)])  # about 60 MB
    encoder = lambda part: np.array([[len(t)] for t in part], np.float64)
    tracemalloc.start()
    got = encoded_rows(texts, encoder, 64)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:, 0].tolist() == [len(t.as_py()) for t in texts] and most < 20 << 20
