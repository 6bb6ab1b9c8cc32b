import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from findery.llm import common, line_dedup
from findery.session import table
from tests.llm.conftest import make_docs

PASSAGE = " ".join(f"Sentence number {i} of a passage that many pages share word for word." for i in range(6))


def brute(docs):
    places = defaultdict(set)
    for r in docs.collect():
        for a, b in line_dedup.chunks(r["text"] or ""):
            places[(r["text"] or "")[a:b]].add((r["doc_id"], a, b))
    return {(i, a, b, len(at), *min(at)[:2], (i, a) != min(at)[:2])
            for at in places.values() if len(at) > 1 for i, a, b in at}


def test_repeats_equal_brute_force(spark, sf01):
    docs = table(spark, sf01, "documents")
    got = line_dedup.repeated_chunks(docs)
    rows = [tuple(r) for r in got.select("doc_id", "start", "end", "copies", "keep_doc_id", "keep_start", "removed").collect()]
    assert len(rows) > 100 and len(rows) == len(set(rows)) and set(rows) == brute(docs)


def test_shared_passage_goes_but_once(spark):
    docs = make_docs(spark, [(i, f"Start {i} of page.\n{PASSAGE}\nEnd {i} of it.") for i in range(1, 300)]
                     + [(1000, "A text of its own. It has two sentences, and it must stay as it is, whole and all.")])
    cut = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated(docs).collect()}
    assert len(cut) == 300 and cut[1] == f"Start 1 of page.\n{PASSAGE}\nEnd 1 of it."
    assert all(cut[i] == f"Start {i} of page.\nEnd {i} of it." for i in range(2, 300))
    assert cut[1000].startswith("A text of its own.")


def test_boundaries_resist_shifts():
    lines = [f"line {i * 7919 % 1000} has some words" for i in range(200)]
    whole = Counter("\n".join(lines)[a:b] for a, b in line_dedup.chunks("\n".join(lines)))
    shifted = "one more line here\n" + "\n".join(lines[:90] + ["another new line put in"] + lines[90:])
    kept = Counter(shifted[a:b] for a, b in line_dedup.chunks(shifted))
    assert sum((whole & kept).values()) >= 0.9 * sum(whole.values())


def test_odd_tables(odd_docs, no_docs):
    got = line_dedup.drop_repeated(odd_docs)
    assert got.columns == odd_docs.columns
    before = sorted((tuple(r) for r in odd_docs.collect()), key=repr)
    assert sorted((tuple(r) for r in got.where("doc_id <> 11 or doc_id is null").collect()), key=repr) == [
        r for r in before if r[0] != 11]
    assert line_dedup.repeated_chunks(no_docs).count() == 0 and line_dedup.drop_repeated(no_docs).count() == 0


def random_words(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefghijklmnop", k=6)) for _ in range(n)]


def shared_words(one, other):
    """Words of ``other`` inside a run of 12 or more words that ``one`` has too, by comparing all pairs."""
    covered, last = set(), [0] * (len(other) + 1)
    for word in one:
        row = [0] * (len(other) + 1)
        for j, w in enumerate(other):
            if w == word:
                row[j + 1] = last[j] + 1
                if row[j + 1] >= 12:
                    covered.update(range(j + 1 - row[j + 1], j + 1))
        last = row
    return covered


def test_passages_inside_paragraphs_come_out_whole(spark):
    rows, want = [], {}
    for k in range(60):
        passage = random_words(f"p{k}", 50 + k)
        one, other = ([*random_words(f"a{k}{i}", 40), *passage, *random_words(f"b{k}{i}", 35)] for i in (0, 1))
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(other))]
        want[2 * k + 1] = shared_words(one, other)
        assert want[2 * k + 1] == set(range(40, 90 + k))
    got = {i: set() for i in want}
    for r in line_dedup.repeated_passages(make_docs(spark, rows)).where("removed").collect():
        text = rows[r["doc_id"]][1]
        assert text[r["start"]:r["end"]] == rows[r["keep_doc_id"]][1][r["keep_start"]:][:r["end"] - r["start"]]
        before = len(text[:r["start"]].split())
        got[r["doc_id"]] |= set(range(before, before + len(text[r["start"]:r["end"]].split())))
    assert got == want
    cut = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated(make_docs(spark, rows)).collect()}
    assert all(cut[i].split() == [w for j, w in enumerate(rows[i][1].split()) if j not in want[i]] for i in want)


def test_passages_of_short_lines_come_out_whole(spark):
    def lines(seed, n):
        words = random_words(seed, 9 * n)
        return [" ".join(words[9 * i: 9 * i + 9]) for i in range(n)]

    rows = []
    for k in range(60):
        passage = lines(f"p{k}", 6 + k % 4)
        rows += [(2 * k + i, "\n".join([*lines(f"a{k}{i}", 5), *passage, *lines(f"b{k}{i}", 4)])) for i in (0, 1)]
    cut = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated(make_docs(spark, rows)).collect()}
    for k in range(60):
        assert cut[2 * k] == rows[2 * k][1]
        assert cut[2 * k + 1].split("\n") == [*lines(f"a{k}1", 5), *lines(f"b{k}1", 4)]


def test_common_chunks_meet_like_rare_ones(spark, sf01, monkeypatch):
    docs = table(spark, sf01, "documents")
    rare = {tuple(r) for r in line_dedup.repeated_passages(docs).collect()}
    monkeypatch.setattr(line_dedup, "COMMON", 2)
    got = line_dedup.repeated_chunks(docs)
    rows = [tuple(r) for r in got.select("doc_id", "start", "end", "copies", "keep_doc_id", "keep_start", "removed").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs) and any(r[3] > 2 for r in rows) and any(r[3] == 2 for r in rows)
    assert {tuple(r) for r in line_dedup.repeated_passages(docs).collect()} == rare


def plain_length(one, other):
    most, blank, best = min(len(one), len(other)), " \t\n\v\f\r", 0
    for n in range(1, most):
        if one[:n] == other[:n] and one[n - 1] not in blank and (
                one[n] == other[n] == "\n" if "\n" in one[:n] else one[n] in blank and other[n] in blank):
            best = n
    return best


def test_same_length_equals_its_definition(monkeypatch):
    draw, one, other = random.Random(1), [], []
    for _ in range(5000):
        text = "".join(draw.choices("ab \n\té文\U0001f600 c", k=draw.randint(0, 14)))
        one.append(text)
        other.append(text[:draw.randint(0, len(text))] + "".join(draw.choices("ab \né", k=draw.randint(0, 6))))
    want = [plain_length(a, b) for a, b in zip(one, other)]
    assert sum(map(bool, want)) > 500
    for at_once in (line_dedup.AT_ONCE, 20):
        monkeypatch.setattr(line_dedup, "AT_ONCE", at_once)
        assert line_dedup.same_length(pa.array(one), pa.array(other)).tolist() == want
        assert line_dedup.same_length(pa.array(one).slice(9), pa.array(other).slice(9)).tolist() == want[9:]
        back = [pa.array([t[::-1] for t in texts]) for texts in (one, other)]
        assert line_dedup.same_length(*back, back=True).tolist() == want


def test_text_is_moved_a_few_times_only(spark, sf01, monkeypatch):
    plans, stage = [], line_dedup.stage

    def noted(df, label):
        plans.append(df)
        return stage(df, label)

    monkeypatch.setattr(line_dedup, "stage", noted)
    plans.append(line_dedup.repeated_passages(table(spark, sf01, "documents")))
    assert sum(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in plans) <= 8


def test_filter_grows_with_its_values(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 16)
    hashes = [r[0] for r in spark.range(60_000).selectExpr("xxhash64(id)").collect()]
    held, others = np.array(hashes[:30_000]), np.array(hashes[30_000:])
    values = spark.createDataFrame([(h,) for h in hashes[:30_000]], "hash long")
    narrow, wide = common.Filter(values), common.Filter(values, 30_000)
    assert narrow.passes(held).all() and wide.passes(held).all()
    assert wide.passes(others).mean() < 0.13 < narrow.passes(others).mean()
