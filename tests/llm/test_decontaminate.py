import random

import numpy as np
import pytest

from findery.llm import decontaminate
from findery.session import table
from tests.llm.conftest import LONG, make_docs


def plain(text):
    return "".join(map(chr, decontaminate.Plain()(text)[0]))


@pytest.fixture(scope="module")
def bench(spark, sf01):
    return table(spark, sf01, "benchmark")


def test_whole_passages_equal_brute_force(spark, sf01, bench):
    docs = table(spark, sf01, "documents")
    items = {r["item_id"]: plain(r["text"]) for r in bench.collect()}
    got = decontaminate.find_leaks(docs, bench).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {(i, k) for i, t in texts.items() for k, item in items.items() if item in plain(t)}
    assert {(r["doc_id"], r["item_id"]) for r in got if r["edits"] == 0} == want and len(want) > 10
    for r in got:
        if r["edits"] == 0:
            assert plain(texts[r["doc_id"]][r["start"]:r["end"]]) == items[r["item_id"]]


def edit_distance_inside(piece, text):
    row = [0] * (len(text) + 1)
    for p in piece:
        last, row[0] = row[0], row[0] + 1
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != c))
    return min(row)


def test_edited_passages_equal_brute_force(bench):
    random.seed(5)
    items = [(r["item_id"], r["text"]) for r in bench.collect()][:12]
    finder = decontaminate.Finder(decontaminate.build_index(items))
    budget = dict(zip(finder.index.items.tolist(), finder.index.edits.tolist()))
    hits = 0
    for number in range(60):
        item, text = random.choice(items)
        letters = list(plain(text))
        for _ in range(random.randint(0, budget[item] + 6)):
            at = random.randrange(len(letters))
            letters[at: at + random.randint(0, 1)] = random.choice(["", "q", "z", "w"])
        doc = f"some words {number} before " + "".join(letters) + " and some words after it"
        got = {m["item_id"]: m["edits"] for m in finder.find(doc)}
        for k, t in items:
            edits = edit_distance_inside(plain(t), plain(doc)) if k == item else None
            if edits is not None:
                assert (k in got) == (edits <= budget[k]), (k, edits, budget[k])
                if k in got:
                    hits += 1
                    assert got[k] == edits
    assert hits > 20


def test_alignment_at_the_ends():
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    assert decontaminate.align(code("abcd"), code("abcd"), 0, 0, 0) == (0, 4)
    assert decontaminate.align(code("abcd"), code("xxabcdxx"), -2, 5, 0) == (0, 6)
    assert decontaminate.align(code("abcd"), code("xbcd"), -2, 3, 1) == (1, 4)
    assert decontaminate.align(code("abcdefghij"), code("zzzzzzzzzz"), -1, 1, 2) is None


def test_many_index_blocks(spark, sf01, bench, monkeypatch):
    docs = table(spark, sf01, "documents")
    whole = {tuple(r) for r in decontaminate.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 4000)
    assert {tuple(r) for r in decontaminate.find_leaks(docs, bench).collect()} == whole


def test_odd_tables(spark, odd_docs, no_docs, bench):
    passage = bench.first()["text"]
    docs = odd_docs.union(make_docs(spark, [(50, LONG + passage), (51, passage.upper().replace(" ", " -- ")), (52, "x")]))
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 2
    assert decontaminate.find_leaks(no_docs, bench).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, None)], "item_id long, text string")
    assert decontaminate.find_leaks(docs, nothing).count() == 0
    assert decontaminate.drop_leaks(docs, nothing.where("item_id < 0")).count() == docs.count()
    long_item = spark.createDataFrame([(9, " ".join(f"word{i} and" for i in range(2000)))], "item_id long, text string")
    part = " ".join(f"word{i} and" for i in range(500, 700))
    got = decontaminate.find_leaks(make_docs(spark, [(1, part), (2, "word word")]), long_item).collect()
    assert {r["doc_id"] for r in got} == {1}


def test_short_items_are_found_as_they_are():
    items = [(1, "Who was Ada?"), (2, "who was ada"), (3, "ada"), (4, ""), (5, "a passage of more than twenty letters")]
    finder = decontaminate.Finder(decontaminate.build_index(items))
    text = "So: who was  ADA, and who was Adam? Ada"
    got = sorted((m["item_id"], text[m["start"]:m["end"]], m["edits"]) for m in finder.find(text))
    assert got == [(1, "who was  ADA", 0), (2, "who was  ADA", 0), (3, "ADA", 0), (3, "Ada", 0)]
    assert [m["item_id"] for m in finder.find("ada")] == [3] and finder.find("") == []


def test_edits_allowed_are_those_stated():
    sizes = range(20, 513)
    edits = decontaminate.build_index([(n, "x" * n) for n in sizes]).edits
    assert [n for n, e in zip(sizes, edits) if e != n // 10] == [*range(20, 27), *range(30, 35), *range(40, 43), 50]


def test_items_without_an_id_are_found(spark, no_docs):
    text = "the quick brown fox jumps over the lazy dog and then runs away into the dark wood"
    items = spark.createDataFrame([(None, text), (7, text), (None, "short one"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {text} behind"), (2, "a short one here"), (3, "nothing")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()), key=repr)
    assert got == [(1, 7), (1, None), (2, None)]
    assert [r["doc_id"] for r in decontaminate.drop_leaks(docs, items).collect()] == [3]


def test_windows_find_the_same_bands():
    draw = random.Random(6)
    words = ["".join(draw.choice("abcde") for _ in range(draw.randrange(1, 6))) for _ in range(30)]
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(8, 160)))) for i in range(12)]
    index = decontaminate.build_index(items)
    text = " ".join(w for i in range(60) for w in (draw.choices(words, k=40) + items[i % 12][1].split()[: draw.randrange(1, 160)]))
    c, _ = decontaminate.Plain()(text)
    found = []
    for at_once in (1, 1000, 1 << 30):
        windows = list(decontaminate.shared_places(c, index, at_once))
        found.append([b for w in windows for b in decontaminate.bands(*w, index)])
        assert len(found[-1]) == len(set(found[-1]))
    assert found[2] and set(found[0]) == set(found[1]) == set(found[2])


def test_frequent_grams_in_a_long_text_stay_bounded():
    draw = random.Random(8)
    words = ["the", "and", "of", "to", "in"] + ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    weights = [40, 30, 25, 20, 15] + [1] * 60
    index = decontaminate.build_index([(i, " ".join(draw.choices(words, weights, k=80))) for i in range(400)])
    c, _ = decontaminate.Plain()(" ".join(draw.choices(words, weights, k=100_000)))
    sizes = [len(w[0]) for w in decontaminate.shared_places(c, index)]
    narrowest = max(len(w[0]) for w in decontaminate.shared_places(c, index, 1))
    assert sum(sizes) > 4 * decontaminate.PLACES and max(sizes) <= decontaminate.PLACES + narrowest
