import random
import re
from collections import Counter, defaultdict

import numpy as np

from findery.llm import jaccard
from findery.llm.common import placed_words, shingles, utf8, word_hashes
from findery.session import table
from tests.llm.conftest import LONG, make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs):
    """doc_id, set size and smallest reachable id, from explicit word tuples and all pairs that share one."""
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r["text"] or "").translate(LOWER))
        sets[r["doc_id"]] = {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    holders, parent = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for t in s:
            holders[t].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, shared in Counter(j for t in s for j in holders[t] if j > i).items():
            if 100 * shared >= 75 * (len(s) + len(sets[j]) - shared):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def rows(docs):
    return sorted(tuple(r) for r in jaccard.jaccard_groups(docs).collect())


def test_groups_equal_brute_force(spark, sf01):
    docs = table(spark, sf01, "documents")
    assert rows(docs) == brute(docs)


def test_families_near_the_threshold(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    docs, number = [], 0
    for _ in range(8):
        base = random.sample(words, 60)
        for _ in range(25):
            text = list(base)
            for _ in range(random.randint(0, 4)):
                text[random.randrange(len(text))] = random.choice(words)
            docs.append((number, " ".join(text[: random.randint(48, 60)])))
            number += 1
    docs += [(number + i, f"{PASSAGE} own ending {i} " + " ".join(random.sample(words, 5 + i % 9))) for i in range(60)]
    frame = make_docs(spark, docs)
    assert rows(frame) == brute(frame)


PASSAGE = " ".join(f"shared{i}" for i in range(30))


def test_exact_threshold_links(spark):
    # 3 of 4 shingles: a similarity of exactly 0.75; and 2 of 3 below it
    docs = make_docs(spark, [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "p q r s t u"), (4, "p q r s t u v")])
    assert rows(docs) == [(1, 3, 1), (2, 4, 1), (3, 2, 3), (4, 3, 4)]


def test_odd_tables(spark, odd_docs, no_docs):
    known = odd_docs.where("doc_id is not null")
    assert sorted(set(rows(known))) == brute(known)
    got = [tuple(r) for r in jaccard.jaccard_groups(odd_docs).collect()]
    assert len(got) == odd_docs.count() and (None, 5, None) in got
    assert rows(no_docs) == []
    kept = jaccard.drop_similar(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted({r["doc_id"] for r in kept.collect()}, key=repr) == sorted(
        [1, 7, 8, 9, 10, 12, 13, 14, None], key=repr)
    short = make_docs(spark, [(1, "One Two"), (2, "one two"), (3, "two one"), (4, "one two"), (5, LONG + "x"), (6, LONG)])
    assert rows(short) == brute(short)


def test_texts_hashed_together_keep_their_own_shingles(monkeypatch):
    texts = ["", None, "a", "a b c d", "A  b\tc\nd e f", "   ", " x y z é Ü ", "one two three four five six", "w " * 400, "p q", ""]
    alone = [shingles(word_hashes(utf8(t or "")), jaccard.SHINGLE) for t in texts]
    calls = []
    monkeypatch.setattr(jaccard, "placed_words", lambda data: calls.append(len(data)) or placed_words(data))
    for most, times in ((1 << 16, 1), (64, 4), (1, 10)):
        calls.clear()
        monkeypatch.setattr(jaccard, "TOGETHER", most)
        found = [one for lists in jaccard.shingle_lists(texts) for one in lists]
        assert [one.tolist() for one in found] == [one.tolist() for one in alone]
        assert len(calls) == times
    assert list(jaccard.shingle_lists([])) == []


def test_around_stays_in_its_text():
    class Common:
        def passes(self, values):
            return values == 8

    lists = [np.array(one, np.uint64) for one in ([1, 2, 3], [], [8, 4, 5], [6, 7])]
    assert [one.tolist() for one in jaccard._around(lists, Common())] == [[], [], [8, 4, 5], []]


def test_counted_shingles_come_without_lists(spark):
    docs = make_docs(spark, [(1, "a b c d e f"), (2, None), (3, ""), (4, "a b c d e a b c d e")])
    tokens = jaccard._tokens(docs, lambda lists: [jaccard.distinct(one) for one in lists])
    assert "Generate" not in tokens._jdf.queryExecution().toString()
    expected = [int(x) for t in ("a b c d e f", "a b c d e a b c d e") for x in jaccard.shingle_set(t).view(np.int64)]
    assert sorted(r["token"] for r in tokens.collect()) == sorted(expected)
