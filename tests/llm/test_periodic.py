import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from findery.llm import periodic
from findery.llm.queries import op13_periodic_runs
from findery.session import table
from tests.llm.conftest import LONG, make_docs


def slow_runs(words, least=24, periods=3):
    """By the definition: every lag, every maximal stretch, kept where no smaller lag fits the stretch."""
    found = []
    for q in range(1, len(words) // periods + 1):
        start = 0
        while start + q < len(words):
            stop = start
            while stop + q < len(words) and words[stop] == words[stop + q]:
                stop += 1
            length = stop + q - start
            if stop > start and length >= max(least, periods * q):
                part = words[start: start + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((start, length, q))
            start = stop + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text, loop=True):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    h = zlib.crc32(str(doc_id if doc_id is not None else "").encode())
    if loop and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def row(r):
    return (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 12)), max_size=8))
def test_runs_equal_brute_force(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert periodic.text_runs(words) == slow_runs(words)
    assert periodic.text_runs(words, 4, 3) == slow_runs(words, 4)
    assert periodic.text_runs(words, 6, 4) == slow_runs(words, 6, 4)


def test_more_rounds_change_nothing(monkeypatch):
    draw = random.Random(4)
    texts = [[draw.choice("abcdefgh") for _ in range(draw.randrange(60))] * draw.randrange(1, 5) + ["x"] for _ in range(60)]
    for rounds in (0, 1, 64):
        monkeypatch.setattr(periodic, "ROUNDS", rounds)
        assert [periodic.text_runs(t) for t in texts] == [slow_runs(t) for t in texts]


def test_long_texts_stay_near_linear():
    unit = [str(i) for i in range(60_000)]
    assert periodic.text_runs(["head"] + unit * 5 + ["tail"]) == [(1, 300_000, 60_000)]
    assert periodic.text_runs(["a"] * 500_000) == [(0, 500_000, 1)]


def test_query_equals_brute_force(spark, sf):
    texts = dict(table(spark, sf, "documents").select("doc_id", "text").collect())
    rows = op13_periodic_runs(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert row(r) == slow_row(r["doc_id"], texts[r["doc_id"]]), r["doc_id"]
    assert sum(r["n_runs"] > 0 for r in rows) > 5


def test_odd_tables(spark, odd_docs, no_docs):
    looped = periodic.loop_tails(odd_docs)
    rows = periodic.run_digest(periodic.find_runs(looped)).collect()
    assert len(rows) == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.select("doc_id", "text").collect()}
    for r in rows:
        if texts[r["doc_id"]] != LONG:
            assert row(r) == slow_row(r["doc_id"], texts[r["doc_id"]])
    plain = {r["doc_id"]: r for r in periodic.find_runs(odd_docs).collect()}
    assert [tuple(x) for x in plain[10]["runs"]] == [(0, 100_000, 5)]
    assert plain[10]["collapsed"] == "lorem ipsum dolor sit amet"
    assert (plain[7]["n_words"], plain[7]["runs"], plain[7]["collapsed"]) == (0, [], "")
    assert periodic.run_digest(periodic.find_runs(periodic.loop_tails(no_docs))).count() == 0


def test_overlapping_runs_and_ties(spark):
    text = " ".join(["x"] + ["a", "b"] * 15 + ["c"] + ["a", "b"] * 15 + ["c"] + ["a", "b"] * 15 + ["c"] + ["z"])
    found = periodic.find_runs(make_docs(spark, [(1, text), (1, text)])).collect()
    assert len(found) == 2
    for r in found:
        assert [tuple(x) for x in r["runs"]] == slow_runs(text.split())
        assert len(r["runs"]) == 4


def test_too_few_periods_are_refused(odd_docs):
    with pytest.raises(ValueError):
        periodic.find_runs(odd_docs, periods=2)
