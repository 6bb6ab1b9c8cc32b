import hashlib
import random
import re
import time

import numpy as np
import pytest

from findery.llm import pii
from findery.llm.queries import op12_personal_data
from findery.session import table

# The base rules as the contract spells them, searched plainly.
PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_ok(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        twice = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (kind, regex) in enumerate(PLAIN) for m in re.finditer(regex, text)
                  if plain_ok(kind, m[0]))


HARD = [
    "a@b.c@d.e", "x@y@z.w", "@a.b", "a@b", "a@b.", "a@-.-.x..y", "Ünï@host.de é@x.y", "a.b+c%d@e-f.g.h,", "1.2.3.4.5.6.7.8",
    "999.1.1.1 1.1.1.1", "1.2.3", "0001.02.3.4", "255.255.255.256", "1.1.1.1@x.y", "4111 1111 1111 1111", "4111-1111-1111-1111 1",
    "4111111111111111", "4111  1111", "00000000000000", "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0", "+1 (974) 555-3436", "+1((((", "++12345678901",
    "+1234567890123456", "+1 2 3 4 5 6 7 8 9 0 .", "+49-30.123 456 78+1 234 567 8901", "9" * 200, "١٢ +١234567890",
]


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(pii.labelled_table(spark))


def test_base_rules_equal_plain_search():
    draw = random.Random(5)
    texts = HARD + ["".join(draw.choice("a1@.+- (9") for _ in range(draw.randrange(60))) for _ in range(4000)]
    texts += ["".join(draw.choice("012. -") for _ in range(40)) for _ in range(2000)]
    for text in texts:
        assert pii.base_spans(text) == plain(text), text


def test_base_rules_are_linear():
    start = time.time()
    for unit in ("a", "1", "1.", "@", "a@", "+1", "1 ", "a@b.", "+1("):
        pii.base_spans(unit * 200_000)
    assert time.time() - start < 20


def test_query_base_columns(spark, sf):
    texts = dict(table(spark, sf, "documents").select("doc_id", "text").collect())
    rows = op12_personal_data(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]] or "")
        line = ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{kind}"] for kind, _ in PLAIN] == [sum(k == i for _, k, _ in want) for i in range(4)]
        spans = [s for s in r["spans"].split(",") if s]
        assert ",".join(s for s in spans if s.split(":")[0] in dict(PLAIN)) == line
        assert len(spans) == len(want) + r["n_more"]
    assert sum(r["base_sha256"] != hashlib.sha256(b"").hexdigest() for r in rows) > 5


def test_held_out_values(field):
    """Values and invented words that the table does not hold."""
    held = pii.labelled_rows("held out", 6)
    found = pii.Tagger(field).spans([t for t, _ in held])
    right = made = there = 0
    for (text, spans), got in zip(held, found):
        want = {(k, *pii.trimmed(text, a, b)) for k, a, b in spans}
        mine = {(field.kinds[k], a, b) for a, k, b in got}
        right, made, there = right + len(want & mine), made + len(mine), there + len(want)
    assert right / made > 0.95 and right / there > 0.95


def test_added_spans_stay_off_prose(field, spark):
    texts = [r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    assert sum(map(len, pii.Tagger(field).spans(texts))) <= len(texts) // 100


def best_path(field, words):
    """Viterbi word by word over the whole text, scores from the features themselves."""
    n, names = field.n, field.names
    weights = field.weights.reshape(-1, len(pii.BESIDE), n)
    score = []
    for t in range(len(words)):
        s = np.zeros(n)
        for at, d in enumerate(pii.BESIDE):
            fs = pii.features(words[t + d]) if 0 <= t + d < len(words) else ["edge"]
            for f in fs:
                if f in names:
                    s = s + weights[names[f], at]
        score.append(s)
    best, back = field.moves[0] + score[0], []
    for s in score[1:]:
        step = best[:, None] + field.moves
        back.append(step.argmax(0))
        best = step.max(0) + s
    path = [int((best + field.moves[:, 0]).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_windows_lose_nothing(field):
    """Decoding windows gives the labels of decoding whole texts."""
    tagger, draw = pii.Tagger(field), random.Random(2)
    rows = pii.labelled_rows("windows", 2)
    texts = [" ".join(t for t, _ in draw.sample(rows, 4)) for _ in range(60)]
    for text in texts:
        words = text.split()
        scores = tagger.scores(tagger._numbers(words))
        path = np.zeros(len(words), int)
        stretches = tagger.windows(scores[:, 1:].max(1) - scores[:, 0])
        for (a, b), part in zip(stretches, field.decode([scores[a:b] for a, b in stretches])):
            path[a:b] = part
        assert path.tolist() == best_path(field, words)


def test_decode_in_small_tables(field):
    draw = np.random.default_rng(1)
    parts = [draw.normal(size=(n, field.n)) for n in (1, 5, 2, 9, 5, 1)]
    whole = field.decode(parts)
    assert all((a == b).all() for a, b in zip(whole, field.decode(parts, at_once=1)))
    assert [len(p) for p in whole] == [1, 5, 2, 9, 5, 1]
    assert field.decode([]) == []


def test_added_spans_never_overlap_base_spans(field):
    base = [(5, 0, 9), (7, 1, 20), (30, 2, 40)]
    assert pii.apart([(0, 4, 5), (8, 4, 10), (20, 4, 30), (39, 4, 50), (40, 4, 45)], base) == [(0, 4, 5), (20, 4, 30), (40, 4, 45)]


def test_odd_tables(spark, odd_docs, no_docs, field):
    rows = pii.find_personal_data(odd_docs, field).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["spans"] == "" and r["n_more"] == 0 for r in rows)
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.find_personal_data(no_docs, field).count() == 0


def test_odd_labelled_tables(spark, odd_docs):
    nothing = pii.train(spark.createDataFrame([], pii.LABELLED))
    assert nothing.kinds == () and all(r["n_more"] == 0 for r in pii.find_personal_data(odd_docs, nothing).collect())
    odd = [(None, None), ("", []), ("code ab12 here", [("code", 5, 9)])] + [(f"the code ab{i} here", [("code", 9, 13)]) for i in range(10, 40)]
    own = pii.train(spark.createDataFrame(odd, pii.LABELLED))
    assert own.kinds == ("code",)
    docs = spark.createDataFrame([(1, "the code ab99 here")], "doc_id long, text string")
    assert pii.find_personal_data(docs, own).first()["spans"] == "code:9:13"
