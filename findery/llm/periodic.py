"""Periodic runs of words by recursive frequency splitting.

A run of period q and at least ``periods`` periods holds each of its words that many times. So a word
that occurs less often in a segment lies in no run of it: such words split the segment, the pieces are
looked at again until nothing changes, and pieces too short for a run go. What survives is scanned by
lags: at doubling window lengths every place looks for the next one that reads alike, and places that
share a lag are a run. Texts are independent; the work stays in the tasks that scan them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from findery.llm.common import WORD, id_crc, map_texts, text_rows

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Rounds of splitting. The scan finds the same runs in larger segments; later rounds could only spare it work.
ROUNDS = 64

RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])


def _pieces(ids: np.ndarray, least_words: int, periods: int) -> list[tuple[int, int]]:
    """(start, end) of the segments in which every word occurs ``periods`` times, none shorter than a run.

    Words are numbered from 0. All segments of a round are counted together.
    """
    at = np.arange(len(ids))
    segment = np.zeros(len(ids), np.int64)
    for _ in range(ROUNDS):
        if len(at) < least_words:
            return []
        key = segment * (int(ids[at].max()) + 1) + ids[at]
        _, which, often = np.unique(key, return_inverse=True, return_counts=True)
        common = often[which] >= periods
        # a piece ends at a rare word, and where its segment ended before
        opens = np.ones(len(at), bool)
        opens[1:] = ~common[:-1] | (segment[1:] != segment[:-1])
        number = np.cumsum(opens | ~common)
        size = np.bincount(number[common], minlength=number[-1] + 1)
        stays = common & (size[number] >= least_words)
        if stays.all():
            break
        at, segment = at[stays], np.unique(number[stays], return_inverse=True)[1]
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    last = np.append(first[1:], len(at)) - 1
    return [(int(at[a]), int(at[b]) + 1) for a, b in zip(first, last)]


def _scan(ids: np.ndarray, least_words: int, periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment.

    Windows of k words serve the periods q with k/2 < q <= k: inside a run of smallest period q such a
    window occurs next exactly q words on, and a stretch of places with that lag, with a window and a
    lag added, is a whole run; three periods have room for a lag and a window of less than two lags.
    Windows are named by the pair of names of their halves, so equal names are equal words. k doubles
    until no run could hold so many periods.
    """
    runs: list[tuple[int, int, int]] = []
    names, k = np.unique(ids, return_inverse=True)[1], 1
    while True:
        n = len(names)
        order = np.argsort(names, kind="stable")
        lag = np.zeros(n, np.int64)
        same = names[order[1:]] == names[order[:-1]]
        lag[order[:-1][same]] = (order[1:] - order[:-1])[same]
        edge = np.flatnonzero(np.concatenate(([True], lag[1:] != lag[:-1])))
        size = np.diff(np.append(edge, n))
        q = lag[edge]
        length = size + q + k - 1
        good = (2 * q > k) & (q <= k) & (length >= np.maximum(least_words, periods * q))
        runs += zip(edge[good].tolist(), length[good].tolist(), q[good].tolist())
        # a run of a period above k has periods * (k + 1) words at least
        if periods * (k + 1) > len(ids) or n <= k:
            return runs
        names = np.unique(names[: n - k] * (int(names.max()) + 1) + names[k:], return_inverse=True)[1]
        k *= 2


def text_runs(words: list, least_words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs among the words, by start and then period."""
    if len(words) < max(least_words, periods):
        return []
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) * periods > len(words) and not _any_piece(ids, len(known), least_words, periods):
        return []
    found = [(a + s, n, q) for a, b in _pieces(ids, least_words, periods) for s, n, q in _scan(ids[a:b], least_words, periods)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _any_piece(ids: np.ndarray, n_words: int, least_words: int, periods: int) -> bool:
    """Whether the first round leaves a piece long enough: most texts end here."""
    common = np.bincount(ids, minlength=n_words)[ids] >= periods
    rare = np.concatenate(([-1], np.flatnonzero(~common), [len(ids)]))
    return bool((np.diff(rare) > least_words).any())


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS,
    periods: int = LEAST_PERIODS,
) -> DataFrame:
    """One row per document: doc_id, n_words, runs and collapsed.

    A word is a run of anything but blanks and ASCII white space; words are numbered from 0. ``runs`` are
    the stretches (start, length, period) with smallest period ``period``, at least ``least_words`` words
    and ``periods`` periods that no neighbouring word extends, by start and then period; they may overlap.
    ``collapsed`` are the words joined by one blank, without those that a run repeats after its first
    period. A null, empty or blank text has no words, no runs and an empty ``collapsed``. Repeated rows
    give repeated rows, ids are kept as they are, other columns are never looked at.
    """
    if least_words < 1 or periods < 3:
        raise ValueError("a run needs a word and three periods at least")
    fields = [StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]

    def make() -> Callable[[list], dict]:
        def work(texts: list) -> dict:
            made: dict[str, list] = {f.name: [] for f in fields}
            for text in texts:
                # bytes are cut at exactly the ASCII white space
                words = text.encode("utf-8", "surrogatepass").split()
                runs = text_runs(words, least_words, periods)
                made["n_words"].append(len(words))
                made["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                if runs:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s, n, q in runs:
                        gone[s + q] += 1
                        gone[s + n] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                made["collapsed"].append(b" ".join(words).decode("utf-8", "surrogatepass"))
            return made

        return work

    return map_texts(text_rows(docs, id_col, text_col), "text", make, fields)


def loop_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a repeated tail planted in about a tenth of the texts.

    Let h be the CRC-32 of the decimal id (a null id counts as the empty text) and g = h div 10. If 10
    divides h, each word i >= a of the n words becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) div (3 + g % 8); the words are then joined by one blank. Other texts stay as they are.
    """
    rows = text_rows(docs, id_col, text_col)
    h = id_crc("doc_id")
    rows = rows.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n = F.coalesce(F.size("words"), F.lit(0)).cast("long")
    g = F.floor(h / 10)
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    rows = rows.select("doc_id", "text", "words", n.alias("n"), F.when(n > 0, a).alias("a"),
                       F.when(n > 0, p).alias("p"))
    order = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
        lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    looped = F.array_join(F.transform(order, lambda i: F.get("words", i.cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), looped).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """Per document of ``find_runs``: the number of runs, the longest one by its periods, and two digests.

    start, length, period and exponent_milli are of the run with the greatest length / period, compared as
    fractions (ties: smallest start, then period), null without runs. runs_sha256 covers a line
    ``start,length,period`` for each run, collapsed_sha256 the collapsed text.
    """
    def longer(best: Column, run: Column) -> Column:
        more = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(more, run).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast(RUN), longer)  # runs are in order, so the first of equals stays
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
