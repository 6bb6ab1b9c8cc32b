"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digits for letters), an Aho-Corasick automaton finds
the lexicon's word beginnings in one pass, matches inside exception phrases are taken off, and the
weights found are set against the length. The lexicon and its weights are learned from labels.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from findery.llm.common import CodeTable, codes, fold_texts, id_crc, map_texts, text_rows

# Letters that look like Latin ones, and digits or signs written for letters.
LOOK_ALIKES = dict(zip("авеёкмнорстухіјѕԁԛԝɑαβεικνορτυχϲ", "abeekmhopctyxijsdqwaabeiknoptuxc"))
FOR_LETTERS = dict(zip("013457@$", "oieastas"))
# Harmless phrases around words that may stand in the lexicon.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "idiot proof", "sore loser")

#: Labelled rows the lexicon is learned from, of each class; chosen by a hash of the id.
SAMPLE_ROWS = 10_000
#: Lengths of the word beginnings that may become entries; longer words enter whole up to the last.
STEMS = (4, 5, 6, 7, 8, 9, 10)
LEXICON_SIZE = 4096
#: Toxic documents that an entry must be found in; copies of one text count once.
LEAST_DOCS = 4
#: Least log likelihood ratio of an entry's documents against a word that does not care about the classes.
LEAST_RATIO = math.log(1000.0)
#: Share of a stem's toxic documents that a longer one must find to stand for it.
SAME_DOCS = 0.95
LEAST_WEIGHT = math.log(12.0)


def _fold(c: str) -> str:
    base = unicodedata.normalize("NFKC", c).lower()[:1] or " "
    base = LOOK_ALIKES.get(base, base)
    return base if base.isalnum() or base in FOR_LETTERS else " "


class Folder:
    """Text to lower-case letters and single gaps, a gap at both ends."""

    def __init__(self):
        self.table = CodeTable(_fold)
        self.signs = np.array([ord(c) for c in FOR_LETTERS], np.uint32)
        self.letters = np.array([ord(c) for c in FOR_LETTERS.values()], np.uint32)

    def fold(self, text: str) -> str:
        c = np.concatenate(([32], self.table[codes(text)], [32])).astype(np.uint32)
        is_sign = np.isin(c, self.signs)
        # A digit or sign stands for a letter only with a letter right behind it, in a word.
        letter = ~is_sign & (c != 32) & ~((c >= 48) & (c <= 57))
        stands = np.zeros(len(c), bool)
        follows = np.zeros(len(c), bool)
        follows[:-1] = letter[1:]
        for _ in range(3):  # runs of up to three signs before a letter
            stands = is_sign & follows
            follows[:-1] = (letter | stands)[1:]
        if stands.any():
            order = np.argsort(self.signs)
            number = order[np.searchsorted(self.signs[order], c[stands])]
            c[stands] = self.letters[number]
        c[(is_sign & ~stands) | ((c >= 48) & (c <= 57) & ~stands)] = 32
        gap = c == 32
        c = c[~(gap & np.concatenate(([False], gap[:-1])))]
        return c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def stems(word: str) -> set[str]:
    """Beginnings of a word, each after a gap; a whole word ends in a gap too."""
    return {" " + word[:n] for n in STEMS if len(word) >= n} | {" " + word + " "}


class _StemDocs:
    """How many toxic and how many other documents of a task hold each stem."""

    def __init__(self):
        self.folder, self.counts = Folder(), (Counter(), Counter())
        self.docs = [0, 0]

    def add(self, batch: pa.RecordBatch) -> None:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            found: set[str] = set()
            for word in set(self.folder.fold(text).split()):
                found |= stems(word)
            self.counts[toxic].update(found)
            self.docs[toxic] += 1

    def rows(self) -> dict:
        clean, toxic = self.counts
        names = [w for w in toxic if len(w) > 3] + [w for w in clean if w not in toxic and len(w) > 3]
        return {"stem": ["", *names], "clean": [self.docs[0], *(clean[w] for w in names)],
                "toxic": [self.docs[1], *(toxic[w] for w in names)]}


STEM_DOCS = StructType([StructField("stem", StringType()), StructField("clean", LongType()),
                        StructField("toxic", LongType())])


class Matcher:
    """Weight, number of matches and number of words of a folded text."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.folder, self.machine = Folder(), ahocorasick.Automaton()
        for stem, weight in lexicon.items():
            self.machine.add_word(stem, (len(stem), weight))
        for phrase in exceptions:
            text = self.folder.fold(phrase)
            self.machine.add_word(text, (len(text), None))
        if len(self.machine):
            self.machine.make_automaton()

    def measure(self, text: str) -> tuple[float, int, int]:
        folded = self.folder.fold(text)
        words = folded.count(" ") - 1
        if not len(self.machine):
            return 0.0, 0, words
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.machine.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            else:
                best[start] = max(weight, best.get(start, 0.0))
        for first, last in spared:
            for start in [s for s in best if first <= s < last]:
                del best[start]
        return sum(best.values()), len(best), max(words, 0)


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    coefficients: np.ndarray


def features(weight: float, matches: int, words: int) -> tuple[float, ...]:
    """Constant, weight found, weight against length, matches; all on a log scale."""
    return 1.0, math.log1p(weight), math.log1p(100.0 * weight / (words + 20.0)), math.log1p(matches)


def _lexicon(stem_docs: DataFrame) -> dict[str, float]:
    """Stems with enough toxic documents and odds that chance does not explain, the strongest first, none longer than it need be."""
    sums = stem_docs.groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = sums.where("stem = ''").first()
    if sizes is None or not sizes["toxic"]:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (sizes["toxic"] + 1.0)) - F.log(
        (F.col("clean") + 0.5) / (sizes["clean"] + 1.0))
    share = max(1, sizes["clean"]) / (max(1, sizes["clean"]) + sizes["toxic"])
    both = F.col("toxic") + F.col("clean")
    ratio = F.col("toxic") * F.log(F.col("toxic") / (both * (1.0 - share))) + F.when(F.col("clean") == 0, 0.0).otherwise(
        F.col("clean") * F.log(F.col("clean") / (both * share)))
    strong = sums.where("stem <> ''").withColumn("weight", odds).where(
        (F.col("toxic") >= LEAST_DOCS) & (F.col("weight") >= LEAST_WEIGHT) & (ratio >= LEAST_RATIO))
    best = strong.orderBy(F.desc(F.col("toxic") * F.col("weight")), F.length("stem"), "stem").limit(LEXICON_SIZE)
    rows = {r["stem"]: r for r in best.collect()}
    kept: dict[str, float] = {}
    for stem in sorted(rows, key=lambda x: (len(x), x)):
        shorter = max((kept.get(stem[:n], 0.0) for n in range(4, len(stem))), default=0.0)
        if rows[stem]["weight"] > shorter + 0.7:
            kept[stem] = float(rows[stem]["weight"])
    # a longer beginning that finds nearly the same documents says the same and catches less else
    longest: dict[str, float] = {}
    for stem in kept:
        same = [x for x in rows if x.startswith(stem) and not x.endswith(" ")
                and rows[x]["toxic"] >= SAME_DOCS * rows[stem]["toxic"]]
        chosen = max(same, key=len, default=stem)
        longest[chosen] = float(rows[chosen]["weight"])
    return longest


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton steps of a logistic fit, classes weighed alike on their root."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - ridge * beta * np.array([0.0] + [1.0] * (x.shape[1] - 1))
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(toxic, text) of a bounded, hash-chosen sample of the labelled documents that may teach; an id with both labels is left out."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("long").alias("toxic"))
    usable = usable.where(F.col("toxic").isin(0, 1) & (id_crc() % 5 != 0)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("toxic").alias("_least")).where("toxic = _least").drop("_least")
    picks = [usable.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
             for v in (0, 1)]
    sample = F.broadcast(picks[0].union(picks[1]))  # at most twice SAMPLE_ROWS ids
    return text_rows(docs, id_col, text_col).join(sample, "doc_id").select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon, weights and the logistic scale. Without a toxic example nothing is ever toxic."""
    rows = labelled(docs, labels, id_col, text_col)
    lexicon = _lexicon(fold_texts(rows.dropDuplicates(["toxic", "text"]), _StemDocs, STEM_DOCS))
    measured = measure(rows, lexicon).toPandas()
    x = np.array([features(*r) for r in measured[["weight", "matches", "words"]].itertuples(index=False)])
    if not lexicon or not len(x):
        return Model({}, np.array([-5.0, 0.0, 0.0, 0.0]))
    return Model(lexicon, _logistic(x, measured["toxic"].to_numpy(dtype=np.float64)))


MEASURES = [StructField("weight", DoubleType()), StructField("matches", LongType()), StructField("words", LongType())]


def measure(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """Add weight, matches and words of each text; drops the text."""

    def make() -> Callable[[list], dict]:
        matcher = Matcher(lexicon)

        def work(texts: list) -> dict:
            made = [matcher.measure(t or "") for t in texts]
            return {f.name: [m[i] for m in made] for i, f in enumerate(MEASURES)}

        return work

    return map_texts(rows, "text", make, MEASURES)


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; a fifth of the ids is held out of training.

    A null text is empty and scores as one without matches. Repeated rows score alike, repeated
    labels count once, an empty documents table gives no rows, and without labels every score is low.
    """
    model = fit(docs, labels, id_col, text_col)
    rows = text_rows(docs, id_col, text_col).withColumn("held_out", id_crc() % 5 == 0)
    measured = measure(rows, model.lexicon)
    b = [F.lit(float(v)) for v in model.coefficients]
    z = (b[0] + b[1] * F.log1p("weight") + b[2] * F.log1p(100.0 * F.col("weight") / (F.col("words") + 20.0))
         + b[3] * F.log1p("matches"))
    chance = 1.0 / (1.0 + F.exp(-z))
    return measured.select(
        "doc_id", "held_out", chance.alias("score"), (chance >= 0.5).cast(IntegerType()).alias("predicted"),
        "matches")
