"""Question-answering checks on whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findery.functions.text import nfd, normalize_answer, tokens, words
from findery.functions.vectors import let

_SEP = "\u0001"


def token_line(text: Column) -> Column:
    """Lower-cased tokens of the decomposed text, each fenced by a character no token can hold."""
    edge = F.array(F.lit(""))
    return F.array_join(F.concat(edge, tokens(nfd(text), uncased=True), edge), _SEP)


def line_has_answer(line: Column, answer_line: Column) -> Column:
    """Whether an answer's tokens stand side by side in the text; an empty answer always does."""
    return (answer_line == _SEP) | line.contains(answer_line)


def has_answer(answer_lines: Column, line: Column) -> Column:
    """Any of an array of answers; a missing text has none."""
    both = F.struct(line.alias("line"), answer_lines.alias("answers"))
    found = let(both, lambda x: F.exists(x["answers"], lambda a: line_has_answer(x["line"], a)))
    return F.coalesce(found, F.lit(False))


def exact_match(prediction: Column, truths: Column) -> Column:
    """1 when the prediction equals a truth after normalisation."""
    return F.array_contains(F.transform(truths, normalize_answer), normalize_answer(prediction))


def _shared_words(mine: Column, theirs: Column) -> Column:
    """Number of words that two bags share, a repeated one as often as both hold it.

    Both bags are sorted into one list, where mine stand before theirs of the same word, and one walk
    over it matches each of theirs with one of mine that is left.
    """
    side = lambda bag, other: F.transform(bag, lambda w: F.struct(w.alias("word"), F.lit(other).alias("theirs")))
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("left"), F.lit(0).alias("shared"))

    def step(s: Column, x: Column) -> Column:
        left = F.when(x["word"] == s["word"], s["left"]).otherwise(F.lit(0))
        after = lambda n, shared: F.struct(x["word"].alias("word"), n.alias("left"), shared.alias("shared"))
        return F.when(~x["theirs"], after(left + 1, s["shared"])).when(
            left > 0, after(left - 1, s["shared"] + 1)).otherwise(after(F.lit(0), s["shared"]))

    both = F.sort_array(F.concat(side(mine, False), side(theirs, True)))
    return F.aggregate(both, start, step, lambda s: s["shared"])


def token_f1(prediction: Column, truths: Column) -> Column:
    """Best F1 of word bags over the truths; 0 when nothing is shared."""

    def score(same: Column, mine: Column, theirs: Column) -> Column:
        p, r = same / F.size(mine), same / F.size(theirs)
        return F.when(same > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))

    def one(mine: Column, truth: Column) -> Column:
        # a lambda computes what it names as often as it is named: bags and counts are made once
        return let(words(normalize_answer(truth)), lambda theirs: let(
            _shared_words(mine, theirs), lambda same: score(same, mine, theirs)))

    best = lambda mine: F.aggregate(
        F.transform(truths, lambda t: one(mine, t)), F.lit(0.0), lambda a, b: F.greatest(a, b))
    return F.coalesce(let(words(normalize_answer(prediction)), best), F.lit(0.0))
