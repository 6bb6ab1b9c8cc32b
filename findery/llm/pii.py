"""Personal data: four kinds by rule, more by a linear-chain conditional random field.

The field is trained on the driver from a small labelled table and labels the blank-separated words of
a text by shape, spelling and neighbours. Each distinct word is scored once per task; prefix sums of the
most a word could gain by not being "other" give the only windows in which the best labelling can differ
from "other" throughout, and Viterbi in numpy decodes those windows in batches: the result is that of
decoding whole texts. Everything happens in the tasks that scan the texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from findery.llm.common import map_texts, text_rows

# The base kinds in their order, as the contract of the query states them.
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the field adds. Their spans never overlap a base span.
ADDED_KINDS = ("tel", "mail", "iban", "national_id", "name")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)?")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds, read from each @ outwards: linear in the text."""
    free = 0
    for m in _HOST.finditer(text):
        before = text[free: m.start()]
        local = len(before) - len(before.rstrip(_LOCAL))
        if local and m[1]:
            yield m.start() - local, m.end()
        free = m.end() if m[1] else m.start() + 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        twice = int(d) * (1 + i % 2)
        total += twice - 9 if twice > 9 else twice
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the base kind, end), ascending: leftmost non-overlapping per kind, failing ones dropped."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Features of a word.

#: Longer words have no shape; they only count as long.
MAX_SHAPE = 40
_EDGE = ".,;:!?\"'()[]<>{}|"


class _Forms(dict):
    """Code point to the mark that stands for it in a shape."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = mark = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        return mark


_FORMS = _Forms()
_AGAIN = re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """Capitals as X, other letters as x, digits as d, the rest as it is."""
    return word.translate(_FORMS)


def features(word: str) -> list[str]:
    """Names of the features of one word, whatever stands beside it."""
    if len(word) > MAX_SHAPE:
        return ["long"]
    form, core = shape(word), word.strip(_EDGE)
    out = ["any", f"shape {_AGAIN.sub(r'\1', form)}", f"word {core.lower()}"]
    if digits := form.count("d"):
        out += [f"digits {digits}", f"form {shape(core)}"]
    if len(core) < len(word):
        out.append(f"edges {form[0] if form[0] in _EDGE else ''} {form[-1] if form[-1] in _EDGE else ''}")
    return out


#: Places beside a word whose features count for it.
BESIDE = (0, -1, 1, -2)


class Field:
    """A linear-chain conditional random field over the labels "other" and one for each kind.

    A path begins and ends at "other". Neighbouring words of one kind are one span.
    """

    def __init__(self, kinds: tuple[str, ...]):
        self.kinds, self.n = kinds, 1 + len(kinds)
        self.names: dict[str, int] = {"edge": 0}
        self.weights, self.moves = np.zeros((len(BESIDE), self.n)), np.zeros((self.n, self.n))
        #: Most words of a span of each kind in the labelled table; longer spans are dropped.
        self.longest = np.zeros(len(kinds), np.int64)

    def labels(self, places: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
        """Label of each word (start, end): of the span it overlaps."""
        hits = [next((k for k, s, e in spans if s < b and a < e), None) for a, b in places]
        return [0 if k is None else 1 + self.kinds.index(k) for k in hits]

    def fit(
        self, texts: list[str], spans: list[list[tuple[str, int, int]]], steps: int, ridge: float, least: int,
    ) -> Field:
        """Maximise the log-likelihood less half of ``ridge`` times the squared weights, by gradient steps of adapted size.

        Features of fewer than ``least`` words are left out.
        """
        cut = [word_places(t) for t in texts]
        words = [[t[a:b] for a, b in p] for t, p in zip(texts, cut)]
        keep = [i for i, w in enumerate(words) if w]
        if not keep or not self.kinds:
            return self
        size = np.array([len(words[i]) for i in keep])
        n, longest = len(keep), int(size.max())
        gold = np.zeros((n, longest + 2), np.int64)
        marked = [[features(w) for w in words[i]] for i in keep]
        often = Counter(f for own in marked for fs in own for f in fs)
        self.names = {f: i for i, f in enumerate(["edge"] + sorted(f for f, c in often.items() if c >= least))}
        rows, cols = [], []
        for r, i in enumerate(keep):
            gold[r, 1: size[r] + 1] = self.labels(cut[i], spans[i])
            for kind, a, b in spans[i]:
                k = self.kinds.index(kind)
                self.longest[k] = max(self.longest[k], sum(s < b and a < e for s, e in cut[i]))
            own = [[self.names[f] for f in fs if f in self.names] for fs in marked[r]]
            for t in range(len(own)):
                for at, d in enumerate(BESIDE):
                    for f in own[t + d] if 0 <= t + d < len(own) else [0]:
                        rows.append(r * longest + t)
                        cols.append(f * len(BESIDE) + at)
        rows, cols = np.array(rows), np.array(cols)
        inside = np.arange(longest)[None, :] < size[:, None]
        hot = np.zeros((n * longest, self.n))
        hot[np.arange(n * longest), gold[:, 1:-1].ravel()] = inside.ravel()
        seen = np.zeros((self.n, self.n))
        for t in range(longest + 1):
            here = t <= size
            np.add.at(seen, (gold[here, t], gold[here, t + 1]), 1)
        self.weights = np.zeros((len(self.names) * len(BESIDE), self.n))
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.weights, self.moves)]
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
        heads = np.flatnonzero(np.concatenate(([True], cols[1:] != cols[:-1])))
        by_row = np.argsort(rows, kind="stable")
        row_heads = np.flatnonzero(np.concatenate(([True], np.diff(rows[by_row]) != 0)))
        filled = rows[by_row][row_heads]
        for step in range(1, steps + 1):
            score = np.zeros((n * longest, self.n))
            score[filled] = np.add.reduceat(self.weights[cols[by_row]], row_heads, axis=0)
            chance, moved = self._expected(score.reshape(n, longest, self.n), size)
            rest = hot - chance.reshape(n * longest, self.n)
            slope = -ridge * self.weights
            slope[cols[heads]] += np.add.reduceat(rest[rows], heads, axis=0)
            slopes = (slope,
                      seen - moved - ridge * self.moves)
            for values, slope, (mean, square) in zip((self.weights, self.moves), slopes, state):
                mean += 0.1 * (slope - mean)
                square += 0.01 * (slope * slope - square)
                values += 0.1 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        return self

    def _expected(self, score: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected labels of each word and expected moves, by scaled forward and backward sums."""
        n, longest, _ = score.shape
        odds = np.exp(self.moves)
        own = np.exp(score - score.max(2, keepdims=True))
        ahead, behind, scale = np.zeros_like(own), np.zeros_like(own), np.ones((n, longest, 1))
        for t in range(longest):
            ahead[:, t] = (odds[0] if t == 0 else ahead[:, t - 1] @ odds) * own[:, t]
            scale[:, t] = ahead[:, t].sum(1, keepdims=True)
            ahead[:, t] /= scale[:, t]
        last = ahead[np.arange(n), size - 1]
        ending = odds[:, 0] / (last @ odds[:, 0])[:, None]
        onward, moved = np.zeros((n, self.n)), np.zeros((self.n, self.n))
        for t in range(longest - 1, -1, -1):
            behind[:, t] = np.where((size == t + 1)[:, None], ending, onward @ odds.T) * (size > t)[:, None]
            onward = own[:, t] * behind[:, t] / scale[:, t]
            if t:
                moved += odds * (ahead[:, t - 1].T @ onward)
        chance = ahead * behind
        moved[0] += chance[:, 0].sum(0)
        moved[:, 0] += chance[np.arange(n), size - 1].sum(0)
        return chance, moved

    def numbers(self, word: str) -> tuple[int, ...]:
        """The features of a word that the field knows."""
        return tuple(self.names[f] for f in features(word) if f in self.names)

    def parts(self, numbers: tuple[int, ...]) -> np.ndarray:
        """What features of a word add to the labels of the words it stands beside, for each place of BESIDE."""
        return self.weights.reshape(-1, len(BESIDE), self.n)[list(numbers)].sum(0)

    def decode(self, scores: list[np.ndarray], at_once: int = 1 << 17) -> list[np.ndarray]:
        """Best labels of each sequence; every sequence stands between two "other".

        Sequences of like length are decoded together, in tables of some ``at_once`` words.
        """
        size = np.array([len(s) for s in scores])
        order = np.argsort(-size, kind="stable")
        out: list[np.ndarray] = [np.empty(0)] * len(scores)
        first = 0
        while first < len(order):
            longest = int(size[order[first]])
            group = order[first: first + max(1, at_once // longest)]
            for i, path in zip(group, self._viterbi([scores[i] for i in group])):
                out[i] = path
            first += len(group)
        return out

    def _viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of sequences that come longest first."""
        size = np.array([len(s) for s in scores])
        longest, moves = int(size[0]), self.moves
        table = np.zeros((len(scores), longest, self.n))
        for r, s in enumerate(scores):
            table[r, : size[r]] = s
        best, back = moves[0] + table[:, 0], np.zeros((longest, len(scores), self.n), np.int16)
        for t in range(1, longest):
            live = int(np.searchsorted(-size, -t, "left"))  # those longer than t
            step = best[:live, :, None] + moves[None]
            back[t, :live] = step.argmax(1)
            best[:live] = step.max(1) + table[:live, t]
        label = (best + moves[:, 0]).argmax(1)
        paths = np.zeros((len(scores), longest), np.int64)
        at = np.arange(len(scores))
        for t in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, "left"))
            paths[:live, t] = label[:live]
            label[:live] = back[t, at[:live], label[:live]]
        return [paths[r, : size[r]] for r in range(len(scores))]


_WORD = re.compile(r"\S+")


def word_places(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


class Tagger:
    """Spans that a trained field finds in texts."""

    #: Distinct words remembered; beyond, the memory starts afresh.
    REMEMBERED = 1 << 18
    #: Words decoded together.
    AT_ONCE = 1 << 16

    def __init__(self, field: Field):
        self.field = field
        moves = field.moves - field.moves[0, 0]
        if field.kinds:
            self.enter = float(moves[0, 1:].max())
            self.leave = float(moves[1:, 0].max())
            self.inner = float(moves[1:, 1:].max())
        self.rows: dict[tuple[int, ...], int] = {(0,): 0}  # of the edge
        self.table = field.parts((0,))[None]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Row of each word in the table of what words add; words of the same features share one."""
        known = self.known
        for w in set(words).difference(known):
            own = self.field.numbers(w)
            if own not in self.rows:
                self.rows[own] = len(self.rows)
                self.table = np.concatenate((self.table, self.field.parts(own)[None]))
            known[w] = self.rows[own]
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def scores(self, numbers: np.ndarray) -> np.ndarray:
        """What every word adds to each label; edges are asked for beyond both ends."""
        reach = max(map(abs, BESIDE))
        padded = np.zeros(len(numbers) + 2 * reach, np.int64)
        padded[reach: reach + len(numbers)] = numbers
        out = np.zeros((len(numbers), self.field.n))
        for i, d in enumerate(BESIDE):
            out += self.table[:, i].take(padded[reach + d: reach + d + len(numbers)], axis=0)
        return out

    def windows(self, gain: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the stretches outside which every word of the best labelling is "other".

        ``gain`` is the most a word scores above "other". Labelling a stretch of m words otherwise gains at most
        the words' gains, m - 1 inner moves, one into it and one out of it. Words in no stretch for which that
        is positive stay "other".
        """
        gain = gain + self.inner
        edges = self.enter + self.leave - self.inner
        most = gain.max()
        if most <= 0 and most + edges < -1e-6:
            return []
        total = np.concatenate(([0.0], np.cumsum(gain)))
        ending = total[1:] - np.minimum.accumulate(total[:-1])
        starting = np.maximum.accumulate(total[::-1])[::-1][1:] - total[:-1]
        may = ending + starting - gain + edges > -1e-6
        edge = np.diff(np.concatenate(([False], may, [False])).astype(np.int8))
        return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, number of the field's kind, end)."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not self.field.kinds:
            return out
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for row, text in enumerate(texts):
            if len(self.known) > self.REMEMBERED:
                self._forget()
            words = text.split()
            if not words:
                continue
            scores = self.scores(self._numbers(words))
            for a, b in self.windows(scores[:, 1:].max(1) - scores[:, 0]):
                held.append((row, a, scores[a:b]))
                size += b - a
            if size >= self.AT_ONCE:
                self._place(texts, held, out)
                held, size = [], 0
        self._place(texts, held, out)
        return [sorted(s) for s in out]

    def _place(self, texts: list[str], held: list, out: list) -> None:
        row_of, places = -1, []
        for (row, a, _), path in zip(held, self.field.decode([s for _, _, s in held])):
            if not path.any():
                continue
            if row != row_of:
                row_of, places = row, word_places(texts[row])
            t = 0
            while t < len(path):
                x, stop = int(path[t]), t + 1
                while stop < len(path) and path[stop] == x:
                    stop += 1
                if x:
                    start, end = trimmed(texts[row], places[a + t][0], places[a + stop - 1][1])
                    if start < end and stop - t <= self.field.longest[x - 1]:
                        out[row].append((start, x - 1, end))
                t = stop


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without marks at its edges; an opening bracket stays if it is closed inside."""
    while start < end and (text[start] in _EDGE or text[start].isspace()) and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    while start < end and (text[end - 1] in _EDGE or text[end - 1].isspace()):
        end -= 1
    return start, end


# The labelled table.

# Made-up sentences; {kind} stands for a value of that kind, # for a digit, {prose} for invented words.
SENTENCES = """
You can call me at {tel} after six.
Phone: {tel}
Tel. {tel} or write to us
Please ring {tel} and ask for the office.
My number is {tel} , thanks
Fax {tel} is out of order
Mobile: {tel} ( evenings )
Call {tel} today
Reach us by telephone at {tel}.
tel: {tel} {prose}
Write to {mail} for details.
My mail is {mail} , do not share it.
E-mail: {mail}
contact {mail} or the desk
You can mail {mail} any time
Send it to {mail} please {prose}
Please pay to {iban} by Friday.
IBAN: {iban}
Account {iban} at the bank
My account number is {iban} , thank you
Transfer the sum to {iban} {prose}
My SSN is {national_id}.
SSN: {national_id}
social security number {national_id} was printed
Tax ID {national_id} belongs to the applicant
The insured person has number {national_id} , {prose}
My name is {name} and I live here.
My name is {name}.
Name: {name}
Dear {name} , thank you for the letter
Dear Mr. {name} , {prose}
Signed by {name} on Monday
Yours sincerely , {name}
Patient: {name} was seen at noon
Customer {name} has paid
I am called {name} by my friends
Mrs. {name} and Mr. {name} came together.
Regards, {name}
Name: {name} Phone: {tel} IBAN: {iban}
{name} , SSN {national_id} , Tel. {tel} , E-mail: {mail}
{prose}
{prose} {prose}
{prose} ################ {prose}
The order ######## was sent on ##.##.20## for ##.## euros.
In 19## and 20## the yield was #,### tons or ##.#% of all.
Version #.#.## of the tool needs port #### on ###.##.##.### today.
See pages ###-### of volume ## and chapter #.
Model XJ-#### costs ### dollars, part number ###-##-## is ## mm wide.
The number is ####### in this case {prose}
{prose} a@b.example.com {prose}
{prose} {word}.##@mail#.example.com {prose}
{prose} +# (###) ###-#### {prose}
{prose} ###.##.###.## {prose}
| {word} | ###.##.##.### | {word} |
token = "a#c#e#f#a#b#c#d#" {prose}
{word}&&& {word}%%% {word}### ###-#### $$$ {prose}
He met them at noon and said that the work at the site dot by dot was done.
The name of the town is not known. The account was closed and the number is wrong.
My number is not yours. Call today or write. Dear all, thank you. Dear friends, {prose}
Please call the office at ## past #. Phone calls cost # cents, a fax ## cents.
ISBN ###-#-####-####-# was out of print for ## years.
Room ###, floor ##, {prose}
The score was ##-## and ###-### after ### minutes.
{Name} {Name} {Name} {prose}
{prose} {Name} {Name}. {Name}, {Name} {prose}
{prose} {Name} {Name} {Name} {Name} {Name} {Name} {prose}
{Name}. {Name}. {Name}. {Name}. {prose}
{Name}, ##.##.##.## {prose} {Name}, {prose}
{prose} {word} at at {word} {prose}
{word} at {word} at {word} at the {word} {prose}
{prose} is at at the {word} at {word} and {prose}
{prose} to {word} at {word} in {word} {prose}
{prose} is. {Name} and {word} {prose}
{prose} {word} is. {Name} on {prose} by. {Name} {prose}
| {word} | {Name} | Is. {Name} | {word} | {word}. {Name} | {word} |
{Name} {Name} {Name} at At At {Name} {prose}
Mr. Speaker, I agree. Name: unknown. Customer service is closed. Patient care is free.
Tax ID numbers are nine digits long. The IBAN is missing. SSN: none
"""
# Made-up value patterns; # is a digit, {word} and {Name} stand for invented words.
VALUES = {
    "tel": ["(###) ###-####", "###-###-####", "###.###.####", "0## ### ####", "(0##) ###-###", "0### / ######", "### ### ####"],
    "mail": ["{word} at {word} dot com", "{word} [at] {word} [dot] org", "{word} (at) {word} (dot) net",
             "{word} AT {word} DOT com", "{word}.{word} at {word} dot de"],
    "iban": ["DE## #### #### #### #### ##", "FR## #### #### #### #### #### ###", "GB##ABCD##############",
             "DE####################", "ES## #### #### #### #### ####", "NL##ABCD##########"],
    "national_id": ["###-##-####", "### ## ####"],
    "name": ["{Name} {Name}", "{Name} {Name}", "{Name} {Name} {Name}", "{Name} X. {Name}", "{Name}"],
}
# Frequent words of four languages, and syllables of the invented words.
FREQUENT = """the of and to in is was for on that with as at by it he she they from or an be this are not have had but
der die das und in zu den von mit sich des auf ist nicht ein eine als auch es an werden aus er hat dass
de la le les et des en un une du que est pour qui dans a par plus pas au sur se ne
el los las y se del un por con no una su para es al lo como o""".split()
SYLLABLES = "an ber co da el fi gor ha in jo ka lu mar no ol pe qui ra son ti ul va wen ya zo the ing ción é ß und".split()
#: Tables made from each sentence.
ROUNDS = 12

LABELLED = StructType([
    StructField("text", StringType()),
    StructField("spans", ArrayType(StructType([
        StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])))])


class _Draws:
    """Repeatable draws from a counter."""

    def __init__(self, seed: str):
        self.seed, self.at = seed, 0

    def below(self, n: int) -> int:
        self.at += 1
        return zlib.crc32(f"{self.seed}:{self.at}".encode()) % n

    def word(self) -> str:
        return "".join(SYLLABLES[self.below(len(SYLLABLES))] for _ in range(1 + self.below(3)))

    def prose(self) -> str:
        words = [FREQUENT[self.below(len(FREQUENT))] if self.below(5) < 2 else self.word() for _ in range(2 + self.below(8))]
        if self.below(6) == 0:  # a word over and over
            words = words[:1] * len(words) + words[1:] * (1 + self.below(2))
        words[0] = words[0].capitalize()
        if self.below(2):
            words[self.below(len(words))] += ".,"[self.below(2)]
        if self.below(3) == 0:
            at = self.below(len(words))
            words[at] = words[at].capitalize()
        look = self.below(16)
        if look == 0:
            words = [w.capitalize() for w in words]
        elif look == 1:
            words = [w.upper() + "!" * self.below(3) for w in words]
        elif look == 2:
            words = [w + "%&$#*"[self.below(5)] * 3 for w in words]
        return " ".join(words)

    def filled(self, pattern: str) -> str:
        out = re.sub(r"\{word\}", lambda _: self.word(), pattern)
        out = re.sub(r"\{Name\}", lambda _: self.word().capitalize(), out)
        return re.sub("#", lambda _: str(self.below(10)), out)


def labelled_rows(seed: str = "table", rounds: int = ROUNDS) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, start, end)]): every sentence with ``rounds`` draws of its values."""
    rows = []
    for number, sentence in enumerate(SENTENCES.strip().split("\n")):
        for turn in range(rounds):
            draws, text, spans = _Draws(f"{seed}:{number}:{turn}"), "", []
            for piece in re.split(r"(\{[a-z_]+\})", sentence):
                kind = piece[1:-1] if piece.startswith("{") else ""
                if kind in VALUES:
                    value = draws.filled(VALUES[kind][draws.below(len(VALUES[kind]))])
                    spans.append((kind, len(text), len(text) + len(value)))
                    text += value
                else:
                    text += draws.prose() if kind == "prose" else draws.filled(piece)
            rows.append((text, spans))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: text, spans of (kind, start, end)."""
    return spark.createDataFrame(labelled_rows(), LABELLED)


def train(labelled: DataFrame, max_rows: int = 4000, steps: int = 120, ridge: float = 0.5, least: int = 6) -> Field:
    """A field for the kinds of a labelled table (text, spans), of which at most ``max_rows`` rows are read.

    Features of fewer than ``least`` words are left out; an empty table gives a field that finds nothing. Null texts and rows without spans count as texts without personal data; rows are taken by text order.
    """
    rows = labelled.select("text", "spans").orderBy("text").limit(max_rows).collect()
    texts = [r["text"] or "" for r in rows]
    spans = [[(s["kind"], s["start"], s["end"]) for s in r["spans"] or []] for r in rows]
    kinds = sorted({k for s in spans for k, _, _ in s})
    order = [k for k in ADDED_KINDS if k in kinds] + [k for k in kinds if k not in ADDED_KINDS]
    return Field(tuple(order)).fit(texts, spans, steps, ridge, least)


def find_personal_data(
    docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, n_more, base_sha256, spans.

    Spans read kind:start:end in code points, end exclusive, by start and then in the order of the kinds, base
    kinds first; base_sha256 covers the base spans, n_more counts those that the field adds. A span of the
    field that overlaps a base span is left out. Without ``field`` one is trained from the built-in table. Null
    texts are empty: no spans, the hash of the empty text. Every row gives one row, repeated ones too.
    """
    if field is None:
        field = train(labelled_table(docs.sparkSession))
    shared = docs.sparkSession.sparkContext.broadcast(field)  # bounded by the features of max_rows texts
    kinds = BASE_KINDS + field.kinds
    fields = [StructField(f"n_{k}", LongType()) for k in BASE_KINDS]
    fields += [StructField("n_more", LongType()), StructField("base_sha256", StringType()), StructField("spans", StringType())]

    def make() -> Callable[[list], dict]:
        tagger = Tagger(shared.value)

        def line(spans: list[tuple[int, int, int]]) -> str:
            return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)

        def work(texts: list) -> dict:
            made: dict[str, list] = {f.name: [] for f in fields}
            for text, added in zip(texts, tagger.spans(texts)):
                base = base_spans(text)
                more = [(a, k + len(BASE_KINDS), b) for a, k, b in added] if added else []
                if more and base:
                    more = apart(more, base)
                for k, name in enumerate(BASE_KINDS):
                    made[f"n_{name}"].append(sum(x == k for _, x, _ in base))
                made["n_more"].append(len(more))
                made["base_sha256"].append(hashlib.sha256(line(base).encode()).hexdigest())
                made["spans"].append(line(sorted(base + more)))
            return made

        return work

    return map_texts(text_rows(docs, id_col, text_col), "text", make, fields)


def apart(more: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of ``more`` that share no character with one of ``base``."""
    starts = np.array([a for a, _, _ in base])
    reach = np.maximum.accumulate([b for _, _, b in base])
    out = []
    for a, k, b in more:
        before = int(np.searchsorted(starts, b, "left"))  # base spans that start before this one ends
        if before == 0 or reach[before - 1] <= a:
            out.append((a, k, b))
    return out
