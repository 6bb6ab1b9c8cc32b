"""Secret scan with a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams that every match must hold. A
batch of texts is indexed by the trigrams any rule asks for, the postings are intersected and
united, and only the rows that remain are searched. A rule without a mandatory trigram searches
every row. Whole texts are read in the scan's own tasks; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as K  # noqa: PLC2701
from re import _parser as P  # noqa: PLC2701

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from findery.llm.common import map_texts, text_rows


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The three base kinds as the contract of the query states them.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=6, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
)
# Published shapes of well-known credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,1000}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+]{1,15}://[^\x09-\x0D\x20/:@]{1,64}:[^\x09-\x0D\x20/@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES

#: Alternatives followed while strings are put together; beyond, the part asks for nothing.
MAX_STRINGS = 64
#: Bytes indexed at once inside a batch.
WINDOW_BYTES = 1 << 22


def trigram_query(pattern: str) -> object:
    """What every match holds: True, a trigram, ("and", ...) or ("or", ...); letters are folded."""
    strings, need = _needs(P.parse(pattern, re.ASCII))
    return _all([need, _of_strings(strings)])


def _all(parts: list) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> object:
    return _any([_all([s[i: i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _needs(nodes) -> tuple[set[str], object]:
    """The strings the end of a match may spell, and the query of all that came before."""
    strings, need = {""}, True
    for op, arg in nodes:
        own, inner, ends = _node(op, arg)
        need = _all([need, inner])
        if own is not None and len(joined := {a + b for a in strings for b in own}) <= MAX_STRINGS:
            strings = joined
        else:
            need = _all([need, _of_strings(strings)])
            strings = own if own is not None and len(own) <= MAX_STRINGS else {""}
        if ends:
            need, strings = _all([need, _of_strings(strings)]), {""}
    return strings, need


def _node(op, arg) -> tuple[set[str] | None, object, bool]:
    """(strings it may spell or None if any, query of its inside, whether more may follow unseen)."""
    if op is K.LITERAL:
        return {chr(arg).lower()}, True, False
    if op is K.IN:
        if all(k is K.LITERAL for k, _ in arg) and len(arg) <= 4:
            return {chr(c).lower() for _, c in arg}, True, False
        return None, True, False
    if op is K.SUBPATTERN:
        strings, need = _needs(arg[-1])
        return strings, need, False
    if op is K.BRANCH:
        parts = [_needs(b) for b in arg[1]]
        if all(need is True for _, need in parts):
            return set().union(*(s for s, _ in parts)), True, False
        return None, _any([_all([need, _of_strings(s)]) for s, need in parts]), False
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, body = arg
        strings, need = _needs(body)
        if (low, high) == (0, 1) and need is True and strings != {""}:
            return strings | {""}, True, False
        if low == 0:
            return None, True, False
        if need is True and all(o is K.LITERAL for o, _ in body):
            return strings, True, True
        return None, _all([need, _of_strings(strings)]), False
    if op is K.AT:
        return {""}, True, False
    return None, True, False


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1:]))


class Scanner:
    """Spans of all rules in a batch of texts, found through the batch's index."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.names = sorted(set().union(*(trigrams(q) for _, _, q in self.rules)))
        # Trigram to its number, by three bytes; other characters than ASCII are never asked for.
        self.slots = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.names):
            a, b, c = t.encode("ascii")
            self.slots[a << 16 | b << 8 | c] = i + 1

    def index(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Trigram to the ascending rows that hold it."""
        folded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        starts = np.cumsum([0] + [len(f) + 2 for f in folded])
        data = np.frombuffer(b"\0\0".join(folded) + b"\0\0", np.uint8)
        pairs = []
        for at in range(0, len(data) - 2, WINDOW_BYTES):
            part = data[at: at + WINDOW_BYTES + 2].astype(np.uint32)
            slot = self.slots[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            hit = np.flatnonzero(slot)
            row = np.searchsorted(starts, hit + at, "right") - 1
            pairs.append(np.unique(slot[hit].astype(np.int64) * len(texts) + row))
        found = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        number, row = np.divmod(found, max(1, len(texts)))
        cuts = np.searchsorted(number, np.arange(1, len(self.names) + 2))
        return {t: row[cuts[i]: cuts[i + 1]] for i, t in enumerate(self.names)}

    def rows(self, query: object, index: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, str):
            return index[query]
        lists = [self.rows(q, index, n) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        lists.sort(key=len)
        kept = lists[0]
        for more in lists[1:]:
            kept = np.intersect1d(kept, more, assume_unique=True)
        return kept

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, number of the rule, end), ascending."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        index = self.index(texts)
        for number, (rule, regex, query) in enumerate(self.rules):
            for row in self.rows(query, index, len(texts)):
                for m in regex.finditer(texts[row]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[row].append((m.start(), number, m.end()))
        return [sorted(s) for s in out]


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Per document: doc_id, a count n_<kind> for each base kind, n_more, base_sha256 and spans.

    Spans read kind:start:end in code points, end exclusive, by start and then in the order of the
    rules; base_sha256 covers those of the base rules alone. Null texts are empty: no spans, the
    hash of the empty text. Every row of the table gives one row, repeated ones too.
    """
    base = [i for i, r in enumerate(rules) if r.base]
    fields = [StructField(f"n_{rules[i].kind}", LongType()) for i in base]
    fields += [StructField("n_more", LongType()), StructField("base_sha256", StringType()),
               StructField("spans", StringType())]

    def make() -> Callable[[list], dict]:
        scanner = Scanner(rules)

        def work(texts: list) -> dict:
            found = scanner.spans(texts)
            made: dict[str, list] = {
                f"n_{rules[i].kind}": [sum(k == i for _, k, _ in s) for s in found] for i in base}
            made["n_more"] = [sum(k not in base for _, k, _ in s) for s in found]
            line = lambda s: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in s)
            made["base_sha256"] = [
                hashlib.sha256(line([x for x in s if x[1] in base]).encode()).hexdigest() for s in found]
            made["spans"] = [line(s) for s in found]
            return made

        return work

    return map_texts(text_rows(docs, id_col, text_col), "text", make, fields)
