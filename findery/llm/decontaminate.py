"""Benchmark passages inside documents, by the q-gram lemma and banded alignment.

A passage of m characters that occurs with at most e edits shares at least m - q + 1 - q e q-grams
with the text, all within e + 1 neighbouring diagonals. Shared q-grams are counted in overlapping
bands of diagonals, bands that reach the bound are retained, and an alignment inside the band
decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from findery.llm.common import CodeTable, codes, map_texts, powers, running_start, stage, text_rows

Q = 8
#: Edits allowed, as a share of a passage's characters.
EDIT_RATE = 0.1
#: A band is looked at from so many shared q-grams; it lowers the edits allowed in very short passages.
LEAST_SHARED = 4
#: Longer items are searched in pieces of this many characters; shorter ones than the second number without edits.
PIECE_CHARS = 512
LEAST_CHARS = 20
#: Characters of the benchmark in one index; a larger benchmark is searched index by index.
INDEX_CHARS = 1 << 22
FILTER_BITS = 20
#: Places of shared q-grams that are listed at once.
PLACES = 1 << 20


def _plain(c: str) -> str:
    return c.lower() if c.isalnum() else " "


class Plain:
    """Lower-case letters and digits with single gaps, and where each character came from."""

    def __init__(self):
        self.table = CodeTable(_plain)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        c = self.table[codes(text)]
        gap = c == 32
        at = np.flatnonzero(~(gap & np.concatenate(([True], gap[:-1])))) if len(c) else np.empty(0, np.int64)
        if len(at) and c[at[-1]] == 32:
            at = at[:-1]
        return c[at], at


def _written(c: np.ndarray) -> str:
    """Plain text with a gap at both ends."""
    return " " + c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") + " "


def gram_hashes(c: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram at each position: a polynomial over the text, shifted back to the origin."""
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(c))
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(977)) * up[: len(c)], out=sums[1:])
    return (sums[q:] - sums[:-q]) * down[:n] * np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Index:
    """Pieces of benchmark items and the places of their q-grams, sorted by hash."""

    items: np.ndarray  # ids as objects, nulls included
    pieces: list[np.ndarray]
    edits: np.ndarray
    shared: np.ndarray
    grams: np.ndarray
    first: np.ndarray  # first place of each distinct gram, and one past the last
    piece_of: np.ndarray
    place_of: np.ndarray
    filter: np.ndarray
    short: list[tuple[int | None, str]] = field(default_factory=list)  # items searched without edits, at word edges


def build_index(rows: list[tuple[int | None, str]], rate: float = EDIT_RATE) -> Index:
    plain, items, pieces, short = Plain(), [], [], []
    for item, text in rows:
        c, _ = plain(text)
        if 0 < len(c) < LEAST_CHARS:
            short.append((item, _written(c)))
        parts = max(1, -(-len(c) // PIECE_CHARS))
        for part in np.array_split(c, parts):
            if len(part) >= LEAST_CHARS:
                items.append(item)
                pieces.append(part)
    size = np.array([len(p) for p in pieces], np.int64)
    most = (size - Q + 1 - LEAST_SHARED) // Q
    edits = np.minimum((size * rate).astype(np.int64), np.maximum(most, 0))
    hashes = [gram_hashes(p) for p in pieces]
    every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    order = np.argsort(every, kind="stable")
    grams, first = np.unique(every[order], return_index=True)
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[grams >> np.uint64(64 - FILTER_BITS)] = True
    return Index(
        np.array(items, object), pieces, edits, size - Q + 1 - Q * edits, grams,
        np.append(first, len(every)),
        np.repeat(np.arange(len(pieces)), [len(h) for h in hashes])[order] if pieces else np.empty(0, np.int64),
        np.concatenate([np.arange(len(h)) for h in hashes])[order] if pieces else np.empty(0, np.int64), seen, short)


def shared_places(c: np.ndarray, index: Index, at_once: int = PLACES) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(piece, diagonal) of every q-gram the text shares with a piece, window by window, and the window's diagonals.

    A window holds all places of the bands that begin at its diagonals, low to high, and of others some; it is
    as wide as ``at_once`` places let it be, but no narrower than a piece.
    """
    h = gram_hashes(c)
    at = np.flatnonzero(index.filter[h >> np.uint64(64 - FILTER_BITS)])
    found = np.searchsorted(index.grams, h[at])
    found[found == len(index.grams)] = 0
    same = index.grams[found] == h[at]
    at, found = at[same], found[same]
    many = index.first[found + 1] - index.first[found]
    before = np.concatenate(([0], np.cumsum(many)))
    # a band reaches over two half bands of diagonals and the length of its piece
    reach = PIECE_CHARS + 2 * (int(index.edits.max(initial=0)) + 1)
    low = -reach
    while low < len(c):
        a = int(np.searchsorted(at, low))
        room = int(np.searchsorted(before, before[a] + at_once, "right")) - 1  # so many grams fit
        high = max(low + reach, (int(at[room]) if room < len(at) else len(c) + reach) - reach)
        b = int(np.searchsorted(at, high + reach))
        n, first = many[a:b], index.first[found[a:b]]
        place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        if len(place):
            yield index.piece_of[place], np.repeat(at[a:b], n) - index.place_of[place], low, high
        low = high


def bands(piece: np.ndarray, diagonal: np.ndarray, low: int, high: int, index: Index) -> list[tuple[int, int]]:
    """(piece, half band) where this half band and the next one together reach the bound; those from low up to high.

    Half bands are e + 1 diagonals wide, so any e + 1 neighbouring diagonals lie in two of them.
    """
    half = diagonal // (index.edits[piece] + 1)
    key, count = np.unique(piece.astype(np.int64) * (1 << 40) + (half + (1 << 39)), return_counts=True)
    with_next = count.copy()
    next_there = np.flatnonzero(key[1:] == key[:-1] + 1)
    with_next[next_there] += count[next_there + 1]
    owner, half = key >> 40, (key & ((1 << 40) - 1)) - (1 << 39)
    start = half * (index.edits[owner] + 1)
    good = (with_next >= index.shared[owner]) & (start >= low) & (start < high)
    # a band whose upper half alone reaches the bound is found again as the next one
    return [(int(p), int(k)) for p, k in zip(owner[good], half[good])]


def align(piece: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best place for the piece that starts at low ... high of the text.

    Cells are kept by diagonal; one row per character of the piece, all diagonals of a row at once.
    None, as soon as it is certain, if the piece takes more than ``most`` edits there.
    """
    width, m = high - low + 1, len(piece)
    left, right = max(0, -low), max(0, high + m - len(text))
    window = text[max(0, low): high + m]
    if left or right:  # no character of a text is zero
        window = np.concatenate((np.zeros(left, text.dtype), window, np.zeros(right, text.dtype)))
    steps = np.arange(width, dtype=np.int32)
    outside = (steps + low < 0) | (steps + low > len(text))
    row = np.where(outside, np.int32(m + 1), np.int32(0))
    for i in range(m):
        new = row + (window[i: i + width] != piece[i])
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - steps) + steps
        if i % 8 == 7 and row.min() > most:
            return None
    best = int(row.argmin())
    if row[best] > most:
        return None
    return int(row[best]), min(len(text), low + best + m)


class Finder:
    """Matches of one index in one text."""

    def __init__(self, index: Index):
        self.index, self.plain = index, Plain()
        self.short = ahocorasick.Automaton()
        for item, text in index.short:
            self.short.add_word(text, (len(text) - 2, [*self.short.get(text, (0, []))[1], item]))
        if len(self.short):
            self.short.make_automaton()

    def find(self, text: str) -> list[dict]:
        c, at = self.plain(text)
        out = []
        if len(c) and len(self.short):
            for last, (size, items) in self.short.iter(_written(c)):
                out += [{"item_id": i, "start": int(at[last - 1 - size]), "end": int(at[last - 2]) + 1, "edits": 0}
                        for i in items]
        if len(c) < LEAST_CHARS or not self.index.pieces:
            return out
        best: dict[tuple[int, int], tuple[int, int]] = {}
        likely = (b for window in shared_places(c, self.index) for b in bands(*window, self.index))
        for p, half in likely:
            piece, e = self.index.pieces[p], int(self.index.edits[p])
            low, high = half * (e + 1), (half + 2) * (e + 1) - 1
            # e more diagonals at both sides let the path leave the band by all its edits
            if (met := align(piece, c, low - e, high + e, e)) is not None:
                best[p, met[1]] = min(met[0], best.get((p, met[1]), met[0]))
        for (p, end), edits in sorted(best.items()):
            piece = self.index.pieces[p]
            # neighbouring bands see the same place; the one with the fewest edits stands for it
            if any(o == p and abs(x - end) <= len(piece) // 2 and (other, x) < (edits, end)
                   for (o, x), other in best.items()):
                continue
            back = align(piece[::-1], c[:end][::-1], -edits, edits, edits + len(piece))
            start = max(0, end - back[1])
            out.append({"item_id": self.index.items[p], "start": int(at[start]),
                        "end": int(at[end - 1]) + 1, "edits": edits})
        return out


MATCH = StructType([StructField("item_id", LongType()), StructField("start", LongType()), StructField("end", LongType()),
                    StructField("edits", IntegerType())])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    items = items.where("text is not null").select(
        "item", "text", F.length("text").cast("long").alias("size"), F.lit(0).alias("all_rows"),
        F.struct("item", F.xxhash64("text").alias("h")).alias("place"))
    placed = running_start(items, ["all_rows"], "place", "size", "before", "benchmark")
    placed = stage(placed.withColumn("block", F.floor(F.col("before") / INDEX_CHARS)), "benchmark-blocks")
    last = placed.agg(F.max("block")).first()[0]
    return placed, 0 if last is None else last + 1


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, start, end, edits): where a document holds a benchmark passage.

    Case, punctuation and white space do not count; up to a tenth of a passage's other characters
    may be edited, one edit less in items of 20 to 26, 30 to 34, 40 to 42 and 50 characters. Start and
    end are code points of the document as it is. Items of fewer than LEAST_CHARS characters are found
    without edits and at word edges only. An item of more than PIECE_CHARS characters is looked for in
    pieces of about that size, and a document that holds one of them holds the item. Null and empty texts
    hold nothing; an item without an id is found like others, under a null id; repeated documents and
    items give their rows each. The benchmark is read in bounded blocks, each one an
    index that all tasks share, and every block goes over all documents.
    """
    placed, blocks = _blocks(benchmark, item_col, item_text_col)
    rows = text_rows(docs, id_col, text_col)
    context = docs.sparkSession.sparkContext
    found = None
    for block in range(blocks):
        part = [(r["item"], r["text"]) for r in placed.where(F.col("block") == block).orderBy("place").collect()]
        shared = context.broadcast(build_index(part))

        def make(shared=shared) -> Callable[[list], dict]:
            finder = Finder(shared.value)
            return lambda texts: {"found": [finder.find(t or "") for t in texts]}

        one = map_texts(rows, "text", make, [StructField("found", ArrayType(MATCH))])
        one = one.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")
        found = one if found is None else found.unionByName(one)
    if found is None:
        schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *MATCH.fields])
        return docs.sparkSession.createDataFrame([], schema)
    return found


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The documents without a benchmark passage, with all their columns."""
    leaks = find_leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_leak")).distinct()
    held = docs.select(F.col(id_col).alias("id"), F.struct("*").alias("row"))
    return held.join(leaks, held["id"].eqNullSafe(leaks["_leak"]), "left_anti").select("row.*")
