"""Repeated passages by content-defined chunks.

A rolling hash over the hashes of neighbouring words chooses places by content alone: a place is
where it is smallest among its neighbours, so an insertion shifts only the places around it. The
words around a place are a chunk, in a line of many words as in a run of short lines. Chunks that
occur again anywhere are compared byte by byte; each is then extended, word by word in its line and
line by line beyond it, as far as its first occurrence reads the same, and all but the first go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from findery.llm.common import Filter, codes, mix64, powers, stage, text_rows

#: Words that the rolling hash covers.
WINDOW = 2
#: A place has the smallest hash of so many on either side, among those not repeated so near.
REACH, PERIOD = 4, 6
#: Words of a chunk around a place; lines of fewer words are short, and taken with their neighbours.
LEAST_WORDS = 12
#: More words than this without a place are a chunk of their own.
SPARSE = 32


#: Chunks whose hash occurs more often are common: no task holds all rows of one.
COMMON = 1000
#: Rows of a common chunk are dealt out so many times, which its first occurrence follows.
DEALS = 16
#: Characters of texts that are read at once.
AT_ONCE = 1 << 17


def _places(hashes: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Words at which the rolling hash is smallest around; none where the words repeat at once."""
    n = len(hashes)
    rolled = hashes.copy()
    for k in range(1, min(WINDOW, n)):
        rolled[k:] = mix64(rolled[k:] * np.uint64(0x9E3779B97F4A7C15) + hashes[: n - k])
    repeated = np.zeros(n, bool)
    for k in range(1, min(PERIOD, n - 1) + 1):
        same = (rolled[k:] == rolled[:-k]) & (segment[k:] == segment[:-k])
        repeated[k:] |= same
        repeated[:-k] |= same
    rolled[repeated] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = ~repeated
    for k in range(1, min(REACH, n - 1) + 1):
        apart = segment[k:] != segment[:-k]
        least[k:] &= (rolled[k:] < rolled[:-k]) | apart
        least[:-k] &= (rolled[:-k] < rolled[k:]) | apart
    return np.flatnonzero(least)


def _read(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of the text, start and end of the chunks of several texts, in order."""
    c = codes("\n".join(texts))
    blank = np.flatnonzero(c <= 32)
    kind = c[blank]
    held = (kind == 32) | ((kind >= 9) & (kind <= 13))
    blank, kind = blank[held], kind[held]
    bounds = np.concatenate(([-1], blank, [len(c)]))
    word = np.flatnonzero(np.diff(bounds) > 1)
    starts, ends = bounds[word] + 1, bounds[word + 1]
    n = len(starts)
    if not n:
        return np.empty(0, np.int64), *(np.empty(0, np.int64) for _ in range(3))
    up, down = powers(len(c) + 1)
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(np.multiply(c + np.uint32(977), up[: len(c)]), out=sums[1:])
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    origin = np.cumsum(size + 1) - size - 1
    text_of = np.searchsorted(origin, starts, "right") - 1
    line = np.concatenate(([0], np.cumsum(kind == 10)))[word]
    opens = np.concatenate(([True], line[1:] != line[:-1]))
    number = np.cumsum(opens) - 1
    firsts = np.flatnonzero(opens)
    lasts = np.append(firsts[1:], n) - 1
    short = (lasts - firsts + 1 < LEAST_WORDS)[number]
    new = np.concatenate(([True], opens[1:] & ~(short[1:] & short[:-1]) | (text_of[1:] != text_of[:-1])))
    segment = np.cumsum(new) - 1
    at = _places(mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), segment)
    low, high = at - LEAST_WORDS // 2, at + (LEAST_WORDS - 1) // 2
    inside = (low >= 0) & (high < n)
    inside[inside] = segment[low[inside]] == segment[high[inside]]
    at, low, high = at[inside], low[inside], high[inside]
    # stretches between places and the edges of segments
    is_edge = np.append(new, True)
    mark = is_edge.copy()
    mark[at] = True
    marks = np.flatnonzero(mark)
    width = np.diff(marks)
    bare = is_edge[marks[:-1]] & is_edge[marks[1:]] & (width >= LEAST_WORDS) | (width > SPARSE)
    low = np.concatenate((low, marks[:-1][bare]))
    high = np.concatenate((high, marks[1:][bare] - 1))
    low, high = np.where(short[low], firsts[number[low]], low), np.where(short[high], lasts[number[high]], high)
    both = np.sort(low * n + high)
    low, high = np.divmod(both[np.append(True, both[1:] != both[:-1])] if len(both) else both, n)
    a, b, of = starts[low], ends[high], text_of[low]
    hashes = mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64)
    return hashes, of, a - origin[of], b - origin[of]


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of AT_ONCE characters together, and the number of the first."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= AT_ONCE:
            yield first, texts[first: i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def chunks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the chunks, in order: at least LEAST_WORDS words each, neighbours overlap.

    A line of that many words is a segment, and so are neighbouring shorter lines; in these a chunk
    has whole lines. A segment, or a long stretch of one, without a place is one chunk.
    """
    _, _, starts, ends = _read([text])
    return list(zip(starts.tolist(), ends.tolist()))


BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each begins and ends."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), at


def same_length(one: pa.Array, other: pa.Array, back: bool = False) -> np.ndarray:
    """Characters that each text and its other have in common from the start, or ``back`` from the end: whole
    words of the first line, whole lines after it. What follows them is a blank, or a line end, in both.
    """
    (a, a_at), (b, b_at) = _bytes(one), _bytes(other)
    size = np.minimum(np.diff(a_at), np.diff(b_at))
    out, until, first = np.zeros(len(size), np.int64), np.cumsum(size), 0
    while first < len(size):
        done = until[first] - size[first]
        last = max(first + 1, int(np.searchsorted(until, done + AT_ONCE, "right")))
        n, stop = size[first:last], until[first:last] - done
        step = np.arange(stop[-1]) - np.repeat(stop - n, n)
        x, y = (t[np.repeat(at[first + 1: last + 1] - 1, n) - step if back else np.repeat(at[first:last], n) + step]
                for t, at in ((a, a_at), (b, b_at)))
        blank = BLANK[x]
        edge = 1 + np.flatnonzero(blank[1:] & BLANK[y[1:]] & ~blank[:-1])
        row = np.searchsorted(stop, edge, "right")
        begin = (stop - n)[row]
        differ, lines, chars = (np.concatenate(([0], np.cumsum(m))) for m in (x != y, x == 10, (x & 0xC0) != 0x80))
        fits = (edge > begin) & (differ[edge] == differ[begin]) & (
            (lines[edge] == lines[begin]) | (x[edge] == 10) & (y[edge] == 10))
        edge, row, begin = edge[fits], row[fits], begin[fits]
        longest = np.append(row[1:] != row[:-1], True)[: len(row)]
        out[first + row[longest]] = (chars[edge] - chars[begin])[longest]
        first = last
    return out


CHUNK = StructType([
    StructField("hash", LongType()), StructField("common", BooleanType()), StructField("start", LongType()),
    StructField("before", StringType()), StructField("body", StringType()), StructField("behind", StringType())])
#: What a chunk takes over from its first occurrence.
KEPT = ["doc_id", "start", "before", "behind"]
SPAN = ["start", "end", "copies", "keep_doc_id", "keep_start", "removed"]


def _hashes(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _groups(batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(_read(texts)[0])], names=["hash"])

    return rows.select("text").mapInArrow(run, StructType([StructField("hash", LongType())]))


def _found(rows: DataFrame, wanted: Filter, common: Filter) -> DataFrame:
    """(doc_id, hash, common, start, before, body, behind): wanted chunks, and the text around them.

    ``before`` goes back to the last start before the chunk's own, ``behind`` on to the next end behind its own, each
    with a character more; a line end stands for the ends of the text.
    """
    schema = StructType([rows.schema["doc_id"], *CHUNK.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            ids = batch.column("doc_id").cast(arrow.field("doc_id").type)
            for first, texts in _groups(batch.column("text").to_pylist()):
                hashes, of, starts, ends = _read(texts)
                likely = np.flatnonzero(wanted.passes(hashes)) if len(hashes) else np.empty(0, np.int64)
                if not len(likely):
                    continue
                # chunks are in order of their starts
                begins, closes = (of << 40) + starts, np.sort((of << 40) + ends)
                last = np.searchsorted(begins, begins[likely]) - 1
                following = np.searchsorted(closes, ((of << 40) + ends)[likely], "right")
                of, starts, ends = of[likely], starts[likely], ends[likely]
                size = np.fromiter(map(len, texts), np.int64, len(texts))[of]
                last = begins[np.maximum(last, 0)] - (of << 40)
                following = closes[np.minimum(following, len(closes) - 1)] - (of << 40)
                low = np.where((last >= 0) & (last < starts), last, 0)
                high = np.where((following > ends) & (following <= size), following, size)
                before, body, behind = [], [], []
                for t, low_at, a, b, high_at in zip(*(x.tolist() for x in (of, low, starts, ends, high))):
                    text = texts[t]
                    before.append(text[low_at - 1: a] if low_at else "\n" + text[:a])
                    body.append(text[a:b])
                    behind.append(text[b: high_at + 1] if high_at < len(text) else text[b:] + "\n")
                hashes = hashes[likely]
                columns = [ids.take(pa.array(of + first)), pa.array(hashes), pa.array(common.passes(hashes)), pa.array(starts)]
                columns += [pa.array(x, pa.string()) for x in (before, body, behind)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, schema)


def _extended(met: DataFrame) -> DataFrame:
    """Chunks that stand beside the one kept: the columns of SPAN, with ``low`` and ``high``, how far both read alike.

    Columns of CHUNK go on for common chunks only.
    """
    stays = F.struct("doc_id", "start").eqNullSafe(F.struct("keep_doc_id", "keep_start"))
    met = met.withColumns({"end": F.col("start") + F.length("body"), "removed": ~stays})
    there = {f.name: f for f in met.schema.fields}
    kept = [there[c] for c in ("doc_id", *SPAN)]
    text = [StructField(c, there[c].dataType) for c in ("hash", "before", "body", "behind")]
    schema = StructType([*kept, there["common"], *text, StructField("low", LongType()), StructField("high", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            left = same_length(batch.column("before"), batch.column("keep_before"), back=True)
            right = same_length(batch.column("behind"), batch.column("keep_behind"))
            common = batch.column("common")
            columns = [*(batch.column(f.name) for f in kept), common]
            columns += [pc.if_else(common, batch.column(f.name), None) for f in text]
            columns += [pa.array(batch.column("start").to_numpy() - left), pa.array(batch.column("end").to_numpy() + right)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return met.mapInArrow(run, schema)


def _repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Occurrences of chunks that occur again: doc_id, the columns of SPAN, low, high."""
    rows = text_rows(docs, id_col, text_col)
    again = stage(_hashes(rows).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "line-hashes")
    wanted = Filter(again.select("hash"), again.count())
    found = _found(rows, wanted, Filter(again.where(F.col("n") > COMMON).select("hash")))
    # grouping by the body compares bytes; a common chunk's rows are dealt out one by one, and meet below
    found = found.withColumn("spread", F.when(F.col("common"), F.xxhash64("doc_id", "start")))
    group = Window.partitionBy("hash", "body", "spread").orderBy("doc_id", "start").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    met = found.select("*", F.count("*").over(group).alias("copies"), *[F.first(c).over(group).alias(f"keep_{c}") for c in KEPT])
    met = stage(_extended(met.where("common or copies > 1")), "line-met")
    common = met.where("common").select("doc_id", *CHUNK.names)
    # partial minima and counts keep a common chunk small
    first = common.groupBy("hash", "body").agg(F.count("*").alias("copies"), F.min(F.struct(*KEPT)).alias("keep"))
    first = first.where("copies > 1").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    common = common.withColumn("deal", F.pmod(F.hash("doc_id", "start"), F.lit(DEALS)))
    common = common.join(first.hint("merge"), ["hash", "body", "deal"])
    common = _extended(common.select("*", *[F.col(f"keep.{c}").alias(f"keep_{c}") for c in KEPT]))
    columns = ["doc_id", *SPAN, "low", "high"]
    return met.where("not common").select(*columns).unionByName(common.select(*columns))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every occurrence of a chunk that occurs again: doc_id, start, end, copies, keep_doc_id, keep_start, removed.

    Start and end are code points. The occurrence with the smallest (doc_id, start) stays, the others
    are ``removed``. Texts below LEAST_WORDS words have no chunk; a chunk that one document holds twice
    counts; of repeated rows (same id, same text) the chunks are the same occurrence. Nulls among the
    ids come first.
    """
    return _repeats(docs, id_col, text_col).select("doc_id", *SPAN)


def _joined(spans: DataFrame) -> DataFrame:
    """Spans that overlap and stand alike to one document, as one that goes from its least ``low`` to its largest ``high``."""
    alike = ["doc_id", "removed", "keep_doc_id", "shift"]
    order = Window.partitionBy(*alike).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= reach, 0).otherwise(1)
    runs = spans.withColumn("shift", F.col("keep_start") - F.col("start")).withColumn("opens", opens).withColumn(
        "run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*alike, "run").agg(
        F.min("low").alias("start"), F.max("high").alias("end"), F.max("copies").alias("copies"))
    return runs.withColumn("keep_start", F.col("start") + F.col("shift")).select("doc_id", *SPAN)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated passages, whole: doc_id, start, end, copies, keep_doc_id, keep_start, removed.

    Repeated chunks that overlap and stand alike to one document are one run, which is extended as far
    as its first occurrence reads the same. A ``removed`` row equals the text of keep_doc_id at
    keep_start; the others, which stay, name their own place. Copies are those of the most frequent
    chunk. Documents of one id have one text.
    """
    # no chunk of a run reads alike beyond the next one's edge, so the ends of a run are those of its outer chunks
    later = stage(_joined(_repeats(docs, id_col, text_col).where("removed")), "line-runs")
    first = later.select(
        F.col("keep_doc_id").alias("doc_id"), F.col("keep_start").alias("start"),
        (F.col("keep_start") + F.col("end") - F.col("start")).alias("end"), "copies")
    first = first.groupBy("doc_id", "start", "end").agg(F.max("copies").alias("copies"))
    first = first.select("*", F.col("doc_id").alias("keep_doc_id"), F.col("start").alias("keep_start"),
                         F.lit(False).alias("removed"))
    return _joined(later.unionByName(first).withColumns({"low": F.col("start"), "high": F.col("end")}))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with removed passages cut out of their text; every row and column stays.

    A line that is empty after the cut goes with it. Texts without a removed passage are untouched,
    null texts stay null.
    """
    cuts = repeated_passages(docs, id_col, text_col).where("removed").groupBy(F.col("doc_id").alias("cut_id")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))  # bounded by one document's passages
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct("*").alias("row"))
    met = held.join(cuts, held["id"].eqNullSafe(cuts["cut_id"]), "left")
    kept = F.aggregate(
        "cuts", F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda s, c: F.struct(
            F.concat(s["text"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), (c["start"] - s["at"]).cast("int"))
                     ).alias("text"), F.greatest(s["at"], c["end"]).alias("at")),
        lambda s: F.concat(s["text"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))))
    cleaned = F.regexp_replace(kept, r"\n{2,}", "\n")
    text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.regexp_replace(cleaned, r"^\n|\n$", ""))
    names = docs.columns
    return met.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])
