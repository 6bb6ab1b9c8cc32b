"""Exact Jaccard links between documents by word shingles, and the groups they form.

Sets are put in one global order, rarest shingles first, and an inverted index holds the prefix in
which any two linked sets must meet. Two relations between sets spare work:

* inside the index: a list is cut into blocks by set size, and blocks of sizes that cannot link are
  skipped; of pairs that met, those whose positions leave too few shingles to share go unchecked;
* between answers: a set is first compared with the leader of the lists it shares most. What is
  connected then needs no other comparison, and the known distances of two sets to one leader
  bound the distance between both: pairs that cannot link by it are ruled out. No answer is taken
  over from a leader.

Links are checked on the whole sets, made from the whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, StructField, StructType,
)

from findery.llm.common import (
    Filter, components, map_texts, passing, placed_words, shingles, stage, text_rows, utf8, word_hashes,
)

SHINGLE = 5
#: A link has 100 * shared >= LEAST_PERCENT * united.
LEAST_PERCENT = 75
#: Levels of the order: shingles of more documents than these come later and later.
COMMON = (8, 64, 512, 4096)
#: Every so many shingles by hash are counted first, and then those so near to a common one.
SAMPLED, REACH = np.uint64(8), 24
#: Bits of a shingle hash that place it inside its level.
PLACE = np.uint64((1 << 56) - 1)
#: Lists of more sets than this are read by pairs of sets only that may need them.
LONG_LIST = 64
#: Size blocks of a list grow by more than the largest ratio of linked sizes, 100 / 75.
BLOCK_RATIO = 1.34
#: Bytes of texts that are hashed together.
TOGETHER = 1 << 16


def distinct(values: np.ndarray) -> np.ndarray:
    """Each value once, ascending. Sorting beats ``np.unique``, which hashes, on sets of this size."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def shingle_set(text: str) -> np.ndarray:
    """Distinct 64-bit shingle hashes, ascending; with fewer words the whole sequence is one."""
    return distinct(shingles(word_hashes(utf8(text)), SHINGLE))


def _together(texts: list) -> Iterator[list[bytes]]:
    """Neighbouring texts as bytes, ASCII capitals lowered, TOGETHER bytes at a time; a longer text is alone."""
    some, length = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if some and length + len(data) > TOGETHER:
            yield some
            some, length = [], 0
        some.append(data)
        length += len(data) + 1
    if some:
        yield some


def shingle_lists(texts: list) -> Iterator[list[np.ndarray]]:
    """Each text's shingles in text order, as many texts at a time as are hashed in one go."""
    for some in _together(texts):
        words, places = placed_words(np.frombuffer(b" ".join(some), np.uint8))
        begins = np.searchsorted(places, np.cumsum([0] + [len(data) + 1 for data in some])).tolist()
        runs = shingles(words, SHINGLE)  # those that reach into the next text are left out
        yield [runs[a: b - SHINGLE + 1] if b - a >= SHINGLE else shingles(words[a:b], SHINGLE)
               for a, b in zip(begins, begins[1:])]


def _joined(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All lists in one, and the bounds between them."""
    return np.concatenate(lists), np.cumsum([0] + [len(one) for one in lists])


def _tokens(rows: DataFrame, pick: Callable[[list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """(token): the shingles that ``pick`` takes from the shingles of each of some documents, each once."""
    schema = StructType([StructField("token", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = [one for lists in shingle_lists(batch.column("text").to_pylist()) for one in pick(lists)]
            if picked:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(picked).view(np.int64))], names=["token"])

    return rows.select("text").mapInArrow(run, schema)


def _sampled(lists: list[np.ndarray]) -> list[np.ndarray]:
    return [distinct(listed[listed % SAMPLED == 0]) for listed in lists]


def _around(lists: list[np.ndarray], common: Filter) -> list[np.ndarray]:
    """Shingles of each list, in text order, within REACH of a sampled one that is common."""
    tokens, bounds = _joined(lists)
    at = np.flatnonzero(tokens % SAMPLED == 0)
    at = at[common.passes(tokens[at].view(np.int64))]
    own = np.searchsorted(bounds, at, "right")
    steps = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(steps, np.maximum(at - REACH, bounds[own - 1]), 1)
    np.add.at(steps, np.minimum(at + REACH + 1, bounds[own]), -1)
    near = np.cumsum(steps)[:-1] > 0
    return [tokens[a:b][near[a:b]] for a, b in zip(bounds, bounds[1:])]


def _limit(tokens: np.ndarray) -> np.uint64:
    """The place that the lowest third of a set ends at, somewhat more than a prefix; ``tokens`` are distinct."""
    last = min(len(tokens), len(tokens) // 3 + 2) - 1
    return np.partition(tokens & PLACE, last)[last]


def _near_and_lowest(lists: list[np.ndarray], common: Filter) -> list[np.ndarray]:
    """Of each list, what is around common shingles and the third of the set with the lowest places."""
    found = []
    for listed, near in zip(lists, _around(lists, common)):
        lowest = distinct(listed)
        if len(lowest):
            lowest = lowest[lowest & PLACE <= _limit(lowest)]
        found.append(distinct(np.concatenate((near, lowest))) if len(near) else lowest)
    return found


def _counted(rows: DataFrame) -> tuple[Filter, DataFrame]:
    """What is counted before the order is made: a filter, and (token, n) of the shingles counted twice or more.

    One shingle in SAMPLED, chosen by its hash, is counted over all documents. Passages that many
    documents share hold some of those, so the shingles around the common ones are counted next,
    together with those that would stand in a prefix by their hash alone.
    """
    sampled = _tokens(rows, _sampled).groupBy("token").agg(F.count("*").alias("n"))
    first = Filter(sampled.where(F.col("n") > COMMON[0]).select("token"))
    near = _tokens(rows, lambda lists: _near_and_lowest(lists, first))
    counted = near.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    return first, stage(counted, "jaccard-counted")


SETS = [StructField("n", LongType()), StructField("digest", BinaryType()), StructField("prefix", ArrayType(LongType())),
        StructField("late", ArrayType(LongType()))]


def _sets(rows: DataFrame, first: Filter, counted: DataFrame) -> DataFrame:
    """(doc_id, n, digest, prefix, late): size, identity and ordered prefix of each document's set.

    Shingles come by level, rare ones first, then by place. Any order gives the same links: one whose
    level is too low only makes a list longer. ``late`` holds what of the prefix was not counted.
    """
    levels = [Filter(counted.where(F.col("n") > level).select("token")) for level in COMMON]

    def make() -> Callable[[list], dict]:
        def one(tokens: np.ndarray, placed: np.ndarray, near: np.ndarray) -> tuple[int, bytes | None, np.ndarray, np.ndarray]:
            n = len(tokens)
            if not n:
                return 0, None, np.empty(0, np.int64), np.empty(0, np.int64)
            length = n + 1 - -(-LEAST_PERCENT * n // 100)
            prefix = np.sort(np.partition(placed, length - 1)[:length])
            late = prefix[prefix & PLACE > _limit(tokens)]
            if len(late) and len(near):
                late = late[np.isin(late & PLACE, near & PLACE, invert=True)]
            return n, hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), prefix.view(np.int64), late.view(np.int64)

        def several(lists: list[np.ndarray]) -> Iterator[tuple]:
            sets = [distinct(listed) for listed in lists]
            tokens, bounds = _joined(sets)
            level, at = np.zeros(len(tokens), np.uint64), np.arange(len(tokens))
            for f in levels:  # a filter's values are among those of the one before, and so are its bits
                at = at[f.passes(tokens[at].view(np.int64))]
                level[at] += np.uint64(1)
            placed = np.split((level << np.uint64(56)) | (tokens & PLACE), bounds[1:-1])
            return map(one, sets, placed, _around(lists, first))

        def work(texts: list) -> dict:
            made = [m for lists in shingle_lists(texts) for m in several(lists)]
            return {f.name: [m[i] for m in made] for i, f in enumerate(SETS)}

        return work

    return map_texts(rows, "text", make, SETS)


def _links(a: Column, b: Column, shared: Column) -> Column:
    return 100 * shared >= LEAST_PERCENT * (a + b - shared)


PAIR = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("na", LongType()),
                   StructField("nb", LongType()), StructField("shared", LongType())])


def _verify(pairs: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """(a, b, na, nb, shared) of the pairs, counted on the whole sets of both documents."""
    pairs = stage(pairs, f"{label}-pairs")
    ends = pairs.select("a").union(pairs.select("b")).distinct()
    texts = passing(rows, "doc_id", Filter(ends)).select(F.col("doc_id").alias("id"), "text")
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            counted = []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                if ta != last[0]:
                    last = ta, shingle_set(ta)
                other = shingle_set(tb)
                counted.append((len(last[1]), len(other), len(np.intersect1d(last[1], other, assume_unique=True))))
            columns = [batch.column("a"), batch.column("b")]
            columns += [pa.array([c[i] for c in counted], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=PAIR.fieldNames())

    ordered = both.select("a", "b", "ta", "tb")
    return stage(ordered.mapInArrow(run, PAIR), f"{label}-checked")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends are not connected yet."""
    near = groups.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    far = groups.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    met = pairs.join(near, "a", "left").join(far, "b", "left")
    return met.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def _entries(sets: DataFrame, counted: DataFrame) -> DataFrame:
    """Index entries of the shingles that several sets hold: token, doc_id, n, position, leader.

    A shingle that two prefixes hold was counted twice, or is late in one of them; others stay out.
    """
    twice, late = Filter(counted.select("token")), Filter(sets.select(F.explode("late").alias("token")))
    schema = StructType([StructField("doc_id", LongType()), StructField("n", LongType()),
                         StructField("token", LongType()), StructField("position", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            tokens = prefix.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(prefix).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            position = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = np.flatnonzero(twice.passes(tokens) | late.passes(tokens))
            take = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("n").take(take), pa.array(tokens[kept], pa.int64()),
                 pa.array(position[kept], pa.int32())], names=schema.fieldNames())

    likely = stage(sets.where("n > 0").select("doc_id", "n", "prefix").mapInArrow(run, schema), "jaccard-likely")
    # the set with the fewest rarer shingles before this one is the most like all others
    leaders = likely.groupBy("token").agg(
        F.min(F.struct("position", "doc_id")).alias("first"), F.count("*").alias("many"))
    leaders = leaders.where("many > 1").select("token", F.col("first.doc_id").alias("leader"), "many")
    return stage(likely.join(leaders.hint("merge"), "token"), "jaccard-index")


def _candidates(entries: DataFrame, groups: DataFrame, checked: DataFrame) -> DataFrame:
    """Pairs of not yet connected sets that meet in a list and may link, each pair once."""
    # Lists with two components or more; the filter lets some others pass, which then make no pair.
    held = groups.select(F.col("node").alias("doc_id"), "component")
    spread = entries.select("token", "doc_id").join(held, "doc_id", "left").groupBy("token").agg(
        F.min(F.coalesce("component", "doc_id")).alias("lo"), F.max(F.coalesce("component", "doc_id")).alias("hi"))
    open_lists = passing(entries, "token", Filter(spread.where("lo < hi").select("token")))
    # Each set was compared with one leader, so its component, that distance and its long lists all go by its id.
    distance = F.col("na") + F.col("nb") - 2 * F.col("shared")
    away = checked.groupBy(F.col("b").alias("doc_id")).agg(
        F.max("a").alias("compared"), (F.min("a") == F.max("a")).alias("one"), F.min(distance).alias("near"),
        F.max(distance).alias("far"))
    away = away.where("one and near = far").select("doc_id", "compared", "far")
    known = open_lists.join(held, "doc_id", "left").join(away, "doc_id", "left")
    known = known.withColumn("component", F.coalesce("component", "doc_id")).withColumn("away", F.when(
        F.col("doc_id") == F.col("leader"), 0).when(F.col("compared") == F.col("leader"), F.col("far")))
    known = known.withColumn("long", (F.col("many") > LONG_LIST).cast("long"))
    # one row per shingle of a document's prefix
    known = known.withColumn("longs", F.sum("long").over(Window.partitionBy("doc_id"))).drop("compared", "far", "leader", "many")
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BLOCK_RATIO)))
    known = stage(known.withColumn("block", block), "jaccard-open")
    left = known.select("token", "long", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("position").alias("pa"),
                        F.col("component").alias("ca"), F.col("away").alias("da"), F.col("longs").alias("la"), "block",
                        F.col("block").alias("own_a"))
    right = known.select("token", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("position").alias("pb"),
                         F.col("component").alias("cb"), F.col("away").alias("db"), F.col("longs").alias("lb"),
                         F.explode(F.array("block", F.col("block") - 1)).alias("block"), F.col("block").alias("own_b"))
    both = F.col("na") + F.col("nb")
    behind = F.greatest(_behind(F.col("na")), _behind(F.col("nb")))
    apart = F.abs(F.col("da") - F.col("db"))
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    # Two sets whose long lists alone could not make a link need not meet there: if they link they
    # share a shorter list too, and are found in that.
    enough = _may_link(F.least("la", "lb") + behind, both)
    met = left.join(right, ["token", "block"]).where(
        (F.col("ca") != F.col("cb")) & ((F.col("own_b") > F.col("own_a")) | (F.col("a") < F.col("b")))
        & (100 * F.least("na", "nb") >= LEAST_PERCENT * F.greatest("na", "nb"))
        & (apart.isNull() | ((100 + LEAST_PERCENT) * apart <= (100 - LEAST_PERCENT) * both))
        & ((F.col("long") == 0) | enough))
    # the first shingle that both share leaves room for all others in both sets
    pairs = met.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.sum(1 - F.col("long")).alias("short"), F.sum("long").alias("long"), F.max(_may_link(rest, both)).alias("fits"),
        F.max(both).alias("both"), F.max(behind).alias("behind"),
        F.max(F.least("la", "lb")).alias("longs"), F.max(enough).alias("enough"))
    # What the set whose prefix ends first shares of its prefix is among what both prefixes share, so
    # both share no more than that and the longer of the remainders.
    shared = F.col("short") + F.when(F.col("enough"), F.col("long")).otherwise(F.col("longs"))
    fits = F.col("fits") | ~F.col("enough")
    return pairs.where(fits & _may_link(shared + F.col("behind"), F.col("both"))).select(
        F.col("x").alias("a"), F.col("y").alias("b"))


def _may_link(shared: Column, both: Column) -> Column:
    """Whether so many shared shingles are enough for sets of so many together."""
    return (100 + LEAST_PERCENT) * shared >= LEAST_PERCENT * both


def _behind(n: Column) -> Column:
    """Shingles of a set of ``n`` that are not in its prefix."""
    return F.ceil(LEAST_PERCENT * n / 100) - 1


def _link_groups(sets: DataFrame, rows: DataFrame, counted: DataFrame) -> DataFrame:
    """(node, component) of all sets with a link."""
    same = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("a"), F.count("*").alias("many"))
    copies = sets.where("n > 0").join(same.where("many > 1"), "digest").where("doc_id <> a")
    links = stage(copies.select("a", F.col("doc_id").alias("b")), "jaccard-copies")
    entries = _entries(sets, counted)
    starred = entries.where("doc_id <> leader").groupBy("doc_id", "leader").agg(F.count("*").alias("met"))
    starred = stage(starred, "jaccard-stars")
    groups = components(links, "jaccard-groups")
    # Leaders only prepare: a pair left out here is still among the candidates below.
    sizes = starred.join(sets.select("doc_id", "n"), "doc_id").where(20 * F.col("met") >= F.col("n"))
    best = sizes.groupBy(F.col("doc_id").alias("b")).agg(
        F.max_by("leader", F.struct("met", -F.col("leader"))).alias("a"))
    checked = _verify(_apart(best.select("a", "b"), groups), rows, "jaccard")
    links = links.union(checked.where(_links(F.col("na"), F.col("nb"), F.col("shared"))).select("a", "b"))
    groups = components(links, "jaccard-groups")
    rest = _candidates(entries, groups, checked).join(checked.select("a", "b"), ["a", "b"], "left_anti")
    found = _verify(rest, rows, "jaccard")
    links = links.union(found.where(_links(F.col("na"), F.col("nb"), F.col("shared"))).select("a", "b"))
    return components(links, "jaccard-groups")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are runs without ASCII white space, A-Z lowered; a set holds the distinct runs of five
    words. Documents link from a similarity of 0.75; the component is the smallest id reachable.
    Null, empty and blank texts have no shingle and link with nothing, not even each other. Ids are
    whole numbers; rows that repeat an id are one document that links where any of them does; a
    null id stays alone with a null component. An empty table gives no rows.
    """
    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    first, counted = _counted(rows)
    sets = stage(_sets(rows, first, counted), "jaccard-sets")
    groups = _link_groups(sets.where("doc_id is not null"), rows, counted)
    named = sets.join(groups, sets["doc_id"] == groups["node"], "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns."""
    kept = jaccard_groups(docs, id_col, text_col).where("doc_id is null or doc_id = component_id")
    kept = kept.select(F.col("doc_id").alias("_kept")).distinct()
    held = docs.select(F.col(id_col).cast("long").alias("id"), F.struct("*").alias("row"))
    return held.join(kept, held["id"].eqNullSafe(kept["_kept"]), "left_semi").select("row.*")
