"""Mix sources to target weights, in column expressions only.

Every source's words are packed into blocks of one length. The output is a row of slots, cut into
shards; a pseudorandom permutation of all slots deals the sources' quotas over the shards, which is
the multinomial draw of source counts per shard, conditioned on its totals. A slot's number inside
its source goes through that source's own permutation to a block, and blocks are joined by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.llm.common import WORD, running_start, stage

BLOCK_WORDS = 128
SHARD_BLOCKS = 4096
SEED = 29
#: Slots one row hands on at a time while they are numbered.
CHUNK = 1 << 14
#: Rounds of the permutation; each swaps or leaves a pair.
ROUNDS = 16


def permuted(x: Column, n: Column, *keys: Column) -> Column:
    """A pseudorandom permutation of 0 ... n-1, another one for other keys.

    Swap-or-not: a round pairs x with (k - x) mod n, and one hash bit of the pair says whether both
    change places; so every round, and the whole, is one-to-one for any n.
    """

    def swap(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("pair"), *keys, r), n) - at, n)
        coin = F.xxhash64(F.lit("coin"), *keys, r, F.greatest(at, partner))
        return F.when(coin.bitwiseAND(F.lit(1)) == 1, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target, blocks, slots, first_slot) from (source, size), one row per source.

    Sources in code point order, null last, take the weights in turn. The share of all words is
    dealt by weight; a source stops at ``most`` times its size and the rest is dealt on by weight.
    That ends where every source has min(cap, level * weight), and the level is the largest of the
    levels that follow when the sources with the lowest cap per weight are full.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source here and below, not per document.
    placed = per.withColumn("no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("no") - 1) % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", turn).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fullest = Window.orderBy(F.col("cap") / F.col("weight"), "no")
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    onward = fullest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
             ) / F.sum("weight").over(onward)
    levelled = placed.withColumn("level", level)
    target = F.least(F.col("cap"), F.max("level").over(whole) * F.col("weight"))
    levelled = levelled.withColumn("target", target)
    blocks = F.ceil(F.col("source_size") / F.lit(BLOCK_WORDS)).cast("long")
    # the last block of a source may be short, so a slot counts for its mean block
    slots = F.when(F.col("source_size") > 0, F.least(
        F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"),
        F.floor(F.col("blocks") * F.lit(float(most))).cast("long"))).otherwise(F.lit(0).cast("long"))
    counted = levelled.withColumn("blocks", blocks).withColumn("slots", slots)
    earlier = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(
        "source", "source_size", "target", "blocks", "slots",
        F.coalesce(F.sum("slots").over(earlier), F.lit(0)).alias("first_slot"), F.sum("slots").over(whole).alias("all"))


def draw_slots(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, block): which block of which source fills each slot of the output."""
    last = F.floor((F.col("slots") - 1) / F.lit(CHUNK))
    chunks = sources.where("slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    # a count of its own: few small rows would be merged into one task, which then made all slots
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = chunks.repartition(tasks, "source", "chunk").withColumn(
        "j", F.explode(F.sequence(F.col("chunk") * CHUNK,
                                  F.least((F.col("chunk") + 1) * CHUNK, F.col("slots")) - 1)))
    epoch = F.floor(F.col("j") / F.col("blocks"))
    slot = permuted(F.col("first_slot") + F.col("j"), F.col("all"), F.lit(seed))
    block = permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("source"), epoch)
    drawn = numbered.select("source", slot.alias("slot"), block.alias("block"))
    return drawn.select(F.floor(F.col("slot") / SHARD_BLOCKS).alias("shard"), "slot", "source", "block")


def _key(df: DataFrame, *names: str) -> Column:
    """Columns as one key whose fields may be null: structs compare nulls as equal.

    The cast gives both sides of a join one type, else an implicit one would deal the rows out again.
    """
    fields = ", ".join(f"{n}: {df.schema[n].dataType.simpleString()}" for n in names)
    return F.struct(*names).cast(f"struct<{fields}>")


class Mix:
    """The parts of one mix: documents in their places, source targets and the drawn slots."""

    def __init__(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = SEED,
    ):
        body = F.coalesce(F.col(text_col), F.lit(""))
        self.texts = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                 body.alias("text"), F.xxhash64(body).alias("hash"))
        sized = self.texts.select(
            "doc_id", "source", "hash", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"))
        sized = sized.withColumn("place", _key(sized, "doc_id", "hash", "source"))
        #: (doc_id, source, hash, size, place, start): its words are start ... start + size - 1 of its source
        self.placed = stage(running_start(sized, ["source"], "place", "size", "start", "mix-sizes"), "mix-places")
        self.sources = stage(source_targets(self.placed.select("source", "size"), weights, share, most), "mix-sources")
        self.slots = draw_slots(self.sources, seed)

    def pieces(self) -> DataFrame:
        """``placed`` once for each block a document reaches into, with its words there: low up to high."""
        first = F.floor(F.col("start") / BLOCK_WORDS)
        last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
        reached = F.when(F.col("size") > 0, F.sequence(first, last))
        cut = self.placed.withColumn("block", F.explode_outer(reached))
        low = F.greatest(F.col("block") * BLOCK_WORDS - F.col("start"), F.lit(0))
        high = F.least((F.col("block") + 1) * BLOCK_WORDS - F.col("start"), F.col("size"))
        return cut.withColumn("low", low).withColumn("high", high)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken; words that the mix takes, repeats counted.

    A null text has size 0 and takes nothing; a null source is a source of its own, the last.
    Repeated rows are documents of their own. An empty table gives no rows.
    """
    mix = Mix(docs, **options)
    uses = mix.slots.groupBy("source", "block").agg(F.count("*").alias("times"))
    pieces = mix.pieces()
    used = uses.select(F.col("source").alias("s"), F.col("block").alias("b"), "times")
    met = pieces.join(used.hint("merge"), pieces["source"].eqNullSafe(used["s"]) & (pieces["block"] == used["b"]), "left")
    words = F.coalesce((F.col("high") - F.col("low")) * F.col("times"), F.lit(0))
    # start tells repeated rows with words apart; those without words stay apart by their count
    sums = met.groupBy("doc_id", "source", "hash", "start", "size").agg(
        F.sum(words).cast("long").alias("taken"), F.when(F.col("size") == 0, F.count("*")).otherwise(1).alias("rows"))
    sums = sums.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows").cast("long"))))
    targets = mix.sources.select(F.col("source").alias("s"), "source_size", "target")
    return sums.join(targets, sums["source"].eqNullSafe(targets["s"])).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


def mixed_text(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: shard, slot, part, source, doc_id, text.

    Parts 0, 1, ... of a slot are the pieces of the documents that its block holds, in their order;
    words are joined by one blank. Sizes, nulls and repeats are as in :func:`taken_words`.
    """
    mix = Mix(docs, **options)
    # one key of three columns that may be null; the text moves once for both steps
    texts = mix.texts.select(_key(mix.texts, "doc_id", "hash", "source").alias("place"), "text").dropDuplicates(["place"])
    places = mix.placed.where("size > 0").select("place", "doc_id", "source", "start", "size")
    whole = texts.join(places.hint("merge"), "place")
    words = whole.select("doc_id", "source", "start", "size",
                         F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    first = F.floor(F.col("start") / BLOCK_WORDS)
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)

    def piece(block: Column) -> Column:
        low = F.greatest(block * BLOCK_WORDS - F.col("start"), F.lit(0))
        high = F.least((block + 1) * BLOCK_WORDS - F.col("start"), F.col("size"))
        text = F.array_join(F.slice("words", (low + 1).cast("int"), (high - low).cast("int")), " ")
        return F.struct(block.alias("block"), text.alias("text"))

    # the slices of a document are made first, so no row carries the whole text along
    cut = words.select("doc_id", "source", "start", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    pieces = cut.select("doc_id", "source", "start", "p.block", "p.text")
    pieces = pieces.select("doc_id", _key(pieces, "source", "block").alias("at"), "start", "text")
    # at most BLOCK_WORDS pieces, each of a word or more, share a block; the join reads them as they lie
    order = Window.partitionBy("at").orderBy("start")
    pieces = pieces.withColumn("part", F.row_number().over(order) - 1)
    slots = mix.slots.select("shard", "slot", _key(mix.slots, "source", "block").alias("at"))
    return slots.join(pieces.hint("merge"), "at").select("shard", "slot", "part", "at.source", "doc_id", "text")
