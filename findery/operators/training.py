"""Training data for contrastive encoders: chunks, crops, augmentation, batches.

Every random choice is a hash draw of (seed, key, position): repeatable, and the
same however the rows are partitioned. Token rules are array expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.functions.draws import draw, draw_int, hash32, position_draw, position_hash
from findery.functions.text import normalize_punctuation, title_text, words
from findery.functions.vectors import let
from findery.operators.prefix import ranged_running_sum

#: Equal parts of the unit interval in which dataset shares are looked up.
MIX_CELLS = 1 << 12

#: More than any position: the factor that leaves a position the low bits below a hash of 32 bits.
POSITIONS = 1 << 31


def token_ids(text: Column, vocabulary: int = 30_000) -> Column:
    """Word ids by hash; stands in for a sub-word tokeniser."""
    return F.transform(words(text), lambda w: (
        F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % vocabulary).cast("int"))


# ---- token streams -----------------------------------------------------------------

def dataset_offset(dataset: Column, length: int, seed: str) -> Column:
    """Start offset in [0, length) of a dataset's stream."""
    return draw_int(F.lit(0), F.lit(length - 1), seed, dataset)


def token_chunks(docs: DataFrame, length: int, seed: str, dataset_col: str = "dataset", id_col: str = "doc_id",
                 token_col: str = "tokens") -> DataFrame:
    """(dataset, chunk_id, tokens): fixed-length chunks of each dataset's concatenated documents.

    The stream starts at the dataset's offset and its last partial chunk is dropped.
    Documents learn their place from sums over ranges of sizes; a chunk then gathers
    its pieces, ``length`` tokens at most, so a large dataset is as parallel as
    many small ones.
    """
    sizes = docs.select(dataset_col, id_col, F.size(token_col).cast("long").alias("_n"))
    placed = ranged_running_sum(sizes, [dataset_col], [F.col(id_col)], F.col("_n"), "_at")
    rows = docs.select(id_col, token_col).join(placed.where("_n > 0"), id_col)
    offset = dataset_offset(F.col(dataset_col), length, seed)
    rows = rows.withColumn("_o", offset).withColumn("_end", F.col("_at") + F.col("_n")).where("_end > _o")
    first = F.floor((F.greatest("_at", "_o") - F.col("_o")) / length)
    last = F.floor((F.col("_end") - 1 - F.col("_o")) / length)

    def piece(chunk: Column) -> Column:
        low = F.greatest(F.col("_at"), F.col("_o") + chunk * length)
        high = F.least(F.col("_end"), F.col("_o") + (chunk + 1) * length)
        cut = F.slice(token_col, (low - F.col("_at") + 1).cast("int"), (high - low).cast("int"))
        return F.struct(chunk.alias("chunk_id"), F.struct(low.alias("at"), cut.alias("piece")).alias("p"))

    # a document is cut first, so that no row carries all its tokens along
    pieces = rows.select(dataset_col, F.explode(F.transform(F.sequence(first, last), piece)).alias("_c"))
    gathered = pieces.select(dataset_col, "_c.chunk_id", F.col("_c.p").alias("_p"))
    return (
        gathered.groupBy(dataset_col, "chunk_id")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list("_p")), lambda p: p["piece"])).alias("tokens"))
        .where(F.size("tokens") == length)
    )


def random_crop(tokens: Column, ratio_min: float, ratio_max: float, seed: str, *key: Column) -> Column:
    """A run of ``floor(n * ratio)`` tokens from a random start."""
    ratio = F.lit(ratio_min) + draw(f"{seed}-ratio", *key) * F.lit(ratio_max - ratio_min)
    length = F.floor(F.size(tokens) * ratio).cast("int")
    start = draw_int(F.lit(0), F.size(tokens) - length, f"{seed}-start", *key).cast("int")
    return F.slice(tokens, start + 1, length)


def delete_words(tokens: Column, p: float, seed: str, *key: Column) -> Column:
    """Each token stays when its draw is above ``p``."""
    return let(hash32(seed, *key), lambda h: F.filter(tokens, lambda t, i: position_draw(h, i) > p))


def replace_words(tokens: Column, low: int, high: int, p: float, seed: str, *key: Column) -> Column:
    """Each token, with probability ``p``, becomes a random id in [low, high]."""

    def change(h: Column) -> Column:
        other = lambda i: (low + F.floor(position_draw(h["id"], i) * (high - low + 1))).cast("int")
        return F.transform(tokens, lambda t, i: F.when(position_draw(h["keep"], i) > p, t).otherwise(other(i)))

    return let(F.struct(hash32(seed, *key).alias("keep"), hash32(f"{seed}-id", *key).alias("id")), change)


def mask_words(tokens: Column, mask_id: int, p: float, seed: str, *key: Column) -> Column:
    """Each token, with probability ``p``, becomes the mask id."""
    return let(hash32(seed, *key), lambda h: F.transform(
        tokens, lambda t, i: F.when(position_draw(h, i) > p, t).otherwise(F.lit(mask_id))))


def shuffle_words(tokens: Column, p: float, seed: str, *key: Column) -> Column:
    """As many positions as draws below ``p`` are chosen and their tokens permuted.

    Orders are sorts of whole numbers: a hash or a position in the high bits, a position in the low ones.
    """
    low = lambda v: v.bitwiseAND(F.lit(POSITIONS - 1)).cast("int")
    over = lambda high, i: high.cast("long") * F.lit(POSITIONS) + i

    def spots(h: Column) -> Column:
        ranked = F.sort_array(F.transform(tokens, lambda t, i: over(position_hash(h["spot"], i), i)))
        count = F.size(F.filter(tokens, lambda t, i: position_draw(h["n"], i) < p))
        # the count is one number, so it is not worked out again for each slice
        return let(F.struct(ranked.alias("all"), count.alias("n")), lambda r: F.struct(
            F.transform(F.slice(r["all"], 1, r["n"]), low).alias("chosen"),
            F.transform(F.slice(r["all"], r["n"] + 1, F.size(tokens)), low).alias("others")))

    def moved(chosen: Column, h: Column) -> Column:
        return F.transform(F.sort_array(F.transform(chosen, lambda i: over(position_hash(h["move"], i), i))), low)

    def placed(s: Column, new: Column) -> Column:
        # by position again: the chosen spots with the positions of their new tokens among the others
        pairs = F.transform(s["chosen"], lambda i, j: over(i, F.get(new, j)))
        rest = F.transform(s["others"], lambda i: over(i, i))
        return F.transform(F.sort_array(F.concat(pairs, rest)), lambda v: F.get(tokens, low(v)))

    hashes = F.struct(hash32(seed, *key).alias("n"), hash32(f"{seed}-spot", *key).alias("spot"),
                      hash32(f"{seed}-move", *key).alias("move"))
    return let(hashes, lambda h: let(spots(h), lambda s: let(moved(s["chosen"], h), lambda new: placed(s, new))))


def add_ends(tokens: Column, bos: int | None, eos: int | None) -> Column:
    """Begin and end marks, each optional."""
    end = lambda x: F.array(F.lit(x)) if x is not None else F.array().cast("array<int>")
    return F.concat(end(bos), tokens, end(eos))


def pad_batch(rows: DataFrame, batch_cols: list[str], token_col: str = "tokens") -> DataFrame:
    """Tokens padded with 0 to the longest of their batch, and the mask; a batch is a bounded group."""
    longest = F.max(F.size(token_col)).over(Window.partitionBy(*batch_cols))
    missing = F.col("_max") - F.size(token_col)
    return rows.withColumn("_max", longest).select(
        *[c for c in rows.columns if c != token_col],
        F.concat(F.col(token_col), F.array_repeat(F.lit(0), missing)).alias("ids"),
        F.concat(F.array_repeat(F.lit(True), F.size(token_col)), F.array_repeat(F.lit(False), missing)).alias("mask"),
    )


def augment(tokens: Column, how: str, p: float, seed: str, key: tuple[Column, ...], mask_id: int,
            ids: tuple[int, int] = (0, 0)) -> Column:
    """One of the augmentations by name; ``none`` leaves the tokens as they are."""
    rules = {
        "none": lambda: tokens, "delete": lambda: delete_words(tokens, p, seed, *key),
        "replace": lambda: replace_words(tokens, *ids, p, seed, *key),
        "mask": lambda: mask_words(tokens, mask_id, p, seed, *key),
        "shuffle": lambda: shuffle_words(tokens, p, seed, *key),
    }
    return rules[how]()


def training_pairs(rows: DataFrame, batch_cols: list[str], ratio: tuple[float, float], seed: str, key: tuple[Column, ...],
                   how: str, p: float, bos: int | None, eos: int | None, mask_id: int, ids: tuple[int, int] = (0, 0),
                   token_col: str = "tokens") -> DataFrame:
    """Query and key of every chunk: two crops, augmented, fenced and padded to the longest of their batch.

    Adds q_ids, q_mask, k_ids, k_mask and drops the tokens; a batch is a bounded group.
    """

    def view(side: str) -> Column:
        crop = random_crop(F.col(token_col), *ratio, f"{seed}-{side}", *key)
        changed = let(crop, lambda c: augment(c, how, p, f"{seed}-{side}-{how}", key, mask_id, ids))
        return add_ends(changed, bos, eos)

    out = rows.withColumns({"_q": view("q"), "_k": view("k")}).drop(token_col)
    for side in ("q", "k"):
        out = pad_batch(out, batch_cols, f"_{side}").withColumnsRenamed({"ids": f"{side}_ids", "mask": f"{side}_mask"})
    return out


# ---- mixing ------------------------------------------------------------------------

def sampling_weights(rows: DataFrame, dataset_col: str, coeff: float) -> DataFrame:
    """(dataset, size, weight): size share to the power ``coeff``, scaled to sum 1; 0 makes them equal."""
    everything = Window.partitionBy()  # one row per dataset
    sizes = rows.groupBy(dataset_col).agg(F.count("*").alias("size"))
    share = sizes.withColumn("_p", F.pow(F.col("size") / F.sum("size").over(everything), F.lit(coeff)))
    return share.select(dataset_col, "size", (F.col("_p") / F.sum("_p").over(everything)).alias("weight"))


def mix_datasets(rows: DataFrame, samples: DataFrame, coeff: float, seed: str, dataset_col: str = "dataset",
                 row_col: str = "chunk_id", sample_col: str = "sample_id") -> DataFrame:
    """For every sample a dataset by weight, then one of its rows at random, with replacement.

    ``row_col`` numbers a dataset's rows from 0. The unit interval is cut into equal cells; a
    dataset is listed in the cells its share touches, so a draw finds it by an equal join whatever
    the number of datasets.
    """
    # one row per dataset
    order = Window.orderBy(dataset_col)
    until = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shares = sampling_weights(rows, dataset_col, coeff).withColumn("_to", until)
    shares = shares.withColumn("_from", F.coalesce(F.lag("_to").over(order), F.lit(0.0)))
    shares = shares.withColumn("_to", F.when(F.lead("_to").over(order).isNull(), F.lit(2.0)).otherwise(F.col("_to")))
    cell = lambda c: F.least(F.floor(c * MIX_CELLS), F.lit(MIX_CELLS - 1))
    listed = shares.withColumn("_cell", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("_to")))))
    chance = draw(f"{seed}-set", F.col(sample_col))
    drawn = samples.select(sample_col, chance.alias("_c")).withColumn("_cell", cell(F.col("_c"))).join(listed, "_cell")
    drawn = drawn.where((F.col("_c") >= F.col("_from")) & (F.col("_c") < F.col("_to"))).select(
        sample_col, dataset_col, draw_int(F.lit(0), F.col("size") - 1, f"{seed}-row", F.col(sample_col)).alias(row_col))
    return drawn.join(rows, [dataset_col, row_col])


# ---- supervised examples -----------------------------------------------------------

def _sample(items: Column, n: Column, seed: str, *key: Column) -> Column:
    """``n`` items without replacement, in draw order."""
    order = F.sort_array(F.transform(items, lambda x, i: F.struct(hash32(seed, *key, i).alias("h"), i.alias("i"))))
    return F.transform(F.slice(order, 1, n), lambda s: F.get(items, s["i"]))


def training_examples(examples: DataFrame, negatives: int, hard_ratio: float, hard_min_idx: int, seed: str,
                      id_col: str = "example_id", training: bool = True, normalize: bool = False) -> DataFrame:
    """(id, query, gold, negatives) from questions with positive, negative and hard negative contexts.

    In training the gold is a random positive; hard negatives are drawn
    Binomial(negatives, hard_ratio) from ``hard_min_idx`` on, random ones fill the
    rest, both limited by what there is. Otherwise the first of each is taken.
    """
    key = F.col(id_col)
    empty = F.array().cast("array<struct<title:string,text:string>>")
    positive, random_pool = F.col("positive_ctxs"), F.coalesce("negative_ctxs", empty)
    hard = F.coalesce("hard_negative_ctxs", empty)
    hard_pool = F.when(F.size(hard) > hard_min_idx, F.slice(hard, hard_min_idx + 1, F.size(hard))).otherwise(empty)
    tidy = normalize_punctuation if normalize else (lambda c: c)
    whole = lambda c: tidy(title_text(c["title"], c["text"]))
    if training:
        gold = F.get(positive, draw_int(F.lit(0), F.size(positive) - 1, f"{seed}-gold", key).cast("int"))
        wanted = sum((draw(f"{seed}-hard", key, F.lit(j)) < hard_ratio).cast("int") for j in range(negatives))
        base = examples.withColumn("_h", F.least(F.lit(0) + wanted, F.size(hard_pool))).withColumn(
            "_r", F.least(F.lit(negatives) - F.col("_h"), F.size(random_pool)))
        chosen = F.concat(_sample(random_pool, F.col("_r"), f"{seed}-random", key),
                          _sample(hard_pool, F.col("_h"), f"{seed}-pick", key))
    else:
        base, gold = examples, F.get(positive, F.lit(0))
        chosen = F.slice(random_pool, 1, 1)
    picked = base.select(key, F.col("question"), gold.alias("_g"), chosen.alias("_n"))
    return picked.select(id_col, tidy(F.col("question")).alias("query"), whole(F.col("_g")).alias("gold"),
                         F.transform("_n", whole).alias("negatives"))


def batch_passages(examples: DataFrame, batch_col: str = "batch_id", id_col: str = "example_id") -> DataFrame:
    """(batch, passages): golds in example order, then all negatives; a batch is a bounded group."""
    rows = F.sort_array(F.collect_list(F.struct(id_col, "gold", "negatives")))
    grouped = examples.groupBy(batch_col).agg(rows.alias("_e"))
    return grouped.select(batch_col, F.concat(
        F.transform("_e", lambda e: e["gold"]), F.flatten(F.transform("_e", lambda e: e["negatives"]))).alias("passages"))


def array_split(rows: DataFrame, world_size: int, index_col: str = "index_id") -> DataFrame:
    """Part of every row in a contiguous near-equal split; the first parts are one longer.

    Plain arithmetic on a dense index: no window, no shuffle.
    """
    total = rows.count()
    short, longer = divmod(total, world_size)
    edge = longer * (short + 1)
    i = F.col(index_col)
    head = F.floor(i / F.lit(short + 1))
    part = head if short == 0 else F.when(i < edge, head).otherwise(longer + F.floor((i - edge) / F.lit(short)))
    return rows.withColumn("part", part.cast("long"))


# ---- batch diagnostics -------------------------------------------------------------

def inbatch_stats(pairs: DataFrame, temperature: float, label_smoothing: float = 0.0, batch_col: str = "batch_id",
                  order_col: str = "pair_id", query_vec: str = "q", key_vec: str = "k") -> DataFrame:
    """Contrastive loss, accuracy and spread per batch: (batch, size, loss, accuracy, stdq, stdk).

    The score matrix of a batch lives inside its task; a batch is a bounded group.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col)
        q, k = (np.array(pdf[c].tolist(), dtype=np.float64) for c in (query_vec, key_vec))
        scores = q @ k.T / temperature
        top = scores.max(axis=1, keepdims=True)
        log_p = scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))
        own = np.arange(len(q))
        loss = -((1 - label_smoothing) * log_p[own, own] + label_smoothing * log_p.mean(axis=1)).mean()
        spread = lambda m: float(m.std(axis=0, ddof=1).mean()) if len(m) > 1 else float("nan")
        return pd.DataFrame({
            batch_col: [pdf[batch_col].iat[0]], "size": [len(q)], "loss": [loss],
            "accuracy": [100.0 * (np.round(scores, 9).argmax(axis=1) == own).mean()],
            "stdq": [spread(q)], "stdk": [spread(k)],
        })

    chosen = pairs.select(batch_col, order_col, query_vec, key_vec)
    return chosen.groupBy(batch_col).applyInPandas(
        one, f"{batch_col} long, size long, loss double, accuracy double, stdq double, stdk double")
