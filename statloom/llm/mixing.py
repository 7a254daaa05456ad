"""Mix sources to target weights with DataFrame functions only.

The words of each source, its documents one after another in a fixed pseudorandom order, form blocks of equal length.
Every output shard draws its source counts: the whole part of what it expects of each source, and for its remaining
slots a multinomial draw by the fractions left, which keeps a source's total within about the root of the number of
shards of its target. The shards' counts, one after another, number a source's slots; its k-th slot takes block pi(k) of
it, where pi is a pseudorandom permutation for each pass over the source; and slots and blocks meet in an equality join
on source and block index.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.base import WORD, dealt, stash, uniform

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
BLOCK_WORDS = 32
SHARD_SLOTS = 1 << 16
ROUNDS = 12
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size) with target: weights in turn by code point, null last, as shares of all sizes.

    A target stops at `most` times its source's size; the excess goes to the others by weight until none is above. In
    order of most * size / weight the capped sources come first: a source is capped if that ratio is below the level
    that the sources from it on would share. One row per source passes through these windows.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)).cast("int") + 1))
    ranked = ranked.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / F.sum("weight").over(rest)).withColumn("capped", F.col("ratio") <= F.col("level"))
    first = F.min(F.when(~F.col("capped"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"]
    return level.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * first)).select("source", "source_size", "target")


def running_total(rows: DataFrame, groups: list[str], order: list[str], value: str, out: str, parts: int) -> DataFrame:
    """Sum of value over the earlier rows of the group, in an order by pseudorandom part and then `order`.

    Two levels keep a large group out of one task: totals of the parts are summed up first, then the rows within one
    part. parts: about the root of the number of rows.
    """
    split = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(SEED), *order), F.lit(parts)))
    keys = [*groups, "_part"]
    totals = split.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    same = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = split.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(starts.hint("merge"), on=same, how="inner").withColumn(out, F.col("_start") + F.col("_within")).select(*rows.columns, out)


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. size-1 by swap-or-not rounds; key selects it."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(r, F.lit(SEED), *key) - x, size)
        return F.when(F.xxhash64(F.greatest(x, partner), r, *key).bitwiseAND(1) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def slots(sources: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, most: int = MOST_PASSES, seed: int = SEED) -> DataFrame:
    """One row per slot of the mix: source_id, shard, slot (its number within the source) and block. sources: source_id,
    source_size, target.

    All shards have the same number of slots, about shard_slots. No source has more slots than `most` passes over it; a
    shard is short of those that its draws would have beyond them.
    """
    blocks = F.ceil(F.col("source_size") / F.lit(float(block_words)))
    drawn = sources.where("source_size > 0").select("source_id", blocks.alias("blocks"), (F.col("target") * blocks / F.col("source_size")).alias("share"))
    whole = drawn.agg(F.sum("share").alias("n")).first()["n"] or 0.0
    shards = max(1, ceil(whole / shard_slots))
    per_shard = max(1, round(whole / shards))
    expected = F.col("share") * F.lit(per_shard / max(whole, 1e-300))
    drawn = drawn.withColumn("sure", F.floor(expected + 1e-9)).withColumn("rest", F.greatest(F.lit(0.0), expected - F.col("sure")))
    told = drawn.agg(F.sum("sure").alias("sure"), F.sum("rest").alias("rest"), F.count("*").alias("sources")).first()
    left = per_shard - (told["sure"] or 0)
    # the sure slots: those of the first shard, then those of the next; in chunks of about the root of their number, so
    # that no task unrolls them all
    n = F.col("sure") * shards
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("long")
    chunks = drawn.where("sure > 0").withColumn("n", n).withColumn("step", step).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("step")))))
    each = dealt(chunks, "source_id", "chunk").select("source_id", "blocks", "sure", F.explode(F.sequence(F.col("chunk") * F.col("step"), F.least("n", (F.col("chunk") + 1) * F.col("step")) - 1)).alias("slot"))
    each = each.select("source_id", "blocks", F.floor(F.col("slot") / F.col("sure")).alias("shard"), "slot")
    if left > 0 and told["rest"] and told["rest"] > 0:
        each = each.unionByName(_draws(drawn, shards, int(left), told["rest"], told["sources"], seed))
    each = each.where(F.col("slot") < most * F.col("blocks"))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    return each.select("source_id", "shard", "slot", permuted(F.col("slot") - turn * F.col("blocks"), F.col("blocks"), F.col("source_id"), turn, F.lit(seed)).alias("block"))


def _draws(drawn: DataFrame, shards: int, left: int, rest: float, buckets: int, seed: int) -> DataFrame:
    """The slots that shards draw beyond their sure ones: left of them a shard, a source by its fraction each.

    A draw is a point on the line of all fractions; points and the sources' stretches of it meet in buckets, as many as
    there are sources.
    """
    spark = drawn.sparkSession
    by_source = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    lines = drawn.where("rest > 0").withColumn("high", F.sum("rest").over(by_source)).withColumn("low", F.col("high") - F.col("rest"))
    bucket = lambda x: F.least(F.lit(buckets - 1), F.floor(x * F.lit(buckets / rest))).cast("long")
    lines = lines.select("source_id", "blocks", "sure", "low", "high", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))).alias("bucket"))
    points = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(left - 1))).alias("draw"))
    points = points.withColumn("at", F.least(uniform(F.xxhash64(F.lit(seed), "shard", "draw")), F.lit(1.0 - 1e-12)) * F.lit(rest * (1.0 - 1e-12)))
    met = points.withColumn("bucket", bucket(F.col("at"))).join(lines.hint("merge"), "bucket").where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    counts = met.groupBy("source_id", "blocks", "sure", "shard").agg(F.count("*").alias("n"))
    placed = running_total(counts, ["source_id"], ["shard"], "n", "start", max(1, ceil(sqrt(shards))))
    one = placed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return one.select("source_id", "blocks", "shard", (F.col("sure") * shards + F.col("start") + F.col("i")).alias("slot"))


def plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (row_id, source, size): the rows with source_id and start, the sources, and the slots."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    sources = targets(per_source, weights, most).withColumn("source_id", F.row_number().over(order).cast("long"))
    n = sizes.count()
    told = sizes.join(sources.select(F.col("source").alias("_source"), "source_id"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = running_total(told, ["source_id"], ["row_id"], "size", "start", max(1, ceil(sqrt(n))))
    return placed, sources, slots(sources, block_words, shard_slots, most, seed)


def _times(drawn: DataFrame) -> DataFrame:
    """How often the slots take each block."""
    return drawn.groupBy("source_id", "block").agg(F.count("*").alias("times"))


def parts(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source_id, block, row_id, size, first word and words of each part of a document that lies in one block."""
    filled = dealt(placed.where("size > 0").select("source_id", "row_id", "start", "size"), "row_id")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut = filled.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0).cast("long"), F.col("block") * block_words - F.col("start"))
    end = F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start"))
    return cut.select("source_id", "block", "row_id", "size", begin.alias("first"), (end - begin).alias("words"))


def pieces(placed: DataFrame, drawn: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """row_id, size, first word, words and times taken of each part of a document that lies in one drawn block."""
    return parts(placed, block_words).join(_times(drawn).hint("merge"), ["source_id", "block"]).select("row_id", "size", "first", "words", "times")


def shard_pieces(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """What each output shard holds: shard, source, slot (of the source), doc_id, first word and words, a row for each
    part of a document in a drawn block. Rows without words are in no shard; nulls and repeats are as in mix()."""
    sizes, _ = stash(_rows(docs), "sizes")
    placed, sources, drawn = plan(sizes, weights, most, block_words, shard_slots, seed)
    held = parts(placed, block_words).join(drawn.hint("merge"), ["source_id", "block"]).join(sources.select("source_id", "source"), "source_id")
    return held.select("shard", "source", "slot", "row_id.doc_id", "first", "words")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a row_id of each row of docs, the same in each run.

    row_id: doc_id, a hash of source and text, and the number of the row among those that are alike in all three.
    """
    counted = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), _mark().alias("mark"))
    again = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("mark"))
    return counted.select("doc_id", "source", "size", F.struct("doc_id", "mark", again.alias("again")).alias("row_id"))


def _mark() -> Column:
    return F.xxhash64(F.col("source").cast("string"), F.col("text").cast("string"))


def _words(text: Column) -> Column:
    """The words of a text. Splitting at a plain space is much faster than by a pattern."""
    for c in "\t\n\v\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken.

    A null or empty text has size 0 and taken 0; a null source is a source of its own, the last; rows that repeat a
    doc_id are mixed each for itself; an empty table gives an empty result; further columns are ignored. A document
    takes at most `most` times its size, as each block is drawn once a pass.
    """
    sizes, _ = stash(_rows(docs), "sizes")
    placed, sources, drawn = plan(sizes, weights, most, block_words, seed=seed)
    taken = pieces(placed, drawn, block_words).groupBy("row_id").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    told = sizes.join(taken.hint("merge"), "row_id", "left").join(sources.select(F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source")))
    return told.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def apply_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """docs as mixed: the k-th row of a document holds its words that the mix takes k times or more.

    A row with all words of its document has its text unchanged; one with some of them has these in order, joined by
    single spaces. n_chars, where docs has it, is that of the new text; the other columns are unchanged. Documents of
    which nothing is taken, those without words among them, have no row. Further columns may have any name.
    """
    sizes, _ = stash(_rows(docs), "sizes")
    placed, _, drawn = plan(sizes, weights, most, block_words, seed=seed)
    held = pieces(placed, drawn, block_words).groupBy("row_id").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("first", "words", "times"))).alias("parts"))
    taken, _ = stash(held, "parts")
    # the row as a whole, so that no column of docs meets one of ours; only rows that are alike need numbers
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), _mark().alias("own_mark"))
    alike = not taken.where("row_id.again > 1").limit(1).isEmpty()
    again = F.row_number().over(Window.partitionBy("own_id", "own_mark").orderBy("own_mark")) if alike else F.lit(1)
    same = F.col("own_id").eqNullSafe(F.col("row_id.doc_id")) & (F.col("own_mark") == F.col("row_id.mark")) & (F.col("own_again") == F.col("row_id.again"))
    copies = rows.withColumn("own_again", again).join(taken.hint("merge"), same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.array_max("parts.times").cast("int"))))
    chosen = F.filter("parts", lambda p: p["times"] >= F.col("copy"))
    count = F.aggregate(chosen, F.lit(0).cast("long"), lambda n, p: n + p["words"])
    text = F.col("row.text").cast("string")
    # the outer function binds the words, so a copy's text is split once
    cut = F.transform(F.array(_words(text)), lambda w: F.array_join(F.flatten(F.transform(chosen, lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int")))), " "))[0]
    mixed = copies.select("row", F.when(count == F.col("size"), text).otherwise(cut).alias("mixed"))
    new = {"text": F.col("mixed")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("mixed").cast(docs.schema["n_chars"].dataType)
    return mixed.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
