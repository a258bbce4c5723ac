"""Mixing sources to target weights (operator 8), in DataFrame functions only.

The words of a source, document after document, are packed into blocks of ``block_words``. The mix has as many slots as
its targets need; a pseudorandom permutation of all slots deals them to output shards, so the source counts of a shard are
a multinomial draw (without replacement over the whole mix: shards vary, totals meet the targets within one block per
source). Slot k of a source takes the block at place k of that source's pseudorandom permutation, one permutation per
pass over the source, and slots meet blocks in a join by index. A hash of its key decides everything, so reruns agree.

Defined cases: a null text has size 0; a null source is a source, the last one; a document without words is never taken;
repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored. The source
table (one row per source) is ordered in one task; documents, blocks and slots never are: a source is cut into 4096
slices by hash before its running sums, and its slots are made in chunks. Tables with a row per document, block or slice
are joined by merging: written narrow, they are so small on disk that Spark would take them for broadcasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftline.llm.native import WORD, let, permuted
from riftline.llm.shared import stored

BLOCK_WORDS = 128
SHARD_SLOTS = 4096
MOST = 3  # passes over a source
SLICES = 4096
CHUNK = 4096
TASK_SLOTS, MOST_TASKS = 1 << 16, 1 << 15  # slots that one task makes, at most so many tasks


def sizes(docs: DataFrame) -> DataFrame:
    """_row, doc_id, source and size (words) of each document, written once."""
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return stored(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "source", count.alias("size")), "mix_sizes")


def targets(sized: DataFrame) -> DataFrame:
    """Per source: number (by code point, null last), weight, source_size, target, blocks, slots, first slot.

    Weights 1, 2, 3, repeating, share all words. A target stops at ``MOST`` times its source; the excess goes to the
    others by weight. With sources in order of cap over weight, the level at which the rest share what is left is known
    at each of them, and the first source above its level ends the capped ones.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy(F.lit(1))
    by_cap = Window.orderBy("_ratio", "number")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = (MOST * F.col("source_size")).cast("double")
    named = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "number", (F.row_number().over(by_name) - 1).cast("long")
    )
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    shared = (
        named.withColumn("weight", F.pmod("number", F.lit(3)) + 1)
        .withColumns({"_cap": cap, "_ratio": cap / F.col("weight")})
        .withColumn("_level", level)
        .withColumn("_free", F.col("_ratio") > F.col("_level"))
        .withColumn("_at", F.min(F.when(F.col("_free"), F.struct("_ratio", "number", "_level"))).over(every))
    )
    target = F.when(F.col("_free") & F.col("_at").isNotNull(), F.col("_at._level") * F.col("weight")).otherwise(F.col("_cap"))
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long")
    slots = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), MOST * F.col("blocks"))
    return (
        shared.withColumn("target", target)
        .withColumn("blocks", blocks)
        .withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(F.lit(0).cast("long")))
        .withColumn("first_slot", F.sum("slots").over(Window.orderBy("number")) - F.col("slots"))
        .withColumn("all_slots", F.sum("slots").over(every))
        .select("source", "number", "weight", "source_size", "target", "blocks", "slots", "first_slot", "all_slots")
    )


def slots(shares: DataFrame, seed: int = 8) -> DataFrame:
    """The mix: shard, slot, number (of the source) and block, one row per slot."""
    chunks = shares.filter("slots > 0").withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("slots") - 1, F.lit(CHUNK))))
    )
    start = F.col("_chunk") * CHUNK
    row = shares.agg(F.max("all_slots")).first()
    tasks = max(1, min(MOST_TASKS, (row[0] or 0) // TASK_SLOTS))
    each = chunks.repartition(tasks, "number", "_chunk").withColumn(
        "_k", F.explode(F.sequence(start, F.least(start + CHUNK, F.col("slots")) - 1))
    )
    lap = F.call_function("div", F.col("_k"), F.col("blocks"))
    place = permuted(F.col("first_slot") + F.col("_k"), F.col("all_slots"), F.lit(seed))
    block = permuted(F.pmod("_k", "blocks"), F.col("blocks"), F.lit(seed + 1), F.col("number"), lap)
    return each.select("number", place.alias("_place"), block.alias("block")).select(
        F.call_function("div", F.col("_place"), F.lit(SHARD_SLOTS)).alias("shard"),
        F.pmod("_place", F.lit(SHARD_SLOTS)).alias("slot"), "number", "block",
    )


def shard_counts(mix: DataFrame) -> DataFrame:
    """Slots of each source in each output shard."""
    return mix.groupBy("shard", "number").agg(F.count(F.lit(1)).alias("slots"))


def pieces(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """Which words of which document lie in which block: _row, number, block, first_word, n_words."""
    numbered = sized.join(
        shares.select(F.col("source").alias("_source"), "number"), F.col("source").eqNullSafe(F.col("_source"))
    ).filter("size > 0").withColumn("_slice", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SLICES)))
    sums = numbered.groupBy("number", "_slice").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("number").orderBy("_slice")
    offsets = sums.select("number", "_slice", (F.sum("_words").over(earlier) - F.col("_words")).alias("_offset"))
    inside = Window.partitionBy("number", "_slice").orderBy("doc_id", "size", "_row")
    start = F.col("_offset") + F.sum("size").over(inside) - F.col("size")
    placed = numbered.join(offsets.hint("merge"), ["number", "_slice"]).select("_row", "number", start.alias("_start"), (start + F.col("size")).alias("_end"))
    cut = placed.withColumn("block", F.explode(F.sequence(
        F.call_function("div", F.col("_start"), F.lit(BLOCK_WORDS)), F.call_function("div", F.col("_end") - 1, F.lit(BLOCK_WORDS))
    )))
    low = F.greatest(F.col("_start"), F.col("block") * BLOCK_WORDS)
    high = F.least(F.col("_end"), (F.col("block") + 1) * BLOCK_WORDS)
    return cut.select("_row", "number", "block", (low - F.col("_start")).alias("first_word"), (high - low).alias("n_words"))


def taken_pieces(sized: DataFrame, shares: DataFrame, seed: int = 8) -> DataFrame:
    """The pieces that the mix takes, with how many slots take them."""
    used = slots(shares, seed).groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))
    return pieces(sized, shares).join(used.hint("merge"), ["number", "block"])


def mix_report(docs: DataFrame, seed: int = 8) -> DataFrame:
    """Per document: size, its source's size and target, and the words of it that the mix takes, repeats counted."""
    sized = sizes(docs)
    shares = stored(targets(sized), "mix_targets")
    taken = taken_pieces(sized, shares, seed).groupBy("_row").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    per_source = shares.select(F.col("source").alias("_source"), "source_size", "target")
    return (
        sized.join(per_source, F.col("source").eqNullSafe(F.col("_source")))
        .join(taken.withColumnRenamed("_row", "_taken_row").hint("merge"), F.col("_row") == F.col("_taken_row"), "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def _some_words(text: Column, spans: Column) -> Column:
    """The words of the spans with the white space that follows each."""
    parts = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    return let(parts, lambda held: F.array_join(F.flatten(F.transform(
        spans, lambda s: F.slice(held, s["first_word"].cast("int") + 1, s["n_words"].cast("int"))
    )), ""))


def mixed_documents(docs: DataFrame, seed: int = 8) -> DataFrame:
    """The documents as the mix takes them: one row per document and pass with the words taken in that pass (the whole
    text where all are), n_chars anew, other columns as they were."""
    # the document travels as one column, so that no name of it can clash
    whole_doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = stored(docs.select(F.monotonically_increasing_id().alias("_row"), whole_doc.alias("_doc")), "mix_documents")
    count = F.coalesce(F.regexp_count("_doc.text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = stored(held.select("_row", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.source").alias("source"), count.alias("size")), "mix_sizes")
    shares = stored(targets(sized), "mix_targets")
    passes = taken_pieces(sized, shares, seed).withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    takes = passes.groupBy("_row", "_pass").agg(
        F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("_spans"), F.sum("n_words").alias("_words")
    ).withColumnRenamed("_row", "_taken_row")
    whole = takes.join(sized.select(F.col("_row").alias("_taken_row"), "size").hint("merge"), "_taken_row")
    joined = held.join(whole.hint("merge"), F.col("_row") == F.col("_taken_row"))
    full = F.col("_doc.text")
    text = F.when(F.col("_words") == F.col("size"), full).otherwise(_some_words(full, F.col("_spans")))
    mixed = joined.select(text.alias("_text"), "_doc")
    return mixed.select(*[
        F.col("_text").alias(c) if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns
    ])
