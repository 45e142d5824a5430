"""Mixing sources to target weights with a low-discrepancy source schedule.

Each source's documents are shuffled by a hash and laid end to end; the stream, read up to `max_epochs` times, is cut
into blocks of `block_words`. Slot t of the schedule draws the van der Corput point of t, the cumulative weights map the
point to a source, and the slots of a source are ranked: the r-th takes the source's block r. The last block of a source
is cut where its target is met, so that the words taken come within one word of every target. The pieces of documents in the
blocks, in slot order, are the mix; what it takes of a document is the sum of its pieces.

Null source: a source of its own, the last one. Null or empty text: size 0, nothing taken. Rows equal in all of id,
source and size are separate rows, each with its own place. Empty input: empty result. Columns other than id, text and
source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut, prefix_sums, stored

WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(src, source_size, target) per source of sized (src, size). Sources by code point, null last, weigh `weights` in turn.

    The targets share `share` of all words by weight; one that would pass `max_epochs` times its source stops there, and
    the excess is shared again. That is the level at which sum(min(cap, level * weight)) is the total: sources are
    taken by cap per weight, and the first at which the level no longer passes its cap fixes it. The windows here
    run over one row per source.
    """
    per = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("words", F.lit(float(share)) * F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    per = per.withColumn("level", (F.col("words") - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(fill), F.lit(0.0))))
    free = F.col("level") * F.col("w") <= F.col("cap")
    per = per.withColumn("final", F.max(F.when(free, F.col("level"))).over(every))
    return per.select("src", "source_size", F.when(F.col("final").isNull() | (F.col("cap") < F.col("final") * F.col("w")), F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


def van_der_corput(t: str, bits: int = 40):
    """The base-2 van der Corput point of the slot number in column `t`, exact for fewer than 2**bits slots."""
    return F.conv(F.reverse(F.lpad(F.bin(F.col(t)), bits, "0")), 2, 10).cast("double") / F.lit(float(1 << bits))


def schedule(targets: DataFrame, block_words: int, cells: int = 4096, stretch: int = 65_536) -> DataFrame:
    """(src, r): the slots each source is due, ranked in schedule order as r, with the slot's number t.

    A slot whose source has had its last block stays empty. A source that the drawn slots leave short (its slots are
    ceil(target / block), more than its share by up to one) gets the missing ones after the last drawn slot.
    """
    spark = targets.sparkSession
    t = targets.select("src", F.ceil(F.round("target") / block_words).cast("long").alias("due")).where("due > 0")
    order = F.col("src").asc_nulls_last()
    t = t.withColumn("hi", F.sum("due").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("all", F.sum("due").over(Window.partitionBy()))
    slots = t.agg(F.coalesce(F.sum("due"), F.lit(0)).alias("n")).first()["n"]
    t = t.withColumn("lo_u", (F.col("hi") - F.col("due")) / F.col("all")).withColumn("hi_u", F.col("hi") / F.col("all"))
    # The map from points to sources as an equi-join: every interval is listed under the cells of [0, 1) that it touches.
    touched = F.sequence(F.floor(F.col("lo_u") * cells), F.least(F.floor(F.col("hi_u") * cells), F.lit(cells - 1)))
    ranges = t.select("src", "due", "lo_u", "hi_u", F.explode(touched).alias("cell"))
    drawn = spark.range(slots).withColumn("u", van_der_corput("id")).withColumn("cell", F.floor(F.col("u") * cells))
    drawn = drawn.join(ranges, "cell").where("u >= lo_u AND u < hi_u").select("src", "due", F.col("id").alias("t"))
    # Rank of a slot within its source: counts per stretch of the schedule first, then within a stretch.
    drawn = drawn.withColumn("s", F.floor(F.col("t") / stretch))
    base = drawn.groupBy("src", "s").count().withColumn("base", F.coalesce(F.sum("count").over(Window.partitionBy("src").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("src", "s").orderBy("t")) - 1)
    same = F.col("d.src").eqNullSafe(F.col("x.src"))
    ranked = drawn.alias("d").join(base.alias("x"), same & (F.col("d.s") == F.col("x.s"))).select(F.col("d.src").alias("src"), (F.col("base") + F.col("k")).alias("r"), "t", "due").where("r < due").drop("due")
    had = ranked.groupBy("src").count()
    short = t.alias("d").join(had.alias("x"), same, "left").select(F.col("d.src").alias("src"), F.coalesce("count", F.lit(0)).alias("from"), "due").where("from < due")
    late = short.select("src", F.explode(F.sequence("from", F.col("due") - 1)).alias("r")).withColumn("t", F.lit(slots) + F.col("r"))
    return ranked.unionByName(late)


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, id, src, size, th) for each row of docs, kept in the shared folder."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("src"), words.alias("size"), F.xxhash64(text_col).alias("th")), "sizes")


def pieces(sized: DataFrame, targets: DataFrame, max_epochs: int, block_words: int, seed: int) -> DataFrame:
    """The mix: (t, row, src, epoch, first, words), words of a document from its word `first` on in slot t of the schedule."""
    slots = schedule(targets, block_words)
    laid = sized.where("size > 0").withColumn("u", place_of(seed))
    laid = prefix_sums(laid.withColumn("k", F.coalesce(F.col("src"), F.lit(""))).withColumn("n", F.col("src").isNull()), ["k", "n"], ["u", "id", "th"], "size", "start")
    same = F.col("d.src").eqNullSafe(F.col("x.src"))
    laid = laid.alias("d").join(targets.alias("x"), same).select("d.row", "d.src", "d.size", "d.start", "x.source_size", "x.target")
    # The document's places in the stream read max_epochs times, cut where blocks end.
    laid = laid.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    laid = laid.withColumn("lo", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.round("target").cast("long")))
    cut_at = F.sequence(F.floor(F.col("lo") / block_words), F.floor((F.col("hi") - 1) / block_words))
    parts = laid.where("hi > lo").withColumn("r", F.explode(cut_at))
    met = parts.alias("d").join(slots.alias("x"), same & (F.col("d.r") == F.col("x.r")))
    begin, end = F.greatest(F.col("lo"), F.col("d.r") * block_words), F.least(F.col("hi"), (F.col("d.r") + 1) * block_words)
    return met.select("x.t", "d.row", F.col("d.src").alias("src"), "epoch", (begin - F.col("lo")).alias("first"), (end - begin).alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, block_words: int = 2048, seed: int = 17) -> DataFrame:
    """One row per row of docs: (id, src, size, source_size, target, taken). See the module's text for the method."""
    sized = sizes(docs, id_col, text_col, source_col)
    targets = cut(source_targets(sized, weights, share, max_epochs))
    taken = pieces(sized, targets, max_epochs, block_words, seed).groupBy("row").agg(F.sum("words").alias("taken"))
    same = F.col("d.src").eqNullSafe(F.col("x.src"))
    out = sized.alias("d").join(targets.alias("x"), same).join(taken, "row", "left")
    return out.select("d.id", "d.src", "d.size", "x.source_size", "x.target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def place_of(seed: int):
    """A number in [0, 1) from the row's id and text: the order in which a source's documents are laid out."""
    return F.pmod(F.xxhash64("id", "th", F.lit(seed)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
