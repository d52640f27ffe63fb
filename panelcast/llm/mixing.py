"""Sources mixed to target weights by whole copies and Pareto order sampling.

A source that is to give ``r`` times its words gives ``floor(r)`` whole copies of each document for
certain; the rest is a sample of the words that are missing. The odds of a document grow with the
binary digits of its size, so that longer texts are somewhat likelier to be repeated: its inclusion
probability is ``p = min(1, level * digits)``, with the ``level`` of its source at which the expected
words are those missing. Documents with ``p = 1`` are taken for certain once more. The others are
ranked by random odds divided by inclusion odds, ``U / (1 - U) / (p / (1 - p))``, and taken in that
order as long as they fit, so that the size of the sample is fixed in words. What the first one that
no longer fits leaves open is filled with up to ``FILLS`` documents behind it, the longest first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.ordinals import number_members
from panelcast.llm.text import bind, fresh_name, n_words, whole
from panelcast.sources.scratch import Scratch

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
# Ranks are cut into WIDTH slices, the slice that matters into as many again, LEVELS times.
WIDTH = 1024
LEVELS = 3
FILLS = 3
UNIT = 1 << 52


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the document and the seed alone.

    52 bits of an MD5 sum, so that any engine finds the same.
    """
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(UNIT))


def targets(
    sources: DataFrame,
    scratch: Scratch,
    weights: Sequence[int] = WEIGHTS,
    most_copies: int = MOST_COPIES,
) -> DataFrame:
    """``(source, source_size)`` rows with each source's ``target`` words.

    The sources, ordered by code point with null last, weigh ``weights``, repeating, and share all
    words. A target stops at ``most_copies`` times its source's size and the excess is shared anew
    by weight among the others. Sorted by the ratio of that limit to the weight, the limited
    sources come first; the share per weight is that of the first prefix after which the next
    source stays within its limit.

    The list of sources may be long: it is numbered and sorted in slices of a range partitioning,
    and only the sums of the slices are summed up in one place.
    """
    named = sources.select(
        F.col("source").isNull().cast("string").alias("dim"),
        F.coalesce("source", F.lit("")).alias("value"),
        "source_size",
    )
    # The null source is a dimension of its own, numbered behind the others.
    numbers = number_members(named.select("dim", "value"), scratch)
    first_null = F.lit(named.filter("dim = 'false'").count())
    position = F.col("ord") + F.when(F.col("dim") == "true", first_null).otherwise(F.lit(0))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sliced = scratch.save(
        named.join(numbers, ["dim", "value"])
        .select(
            F.when(F.col("dim") == "false", F.col("value")).alias("source"),
            position.alias("position"),
            "source_size",
            F.get(cycle, (position % len(weights)).cast("int")).alias("weight"),
            (F.col("source_size") * most_copies).cast("double").alias("limit"),
        )
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .repartitionByRange("ratio", "position")
        .withColumn("slice", F.spark_partition_id()),
        "sources",
    )
    by_slice = Window.orderBy("slice")
    sums = (
        sliced.groupBy("slice")
        .agg(F.sum("limit").alias("limits"), F.sum("weight").alias("weights"))
        .withColumn("limits_to", F.sum("limits").over(by_slice) - F.col("limits"))
        .withColumn("weights_to", F.sum("weights").over(by_slice) - F.col("weights"))
        .drop("limits", "weights")
    )
    # Two sums and a share: plain numbers, whatever the number of sources.
    words, weighing = sliced.agg(
        F.sum("source_size").cast("double"), F.sum("weight")
    ).first()
    inside = Window.partitionBy("slice").orderBy("ratio", "position")
    taken = F.col("limits_to") + F.sum("limit").over(inside) - F.col("limit")
    passed = F.col("weights_to") + F.sum("weight").over(inside) - F.col("weight")
    level = (
        sliced.join(sums, "slice")
        .withColumn("share", (F.lit(words) - taken) / (F.lit(weighing) - passed))
        .filter("share <= ratio")
        .agg(F.max("share"))
        .first()[0]
    )
    shared = F.lit(level).cast("double") * F.col("weight")
    target = F.least(F.col("limit"), F.coalesce(shared, F.col("limit")))
    return sliced.select("source", "source_size", target.alias("target"))


def _digits(size: Column) -> Column:
    """The binary digits of a size: what the odds of a document grow with."""
    return F.length(F.bin(size)).cast("long")


def _sized(docs: DataFrame, seed: str, doc_id: str, text: str, source: str) -> DataFrame:
    """One narrow row per document; the text is read here."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        n_words(whole(text)).alias("size"),
        uniform(F.col(doc_id), seed).alias("u"),
    )


def _chance(size: Column) -> Column:
    return F.least(F.lit(1.0), F.col("level") * _digits(size))


def _odds(size: Column, u: Column) -> Column:
    """Random odds over inclusion odds; zero for what is certain, null for what has no chance."""
    p = _chance(size)
    return F.when(p >= 1, F.lit(0.0)).otherwise(F.try_divide(u / (1 - u), F.try_divide(p, 1 - p)))


def _slice(odds: Column, level: int) -> Column:
    """The slice of a rank, ``odds / (1 + odds)`` in [0, 1]; samples end near its middle, where a
    slice holds no more than its share of a source."""
    return F.floor(odds / (odds + 1) * WIDTH**level).cast("int")


def _levels(plan: DataFrame, classes: DataFrame) -> DataFrame:
    """``plan`` with the ``level`` of each source, at which ``min(1, level * digits)`` of all words
    are those missing; zero where nothing is. A source has at most 63 classes of digits."""
    down = Window.partitionBy("source").orderBy(F.col("digits").desc())
    certain = F.col("missing") - (F.sum("words").over(down) - F.col("words"))
    weighted = F.col("digits") * F.col("words")
    rest = F.sum(weighted).over(down.rowsBetween(0, Window.unboundedFollowing))
    found = (
        classes.filter("words > 0")
        .join(plan, F.col("source").eqNullSafe(F.col("cut_source")))
        .filter("part > 0")
        .withColumn("level", F.greatest(certain / rest, F.lit(0.0)))
        .filter("level * digits <= 1")
        .groupBy(F.col("source").alias("level_source"))
        .agg(F.max("level").alias("level"))
    )
    return plan.join(found, F.col("cut_source").eqNullSafe(F.col("level_source")), "left").select(
        *plan.columns, F.coalesce("level", F.lit(0.0)).alias("level")
    )


def _rank(odds: Column, doc_id: Column, size: Column) -> Column:
    return F.struct(odds.alias("odds"), doc_id.alias("doc_id"), size.alias("size"))


def cuts(
    rows: DataFrame, scratch: Scratch, weights: Sequence[int], most_copies: int
) -> DataFrame:
    """One row per source: ``cut_source, source_size, target, whole, level, last_slice, end, fills``.

    ``whole`` copies of each document are certain. Of the ranked documents all of the slices before
    ``last_slice`` are taken once more, of that slice those up to the rank ``end``, and those whose
    ranks are in ``fills``.

    No source is sorted as a whole. Words are summed by source and slice of the rank, the slice in
    which a source's sample ends is found from the sums and cut again, and only the last (one in
    ``WIDTH ** LEVELS``) is ranked row by row, equal rows counted before. The windows over a source
    so have at most ``WIDTH`` rows, but for the rows of that last slice. To fill up, the first rank
    of each length that still fits is looked at, so what is compared grows with the lengths alone.
    """
    classes = scratch.save(
        rows.groupBy("source", _digits(F.col("size")).alias("digits")).agg(
            F.sum("size").alias("words")
        ),
        "classes",
    )
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    ratio = F.try_divide(F.col("target"), F.col("source_size"))
    plan = (
        targets(sources, scratch, weights, most_copies)
        .withColumnRenamed("source", "cut_source")
        .withColumn("whole", F.coalesce(F.floor(ratio), F.lit(0)).cast("long"))
        .withColumn("part", F.coalesce(ratio - F.col("whole"), F.lit(0.0)))
        .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    plan = scratch.save(_levels(scratch.save(plan, "targets"), classes), "levels")

    size, odds = F.col("size"), F.col("odds")
    same = F.col("source").eqNullSafe(F.col("cut_source"))

    def ranked(table: DataFrame) -> DataFrame:
        """The documents of the sources in ``table`` that have a chance."""
        joined = rows.filter("size > 0").join(table, same)
        return joined.withColumn("odds", _odds(size, F.col("u"))).filter("odds IS NOT NULL")

    along = Window.partitionBy("cut_source").orderBy("slice")
    preceding = F.sum("words").over(along.rowsBetween(Window.unboundedPreceding, -1))
    last = plan.filter("level > 0").select(
        "cut_source", F.lit(0).alias("last_slice"), F.lit(0).cast("long").alias("before"),
        "level", "missing",
    )
    for depth in range(1, LEVELS + 1):
        last = scratch.save(
            ranked(last)
            .filter(_slice(odds, depth - 1) == F.col("last_slice"))
            .groupBy("cut_source", "level", "missing", "before", _slice(odds, depth).alias("slice"))
            .agg(F.sum("size").alias("words"))
            .withColumn("before", F.col("before") + F.coalesce(preceding, F.lit(0)))
            .filter("before <= missing AND before + words > missing")
            .select("cut_source", F.col("slice").alias("last_slice"), "before", "level", "missing"),
            "last-slices",
        )
    order = Window.partitionBy("cut_source").orderBy("odds", "doc_id", "size")
    rank = _rank(odds, F.col("doc_id"), size)
    ends = (
        ranked(last)
        .filter(_slice(odds, LEVELS) == F.col("last_slice"))
        .groupBy("cut_source", "odds", "doc_id", "size", "before", "missing")
        .agg(F.sum("size").alias("words"))
        .withColumn("upto", F.col("before") + F.sum("words").over(order))
        .filter("upto <= missing")
        .groupBy(F.col("cut_source").alias("end_source"))
        .agg(F.max(rank).alias("end"), F.max("upto").alias("upto"))
    )
    ended = scratch.save(
        last.join(ends, F.col("cut_source").eqNullSafe(F.col("end_source")), "left").select(
            "cut_source", "level", "last_slice", "end",
            (F.col("missing") - F.coalesce("upto", "before")).alias("open"),
        ),
        "ends",
    )
    # A sample always ends in front of a document: what is certain is in the first slice.
    firsts = (
        ranked(ended)
        .filter("size <= open")
        .filter(~_sampled(size, odds, rank))
        .groupBy("cut_source", "open", "size")
        .agg(F.min(F.struct("odds", "doc_id")).alias("first"))
        .select(
            F.col("cut_source").alias("of_source"), "open", F.col("size").alias("length"), "first"
        )
    )
    firsts = scratch.save(firsts, "firsts")
    # Rows that repeat a document go together.
    is_first = (
        F.col("source").eqNullSafe(F.col("of_source"))
        & (size == F.col("length"))
        & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    )
    fitting = scratch.save(
        rows.join(firsts, is_first)
        .groupBy("of_source", "open", "length", "first")
        .agg(F.sum("size").alias("words")),
        "fitting",
    )
    left = ended.select("cut_source", "open", F.lit(None).cast("long").alias("above"))
    fills = []
    for _ in range(FILLS):
        fill = scratch.save(
            fitting.drop("open")
            .join(left, F.col("of_source").eqNullSafe(F.col("cut_source")))
            .filter("words <= open AND (above IS NULL OR length < above)")
            .groupBy("cut_source", "open")
            .agg(F.max(F.struct("length", "first", "words")).alias("best")),
            "fills",
        )
        fills.append(
            fill.select(
                F.col("cut_source").alias("fill_source"),
                _rank(
                    F.col("best.first.odds"), F.col("best.first.doc_id"), F.col("best.length")
                ).alias("fill"),
            )
        )
        left = fill.select(
            "cut_source",
            (F.col("open") - F.col("best.words")).alias("open"),
            F.col("best.length").alias("above"),
        )
    filled = fills[0]
    for more in fills[1:]:
        filled = filled.union(more)
    filled = filled.groupBy("fill_source").agg(F.collect_list("fill").alias("fills"))
    found = ended.select(F.col("cut_source").alias("last_source"), "last_slice", "end")
    return scratch.save(
        plan.join(found, F.col("cut_source").eqNullSafe(F.col("last_source")), "left")
        .join(filled, F.col("cut_source").eqNullSafe(F.col("fill_source")), "left")
        .drop("last_source", "fill_source", "missing", "part"),
        "cuts",
    )


def _sampled(size: Column, odds: Column, rank: Column) -> Column:
    """Whether a document lies before the end of its source's sample."""
    inside = (_slice(odds, LEVELS) < F.col("last_slice")) | (
        (_slice(odds, LEVELS) == F.col("last_slice")) & (rank <= F.col("end"))
    )
    return (size > 0) & ((_chance(size) >= 1) | F.coalesce(inside, F.lit(False)))


def _copies(doc_id: Column, size: Column, u: Column) -> Column:
    """How often a document is taken, next to the row of its source in ``cuts``.

    ``size`` and ``u`` are mentioned many times and should be columns, not what they are made of.
    """

    def chosen(odds: Column) -> Column:
        rank = _rank(odds, doc_id, size)
        fills = F.exists(F.col("fills"), lambda f: f.eqNullSafe(rank))
        return _sampled(size, odds, rank) | F.coalesce(fills, F.lit(False))

    once_more = F.when(bind(_odds(size, u), chosen), F.lit(1)).otherwise(F.lit(0))
    return F.col("whole") + once_more.cast("long")


def mix(
    docs: DataFrame,
    scratch: Scratch,
    weights: Sequence[int] = WEIGHTS,
    most_copies: int = MOST_COPIES,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``copies`` is how often the mix takes the document, ``taken`` its words times that. A null or
    empty text has size 0 and is never sampled; a null source is a source of its own. Rows
    that repeat a ``doc_id`` and size share one rank and so one fate; documents of equal odds are
    taken in order of their ids. An empty table gives no rows.
    """
    rows = scratch.save(_sized(docs, seed, doc_id, text, source), "sizes")
    of_source = F.col("source").eqNullSafe(F.col("cut_source"))
    return (
        rows.join(cuts(rows, scratch, weights, most_copies), of_source)
        .withColumn("copies", _copies(F.col("doc_id"), F.col("size"), F.col("u")))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mixed_rows(
    docs: DataFrame,
    scratch: Scratch,
    weights: Sequence[int] = WEIGHTS,
    most_copies: int = MOST_COPIES,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, in the columns of ``docs``.

    Texts are joined with one row per source only, and not moved where that table is small.
    """
    rows = scratch.save(_sized(docs, seed, doc_id, text, source), "sizes")
    table = cuts(rows, scratch, weights, most_copies)
    own = fresh_name(docs, "own")
    cut = table.select(F.struct(*table.columns).alias(own))
    # Words are counted below the join, once a text: above it, Spark would put the expression into
    # every place of the copies and of the filters made of them.
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        n_words(whole(F.col(f"`{text}`"))).alias("size"),
        uniform(F.col(f"`{doc_id}`"), seed).alias("u"),
    )
    of_source = F.col(f"doc.`{source}`").cast("string").eqNullSafe(F.col(f"{own}.cut_source"))
    return (
        named.join(cut, of_source)
        .select("doc", "size", "u", f"{own}.*")
        .withColumn("copies", _copies(F.col(f"doc.`{doc_id}`"), F.col("size"), F.col("u")))
        .filter("copies > 0")
        .select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select("doc.*")
    )
