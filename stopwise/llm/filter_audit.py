"""Filter interaction audit: what each filter removes, and hides, in every order of the filters.

A document's failures form a mask of n bits. In the lexicographic list of the n! orders (their Lehmer
ranks), the orders that share a prefix are one interval; a document leaves at the step where an order
first names a filter of its mask, so its mask's orders with that step are a few intervals, known
beforehand. The audit is then:

1. masks of all rows in one pass over the texts, counted by (part, mask);
2. per mask and step, the count is added at the start of each interval and taken off behind its end;
3. running sums over the n! ranks give what every order removes at every step.

Documents never meet orders: the n! orders cost one table of at most 2^n masks a part.

Defined results: a null text counts as empty; an empty text has no words, so it is too short and
nothing else. A copy is a row whose text some smaller id has anywhere in the table; rows of one id are
no copies of each other, and rows without an id neither are copies nor make any. Repeated rows count as
often as they occur. A null language is the part ''. A document is good (toxic) when any of its label
rows says 1; labels of unknown ids and null labels count for nothing. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.session import materialize

LETTERS = "ABCDE"
#: White space between words.
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 100, 80, 10, "[#$%&*|]"


def intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last): the orders in which a mask's rows leave at a step."""
    found: list[tuple[int, int, int, int]] = []

    def descend(mask: int, used: int, first: int, step: int) -> None:
        width = factorial(n - step)
        free = [f for f in range(n) if not used >> f & 1]
        for place, f in enumerate(free):
            start = first + place * width
            if mask >> f & 1:
                found.append((mask, step, start, start + width))
            else:
                descend(mask, used | 1 << f, start, step + 1)

    for mask in range(1, 1 << n):
        descend(mask, 0, 0, 1)
    merged: list[tuple[int, int, int, int]] = []
    for mask, step, start, end in sorted(found):
        if merged and merged[-1][:2] == (mask, step) and merged[-1][3] == start:
            merged[-1] = (mask, step, merged[-1][2], end)
        else:
            merged.append((mask, step, start, end))
    return merged


def text_mask(text: Column) -> Column:
    """Bits of the four filters that look at the text alone: short, repetitive, upper case, marks."""
    inner = F.btrim(text, F.lit(SPACES))
    words = F.split(inner, f"[{SPACES}]+")
    nothing = (inner == "").cast("int")
    n, distinct = F.size(words) - nothing, F.size(F.array_distinct(words)) - nothing
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = (
        n < MIN_WORDS,
        distinct.cast("long") * 100 < n.cast("long") * DISTINCT_PERCENT,
        upper * 100 > F.char_length(text).cast("long") * UPPER_PERCENT,
        text.rlike(MARKS),
    )
    return sum((fail.cast("int") * (1 << bit) for bit, fail in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic`` of every row of ``docs`` (doc_id, text, lang)."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        text_mask(text).alias("seen"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    slim = materialize(slim, "slim")
    named = slim.where("doc_id IS NOT NULL")
    # the first holder of each text; the join key holds its id, so a text with very many copies is no hot key
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("copy", F.lit(False))
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"))
        .groupBy("doc_id")
        .agg(F.coalesce(F.bool_or("q"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("t"), F.lit(False)).alias("toxic"))
    )
    known = named.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    mask = F.col("seen") + F.coalesce("copy", F.lit(True)).cast("int") * (1 << LETTERS.index("E"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    nameless = slim.where("doc_id IS NULL").select("part", F.col("seen").alias("mask"), F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.select("part", mask.alias("mask"), *flags).union(nameless)


def interactions(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Counts for every part, order and step; bit i of ``mask`` is a failure of ``letters[i]``.

    ``letters`` must be in ascending order, so that the orders' ranks are lexicographic.
    """
    spark, n = masks.sparkSession, len(letters)
    counts = masks.groupBy("part", "mask").agg(
        F.count("*").alias("rows"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    counts = materialize(counts, "masks")
    # both ends of each interval, with the sign of the count
    cover = spark.createDataFrame(intervals(n), "mask int, step int, start int, stop int")
    ends = F.explode(F.array(F.struct(F.col("start").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("rank"), F.lit(-1).alias("sign"))))
    steps = counts.join(cover, "mask").select("part", "step", "rows", "good", "toxic", ends.alias("end"))
    change = steps.groupBy("part", "step", F.col("end.rank").alias("rank")).agg(
        *[F.sum(F.col(c) * F.col("end.sign")).alias(c) for c in ("rows", "good", "toxic")]
    )
    failing = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("rows")).otherwise(0)) for i in range(n)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("rows")).otherwise(0)) for i in range(n)]
    parts = counts.groupBy("part").agg(F.sum("rows").alias("total"), F.array(*failing).alias("failing"), F.array(*alone).alias("alone"))
    orders = spark.createDataFrame([(r, "".join(p)) for r, p in enumerate(permutations(letters))], "rank int, filter_order string")
    spine = parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1)))).join(orders, "rank")
    spine = spine.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    letter = F.col("filter_order").substr(F.col("step"), F.lit(1))
    spine = spine.withColumn("letter", F.instr(F.lit(letters), letter))
    over_ranks = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    over_steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    joined = spine.join(change, ["part", "rank", "step"], "left")
    sums = [F.coalesce(F.sum(source).over(over_ranks), F.lit(0)).alias(name) for source, name in (("rows", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))]
    totals = joined.select("part", "rank", "filter_order", "step", "letter", "total", "failing", "alone", *sums)
    return totals.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("removed").over(over_steps)).alias("kept"),
        "removed",
        (F.get("failing", F.col("letter") - 1) - F.col("removed")).alias("redundant"),
        F.get("alone", F.col("letter") - 1).alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over ``docs``, in all 120 orders (see ``interactions``)."""
    return interactions(failure_masks(docs, labels))
