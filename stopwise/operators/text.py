"""Term counts, vocabularies and fold-local TF-IDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.functions import stats
from stopwise.operators.ingest import evaluate_once
from stopwise.operators.ranking import range_ids, top_by
from stopwise.session import materialize, materialize_all


def tokens(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(fixed.TOKEN_PATTERN), F.lit(0))


def grams(toks: Column) -> Column:
    """Words and pairs of neighbouring words."""
    following = F.slice(toks, F.lit(2), F.greatest(F.size(toks), F.lit(1)))
    pairs = F.array_compact(F.zip_with(toks, following, lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(toks, pairs)


#: So many keys that repeat are sent to the tasks at most.
BROADCAST_KEYS = 1_000_000


def texts_by_key(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per key with the list ``_texts``; only texts whose key repeats are shuffled. Null keys are one key."""
    again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    again = materialize(again, "again")
    some = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
    same = F.lit(True)
    for key in keys:
        same = same & rows[key].eqNullSafe(some[key])
    alone = rows.join(some, same, "left_anti").select(*keys, F.array_compact(F.array(text)).alias("_texts"))
    return alone.union(rows.join(some, same, "left_semi").groupBy(*keys).agg(F.collect_list(text).alias("_texts")))


def row_counts(rows: DataFrame, keys: Sequence[str], text: str, **carried: Column) -> DataFrame:
    """One row per key with ``items array<struct<term, cnt>>`` of its whole texts, and the aggregates ``carried``.

    Texts meet by key, so a key that repeats is counted as one; only texts are shuffled, never terms, and without
    aggregates only those whose key repeats. A row's terms are sorted inside the row and counted by the lengths of
    equal runs. Keys without terms have no row.
    """
    if carried:
        grouped = rows.groupBy(*keys).agg(F.collect_list(text).alias("_texts"), *[c.alias(n) for n, c in carried.items()])
    else:
        grouped = texts_by_key(rows, keys, text)
    terms = F.sort_array(F.flatten(F.transform(F.transform("_texts", tokens), grams)))
    n = F.size("_terms")
    sorted_terms = evaluate_once(grouped, _terms=terms).where(n > 0)
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("_terms", i) != F.get("_terms", i - 1)))
    runs = evaluate_once(sorted_terms, _first=first)
    ends = F.concat(F.slice("_first", F.lit(2), F.size("_first")), F.array(n))
    items = F.zip_with("_first", ends, lambda a, b: F.struct(F.get("_terms", a).alias("term"), (b - a).cast("long").alias("cnt")))
    return runs.select(*keys, *carried, items.alias("items"))


def term_counts(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(row, term, count) of the whole text."""
    return row_counts(rows, keys, text).select(*keys, F.inline("items"))


def prefix_term_counts(runs: DataFrame, actions: str = "actions") -> DataFrame:
    """Term counts of cumulative prefixes without building cumulative text.

    Each occurrence is dated by the step that completes it (a pair across two steps by the later
    one). The result holds the running count of a term from each step on at which it grows.
    """
    dated = F.flatten(
        F.transform(
            actions, lambda text, i: F.transform(tokens(text), lambda w: F.struct(w.alias("w"), (i + 1).alias("step")))
        )
    )
    following = F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1)))
    pairs = F.filter(
        F.zip_with(
            "words",
            following,
            lambda a, b: F.struct(F.concat(a["w"], F.lit(" "), b["w"]).alias("w"), b["step"].alias("step")),
        ),
        lambda x: x["w"].isNotNull(),
    )
    terms = runs.select("traj_id", dated.alias("words")).select("traj_id", F.inline(F.concat("words", pairs)))
    per_step = terms.groupBy("traj_id", F.col("w").alias("term"), "step").agg(F.count(F.lit(1)).alias("n"))
    until = Window.partitionBy("traj_id", "term").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return per_step.select("traj_id", "term", F.col("step").alias("from_step"), F.sum("n").over(until).alias("cnt"))


def vocabulary(
    term_stats: DataFrame,
    n_rows: DataFrame,
    by: Sequence[str] = (),
    min_df: int = fixed.MIN_DOCUMENT_FREQUENCY,
    max_features: int | None = fixed.MAX_FEATURES,
) -> DataFrame:
    """Kept terms with id and idf. ``term_stats`` has df and tf per (by, term), ``n_rows`` n per by.

    Ids follow term order; without ``max_features`` every frequent term is kept.
    """
    by = list(by)
    kept = term_stats.where(F.col("df") >= min_df)
    if max_features is not None:
        kept = top_by(kept, by, "tf", "term", max_features)
    numbered = range_ids(kept, by, ["term"], "term_id").drop("term_id_total")
    if by:
        numbered = numbered.join(n_rows, by)
    else:
        numbered = numbered.withColumn("n", n_rows.select("n").scalar())
    return numbered.withColumn("idf", F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1)


def term_stats(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("tf"))


def global_ids(counts: DataFrame, n_rows: DataFrame) -> DataFrame:
    """``term, term_id`` of every term that any fold could keep."""
    return vocabulary(term_stats(counts), n_rows, max_features=None).select("term", "term_id")


def global_encode(counts: DataFrame, n_rows: DataFrame) -> DataFrame:
    """Counts with global term ids; the vocabulary is every term that any fold could keep."""
    return counts.join(global_ids(counts, n_rows), "term")


#: Rows that are encoded in one wave, at least, and waves at most.
WAVE_ROWS, WAVES = 20_000, 8


def global_totals(rows: DataFrame, n_rows: DataFrame, text: str = "text") -> DataFrame:
    """Per row the terms that ``global_encode`` keeps, their counts and ids, summed up.

    Where the vocabulary is too large to be sent to the tasks, counts are shuffled by term. Each wave does so for a share of the
    rows, dealt by a hash of their id, and its shuffle ends with it; all rows are encoded, each in one wave.
    """
    n = n_rows.select("n").first()[0]
    vocab = materialize(global_ids(term_counts(rows, ["row_id"], text), n_rows), "vocabulary")
    waves = max(1, min(WAVES, -(-n // WAVE_ROWS)))

    def totals(wave: int) -> DataFrame:
        own = rows.where(F.pmod(F.xxhash64("row_id"), F.lit(waves)) == wave)
        encoded = term_counts(own, ["row_id"], text).join(vocab, "term")
        return encoded.groupBy("row_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("cnt").alias("total"), F.sum("term_id").alias("id_sum"))

    return materialize_all(map(totals, range(waves)), "encoded")


def train_folds(cells: DataFrame) -> DataFrame:
    """Per (model, task) cell the folds that train on it."""
    return cells.where(F.col("role") == "train").groupBy("model_id", "instance_id").agg(F.collect_list("fold").alias("folds"))


def fold_vocabulary(
    rows: DataFrame, cells: DataFrame, text: str = "text", min_df: int = fixed.MIN_DOCUMENT_FREQUENCY, max_features: int = fixed.MAX_FEATURES
) -> DataFrame:
    """Vocabulary of each fold's TRAIN rows.

    A row brings the folds that train on its cell, so the sums of all folds are columns of one aggregate
    per term, and terms that no fold keeps end there. Cells and fold names are dimensions, not rows: the
    cell table is sent to every task.
    """
    trains = materialize(train_folds(cells), "trains")
    names = [r[0] for r in trains.select(F.explode("folds").alias("fold")).distinct().orderBy("fold").collect()]
    placed = rows.join(F.broadcast(trains), ["model_id", "instance_id"])
    n = placed.select(F.explode("folds").alias("fold")).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    counts = row_counts(placed.where(F.col("row_id").isNotNull()), ["row_id"], text, folds=F.flatten(F.collect_list("folds")))
    times = lambda name: F.size(F.filter("folds", lambda f: f == name))
    terms = evaluate_once(counts, times=F.array(F.lit(0), *[times(name) for name in names])).select("times", F.inline("items"))
    sums = [
        F.sum(value).alias(f"{kind}{i}")
        for i in range(1, len(names) + 1)
        for kind, value in (("df", F.get("times", F.lit(i))), ("tf", F.get("times", F.lit(i)) * F.col("cnt")))
    ]
    per_term = terms.groupBy("term").agg(F.sum(F.lit(0)).alias("df0"), *sums)
    per_term = per_term.where(F.array_max(F.array("df0", *[f"df{i + 1}" for i in range(len(names))])) >= min_df)
    none = F.struct(F.lit(None).cast("string").alias("fold"), F.lit(0).cast("long").alias("df"), F.lit(0).cast("long").alias("tf"))
    per_fold = F.array(none, *[F.struct(F.lit(f).alias("fold"), F.col(f"df{i}").alias("df"), F.col(f"tf{i}").alias("tf")) for i, f in enumerate(names, 1)])
    return vocabulary(per_term.select("term", F.inline(per_fold)).where("df > 0"), n, ["fold"], min_df, max_features)


def raw_tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(fold, row, term, raw weight): (1 + ln count) x idf of the fold.

    Terms outside the fold's vocabulary add nothing. The vocabularies have at most ``max_features`` terms a
    fold; one row per term packs all folds and is sent to every task, so the counts stay where they are.
    """
    packed = vocab.groupBy("term").agg(F.collect_list(F.struct("fold", "term_id", "idf")).alias("folds"))
    placed = counts.join(F.broadcast(packed), "term").select("row_id", "term", "cnt", F.inline("folds"))
    return placed.select("fold", "row_id", "term", "term_id", ((1 + F.ln("cnt")) * F.col("idf")).alias("raw_weight"))


def fold_tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``raw_tfidf`` with each row of a fold also scaled to length one (``weight``)."""
    row = Window.partitionBy("fold", "row_id")
    normed = raw_tfidf(counts, vocab).withColumn("norm", F.sqrt(F.sum(F.col("raw_weight") * F.col("raw_weight")).over(row)))
    return normed.withColumn("weight", stats.ratio("raw_weight", "norm")).drop("norm")


def tfidf_summary(raw: DataFrame) -> DataFrame:
    """Per fold and row what its weights add up to; a row's length divides its sums, so no row is gathered."""
    sums = raw.groupBy("fold", "row_id").agg(
        F.count(F.lit(1)).alias("terms"),
        F.sum("term_id").alias("id_sum"),
        F.sum(F.col("raw_weight") * F.col("raw_weight")).alias("squared_norm"),
        F.sum("raw_weight").alias("raw_sum"),
        F.max("raw_weight").alias("raw_max"),
    )
    norm = F.sqrt("squared_norm")
    return sums.withColumns({"weight_sum": stats.ratio("raw_sum", norm), "max_weight": stats.ratio("raw_max", norm)}).drop("raw_sum", "raw_max")


def token_profile(rows: DataFrame, by: Sequence[str], text: str, full: DataFrame) -> DataFrame:
    """Characters, tokens and distinct terms per row, and what a table with the rows of ``full`` would hold."""
    toks = tokens(text)
    sized = rows.select(
        *by,
        F.length(text).alias("chars"),
        F.size(toks).alias("n_tokens"),
        F.size(F.array_distinct(grams(toks))).alias("n_terms"),
    )
    return sized.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("chars").alias("chars"),
        F.sum("n_tokens").alias("tokens"),
        F.avg("n_terms").alias("terms_per_row"),
        (F.avg("n_terms") * full.select(F.count(F.lit(1)).alias("n")).scalar()).alias("projected_nonzeros"),
    )
