"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Inside each source the rows are sorted in ranges of that key,
prefix sums of their token counts are built from per-range sums, and the source is cut at its exact
budget: whole epochs first, then the part of one more epoch that the budget still allows. The row
at the cut is taken in part, so a source gives its target to the word. What decides is one cut key
per source, so the texts are never shuffled.

Cases. Null text or text without words: size 0, in the plan with 0 words taken, not in the mix. Null
source: a source of its own, last in order. Source without words: target 0. Repeated rows: each
counts by itself; repeats at the cut share evenly what is left. Null ids: keyed by their text. Empty
table: empty plan. Extra columns: not read by ``plan``, carried by ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.llm.common import WORD, fresh, materialize

# Fixed values of the mix: weights by position of the source, and the most epochs of a source.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def words(column) -> F.Column:
    """Number of words of a text, null counting as none."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``_source, source_size`` to ``_source, source_size, target``: one row per source.

    The share of a source is ``rest * weight / weights of the rest``, where sources whose share
    would exceed ``max_epochs`` times their size are held at that bound and leave the rest. Sorted
    by bound over weight, the held sources come first, so one running sum replaces the rounds of
    resharing. All sums are integers up to the last division.
    """
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.col("_place"), F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_place")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding,
                                                 Window.unboundedFollowing)
    rest, left = F.col("_rest"), F.col("_left")
    shares = (
        sizes.withColumn("_place", place)
        .withColumn("_weight", weight.cast("bigint"))
        .withColumn("_cap", F.col("source_size") * max_epochs)
        .select("*",
                (F.sum("source_size").over(whole)
                 - F.coalesce(F.sum("_cap").over(upto), F.lit(0))).alias("_rest"),
                (F.sum("_weight").over(whole)
                 - F.coalesce(F.sum("_weight").over(upto), F.lit(0))).alias("_left"))
        .withColumn("_held", F.col("_cap").cast("decimal(38,0)") * left.cast("decimal(19,0)")
                    <= rest.cast("decimal(38,0)") * F.col("_weight").cast("decimal(19,0)"))
    )
    # The first source that is not held fixes the rest and the weights for all later ones.
    free = F.struct("_rest", "_left")
    first = F.first(F.when(~F.col("_held"), free), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return shares.withColumn("_free", first).select(
        "_source", "source_size",
        F.when(F.col("_free").isNull(), F.col("_cap").cast("double"))
        .otherwise((F.col("_free._rest") * F.col("_weight")).cast("double")
                   / F.col("_free._left").cast("double")).alias("target"))


def _group(source) -> F.Column:
    """A text that stands for a source and is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _key(id_col: str, text: str) -> F.Column:
    """The hash-random key of a row; only repeats of a row share it."""
    return F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                             F.md5(F.coalesce(F.col(text), F.lit("")))))


def _rows(docs, source, text, id_col, slices) -> DataFrame:
    """The narrow rows all steps work on, stored once: the texts are read a single time."""
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source).alias("_source"),
        _group(source).alias("_group"), words(F.col(text)).alias("size"),
        _key(id_col, text).alias("_key"))
    # Keys are uniform, so equal parts of their range are a range partitioning without sampling.
    part = F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") * slices / F.lit(2 ** 32)
    return materialize(rows.withColumn("_slice", F.floor(part).cast("int")), "mix")


def cuts(rows: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: its target, the whole epochs, and where the last one is cut.

    Prefix sums run over the (source, range) sums; only the range in which a source's budget ends
    is opened, sorted by key and summed row by row. ``_cut`` is the key of the row at the cut and
    ``_words`` what is taken of it; repeats of that row share what is left evenly.
    """
    sizes = rows.groupBy("_group").agg(F.max("_source").alias("_source"),
                                       F.sum("size").alias("source_size"))
    goals = targets(sizes.select("_source", "source_size"), weights, max_epochs).select(
        _group("_source").alias("_group"), "source_size", "target",
        F.floor("target").cast("bigint").alias("_budget")
    ).withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(
        F.col("_budget") / F.col("source_size"))).otherwise(0).cast("bigint")
    ).withColumn("_part", F.col("_budget") - F.col("_epochs") * F.col("source_size"))
    goals = materialize(goals, "goals")

    earlier = Window.partitionBy("_group").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_group", "_slice").agg(F.sum("size").alias("_sum")).select(
        "*", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_off"))
    ends = ranges.join(goals, "_group").where(
        (F.col("_part") > F.col("_off")) & (F.col("_part") <= F.col("_off") + F.col("_sum"))
    ).select("_group", "_slice", "_off", "_part")
    before = Window.partitionBy("_group").orderBy("_key").rowsBetween(
        Window.unboundedPreceding, -1)
    inside = rows.join(ends, ["_group", "_slice"]).groupBy("_group", "_key").agg(
        F.sum("size").alias("_here"), F.count(F.lit(1)).alias("_n"),
        F.max("_off").alias("_off"), F.max("_part").alias("_part")
    ).select("*", (F.coalesce(F.sum("_here").over(before), F.lit(0)) + F.col("_off")).alias("_at"))
    at = inside.where((F.col("_part") > F.col("_at"))
                      & (F.col("_part") <= F.col("_at") + F.col("_here"))).select(
        "_group", F.col("_key").alias("_cut"),
        F.floor((F.col("_part") - F.col("_at")) / F.col("_n")).cast("bigint").alias("_words"))
    return materialize(goals.join(at, "_group", "left").select(
        "_group", "source_size", "target", "_epochs", "_cut", "_words"), "cuts")


def plan(docs: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id",
         weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, slices: int = 4096) -> DataFrame:
    """One row per document: ``id, source, size, source_size, target, taken``."""
    rows = _rows(docs, source, text, id_col, slices)
    last = F.when(F.col("_key") < F.col("_cut"), F.col("size")) \
        .when(F.col("_key") == F.col("_cut"), F.least("size", "_words")).otherwise(0)
    return rows.join(cuts(rows, weights, max_epochs), "_group").select(
        F.col("_id").alias(id_col), F.col("_source").alias(source), "size", "source_size",
        "target", (F.col("_epochs") * F.col("size") + last).cast("bigint").alias("taken"))


def first_words(text, count) -> F.Column:
    """The text up to the end of its first ``count`` words, with the blanks after the last one."""
    blank = r"\x20\x09-\x0D"
    pieces = F.split(text, f"(?<=[{blank}])(?=[^{blank}])")
    lead = text.rlike(f"^[{blank}]").cast("int")
    return F.array_join(F.slice(pieces, 1, count.cast("int") + lead), "")


def mix(docs: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id",
        weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, slices: int = 4096) -> DataFrame:
    """The mixed rows with the columns of ``docs``: each row as often as the plan takes it.

    The last, partial repetition holds the first words of the text. ``n_chars``, where present,
    follows the text.
    """
    ends = cuts(_rows(docs, source, text, id_col, slices), weights, max_epochs)
    group, key, each = (fresh(docs, c) for c in ("_mix_group", "_mix_key", "_mix_each"))
    count, cut, part = (fresh(docs, c) for c in ("_mix_epochs", "_mix_cut", "_mix_words"))
    ends = ends.select(F.col("_group").alias(group), F.col("_epochs").alias(count),
                       F.col("_cut").alias(cut), F.col("_words").alias(part))
    keyed = docs.where(F.col(text).rlike(WORD)).select(
        "*", _group(source).alias(group), _key(id_col, text).alias(key))
    more = F.when((F.col(key) < F.col(cut)) | (F.col(key) == F.col(cut)) & (F.col(part) > 0), 1) \
        .otherwise(0)
    out = keyed.join(ends, group).withColumn(each, F.explode(
        F.when(F.col(count) + more > 0, F.sequence(F.lit(1), (F.col(count) + more).cast("int")))))
    partial = (F.col(key) == F.col(cut)) & (F.col(each) > F.col(count))
    out = out.withColumn(text, F.when(partial, first_words(F.col(text), F.col(part)))
                         .otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(partial, F.length(text)).otherwise(
            F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
