"""Mixing sources to target weights.

Words are summed per source, each source gets a target (its share of the budget by weight, stopped at ``most`` times its
words, the excess shared out again), and a document is emitted floor(rate) times, plus once more if a seeded number drawn
from its doc_id and text is below the fraction of the rate (rate = target / words of the source).

Defined cases: a null or empty text has size 0 and is emitted like any other document of its source; the null source is a
source of its own, last in order; a source without words has target 0; rows equal in doc_id and text draw the same number; an empty table
gives an empty result; other columns pass through ``mix`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import WORD, bounded, materialize, quoted, sealed, unit

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of words of the size contract; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (source, source_size) to (source, source_size, target).

    The share-out ends where every source has min(cap, weight * level): sources reach their cap in ascending order of
    cap / weight, so the level is that of the first source in this order whose cap is not below the level left to it.
    One row a source: its windows hold as many rows as there are sources, never documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("_n", F.row_number().over(order) - 1).withColumn(
        "_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    )
    by_cap = Window.orderBy(F.lit(most) * F.col("source_size") / F.col("_w"), F.col("_n"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.lit(most) * F.sum("source_size").over(before), F.lit(0.0))) / (
        F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("_level", level)
    open_level = F.min(F.when(F.lit(most) * F.col("source_size") >= F.col("_w") * F.col("_level"), F.struct(F.lit(most) * F.col("source_size") / F.col("_w"), "_n", "_level"))).over(whole)["_level"]
    cap = F.lit(most) * F.col("source_size")
    return levels.withColumn("_open", open_level).select(
        "source", "source_size", F.when(F.col("_open").isNull(), cap).otherwise(F.least(cap, F.col("_w") * F.col("_open"))).alias("target")
    )


def plan_rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(_key, _source_size, _target, _rate), a row a source, computed once and kept in the shared folder."""
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = targets(totals, weights, share, most)
    return materialize(goals.select(sealed(F.col("source")).alias("_key"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), rate.alias("_rate")), "rates")


def _rated(rows: DataFrame, rates: DataFrame, source: str) -> DataFrame:
    """``rows`` with their source's rate: a broadcast while the counted sources fit the bound, else a join that may split hot keys."""
    n, width = rates.agg(F.count("*"), F.coalesce(F.max(F.length("_key.some")), F.lit(0))).first()
    return rows.withColumn("_key", sealed(F.col(source))).join(bounded(rates, n, width * 4 + 64), "_key")


def _draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A row's number in [0, 1): from its doc_id and its text, so rows that share a doc_id draw each their own."""
    return unit(seed, doc_id, F.md5(F.encode(text, "UTF-8")))


def _copies(draw: str) -> Column:
    extra = F.col(draw) < F.col("_rate") - F.floor("_rate")
    return F.floor("_rate").cast("long") + extra.cast("long")


def plan_mixture(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) for every document, those with no copy included."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _draw(seed, F.col("doc_id"), F.col("text")).alias("_draw"))
    return _rated(sized, plan_rates(docs, weights, share, most), "source").select(
        "doc_id", "source", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_rate").alias("rate"), _copies("_draw").alias("copies")
    )


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixture itself: every document as often as ``plan_mixture`` says, with all its columns; texts are not shuffled."""
    packed = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"), _draw(seed, F.col("doc_id"), F.col("text")).alias("_draw"))
    rated = _rated(packed, plan_rates(docs, weights, share, most), "_row.source")
    return rated.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), _copies("_draw").cast("int")))).select("_row.*")
