"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded number, row k of n gets the fractional rank (k - 1/2) / n, all rows are
sorted by it, and the order is cut into shards of equal row counts (at most one apart): any stretch of the order, so every
shard, holds the sources in the proportions of the whole.

Both ranks are taken without gathering a source or the table in one task: rows fall into cells (of the seeded number within
a source, of the fractional rank over all), cells are counted, the running totals of the counts say where a cell starts, and
only the rows of one cell are ranked together. The number of cells follows the number of rows.

Defined cases: a null text has size 1 and CRC 0; the null source is a stratum of its own; repeated rows are ranked
apart, in any order, as they are equal; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import materialize, sealed, unit

#: Rows that share a cell, and so a window, on average.
CELL_ROWS = 5_000


def _ranked(rows: DataFrame, group: list[str], cell: str, order: list, name: str) -> DataFrame:
    """``rows`` with ``name``: the rank from 1 within ``group`` by (cell, order), ranked a cell at a time."""
    counts = rows.groupBy(*group, cell).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, cell, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*group, cell).orderBy(*order))
    return rows.withColumn(name, within).join(starts, [*group, cell]).withColumn(name, F.col(name) + F.col("_start")).drop("_start")


def interleave(docs: DataFrame, shards: int = 8, seed: int = 23) -> DataFrame:
    """(doc_id, source, size, text_crc32, fraction, position, shard, slot): position from 0 in the interleaved order, slot from 0 in the shard."""
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = materialize(
        docs.select(
            "doc_id",
            sealed(F.col("source")).alias("_source"),
            (F.octet_length(data) + 1).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            unit(seed, F.col("doc_id")).alias("_draw"),
        ),
        "strata",
    )
    n = rows.count()
    cells = max(1, math.ceil(n / CELL_ROWS))
    drawn = rows.withColumn("_cell", F.floor(F.col("_draw") * cells))
    ranked = _ranked(drawn, ["_source"], "_cell", ["_draw", "doc_id", "text_crc32", "size"], "_rank").drop("_cell")
    sizes = rows.groupBy("_source").agg(F.count("*").alias("_n"))
    placed = materialize(
        ranked.join(sizes, "_source").withColumn("fraction", (F.col("_rank") - 0.5) / F.col("_n")).withColumn("_cell", F.floor(F.col("fraction") * cells)).withColumn("_all", F.lit(0)),
        "fractions",
    )
    order = ["fraction", "_source", "doc_id", "text_crc32", "size"]
    position = F.col("_position") - 1
    return (
        _ranked(placed, ["_all"], "_cell", order, "_position")
        .withColumn("position", position.cast("long"))
        # Shard s holds the positions from ceil(s * n / shards) on.
        .withColumn("shard", F.expr(f"cast(position * {shards}L div {max(n, 1)}L as int)"))
        .withColumn("slot", F.expr(f"position - (shard * {n}L + {shards - 1}L) div {shards}L"))
        .select("doc_id", F.col("_source.some").alias("_s"), F.col("_source.none").alias("_none"), "size", "text_crc32", "fraction", "position", "shard", "slot")
        .select("doc_id", F.when(~F.col("_none"), F.col("_s")).alias("source"), "size", "text_crc32", "fraction", "position", "shard", "slot")
    )
