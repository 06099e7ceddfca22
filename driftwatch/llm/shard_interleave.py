"""Sharding by proportional stratified interleaving (DataFrame operations only).

Rows of each source are shuffled by a seeded hash and ranked; rank r of n rows
becomes the fractional rank (r - 1 + phase) / n, where the phase in [0, 1) is a
hash of the source (so sources of a row or two spread out too).  All rows are
then sorted by fractional rank and cut into equal runs, so each shard holds
each source in proportion, to within one row or so.

Neither sort runs in one task: rows are first counted per cell of the sort key
(``CELL_ROWS`` rows on average, so a source with a third of all rows has a
third of all cells), offsets of the cells come from a running sum over the
counts, and only rows of one cell are ranked together.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 5_000
#: 2^31, the number of steps of the shuffle key that selects a cell.
STEPS = 1 << 31


def _offsets(cells: DataFrame, part: list[str], cell: str) -> DataFrame:
    order = Window.partitionBy(*part).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("_off", F.coalesce(F.sum("_c").over(order), F.lit(0))).drop("_c")


def interleave(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id",
               text_col: str = "text", source_col: str = "source", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows ``(id_col, size, text_crc32, law, shard, slot, grown_shard, source)``.

    The law kept is ``rows``: shard sizes differ by one row at most. Slots count
    from 0 without gaps. A null text has no bytes (size 1), a null source is a
    source of its own, a null id is an id like others, repeated rows take one
    slot each, an empty table gives no rows. Other columns of the input are
    not looked at.
    """
    total = max(1, docs.count())
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")).alias("_src"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ).withColumn("_h", F.xxhash64(F.lit(seed), "_id", "text_crc32", "size"))
    rows = rows.withColumn("_u", F.shiftrightunsigned("_h", 33))
    sources = rows.groupBy("_src").agg(F.count(F.lit(1)).alias("_n"))
    phase = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_src"), 33) / F.lit(STEPS)
    cells_of = F.ceil(F.col("_n") / cell_rows).cast("long")
    rows = rows.join(sources, "_src").withColumn("_cell", F.shiftright(F.col("_u") * cells_of, 31))
    # dealt anew: the join above may leave the rows dealt by source alone
    rows = rows.repartition("_src", "_cell")
    counts = _offsets(rows.groupBy("_src", "_cell").agg(F.count(F.lit(1)).alias("_c")), ["_src"], "_cell")
    within = Window.partitionBy("_src", "_cell").orderBy("_u", "_h", "_id", "size", "text_crc32")
    ranked = (rows.withColumn("_r", F.row_number().over(within)).join(counts, ["_src", "_cell"])
              .withColumn("_r", F.col("_r") + F.col("_off") - 1).drop("_off", "_cell")
              .withColumn("_f", (F.col("_r") + phase) / F.col("_n")))
    n_cells = -(-total // cell_rows)
    ranked = ranked.withColumn("_cell", F.least(F.floor(F.col("_f") * n_cells), F.lit(n_cells - 1)))
    glob = ranked.groupBy("_cell").agg(F.count(F.lit(1)).alias("_c")).withColumn("_all", F.lit(0))
    glob = _offsets(glob, ["_all"], "_cell").drop("_all")
    order = Window.partitionBy("_cell").orderBy("_f", "_src", "_r")
    pos = F.col("_p") + F.col("_off") - 1
    placed = (ranked.withColumn("_p", F.row_number().over(order)).join(glob, "_cell")
              .withColumn("_p", pos.cast("long")).withColumn("_s", F.expr(f"(_p * {shards}) div {total}")))
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
        F.col("_s").cast("int").alias("shard"),
        (F.col("_p") - F.expr(f"(_s * {total} + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.when(F.col("_src") != "null", F.substring("_src", 2, 1 << 30)).alias("source"))
