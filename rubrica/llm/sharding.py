"""Contiguous shards of near equal bytes, by global prefix sums.

Rows lie on a line in the order of their text's hash, so equal texts are
neighbours. The line consists of pieces of at most about PIECE_ROWS rows of one
text, cut into buckets of neighbouring hashes. Each bucket's total bytes and
rows give its start by a prefix sum over the buckets, a window inside the
bucket gives each piece's, and one inside the piece each row's. Shards are the
stretches between equal targets.

A group of equal texts, or a single long one, is no good at a cut if it is
larger than ``slack`` of a shard. There are at most n_shards / slack of these;
the line begins each shard with the ones that it can hold, largest first and
each in the emptiest shard, so that cuts fall among small groups. A small group
across a cut goes to the side that has the greater part of it. A large group
that no shard can hold stays among the others and is cut between two rows. No
group of any size meets in one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubrica.llm.common import Workspace

#: Rows that a piece, and that a bucket's groups, are meant to have.
PIECE_ROWS, BUCKET_ROWS = 256, 20_000


def lay_large(groups: list[tuple[int, int, int]], target: float, n_shards: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """([(group, shard, rows before it)], [(bytes, rows) laid in each shard]) of (group, bytes, rows): largest first, each to the emptiest shard.

    Groups that fit no shard are left out.
    """
    emptiest = [(0, s) for s in range(n_shards)]
    placed, laid = [], [(0, 0)] * n_shards
    for g, size, rows in sorted(groups, key=lambda x: (-x[1], x[0])):
        used, s = emptiest[0]
        if used + size > target:
            continue
        heapq.heapreplace(emptiest, (used + size, s))
        placed.append((g, s, laid[s][1]))
        laid[s] = used + size, laid[s][1] + rows
    return placed, laid


def _before(c: str, order: Window) -> Column:
    return F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(c)


def _placed(space: Workspace, base: DataFrame, n_shards: int, slack: float) -> DataFrame:
    """``base`` (row, id, size, g, ...), a kept table, with shard and slot."""
    spark = space.spark
    total, n = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bits, share = max(4, (n // BUCKET_ROWS).bit_length()), total / n_shards
    groups = space.keep(base.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    # at most n_shards / slack rows come to the driver
    placed, laid = lay_large([tuple(r) for r in groups.where(F.col("bytes") > slack * share).collect()], share, n_shards)
    of_large = spark.createDataFrame(placed, "g long, whole int, rows_before long")
    crowded = groups.where(F.col("rows") > PIECE_ROWS).select("g", F.ceil(F.col("rows") / PIECE_ROWS).alias("pieces"))
    rows = base.join(crowded, "g", "left").withColumn("own", F.xxhash64("g", "id"))
    # rows that repeat have one id, so their own number tells them apart
    rows = space.keep(rows.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("own", "row"), F.col("pieces")), F.lit(0))).drop("pieces"), "rows")
    pieces = space.keep(rows.groupBy("g", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "pieces")
    large = pieces.join(of_large, "g").select("g", "piece", F.lit(0).cast("long").alias("start"), (F.col("rows_before") + _before("rows", Window.partitionBy("g").orderBy("piece"))).alias("first"), "whole", F.lit(True).alias("large"))
    small = pieces.join(of_large, "g", "left_anti").withColumn("bucket", F.shiftright("g", 64 - bits))
    buckets = small.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    every = Window.orderBy("bucket")
    buckets = buckets.select("bucket", _before("bytes", every).alias("bytes_before"), _before("rows", every).alias("rows_before"))
    inside = Window.partitionBy("bucket").orderBy("g", "piece")
    line = small.select("*", _before("bytes", inside).alias("b"), _before("rows", inside).alias("r")).join(buckets, "bucket")
    line = line.select("g", "piece", (F.col("bytes_before") + F.col("b")).alias("start"), (F.col("rows_before") + F.col("r")).alias("first"), "bytes")
    cuts, upto = [], 0.0
    for size, _ in laid[:-1]:
        upto += max(0.0, share - size)
        cuts.append(upto)
    cut_at = F.array(*map(F.lit, cuts)).cast("array<double>")
    at = lambda c: F.size(F.filter(cut_at, lambda x: x <= c))
    # a group's place; a group has many pieces only if it has many rows
    group = Window.partitionBy("g")
    line = line.withColumn("low", F.min("start").over(group)).withColumn("high", F.max(F.col("start") + F.col("bytes")).over(group))
    line = line.withColumn("a", at(F.col("low"))).withColumn("b", at(F.col("high") - 1))
    side = F.when(2 * F.get(cut_at, F.col("b") - 1) > F.col("low") + F.col("high"), F.col("a")).otherwise(F.col("b"))
    whole = F.when(F.col("a") == F.col("b"), F.col("a")).when(F.col("high") - F.col("low") <= slack * share, side)
    line = space.keep(line.select("g", "piece", "start", "first", whole.alias("whole"), F.lit(False).alias("large")).unionByName(large), "line")
    order = Window.partitionBy("g", "piece").orderBy("own", "row")
    out = rows.withColumn("start_in", _before("size", order)).withColumn("number", F.row_number().over(order)).join(line, ["g", "piece"])
    shard = F.coalesce("whole", at(F.col("start") + F.col("start_in") + F.col("size") / 2))
    out = space.keep(out.select(*base.columns, shard.cast("int").alias("shard"), "large", (F.col("first") + F.col("number") - 1).alias("index")), "placed")
    begins = out.where("not large").groupBy("shard").agg(F.min("index").alias("least"))
    begins = begins.join(spark.createDataFrame([(s, r) for s, (_, r) in enumerate(laid)], "shard int, laid long"), "shard").select("shard", (F.col("laid") - F.col("least")).alias("shift"))
    slot = F.when(F.col("large"), F.col("index")).otherwise(F.col("index") + F.col("shift"))
    return out.join(begins, "shard", "left").withColumn("slot", slot).drop("large", "index", "shift")


def _raw(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slack: float = 1 / 64) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each row.

    size is the text's UTF-8 bytes plus 1 (null text: 1, its checksum that of
    no bytes). Shards differ from equal bytes by at most ``slack`` of a shard,
    or one row. Equal texts (null is empty) share a shard, but for groups
    larger than ``slack`` of one that fit none; these are cut where the line
    is. Slots number a shard's rows from 0 without gaps, in the line's order.
    Ids may be null or repeat: rows are placed one by one. Other columns are
    ignored; an empty table gives an empty one.
    """
    space = Workspace(docs.sparkSession, "sharding")
    raw = _raw(text_col)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.xxhash64(raw).alias("g"), F.crc32(raw).alias("text_crc32"))
    out = _placed(space, space.keep(slim, "base"), n_shards, slack)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, rows_a_file: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", slack: float = 1 / 64) -> None:
    """Writes ``docs`` as Parquet, one folder for each shard, files and rows in slot order.

    Every row is written once, null and repeated ids included. Columns of docs
    named shard or slot give way to the placement's; others keep their names,
    whatever they are. An empty table writes no folder.
    """
    space = Workspace(docs.sparkSession, "sharding")
    raw = _raw(text_col)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.xxhash64(raw).alias("g"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot"))).alias("whole"))
    base = space.keep(slim, "base")
    placed = _placed(space, base.drop("whole"), n_shards, slack).select("row", "shard", "slot")
    rows = base.select("row", "whole").join(placed, "row").withColumn("file", F.floor(F.col("slot") / rows_a_file))
    rows = rows.repartition("shard", "file").sortWithinPartitions("shard", "file", "slot")
    rows.select("whole.*", "shard", "slot").write.partitionBy("shard").parquet(path)
