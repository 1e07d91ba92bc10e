"""Which rows: limits, shards, samples, tops, centres, windows and running state."""

from __future__ import annotations

import fnmatch
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubrica.functions.geometry import cosine
from rubrica.functions.text import let, tokens
from rubrica.sources.staging import staged


def limit_docs(docs: DataFrame, limit: float | None, doc_id: str = "doc_id") -> DataFrame:
    """The first documents by id: a number of them, or under 1 a share, rounded up."""
    if limit is None:
        return docs
    if limit < 1:
        limit = math.ceil(docs.count() * limit)
    return docs.where(F.col(doc_id) < int(limit))


def stride_shard(df: DataFrame, rank: int, world: int, doc_id: str = "doc_id") -> DataFrame:
    return df.where(F.pmod(F.col(doc_id), F.lit(world)) == rank)


def positions(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``_pos``, 0 and on in each group's order, and ``_size``, the group's rows.

    Without groups no task sees all rows: they are dealt by ranges of the order
    and written, then numbered in each range behind the ranges before it.
    """
    if by:
        group = Window.partitionBy(*by)
        return df.withColumn("_pos", (F.row_number().over(group.orderBy(*order)) - 1).cast("long")).withColumn("_size", F.count("*").over(group))
    ranged = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row for each task
    every = Window.orderBy("_range")
    before = sizes.select("_range", (F.sum("_n").over(every) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_size"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_in", inside).join(before, "_range").withColumn("_pos", F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


def divide(df: DataFrame, parts: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``part``, 0 to parts - 1: contiguous parts of which sizes differ by one at most, the larger ones first."""
    if by:
        return df.withColumn("part", F.ntile(parts).over(Window.partitionBy(*by).orderBy(*order)) - 1)
    small, larger = F.floor(F.col("_size") / parts), F.pmod(F.col("_size"), F.lit(parts))
    head = larger * (small + 1)
    part = F.when(F.col("_pos") < head, F.floor(F.col("_pos") / (small + 1))).otherwise(larger + F.floor((F.col("_pos") - head) / F.greatest(small, F.lit(1))))
    return positions(df, order).withColumn("part", part.cast("int")).drop("_pos", "_size")


def chunks(df: DataFrame, size: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``chunk``: runs of ``size`` rows in order, the last one shorter."""
    return positions(df, order, by).withColumn("chunk", F.floor(F.col("_pos") / size)).drop("_pos", "_size")


def keyed_batches(df: DataFrame, keys: Sequence[str], length: Column, id_col: str, size: int) -> DataFrame:
    """Adds ``batch``, 0 and on in each key: rows of like generation settings together, long ones first, ``size`` to a batch.

    Keys are few and may be hot, so rows are ordered over all tasks and a key's
    first place is taken off. Ids say the order of results.
    """
    placed = positions(df.withColumn("_length", -length), [*keys, "_length", id_col])
    start = placed.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = placed.alias("a").join(start.alias("b"), on).select("a.*", "_first")
    return joined.withColumn("batch", F.floor((F.col("_pos") - F.col("_first")) / size)).drop("_pos", "_size", "_first", "_length")


def matching(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose name matches a wildcard pattern; patterns become one regex that the scan evaluates."""
    return df.where(F.col(column).rlike("|".join("^" + fnmatch.translate(p).replace(r"\Z", r"\z") for p in patterns)))


def wildcard_names(patterns: Sequence[str], names: Sequence[str]) -> list[str]:
    return sorted({n for n in names if any(fnmatch.fnmatch(n, p) for p in patterns)})


def hash_order(key: Column, seed: int) -> Column:
    """A random order that depends on the row's key and the seed alone."""
    return F.xxhash64(F.lit(seed), key)


def hash_numbered(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``_pos``, 0 and on in hash order of the key.

    Rows are numbered inside each of 256 ranges of the hash; no task sees all.
    """
    h = hash_order(F.col(key), seed)
    ranged = df.withColumn("_h", h).withColumn("_range", F.shiftright("_h", 56))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    # at most 256 rows
    before = sizes.select("_range", F.sum("_rows").over(Window.orderBy("_range")).alias("_upto"), "_rows")
    before = before.select("_range", (F.col("_upto") - F.col("_rows")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy("_h", key)) - 1
    # broadcast: at most 256 rows
    return ranged.withColumn("_pos", inner).join(F.broadcast(before), "_range").withColumn("_pos", F.col("_pos") + F.col("_before")).drop("_range", "_h", "_before")


def fewshot_random(docs: DataFrame, pool: DataFrame, n: int, seed: int = 1234, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, shots): n pool rows for each document, never itself; all others if the pool has fewer.

    The whole pool is numbered in hash order; each document draws n + 1
    different positions by Floyd's method, every set of them alike, and drops
    itself or the last one. Ids of the pool are unique.
    """
    columns = pool.columns
    size = pool.agg(F.count("*").alias("_size"))
    # broadcast: one row
    asked = docs.select(F.col(doc_id).alias("_doc"), F.monotonically_increasing_id().alias("_row")).join(F.broadcast(size))
    taken = F.least(F.lit(n + 1).cast("long"), F.col("_size"))

    def add(drawn: Column, j: Column) -> Column:
        t = F.pmod(F.xxhash64(F.lit(seed), F.col("_doc"), j), j + 1)
        return F.concat(drawn, F.array(F.when(F.array_contains(drawn, t), j).otherwise(t)))

    last = F.when(taken > 0, F.sequence(F.col("_size") - taken, F.col("_size") - 1)).otherwise(F.array().cast("array<bigint>"))
    drawn = asked.select("_doc", "_row", F.explode_outer(F.aggregate(last, F.array().cast("array<bigint>"), add)).alias("_at"))
    held = hash_numbered(pool, doc_id, seed).select("_pos", F.struct(*columns).alias("_shot"))
    joined = drawn.join(held, F.col("_at") == F.col("_pos"), "left")
    other = F.col("_shot").isNotNull() & ~F.col(f"_shot.{doc_id}").eqNullSafe(F.col("_doc"))
    turn = F.xxhash64(F.lit(seed), F.col("_at"), F.col("_doc"))
    # at most n + 1 rows of a document are gathered
    shots = F.array_sort(F.collect_list(F.when(other, F.struct(turn.alias("_turn"), F.col("_at"), F.col("_shot")))))
    grouped = joined.groupBy("_row").agg(F.first("_doc").alias(doc_id), shots.alias("_shots"))
    return grouped.select(doc_id, F.transform(F.slice("_shots", 1, n), lambda x: x["_shot"]).alias("shots"))


def fewshot_first(pool: DataFrame, n: int, doc_id: str = "doc_id") -> DataFrame:
    return pool.orderBy(doc_id).limit(n)


def top_per_group(df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def latest_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the last one. An upsert is a union, then this."""
    newest = [c.desc() for c in order]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).where("_rn = 1").drop("_rn")


def upsert(table: DataFrame, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``table`` with ``rows`` added; rows win over the table."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return latest_per_key(both, by, [F.col("_new")]).drop("_new").select(table.columns)


def uniform_indices(total: Column, n: int) -> Column:
    """n positions spread evenly from 0 to total - 1, truncated."""
    if n == 1:
        return F.array(F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (total - 1) / (n - 1)).cast("int"))


def cosine_top(df: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k rows nearest to a query vector; each task keeps k."""
    q = F.array(*map(F.lit, map(float, query)))
    return df.select(id_col, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def top_frames(df: DataFrame, k: int, by: Sequence[str], score: str, pos: str) -> DataFrame:
    """The k best-scored positions of each group (at least one), ties by position."""
    return top_per_group(df, max(1, k), by, [F.col(score).desc(), F.col(pos)])


def k_center(df: DataFrame, k: int, vector: str = "embedding", id_col: str = "vec_id", start: int | None = None) -> DataFrame:
    """(step, id): greedy k-center picks; each is the row farthest from all before it, ties by id.

    Every step is one distributed pass that sends one vector to the tasks and
    one row back; distances are carried in a table that is written anew every
    few steps, so that plans stay short and lost tasks can be redone.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    first = rows.orderBy("id").first() if start is None else rows.where(F.col("id") == start).first()
    picked, centre = [first["id"]], first["v"]
    state = rows.withColumn("d", F.lit(float("inf")))
    for step in range(1, k):
        c = F.array(*map(F.lit, centre))
        d = F.aggregate(F.zip_with("v", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        state = state.withColumn("d", F.least("d", d))
        if step % 8 == 0:
            state = staged(state)
        best = state.agg(F.max_by(F.struct("id", "v"), F.struct("d", -F.col("id"))).alias("b")).first()["b"]
        picked.append(best["id"])
        centre = best["v"]
    return spark.createDataFrame(list(enumerate(picked)), "step int, id long")


def shuffle_options(options: Column, key: Column, seed: int = 42) -> Column:
    """An array in an order that depends on its row's key and the seed."""
    keyed = F.transform(options, lambda o, i: F.struct(F.xxhash64(F.lit(seed), key, o, i).alias("h"), i.alias("i"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda x: x["o"])


def sliding_windows(df: DataFrame, width: int, stride: int, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row for each row and window it lies in: adds ``window`` and ``place``; the last windows may be short."""
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    numbered = df.withColumn("_pos", pos)
    first = F.greatest(F.lit(0), F.floor((F.col("_pos") - width) / stride) + 1)
    return numbered.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("_pos") / stride)))).withColumn("place", F.col("_pos") - F.col("window") * stride).drop("_pos")


def rolling_token_windows(tokens: Column, width: int, context: int = 1) -> Column:
    """Windows (context, targets) that cover all tokens once; each is predicted from up to ``width`` before it."""
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(F.slice(tokens, F.greatest(s - context, F.lit(0)) + 1, F.least(s, F.lit(context))).alias("context"), F.slice(tokens, s + 1, F.lit(width)).alias("targets")))


def running_topics(df: DataFrame, order: Sequence[str], by: Sequence[str], start: str, end: str) -> DataFrame:
    """Adds the state so far of each key: first start, last end, how often seen. A key's rows are taken in order, by one task."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("first_start", F.min(start).over(w)).withColumn("last_end", F.max(end).over(w)).withColumn("seen", F.count("*").over(w))


def compare_models(a: DataFrame, b: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Both models' values side by side, the largest gain of the second first."""
    x, y = a.select(*on, F.col(value).alias("value_a")), b.select(*on, F.col(value).alias("value_b"))
    return x.join(y, list(on)).withColumn("delta", F.col("value_b") - F.col("value_a")).orderBy(F.desc("delta"), *on)


def zero_filled(expected: DataFrame, scores: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Every expected row, with 0 where there is no score."""
    return expected.join(scores, list(on), "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


_SAFE = re.compile(r"[^\w\-.]")


def safe_name(name: str) -> str:
    return _SAFE.sub("_", name)


def decontaminated(items: DataFrame, corpus: DataFrame, words: int = 8, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, documents): in how many documents of the corpus some run of ``words`` words of an item's text is found; 0 for none.

    Runs are compared in lower case, by 128 bits of hashes, so that no run's
    text is made or shuffled. Null texts have none; ids are unique.
    """

    def runs(df: DataFrame, key: str) -> DataFrame:
        def hashes(w: Column) -> Column:
            each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1))), lambda i: F.struct(F.xxhash64(F.slice(w, i, words)).alias("h"), F.xxhash64(F.lit(1), F.slice(w, i, words)).alias("g")))
            return F.when(F.size(w) >= words, each)

        return df.select(key, F.explode(let(hashes, tokens(F.lower(text)))).alias("r")).select(key, "r.h", "r.g")

    mine = runs(items, item_id).distinct()
    met = runs(corpus, doc_id).join(mine, ["h", "g"]).select(item_id, doc_id).distinct()
    found = met.groupBy(item_id).agg(F.count("*").alias("documents"))
    return items.select(item_id).join(found, item_id, "left").select(item_id, F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))


def is_long(doc: DataFrame, seconds: float = 60.0) -> Column:
    """Whether a document's video is long: a duration label says so, or its seconds reach the bound; of nested metadata too."""
    labels, numbers = ("duration", "duration_label", "duration_category"), ("duration_sec", "duration_seconds", "video_duration", "video_time")
    kinds, found = dict(doc.dtypes), F.lit(False)
    places = [(k, F.col(k)) for k in doc.columns]
    for outer in ("meta", "metadata"):
        if kinds.get(outer, "").startswith("struct"):
            places += [(k, F.col(outer)[k]) for k in doc.schema[outer].dataType.names]
    for k, c in places:
        if k in labels:
            found = found | F.coalesce(F.lower(F.trim(c.cast("string"))) == "long", F.lit(False))
        elif k in numbers:
            found = found | F.coalesce(c.try_cast("double") >= seconds, F.lit(False))
    return found
