"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame and SQL functions only. Targets come from the sources' sizes by
water filling. A source's documents are dealt by hash into about sqrt(n)
disjoint blocks. A target is whole passes over the source, each a quota of all
its blocks, and a part of one more pass, a quota of some. A binary tree splits
the exact quotas among output shards: at each node every quota's share for the
left child is a hypergeometric draw given what is left, so that each shard's
counts are those of a random permutation of all blocks drawn.

Each pass permutes its blocks. The leaves cut the permutation into one pool a
shard, as many blocks as the leaf drew and an even share of those that no leaf
draws; a shard takes the first blocks of its pool. So the tree decides which
blocks are drawn and where they go. The words drawn are then brought to the
target by document: blocks too many go, or further ones of the pools come, the
last block in part. Copies in a shard are shuffled locally, by hash.

A row's draw depends on its source and hash alone, through a table of one row
for each block: rows are never collected, and no window holds more than about
sqrt(n) rows of a source. Rows that repeat are told apart by a number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubrica.llm.common import WORD, Workspace

#: Weights by the rank of the source's name, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds sid, weight and target to (source, n, source_size).

    Sources rank by code point, null last. All share ``share`` times the total
    by weight; a target stops at ``cap`` times its source's size and the excess
    is shared again by weight among the rest: target = least(cap * size,
    weight * level) with the one level at which the targets add up.
    """
    ranked = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    everything = Window.partitionBy(F.lit(0))
    full_before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(share) * F.sum("source_size").over(everything) - full_before) / weight_left
    ranked = ranked.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("limit") / F.col("weight"))
    # the first source that fits its level, in order of the level at which each is full
    ranked = ranked.withColumn("level", F.min_by("level", F.when(F.col("fits"), F.struct(F.col("limit") / F.col("weight"), "sid"))).over(everything))
    return ranked.select("source", "sid", "n", "source_size", "weight", F.least(F.col("limit"), F.coalesce(F.col("weight") * F.col("level"), F.col("limit"))).alias("target"))


def _ln_factorial(n: str) -> str:
    return f"if({n} <= 15, ln(factorial(cast(greatest(0, least(15, {n})) as int))), ({n} + 0.5D) * ln({n}) - {n} + 0.9189385332046727D + 1 / (12D * {n}) - 1 / (360D * pow({n}, 3)))"


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the number of marked among ``drawn`` of ``total``, by inversion at ``u``.

    Values farther than 12 deviations from the mode are left out; their
    probability is below any double's resolution.
    """

    def weight(k: str) -> str:
        return f"(-({_ln_factorial(f'({k})')} + {_ln_factorial(f'(p.c - {k})')} + {_ln_factorial(f'(p.m - {k})')} + {_ln_factorial(f'(p.n - p.c - p.m + {k})')}))"

    given = f"named_struct('n', cast({total} as bigint), 'c', cast({marked} as bigint), 'm', cast({drawn} as bigint), 'u', cast({u} as double))"
    low, high = "greatest(0L, p.m - (p.n - p.c))", "least(p.c, p.m)"
    mode = f"least({high}, greatest({low}, cast(floor((p.m + 1D) * (p.c + 1D) / (p.n + 2D)) as bigint)))"
    width = "cast(ceil(12 * sqrt(p.m * 1D * p.c * (p.n - p.c) * (p.n - p.m) / (greatest(1D, p.n * 1D * p.n * (p.n - 1D))))) as bigint) + 12"
    ranged = f"named_struct('n', p.n, 'c', p.c, 'm', p.m, 'u', p.u, 'mode', {mode}, 'ks', sequence(greatest({low}, {mode} - ({width})), least({high}, {mode} + ({width}))))"
    weighed = f"named_struct('u', p.u, 'ks', p.ks, 'ws', transform(p.ks, k -> exp({weight('k')} - {weight('p.mode')})))"
    chosen = (
        "aggregate(zip_with(p.ks, p.ws, (k, w) -> named_struct('k', k, 'w', w)),"
        " named_struct('left', p.u * aggregate(p.ws, 0D, (s, w) -> s + w), 'k', cast(null as bigint)),"
        " (a, x) -> named_struct('left', a.left - x.w, 'k', if(a.k is null and a.left < x.w, x.k, a.k)),"
        " a -> coalesce(a.k, element_at(p.ks, -1)))"
    )
    out = f"array({given})"
    for step in (ranged, weighed):
        out = f"transform({out}, p -> {step})"
    return f"transform({out}, p -> {chosen})[0]"


def _fold(counts: str, total: str, drawn: str, u: str) -> str:
    """SQL for the numbers of each of ``counts`` among ``drawn`` of all ``total``, one conditional draw after another."""
    draw = hypergeometric("acc.n", "c", "acc.m", u)
    return (
        f"aggregate({counts}, named_struct('n', {total}, 'm', {drawn}, 'i', 0, 'left', cast(array() as array<bigint>)),"
        f" (acc, c) -> transform(array({draw}), x -> named_struct('n', acc.n - c, 'm', acc.m - x, 'i', acc.i + 1, 'left', concat(acc.left, array(x))))[0],"
        " acc -> acc.left)"
    )


_SUM = "aggregate({0}, 0L, (s, c) -> s + c)"
#: Quotas that are drawn in one run; more are drawn in groups of about the square root of their number, then inside each group.
RUN = 64


def split_quotas(quotas: DataFrame, n_shards: int, n_quotas: int, seed: int = 7, by: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(by, shard, drawn) from (by, quota), ``n_quotas`` rows or fewer: exact quotas dealt to shards by the splitting tree.

    Each node is one row with an array of the quotas, so their number must fit
    a row: it is that of sources times passes, not of documents. The tree has
    log2 of the shards levels; from 64 nodes on a level is dealt out to tasks.
    """
    root = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(*by, F.col("quota").cast("long").alias("quota")))).alias("q"))
    nodes = root.select(F.lit(0).alias("shard"), F.lit(n_shards).alias("k"), F.transform("q", lambda x: F.struct(*(x[b].alias(b) for b in by))).alias("keys"), F.col("q.quota").alias("counts"))
    for level in range(max(1, n_shards - 1).bit_length() if n_shards > 1 else 0):
        if level and level % 6 == 0:
            nodes = nodes.repartition(F.col("shard"))
        uniform = lambda key, level=level: f"shiftrightunsigned(xxhash64({seed}, {level}, shard, {key}), 11) * pow(2D, -53)"
        if n_quotas <= RUN:
            left = _fold("counts", "total", "goes", uniform("acc.i"))
        else:
            width = math.isqrt(n_quotas)
            groups = f"transform(sequence(0, (size(counts) - 1) div {width}), g -> slice(counts, g * {width} + 1, {width}))"
            sums = f"transform({groups}, x -> {_SUM.format('x')})"
            left = f"transform(array(named_struct('g', {groups}, 's', {sums}, 'l', {_fold(sums, 'total', 'goes', uniform('-1 - acc.i'))})), w -> flatten(transform(w.g, (x, g) -> {_fold('x', 'w.s[g]', 'w.l[g]', uniform('g, acc.i'))})))[0]"
        total = _SUM.format("counts")
        halves = nodes.selectExpr("shard", "k", "keys", "counts", f"{total} as total").selectExpr("*", "total * (k div 2) div k as goes")
        halves = halves.selectExpr("shard", "k", "keys", "counts", f"if(k = 1, counts, {left}) as left")
        parts = "if(k = 1, array(struct(shard, k, counts)), array(struct(shard, k div 2 as k, left as counts), struct(shard + k div 2 as shard, k - k div 2 as k, zip_with(counts, left, (c, x) -> c - x) as counts)))"
        nodes = halves.selectExpr("keys", f"explode({parts}) as p").select("p.shard", "p.k", "keys", "p.counts")
    leaves = nodes.select("shard", F.explode(F.arrays_zip("keys", "counts")).alias("x"))
    return leaves.select("x.keys.*", "shard", F.col("x.counts").alias("drawn"))


class Mix:
    """The plan of a mix: ``sources`` (one row each), and ``blocks`` and ``drawn`` (one row for each block)."""

    def __init__(self, docs: DataFrame, share: float, cap: float, weights: tuple[int, ...], n_shards: int | None, shard_words: int, seed: int, id_col: str, text_col: str, source_col: str):
        self.space = space = Workspace(docs.sparkSession, "mixing")
        self.seed, self.id_col, self.text_col, self.source_col = seed, id_col, text_col, source_col
        slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), self.hash().alias("h"), F.monotonically_increasing_id().alias("row"))
        base = space.keep(slim, "sizes")
        repeated = space.keep(base.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
        self.repeated = None if repeated.isEmpty() else repeated
        base = self.told_apart(base)
        sums = base.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
        sources = targets(sums, share, cap, weights)
        full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
        sources = sources.withColumn("passes", full).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        self.sources = space.keep(sources.withColumn("n_blocks", F.ceil(F.sqrt("n")).cast("long")), "sources")
        self.base = self.placed(base)
        total, self.n_quotas = self.sources.agg(F.coalesce(F.sum("target"), F.lit(0)), F.coalesce(F.sum(F.col("passes") + 1), F.lit(0))).first()
        self.n_shards = n_shards or max(8, 1 << max(0, int(total // shard_words)).bit_length())
        self.blocks = space.keep(self._blocks(), "blocks")
        # written, so that Spark knows how small it is and no document is shuffled to meet it
        self.drawn = space.keep(self._drawn(), "drawn")

    def hash(self) -> Column:
        parts = [F.col(c) for c in (self.id_col, self.text_col, self.source_col)]
        return F.xxhash64(F.lit(self.seed), *parts, *(c.isNull() for c in parts))

    def told_apart(self, rows: DataFrame) -> DataFrame:
        """Rows with (h, row), of which those that repeat get hashes of their own, by their number among their like.

        They are numbered in each task first and then over the tasks, so a
        row that repeats without end never meets all its like.
        """
        if self.repeated is None:
            return rows.drop("row")
        again = self.space.keep(rows.join(self.repeated, "h", "left_semi").withColumn("_part", F.shiftright("row", 33)), "again")
        parts = again.groupBy("h", "_part").agg(F.count("*").alias("n"))
        before = parts.select("h", "_part", (F.sum("n").over(Window.partitionBy("h").orderBy("_part")) - F.col("n")).alias("_before"))
        inside = F.row_number().over(Window.partitionBy("h", "_part").orderBy("row"))
        numbered = again.withColumn("_inside", inside).join(before, ["h", "_part"])
        numbered = numbered.withColumn("h", F.xxhash64("h", F.col("_before") + F.col("_inside")))
        return rows.join(self.repeated, "h", "left_anti").unionByName(numbered.select(rows.columns)).drop("row")

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with (source, h) get their source's figures and their block."""
        s = self.sources.withColumnRenamed("source", "_source")
        return rows.join(s, rows["source"].eqNullSafe(s["_source"])).drop("_source").withColumn("block", F.pmod(F.col("h"), F.col("n_blocks")))

    def _blocks(self) -> DataFrame:
        """(sid, block, shards, state, words_left, shard): where its whole passes go; whether the last pass takes all of it (2), a part (1) or nothing (0), for which shard."""
        spans = self.space.keep(self.base.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"), F.first("source_size").alias("of")), "spans")
        by = ["sid", "pass"]
        colours = spans.groupBy("sid").agg(F.count("*").alias("pool"), F.first("passes").alias("passes"), F.first("rest").alias("rest"), F.first("of").alias("of"))
        colours = colours.select("sid", "pool", F.coalesce(F.round(F.try_divide("rest", "of") * F.col("pool")), F.lit(0.0)).cast("long").alias("part"), "passes", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("pass"))
        colours = colours.select(*by, "pool", F.when(F.col("pass") < F.col("passes"), F.col("pool")).otherwise(F.col("part")).alias("quota"))
        colours = self.space.keep(colours, "quotas")
        leaves = self.space.keep(split_quotas(colours, self.n_shards, self.n_quotas, self.seed, ("sid", "pass")), "leaves").join(colours, by)
        idle = lambda shard: F.floor(shard * (F.col("pool") - F.col("quota")) / self.n_shards)
        start = F.sum("drawn").over(Window.partitionBy(*by).orderBy("shard")) - F.col("drawn") + idle(F.col("shard"))
        more = idle(F.col("shard") + 1) - idle(F.col("shard"))
        places = leaves.select(*by, "shard", "drawn", start.alias("start"), (F.col("drawn") + more).alias("n")).where("n > 0")
        places = places.select(*by, "shard", "drawn", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select(*by, "shard", (F.col("start") + F.col("i")).alias("place"), (F.col("i") < F.col("drawn")).alias("drawn"))
        units = spans.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
        order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(self.seed), F.lit("unit"), *by, "block"), "block")
        units = units.withColumn("place", (F.row_number().over(order) - 1).cast("long")).join(places, [*by, "place"])
        # of the last pass, the drawn blocks' words come first, then those of the pools' others, up to the target
        last = F.col("pass") == F.col("passes")
        before = F.sum("words").over(Window.partitionBy(*by).orderBy(F.desc("drawn"), "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
        units = units.withColumn("left", F.col("rest") - before)
        state = F.when(~last | (F.col("words") <= F.col("left")) & (F.col("rest") > 0), 2).when(F.col("left") > 0, 1).otherwise(0)
        units = units.select("sid", "block", "pass", "shard", "left", state.alias("state"), last.alias("last"))
        # a block has at most cap + 1 passes
        whole = F.array_sort(F.collect_list(F.when(F.col("state") == 2, F.struct("pass", "shard"))))["shard"]
        of_last = lambda c: F.max(F.when(F.col("last"), F.col(c)))
        return units.groupBy("sid", "block").agg(whole.alias("shards"), of_last("state").alias("state"), of_last("left").alias("words_left"), of_last("shard").alias("shard"))

    def _drawn(self) -> DataFrame:
        """(sid, block, shards, shard, taken, one, one_shard): the blocks with the hashes taken of the one in which a target ends, and one more document of the source, if it comes nearer to the target."""
        last = self.blocks.where("state = 1").select("sid", "block", "words_left")
        inside = self.base.select("sid", "block", "h", "size").join(last, ["sid", "block"])
        # about sqrt(n) documents of a source, in hash order: each that fits what is left
        members = inside.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("h", "size"))).alias("docs"), F.first("words_left").alias("words_left"))
        fill = "aggregate(docs, named_struct('left', words_left, 'taken', cast(array() as array<bigint>)), (a, x) -> if(x.size <= a.left, named_struct('left', a.left - x.size, 'taken', concat(a.taken, array(x.h))), a))"
        cut = self.space.keep(members.selectExpr("sid", "block as at", f"{fill} as f").selectExpr("sid", "at", "f.taken", "f.left as short"), "cut")
        # one more document of the source that the last pass doesn't take, whose size is nearest to what is short
        spare = self.base.select("sid", "block", "h", "size").join(self.blocks.where("state < 2").select("sid", "block", "shard"), ["sid", "block"]).join(cut, "sid")
        spare = spare.where((F.col("block") != F.col("at")) | ~F.array_contains("taken", F.col("h")))
        off = F.abs(F.col("size") - F.col("short"))
        one = spare.where(off < F.col("short")).groupBy("sid").agg(F.min(F.struct(off.alias("off"), "h", "shard")).alias("x")).select("sid", F.col("x.h").alias("one"), F.col("x.shard").alias("one_shard"))
        ends = cut.select("sid", F.col("at").alias("block"), "taken")
        return self.blocks.drop("state", "words_left").join(ends, ["sid", "block"], "left").join(one, "sid", "left")

    def draws(self, placed: DataFrame) -> DataFrame:
        """Adds ``shards``, the shard of each copy drawn (an empty array: none), to rows with (sid, block, h)."""
        rows = placed.join(self.drawn, ["sid", "block"])
        edge = F.when(F.array_contains("taken", F.col("h")), F.array("shard")).when(F.col("h") == F.col("one"), F.array("one_shard"))
        return rows.withColumn("shards", F.concat("shards", F.coalesce(edge, F.array().cast("array<int>")))).drop("shard", "taken", "one", "one_shard")


def mix_plan(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, n_shards: int | None = None, shard_words: int = 1 << 23, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, shards) of each row.

    size counts words (null text: 0); taken = size times the copies drawn, at
    most ``cap`` rounded up copies; shards lists each copy's output shard. A
    null source is a source of its own. Ids may be null or repeat: every row is
    drawn for itself, and how many of rows that agree in id, text and source
    are drawn doesn't depend on how they are partitioned. Words taken from a
    source differ from its target by less than one document. Other columns are
    ignored. An empty table gives an empty one.
    """
    mix = Mix(docs, share, cap, weights, n_shards, shard_words, seed, id_col, text_col, source_col)
    rows = mix.draws(mix.base)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix_documents(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, n_shards: int | None = None, shard_words: int = 1 << 23, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every copy drawn as a row of ``docs``'s columns, in shards that are shuffled locally.

    A document drawn twice is two rows. Copies of a shard are in one
    partition, in an order that only their hash decides. Null ids, texts and
    sources, repeated rows and an empty table are as in mix_plan(); all
    columns of ``docs`` are kept, whatever their names.
    """
    mix = Mix(docs, share, cap, weights, n_shards, shard_words, seed, id_col, text_col, source_col)
    rows = mix.told_apart(docs.select(F.struct("*").alias("whole"), F.col(source_col).alias("source"), mix.hash().alias("h"), F.monotonically_increasing_id().alias("row")))
    rows = mix.draws(mix.placed(rows).select("whole", "h", "sid", "block")).select("whole", "h", F.posexplode("shards").alias("copy", "shard"))
    rows = rows.repartitionById(mix.n_shards, F.col("shard").cast("int")).sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "h", "copy"), "h", "copy")
    return rows.select("whole.*")
