"""Exact dedup by a log-structured merge index of digests.

DataFrame and SQL functions only. A batch of rows fills several memtables, one
for the scan partitions of equal remainder. A memtable combines its rows by
digest (their number, and the row that stays) and is flushed as a run, sorted
by digest in each file. Every run has a bitmap filter. Compaction merges all
runs into one level: an entry that no other run's filter knows passes those
runs by and is copied as it is; the others are merged by digest. Entries are
unique in a run, so a group of any size meets as one entry of each run.

Digests of two or more rows are hits, and their rows' texts are compared byte
for byte by grouping on the text itself. A filter of the hits finds nearly all
rows without one at once, so that only texts of hits are shuffled, and copies
of a text are combined before that. Filters are broadcast and so have a bound;
where the hits are too many for one, rows are joined with the hits themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import Workspace

#: Memtables that a batch fills.
MEMTABLES = 4
#: Bits of a filter: 16 for each entry, within these bounds; with more entries than an eighth of the most bits, there is none. At most 32 MB are broadcast.
RUN_BITS, HIT_BITS = (1 << 16, 1 << 26), (1 << 20, 1 << 28)
_MIX = 0x2545F4914F6CDD1D


def digest(text: Column, bits: int = 256) -> Column:
    """The first ``bits`` bits of the SHA-256 of a text, null as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, bits // 8)


def _bits(n: int, bounds: tuple[int, int]) -> int:
    """Bits of a filter of n entries; 0 where it would be too full."""
    return 0 if 8 * n > bounds[1] else min(bounds[1], max(bounds[0], 1 << (16 * n).bit_length()))


def _position(bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1


def _bitmaps(entries: DataFrame, bits: int, by: list[str]) -> DataFrame:
    at = entries.select(*by, _position(bits).alias("at"))
    return at.groupBy(*by, F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def _holds(bitmap: Column, bits: int) -> Column:
    """Whether a bitmap, or null for an empty one, has a row's digest."""
    bit = F.bitmap_bit_position(_position(bits))
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))


class DigestIndex:
    """A log of (digest, id, row), the runs flushed from it, and the level they are compacted to."""

    def __init__(self, space: Workspace, keep: str = "smallest", bits: int = 256):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep must be smallest or largest, not {keep!r}")
        self.space, self.keep, self.bits, self.logs, self.runs = space, keep, bits, [], []

    def best(self, x: str | None = None) -> Column:
        """The row that stays, of rows or of those that stay in runs; null ids last, rows of one id by their number."""
        largest = self.keep == "largest"
        known = F.col("id").isNotNull() if largest else F.col("id").isNull()
        return (F.max if largest else F.min)(F.col(x) if x else F.struct(known.alias("k"), "id", "row"))

    def flush(self, batch: DataFrame, id_col: str, text_col: str) -> None:
        """Adds a batch: its rows to the log, and a run of each of its memtables."""
        number = len(self.logs)
        row = F.monotonically_increasing_id()
        rows = batch.select(digest(F.col(text_col), self.bits).alias("digest"), F.col(id_col).alias("id"), F.struct(F.lit(number).alias("batch"), row.alias("row")).alias("row"))
        self.logs.append(self.space.keep(rows, f"log{number}"))
        table = F.pmod(F.shiftright("row.row", 33), F.lit(MEMTABLES)).cast("int") + F.lit(number * MEMTABLES)
        entries = self.logs[-1].withColumn("run", table).groupBy("run", "digest").agg(F.count("*").alias("n"), self.best().alias("best"))
        self.runs.append(self.space.keep(entries.sortWithinPartitions("run", "digest"), f"runs{number}", by="run"))

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.logs)

    def compact(self) -> DataFrame:
        """The level: (digest, n, best) of all runs."""
        runs, n_runs = reduce(DataFrame.unionByName, self.runs), MEMTABLES * len(self.runs)
        largest = runs.groupBy("run").count().agg(F.max("count")).first()[0] or 0
        bits = _bits(largest, RUN_BITS)
        alone = None
        if bits and n_runs * bits <= HIT_BITS[1]:
            filters = _bitmaps(runs, bits, ["run"]).groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("run", "bitmap"))).alias("of"))
            # the filters' size is bounded by HIT_BITS, whatever the input
            probed = runs.withColumn("bucket", F.bitmap_bucket_number(_position(bits))).join(F.broadcast(self.space.keep(filters, "filters")), "bucket")
            elsewhere = [(F.col("run") != r) & _holds(F.element_at("of", F.lit(r)), bits) for r in range(n_runs)]
            probed = probed.withColumn("met", reduce(Column.__or__, elsewhere)).select("digest", "n", "best", "met")
            alone, runs = probed.where("not met").drop("met"), probed.where("met").drop("met")
        merged = runs.groupBy("digest").agg(F.sum("n").alias("n"), self.best("best").alias("best"))
        level = merged if alone is None else alone.unionByName(merged)
        self.level = self.space.keep(level.sortWithinPartitions("digest"), "level")
        self.hits = self.space.keep(self.level.where("n > 1").select("digest"), "hits")
        self.n_hits = self.hits.count()
        self.hit_bits = _bits(self.n_hits, HIT_BITS)
        if self.n_hits and self.hit_bits:
            self.filter = self.space.keep(_bitmaps(self.hits, self.hit_bits, []), "filter")
        return self.level

    def may_hit(self, rows: DataFrame) -> DataFrame:
        """Adds ``maybe`` to rows with a digest: false only for digests of one row. No shuffle, unless the hits are too many for a filter."""
        if self.n_hits == 0:
            return rows.withColumn("maybe", F.lit(False))
        if not self.hit_bits:
            hits = self.hits.select(_dealt_anew(F.col("digest")).alias("_k"), F.col("digest").alias("_hit"))
            met = rows.withColumn("_of", _dealt_anew(F.col("digest"))).join(hits, (F.col("_of") == F.col("_k")) & (F.col("digest") == F.col("_hit")), "left")
            return met.withColumn("maybe", F.col("_hit").isNotNull()).drop("_of", "_k", "_hit")
        # the filter's size is bounded by HIT_BITS, whatever the input
        found = rows.withColumn("bucket", F.bitmap_bucket_number(_position(self.hit_bits))).join(F.broadcast(self.filter), "bucket", "left")
        return found.withColumn("maybe", _holds(F.col("bitmap"), self.hit_bits)).drop("bucket", "bitmap")

    def collisions(self, batch: DataFrame, text_col: str) -> DataFrame:
        """Digests under which different texts lie, by comparing the texts of all hits byte for byte."""
        rows = batch.select(digest(F.col(text_col), self.bits).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        # copies are combined before the shuffle; a row that the filter let through by chance has one text
        texts = self.may_hit(rows).where("maybe").groupBy("digest", "text").agg(F.count("*").alias("n"))
        return self.space.keep(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "collisions")


def _dealt_anew(d: Column) -> Column:
    """The digest as another expression of the same value: the join deals both sides, and can split a hot one."""
    return F.xxhash64(d).bitwiseXOR(F.lit(_MIX))


def find_copies(docs: DataFrame, keep: str = "smallest", bits: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, digest) of each row, dropped ones too.

    Texts are equal if identical byte for byte; null counts as empty. Of equal
    texts one row stays: that of the smallest or largest id; of rows that
    repeat the id too, one. Null ids lose to others; keep_id is null only in
    groups without any id. ``bits`` shortens the digest (the byte comparison
    still tells different texts apart). Other columns are ignored; an empty
    table gives an empty one.
    """
    space = Workspace(docs.sparkSession, "exact")
    index = DigestIndex(space, keep, bits)
    index.flush(docs, id_col, text_col)
    level = index.compact()
    rows, clashes = index.rows(), None
    if index.n_hits:
        clashes = index.collisions(docs, text_col)
        if clashes.isEmpty():
            clashes = None
    groups = level.select(_dealt_anew(F.col("digest")).alias("k"), F.col("digest").alias("d"), "n", "best")
    rows = rows.withColumn("k", _dealt_anew(F.col("digest")))
    out = rows.join(groups, (rows["k"] == groups["k"]) & (rows["digest"] == groups["d"]))
    full = F.lower(F.hex("digest"))
    shape = [F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("best.row") == F.col("row")).alias("kept"), full.alias("digest")]
    if clashes is None:
        return out.select(*shape)
    # a digest of several texts: those rows are grouped by the text itself
    texts = docs.select(digest(F.col(text_col), bits).alias("digest"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.lit(0).alias("batch"), F.monotonically_increasing_id().alias("row")).alias("row"))
    texts = space.keep(texts.join(clashes, "digest", "left_semi"), "clashing")
    exact = texts.groupBy("digest", "text").agg(F.count("*").alias("n"), index.best().alias("best"))
    split = texts.join(exact, ["digest", "text"]).select(*shape)
    return out.join(clashes, "digest", "left_anti").select(*shape).unionByName(split)


def drop_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, all columns kept, whatever their names.

    Null counts as empty. The row that stays is that of the smallest or largest
    id; null ids lose to others, and of rows that repeat the id one stays, by
    its other columns. Rows that the filter clears pass without a shuffle. Hits
    are grouped by digest and text, so texts are compared byte for byte. An
    empty table gives an empty one.
    """
    space = Workspace(docs.sparkSession, "exact-drop")
    index = DigestIndex(space, keep)
    index.flush(docs, id_col, text_col)
    index.compact()
    if index.n_hits == 0:
        return docs
    rows = docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest(F.col(text_col)).alias("digest"))
    rows = index.may_hit(rows)
    clear = rows.where(~F.col("maybe")).select("whole.*")
    tie = F.xxhash64(F.to_json("whole"))
    if keep == "largest":
        pick = F.max_by("whole", F.struct(F.col("id").isNotNull(), "id", tie))
    else:
        pick = F.min_by("whole", F.struct(F.col("id").isNull(), "id", tie))
    # a row that the filter let through by chance is a group of its own
    stays = rows.where("maybe").groupBy("digest", "text").agg(pick.alias("whole")).select("whole.*")
    return clear.unionByName(stays)
