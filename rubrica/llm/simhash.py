"""SimHash near-dedup by pigeonhole blocks.

Fingerprints are cut into ``max_distance + 2`` blocks: two fingerprints that
differ in at most ``max_distance`` bits agree in at least two whole blocks, so
a join on every pair of blocks finds them; the Hamming distance is then
verified. Copies share one fingerprint and are joined once. Buckets of more
than ``bucket`` different fingerprints are cut into blocks again, of the bits
in which their members may still differ; after three such cuts a bucket has at
most 256 fingerprints, so nothing is quadratic in a hot one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import Workspace, bound_batches

SEED = 42
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
_ODD = 0x5DEECE66D


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is 1 if set in over half of the shingles' hashes."""
    words = (raw or b"").lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    n, ones, h = 0, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    while hashes := [h(g, SEED) for _, g in zip(range(CHUNK), grams, strict=False)]:
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
        if len(hashes) < CHUNK:
            break
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): fp holds the 64 bits as a signed long; null and wordless texts have 0. One narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], [id_col, "fp"])

    slim = bound_batches(docs).select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, fp long")


def _fresh(key: Column) -> Column:
    """The same key as another value, so that an aggregate's output is dealt anew before a join and a skewed side can be split."""
    return key.bitwiseXOR(F.lit(_ODD))


#: Bits of which all values may meet in one bucket.
LAST = 8


def links(space: Workspace, nodes: DataFrame, max_distance: int = 2, bucket: int = 64) -> DataFrame:
    """(a, b), a < b: the pairs of different fingerprints within max_distance bits.

    A bucket of more than ``bucket`` fingerprints is cut into blocks again, of
    the bits that its members may still differ in, until there are LAST such
    bits at most. Every bucket that is paired is small by then, whatever the
    corpus; buckets of any size give the same pairs.
    """
    if not 0 <= max_distance <= LAST - 2:
        raise ValueError(f"max_distance must be 0 to {LAST - 2}, not {max_distance}")
    n, width, found = max_distance + 2, 64, []
    rows = nodes.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"))
    while True:
        cuts = [width * i // n for i in range(n + 1)]
        sizes = [hi - lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
        blocks = [F.shiftrightunsigned("rest", width - hi).bitwiseAND(F.lit((1 << size) - 1)) for hi, size in zip(cuts[1:], sizes, strict=True)]

        def others(*pair: int) -> Column:
            return reduce(lambda x, k: F.shiftleft(x, sizes[k]).bitwiseOR(blocks[k]), (k for k in range(n) if k not in pair), F.lit(0).cast("long"))  # noqa: B023

        keyed = (F.struct(F.xxhash64("key", F.lit(c), blocks[i], blocks[j]).alias("key"), others(i, j).alias("rest")) for c, (i, j) in enumerate(combinations(range(n), 2)))
        rows = rows.select("fp", F.explode(F.array(*keyed)).alias("x")).select("fp", "x.key", "x.rest")
        width -= sum(sorted(sizes)[:2])
        often = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(_fresh(F.col("key")).alias("k"), "n")
        met = space.keep(rows.select(_fresh(F.col("key")).alias("k"), "fp", "key", "rest").join(often, "k"), "buckets")
        few = met if width <= max(LAST, n) else met.where(F.col("n") <= bucket)
        a, b = few.select("k", F.col("fp").alias("a")), few.select("k", F.col("fp").alias("b"))
        found.append(a.join(b, "k").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)).select("a", "b"))
        rows = met.where(F.col("n") > bucket).select("fp", "key", "rest")
        if width <= max(LAST, n) or rows.isEmpty():
            return space.keep(reduce(DataFrame.unionByName, found).distinct(), "links")


def components(space: Workspace, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternating large-star and small-star steps; every step is a join on
    nodes whose minima come from a combining aggregate. Each round is written
    to the shared folder. The number of rounds grows with the logarithm of
    the longest chain.
    """
    current = edges
    for _ in range(rounds):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).select(_fresh(F.col("u")).alias("k"), "m")
        large = both.select(_fresh(F.col("u")).alias("k"), "u", "v").join(low, "k").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = space.keep(large, "large")
        down = large.groupBy("b").agg(F.min("a").alias("m")).select(_fresh(F.col("b")).alias("k"), "m")
        joined = large.select(_fresh(F.col("b")).alias("k"), "a", "b").join(down, "k")
        small = joined.select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        small = space.keep(small, "small")
        space.drop(large)
        if current is not edges:
            space.drop(current)
        current = small
        # done when each node hangs on one root, and no root hangs on another
        hanging = current.select(F.col("b").alias("a")).distinct()
        if current.join(hanging, "a", "left_semi").isEmpty():
            return current.select(F.col("b").alias("node"), F.col("a").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2, bucket: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component): the near-duplicate class of each row.

    component is the smallest id that links reach, the row's own included. A
    null or wordless text has fingerprint zero and is linked like any other.
    Null ids are passed over by the minimum; a class of null ids alone has a
    null component. Repeated rows each get their row. Other columns are
    ignored; an empty table gives an empty one.
    """
    space = Workspace(docs.sparkSession, "simhash")
    base = space.keep(fingerprints(docs, shingle, id_col, text_col).select(F.col(id_col).alias("id"), "fp"), "fingerprints")
    nodes = space.keep(base.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    edges = links(space, nodes, max_distance, bucket)
    roots = nodes.select("fp", "least")
    if not edges.isEmpty():
        found = space.keep(components(space, edges), "components")
        roots = roots.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        smallest = roots.groupBy("root").agg(F.min("least").alias("component")).select(_fresh(F.col("root")).alias("k"), "component")
        roots = roots.select("fp", _fresh(F.col("root")).alias("k")).join(smallest, "k").select("fp", "component")
        roots = space.keep(roots, "classes")
    else:
        roots = nodes.select("fp", F.col("least").alias("component"))
    return base.join(roots, "fp").select(F.col("id").alias(id_col), "fp", "component")


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the one of the smallest id.

    Null and wordless texts are one class. Ids are expected to be unique; where
    the smallest id repeats, its rows all stay. Rows without an id stay,
    whatever their class: nothing names them. All columns are kept, whatever
    their names; an empty table gives an empty one.
    """
    near = near_duplicates(docs, shingle, max_distance, id_col=id_col, text_col=text_col)
    gone = near.where(F.col(id_col) != F.col("component")).select(F.col(id_col).alias("_gone"))
    space = Workspace(docs.sparkSession, "simhash-drop")
    gone = space.keep(gone, "dropped")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
