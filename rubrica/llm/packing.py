"""Best-fit packing of token sequences by large-item matching.

Texts longer than the capacity are cut into whole-capacity pieces, so every
piece has one of at most ``capacity`` lengths. The histogram of lengths, which
no corpus makes longer than the capacity, is packed on the driver: pieces
above one third of the capacity are matched greedily, the longest with the
longest that still fits, at most two to a bin; then shorter pieces, longest
first, go where they leave the least room. The outcome is a list of layouts
with the number of bins of each. Pieces get a rank among those of their length
from counts by task, and the rank names a bin and an offset.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rubrica.llm.common import Workspace, bound_batches
from rubrica.llm.tokens import vocabulary_path

#: Words whose ids one worker remembers, and characters of the longest; the memo is emptied when full.
MEMO, MEMO_CHARS = 1 << 19, 64
# The pre-tokenizer's pattern for lower-case texts within Latin-1 (fixed values).
_L = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\x09-\\x0d\\x20\\x85\\xa0{_L}{_N}]+")


class WordIds(dict):
    """word -> its ids as little-endian 32-bit bytes.

    The vocabulary's pre-tokenizer makes words independent of each other, so a
    text's ids are its words' ids one after another. A text with characters
    beyond Latin-1, or with a special string, goes through the library as a
    whole.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of new words, in one call: spaces part them as other words do in a text."""
        new = sorted(words)
        e = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
        ids, cuts = np.array(e.ids, "<u4"), np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(new) + 1))
        raw, cuts = ids.tobytes(), (4 * cuts).tolist()
        found = {w: raw[a:b] for w, a, b in zip(new, cuts, cuts[1:], strict=False)}
        if len(self) + len(found) > MEMO:
            self.clear()
        self.update((w, i) for w, i in found.items() if len(w) <= MEMO_CHARS)
        return found

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if "<|" in text and any(s in text for s in self.specials):
            return self.whole(text)
        words = LATIN_WORDS.findall(text.lower())
        ids = list(map(self.get, words))
        if None in ids:
            new = self.learn({w for w, i in zip(words, ids, strict=True) if i is None})
            ids = [new[w] if i is None else i for w, i in zip(words, ids, strict=True)]
        return b"".join(ids)


_words: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    if vocabulary not in _words:
        _words[vocabulary] = WordIds(vocabulary_path(vocabulary))
    return _words[vocabulary]


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a bin, number of such bins)] for a histogram {length: pieces}.

    Time and layouts depend on the capacity, not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0 and n > 0}
    third = capacity / 3
    bins: dict[tuple[int, ...], int] = defaultdict(int)
    sizes = sorted(n for n in left if n > third)
    while sizes:
        big = sizes[-1]
        at = bisect.bisect_right(sizes, capacity - big) - 1
        if at < 0:
            bins[(big,)] += left.pop(big)
            sizes.pop()
            continue
        mate = sizes[at]
        n = left[big] // 2 if mate == big else min(left[big], left[mate])
        if n == 0:  # one left of a length that pairs with itself: with the next shorter
            n, mate = (1, sizes[at - 1]) if at else (1, 0)
        bins[(big, mate) if mate else (big,)] += n
        for x in (big, mate):
            if x:
                left[x] -= n
                if left[x] <= 0:
                    left.pop(x)
                    sizes.pop(bisect.bisect_left(sizes, x))
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for layout, n in bins.items():
        room[capacity - sum(layout)].append((layout, n))
    gaps = sorted(g for g in room if g)
    for size in sorted((n for n in left if n <= third), reverse=True):
        todo = left[size]
        while todo:
            at = bisect.bisect_left(gaps, size)
            if at == len(gaps):  # new bins
                each = capacity // size
                whole, rest = divmod(todo, each)
                made = [((size,) * each, whole), ((size,) * rest, 1)]
                todo = 0
            else:
                gap = gaps[at]
                layout, n = room[gap].pop()
                if not room[gap]:
                    del room[gap], gaps[at]
                each = gap // size
                whole, rest = divmod(todo, each)
                if whole >= n:
                    made, todo = [(layout + (size,) * each, n)], todo - n * each
                else:
                    made, todo = [(layout + (size,) * each, whole), (layout + (size,) * rest, 1), (layout, n - whole - 1)], 0
            for layout, n in made:
                if layout and n:
                    g = capacity - sum(layout)
                    if g and g not in room:
                        bisect.insort(gaps, g)
                    room[g].append((layout, n))
    return [x for g in sorted(room) for x in room[g]]


def slots(layouts: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first bin, offset) of each run of its slots, by rank."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter[int] = Counter()
    first = 0
    for layout, n in layouts:
        offset = 0
        for size in layout:
            runs[size].append((used[size], first, offset))
            used[size] += n
            offset += size
        first += n
    return {size: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for size, r in runs.items()}


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth): each text's pieces, and their place among those of their length in their task; if wanted, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_ids(vocabulary), TaskContext.get().partitionId()
        end = int(end_id).to_bytes(4, "little")
        seen: Counter[int] = Counter()
        for b in batches:
            take, rest = [], []
            for i, t in enumerate(b.column(1)):
                raw = t.as_py()
                ids = (words.ids(raw.decode("utf-8", "replace")) if raw else b"") + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    n = len(cut) // 4
                    take.append(i)
                    rest.append((p, at // 4, n, zlib.crc32(cut), part, seen[n], cut if with_ids else None))
                    seen[n] += 1
            columns = list(zip(*rest, strict=True)) or [()] * 7
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            arrays = [b.column(0).take(pa.array(take, pa.int32())), *(pa.array(c, k) for c, k in zip(columns[:6], kinds, strict=True))]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(c, "<i4") for c in columns[6]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids])

    slim = bound_batches(docs).select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of each piece, and its ids if wanted.

    A text's ids get ``end_id`` behind them, so a null or empty text is one
    piece of length 1. Only texts longer than the capacity are cut. Ids may be
    null or repeat: each row's pieces are packed. Every sequence is gapless
    from 0 and at most ``capacity`` long. Other columns are ignored; an empty
    table gives an empty one.
    """
    space = Workspace(docs.sparkSession, "packing")
    table = space.keep(pieces(docs, capacity, vocabulary, end_id, id_col, text_col, with_ids), "pieces")
    counts = space.keep(table.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    # at most ``capacity`` rows come to the driver
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = slots(pack_lengths(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    # one row a task, with a number for each length up to the capacity
    of = F.map_from_entries(F.collect_list(F.struct("length", "base")))
    bases = bases.groupBy("part").agg(of.alias("of")).select("part", F.transform(F.sequence(F.lit(1).cast("long"), F.lit(capacity).cast("long")), lambda n: F.coalesce(F.element_at("of", n), F.lit(0))).alias("bases"))
    bases = space.keep(bases, "bases")
    ranked = table.join(bases, "part").select(id_col, "piece", "start", "length", "ids_crc32", (F.get("bases", (F.col("length") - 1).cast("int")) + F.col("nth")).alias("rank"), *["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts) if len(order) else ():
                first, bin_, off = places[int(length[at[0]])]
                run_ = np.searchsorted(first, rank[at], "right") - 1
                sequence[at] = bin_[run_] + rank[at] - first[run_]
                offset[at] = off[run_]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset), *b.columns[6:]], [*b.schema.names[:5], "sequence_id", "offset", *["ids"] * with_ids])

    return ranked.mapInArrow(run, f"`{id_col}` {ranked.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, spans) of pack(..., with_ids=True): whole sequences, at most the capacity long, and whose pieces lie where."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", F.col(id_col).alias("id"), "piece", "ids"))).alias("p"))
    spans = F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length")))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), spans.alias("spans"))
