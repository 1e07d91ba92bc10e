"""Token counts by heap-and-linked-list byte-pair merging.

The text is split into pieces as the vocabulary's pre-tokenizer splits it. In
each piece, adjacent symbols form a doubly linked list and a heap holds the
pairs that have a merge rank; the lowest rank (leftmost first) is popped and
merged until no pair is left. The count is the piece's bytes minus its merges;
no identifiers are made. Counts of pieces seen are kept in a bounded memo.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from rubrica.llm.common import bound_batches

#: Pieces whose counts one worker remembers, and characters of the longest; the memo is emptied when full, which changes no result.
MEMO, MEMO_CHARS = 1 << 19, 64

# Letters and numbers of Latin-1, as the pre-tokenizer's \p{L} and \p{N} have them (fixed values).
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\\x09-\\x0d\\x20\\x85\\xa0"
#: The byte-level pre-tokenizer's pattern, for texts within Latin-1.
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def vocabulary_path(name: str) -> str:
    """The place of a vocabulary file on this machine; an absolute path stays as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves; the others take the code
    points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class MergeCounter(dict):
    """piece -> tokens; a missing piece is counted by merging."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        symbols = byte_symbols()
        self.byte_id = [vocab[symbols[b]] for b in range(256)]
        self.char_byte = {c: b for b, c in symbols.items()}
        self.pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece.encode("utf-8"))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = n
        return n

    def merged(self, piece: bytes) -> int:
        """Symbols minus merges."""
        n = len(piece)
        pairs, symbol = self.pairs, [self.byte_id[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i) for i in range(n - 1) if (p := pairs.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            pair = pairs.get((symbol[i], symbol[j]))
            if pair is None or pair[0] != rank:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = pair[1], -1
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if p := pairs.get((symbol[i], symbol[k])):
                    heapq.heappush(heap, (p[0], i))
            if (h := before[i]) >= 0 and (p := pairs.get((symbol[h], symbol[i]))):
                heapq.heappush(heap, (p[0], h))
        return n - merges

    def pieces(self, text: str) -> Iterator[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            # the library's own splitter, whose Unicode tables are the vocabulary's
            back = self.char_byte
            return (bytes(back[c] for c in piece).decode("utf-8") for piece, _ in self.splitter.pre_tokenize_str(text))
        return LATIN.findall(text) if len(text) < 1 << 22 else (m.group() for m in LATIN.finditer(text))

    def count(self, text: str) -> int:
        if self.cut is None:
            return sum(map(self.__getitem__, self.pieces(text)))
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts if p)


_counters: dict[str, MergeCounter] = {}


def counter(vocabulary: str) -> MergeCounter:
    """One counter for each vocabulary in a worker."""
    if vocabulary not in _counters:
        _counters[vocabulary] = MergeCounter(vocabulary_path(vocabulary))
    return _counters[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row's whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeat;
    each row is counted by itself. Other columns are ignored. Special strings
    inside a text count as one token, as the library does by default. One
    narrow stage; memory is bounded by a batch and the memo.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for b in batches:
            n_bytes, n_tokens = [], []
            for t in b.column(1):
                raw = t.as_py() or b""
                n_bytes.append(len(raw))
                n_tokens.append(count(raw.decode("utf-8", "replace")) if raw else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    slim = bound_batches(docs).select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
