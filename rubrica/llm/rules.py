"""Quality rules by distribution divergence.

One pass over all documents makes a reference for each language: the counts
of its character classes and of its words. A second pass compares each
document's histograms with its language's: the Jensen-Shannon distance of the
character classes and of the most common words (all others in one class). A
distance counts only from a minimum length on, since short texts are far from
any distribution by chance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubrica.llm.common import Workspace, bound_batches

CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other_ascii", "beyond_ascii")
SYMBOLS = b"#*$%&|<>"


def _class_of_byte() -> np.ndarray:
    out = np.full(256, CLASSES.index("other_ascii"))
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", b" \t\n\r\x0b\x0c"), ("stop", b".,"), ("symbol", SYMBOLS), ("beyond_ascii", range(192, 256))):
        out[list(chars)] = CLASSES.index(name)
    out[128:192] = len(CLASSES)  # continuation bytes belong to no class
    return out


CLASS_OF_BYTE = _class_of_byte()


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    #: The most words, in percent, that may lie in repeated 3-word windows.
    max_repeat_percent: int = 50
    common_words: int = 40
    #: Lengths from which a distance counts.
    min_chars: int = 200
    min_common_words: int = 100
    max_class_distance: float = 0.32
    max_word_distance: float = 0.335
    #: A language with fewer words has no reference, and its documents no distances.
    min_reference_words: int = 2000


def class_counts(raw: bytes) -> np.ndarray:
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return np.bincount(CLASS_OF_BYTE, weights=bytes_, minlength=len(CLASSES) + 1)[: len(CLASSES)].astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    # pairs are numbered first, so that a window's number fits 64 bits for any vocabulary
    pairs = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * v + ids[2:]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(windows, twice)
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[k : n - 2 + k] |= again
    return int(marked.sum())


def base_counts(raw: bytes, words: list[bytes], classes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols = int(classes[CLASSES.index("symbol")])
    spaces = int(classes[CLASSES.index("space")])
    return len(words), code_points(raw) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def code_points(raw: bytes) -> int:
    return len(raw.decode("utf-8", "replace")) if not raw.isascii() else len(raw)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, 0 to 1, of two histograms; of an empty one, 0."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


#: Words counted in a task before its counts are passed on; bounds its memory.
FLUSH = 300_000


def references(docs: DataFrame, rules: Rules, text_col: str, lang_col: str) -> DataFrame:
    """(lang, words, chars, common): words in all, counts of the classes, and the most common words with their counts, of each language with enough words.

    Every word of every document is counted: in each task first, then over
    all. The table has a row for each language and stays in the shared folder;
    nothing of it comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, Counter[bytes]] = {}
        classes: dict[str | None, np.ndarray] = {}
        held = 0

        def out() -> pa.RecordBatch:
            rows = [(k, False, w, c) for k, ws in words.items() for w, c in ws.items()] + [(k, True, str(i).encode(), int(c)) for k, cs in classes.items() for i, c in enumerate(cs)]
            words.clear()
            classes.clear()
            lang, kind, key, n = zip(*rows, strict=True) if rows else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.bool_()), pa.array(key, pa.binary()), pa.array(n, pa.int64())], ["lang", "is_class", "key", "n"])

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = t.as_py() or b""
                if lang not in words:
                    words[lang], classes[lang] = Counter(), np.zeros(len(CLASSES), np.int64)
                    held += len(CLASSES)
                ws = words[lang]
                held -= len(ws)
                ws.update(raw.split())
                held += len(ws)
                classes[lang] += class_counts(raw)
                if held > FLUSH:
                    yield out()
                    held = 0
        yield out()

    slim = bound_batches(docs).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("_text"))
    counted = slim.mapInArrow(run, "lang string, is_class boolean, key binary, n long").groupBy("lang", "is_class", "key").agg(F.sum("n").alias("n"))
    space = Workspace(docs.sparkSession, "rules")
    table = space.keep(counted.where("lang is not null"), "counts")
    chars = (F.coalesce(F.sum(F.when(F.col("is_class") & (F.col("key") == F.lit(str(i).encode())), F.col("n"))), F.lit(0)) for i in range(len(CLASSES)))
    sums = table.groupBy("lang").agg(F.coalesce(F.sum(F.when(~F.col("is_class"), F.col("n"))), F.lit(0)).alias("words"), F.array(*chars).alias("chars"))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    # at most ``common_words`` rows of a language are gathered
    common = table.where("not is_class").withColumn("place", top).where(F.col("place") <= rules.common_words).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "key", "n"))).alias("common"))
    known = sums.where(F.col("words") >= rules.min_reference_words).join(common, "lang", "left")
    return space.keep(known.select("lang", "words", "chars", F.transform("common", lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n"))).alias("common")), "references")


#: References that a task remembers in decoded form.
MEMO = 1000


def apply_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept) of each row.

    A null text counts as empty and fails for its length. Distances are null
    and reject nothing for texts under the minimum lengths, for null languages
    and for those without enough words for a reference: no other language's
    words say what is usual in them. Ids may be null or repeat; other columns
    are ignored; an empty table gives an empty one.
    """
    known = references(docs, rules, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]] = {}

        def reference(b: pa.RecordBatch, i: int, lang: str) -> tuple[np.ndarray, dict[bytes, int], np.ndarray]:
            if lang not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                total, chars, common = (b.column(k)[i].as_py() for k in (3, 4, 5))
                common = common or []
                counts = [x["n"] for x in common]
                memo[lang] = np.array(chars, float), {x["key"]: k for k, x in enumerate(common)}, np.array([*counts, total - sum(counts)], float)
            return memo[lang]

        for b in batches:
            rows = []
            has = b.column(3).is_valid().to_pylist()
            for i, (lang, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                raw = t.as_py() or b""
                words, classes = raw.split(), class_counts(raw)
                base = base_counts(raw, words, classes)
                n, repeats = base[0], base[4]
                failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
                of_classes = of_words = None
                if has[i]:
                    chars, places, counts = reference(b, i, lang)
                    of_classes = distance(classes, chars) if base[1] >= rules.min_chars else None
                if has[i] and n >= rules.min_common_words:
                    mine, last = np.zeros(len(counts)), len(counts) - 1
                    for w, c in Counter(words).items():
                        mine[places.get(w, last)] += c
                    of_words = distance(mine, counts)
                bad = (of_classes or 0) > rules.max_class_distance or (of_words or 0) > rules.max_word_distance
                rows.append((*base, failed, of_classes, of_words, not failed and not bad))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"])

    slim = bound_batches(docs).select(F.col(id_col), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("binary").alias("_text"))
    # Spark chooses the join by the table's size; a frequent language's rows can be split
    known = known.withColumnRenamed("lang", "_of")
    joined = slim.join(known, F.col("_lang") == F.col("_of"), "left").select(*slim.columns, "words", "chars", "common")
    return joined.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean")
