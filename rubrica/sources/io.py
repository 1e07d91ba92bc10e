"""Tables in and out: dataset scans, logs, captions, submissions, results, caches."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEDIA = ("binary", "struct<array:", "array<binary>")


def read_table(spark: SparkSession, path: str, format: str | None = None, schema: str | None = None, split: str | None = None) -> DataFrame:
    """A dataset by its ending (parquet, orc, json, jsonl, csv, tsv); a split is a partition of the folder."""
    kind = format or {".json": "jsondoc", ".jsonl": "json", ".csv": "csv", ".tsv": "tsv", ".orc": "orc"}.get(os.path.splitext(path)[1], "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    match kind:
        case "jsondoc":
            df = reader.option("multiLine", True).json(path)
        case "csv" | "tsv":
            df = reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"').option("multiLine", True).csv(path)
        case _:
            df = reader.format(kind).load(path)
    return df.where(F.col("split") == split) if split and "split" in df.columns else df


def without_media(df: DataFrame) -> DataFrame:
    """Drops binary and audio columns; the scan then doesn't read them."""
    return df.drop(*(n for n, t in df.dtypes if t == "binary" or t.startswith(MEDIA)))


def shaped(df: DataFrame, columns: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """A declared schema: name -> (expression, type)."""
    return df.select(*(c.cast(t).alias(n) for n, (c, t) in columns.items()))


def media_files(spark: SparkSession, paths: Sequence[str], glob: str = "*") -> DataFrame:
    """(path, length) of files under several folders or globs, each once."""
    out = None
    for p in paths:
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(p).select("path", "length")
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates(["path"])


def with_files(docs: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows whose file exists; the file's name without ending is the key."""
    names = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias(key)).distinct()
    return docs.join(names, key, "left_semi")


def captions(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, frame_index, ts, caption) from caption stores {"frames": {k: {...}}}, one file a video."""
    frame = "map<string,struct<frame_index:int,ts:double,caption:string>>"
    raw = spark.read.schema(f"frames {frame}").option("multiLine", True).json(path).withColumn("video_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return raw.select("video_id", F.explode("frames").alias("k", "f")).select("video_id", "f.frame_index", "f.ts", "f.caption")


#: Named character references that page_text() reads; the ampersand comes last. Fixed values.
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"))


def page_text(html: Column) -> Column:
    """All text that a page shows, as one line, inside the JVM: without scripts, styles, head and tags."""
    shown = F.regexp_replace(html, r"(?is)<(script|style|head|noscript|template)\b.*?</(script|style|head|noscript|template)>|<!--.*?-->", " ")
    shown = F.regexp_replace(shown, r"(?s)<[^>]*>", " ")
    for name, sign in _REFERENCES:
        shown = F.replace(shown, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(shown, r"[ \t\r\n]+", " "))


def unpacked(archives: Sequence[str], folder: str) -> list[str]:
    """The files of ZIP and TAR archives, unpacked below a folder all executors see; parts name.tar.partN are joined in order.

    For the driver, before a scan: archives are few, their files are read by
    media_files(). Members that would leave the folder are an error.
    """
    import io as streams
    import itertools
    import re
    import tarfile
    import zipfile

    out: list[str] = []
    key = lambda p: re.sub(r"\.part\d+$", "", p)
    number = lambda p: int(m[1]) if (m := re.search(r"\.part(\d+)$", p)) else 0
    for name, parts in itertools.groupby(sorted(archives, key=lambda p: (key(p), number(p))), key):
        parts = list(parts)
        to = os.path.join(folder, re.sub(r"\.(zip|tar(\.\w+)?|tgz)$", "", os.path.basename(name)))
        os.makedirs(to, exist_ok=True)
        if name.endswith(".zip"):
            with zipfile.ZipFile(parts[0]) as z:
                if any(os.path.isabs(n) or ".." in n.split("/") for n in z.namelist()):
                    raise ValueError(f"{name} has members outside of its folder")
                z.extractall(to)
        else:
            whole = streams.BytesIO(b"".join(open(p, "rb").read() for p in parts)) if len(parts) > 1 else open(parts[0], "rb")
            with whole, tarfile.open(fileobj=whole) as t:
                t.extractall(to, filter="data")
        out += sorted(os.path.join(base, n) for base, _, names in os.walk(to) for n in names)
    return out


def write_vectors(vectors: DataFrame, path: str) -> None:
    """An embedding cache: (key, vector), the newest write of a key wins on reading."""
    vectors.withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)


def cached_vectors(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """The cache's vectors, one for each key."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("written")))
    return spark.read.parquet(path).withColumn("_rn", newest).where("_rn = 1").drop("_rn", "written")


def replayed(logs: DataFrame) -> DataFrame:
    """Responses (task, doc_id, resp) of logged runs (with log_time): the newest log of a document wins."""
    w = Window.partitionBy("task", "doc_id").orderBy(F.desc("log_time"))
    return logs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def parsed_list(c: Column) -> Column:
    """A list written as text, in JSON or with single quotes; null if it is neither."""
    return F.coalesce(F.from_json(c, "array<string>"), F.from_json(F.translate(c, "'", '"'), "array<string>"))


# --- sinks


def write_samples(samples: DataFrame, path: str) -> None:
    """Logged samples as JSON lines: without document and arguments, responses only where filtering changed them, targets as text."""
    df = samples.drop("doc", "arguments")
    if {"resps", "filtered_resps"} <= set(df.columns):
        df = df.withColumn("resps", F.when(F.to_json(F.array("resps")) == F.to_json(F.array("filtered_resps")), None).otherwise(F.col("resps")))
    if "target" in df.columns:
        df = df.withColumn("target", F.col("target").cast("string"))
    df.write.mode("overwrite").json(path)


def write_submission(df: DataFrame, path: str, format: str = "json") -> None:
    """Predictions in one file, as JSON lines, CSV (quotes doubled, as read_table() reads them) or lines of text (of the one column)."""
    writer = df.coalesce(1).write.mode("overwrite")
    match format:
        case "csv":
            writer.option("header", True).option("escape", '"').csv(path)
        case "text":
            writer.text(path)
        case _:
            writer.json(path)


def write_results(results: DataFrame, path: str, config: Mapping | None = None) -> None:
    """Aggregated results, few rows, with the configuration they came from."""
    results.withColumn("config", F.lit(json.dumps(dict(config or {}), sort_keys=True))).coalesce(1).write.mode("overwrite").json(path)


def task_hashes(samples: DataFrame) -> DataFrame:
    """(task, task_hash): one digest of each task's documents, whatever their order or partitions."""
    each = samples.select("task", F.sha2(F.to_json(F.struct("doc_id", "doc")), 256).alias("h"))
    return each.groupBy("task").agg(F.sha2(F.concat_ws(",", F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")), F.count("*")), 256).alias("task_hash"))


def markdown(results: DataFrame) -> str:
    """The results as a Markdown table; collected, one row for each metric."""
    arrows = {True: "↑", False: "↓", None: ""}
    lines = ["| Tasks | Version | Filter | n-shot | Metric | | Value | | Stderr |", "|---|---|---|---|---|---|---|---|---|"]
    for r in results.orderBy("task", "filter_key", "metric").collect():
        d = r.asDict()
        err = d.get("stderr")
        value = "N/A" if d["value"] is None else f"{d['value']:.4f}"
        lines.append(f"| {d['task']} | {d.get('version') or ''} | {d['filter_key']} | {d.get('n_shot') or 0} | {d['metric']} | {arrows[d.get('higher_is_better')]} | {value} | ± | {'N/A' if err is None else f'{err:.4f}'} |")
    return "\n".join(lines)


def sample_table(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """A flat table of samples with a column for each metric."""
    wide = scores.groupBy("task", "doc_id").pivot("metric").agg(F.first("value"))
    return samples.join(wide, ["task", "doc_id"], "left")


# --- caches


def request_key(*columns: Column) -> Column:
    """A digest of a request's attributes and arguments."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def split_by_cache(requests: DataFrame, cache: DataFrame, key: str = "key", sampled: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits with their responses, misses); requests that sample are never hits."""
    usable = requests if sampled is None else requests.where(~sampled)
    hits = usable.join(cache, key)
    misses = usable.join(cache.select(key), key, "left_anti")
    return hits, misses if sampled is None else misses.unionByName(requests.where(sampled))
