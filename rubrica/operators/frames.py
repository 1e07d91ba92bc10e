"""Frame search and live benchmarks as staged tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubrica.functions import timeline
from rubrica.functions.geometry import cosine
from rubrica.operators.selection import positions, top_per_group


def caption_similarity(frames: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The k frames of each video whose caption vectors are nearest to its question's, ties by frame."""
    scored = frames.join(questions.select("video_id", F.col("embedding").alias("_q")), "video_id").withColumn("score", cosine(F.col("embedding"), F.col("_q"))).drop("_q")
    return top_per_group(scored, k, ["video_id"], [F.desc("score"), F.col("frame_index")])


def resumed(inputs: DataFrame, done: DataFrame, on: Sequence[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage's table: what is done, and the stage over what isn't."""
    return done.unionByName(stage(inputs.join(done.select(*on), list(on), "left_anti")))


def selected_frames(scores: DataFrame, k: int, fps: Column) -> DataFrame:
    """(video_id, indices, frame_time): the k best frames in time order, with their times as text."""
    best = top_per_group(scores.withColumn("_fps", fps), max(1, k), ["video_id"], [F.desc("score"), F.col("frame_index")])
    g = best.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("frame_index", "_fps"))).alias("f"))
    return g.select("video_id", F.col("f.frame_index").alias("indices"), F.array_join(F.transform("f", lambda x: F.format_string("%.2fs", (x["frame_index"] / x["_fps"]).cast("double"))), ",").alias("frame_time"))


def known_info(bullets: DataFrame) -> DataFrame:
    """Running state of topics (video_id, window, pos, bullet, start, end): merged intervals and phases, counts, last window, as of each row.

    A topic's bullets are taken in order, by one task.
    """
    keyed = bullets.withColumn("topic", timeline.topic_key(F.col("bullet"))).where("topic <> ''").withColumn("a", timeline.anchors(F.col("bullet"), F.col("start"), F.col("end")))
    w = Window.partitionBy("video_id", "topic").orderBy("window", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = {"t_start": F.min("a.t_start"), "t_end": F.max("a.t_end"), "p_min": F.min("a.p_min"), "p_max": F.max("a.p_max"), "seen": F.count("*")}
    return keyed.select("video_id", "window", "pos", "topic", *(c.over(w).alias(k) for k, c in merged.items()))


def known_summary(state: DataFrame, items: int = 6) -> DataFrame:
    """The topics of each video seen last and most often, with their anchor as text."""
    newest = state.withColumn("_rn", F.row_number().over(Window.partitionBy("video_id", "topic").orderBy(F.desc("window"), F.desc("pos")))).where("_rn = 1")
    top = top_per_group(newest, items, ["video_id"], [F.desc("window"), F.desc("seen"), F.col("topic")])
    point = F.abs(F.col("t_end") - F.col("t_start")) < 1e-3
    anchor = F.when(point, F.format_string("[t=%.2f s]", "t_start")).otherwise(F.format_string("[t=%.2f→%.2f s]", "t_start", "t_end"))
    return top.select("video_id", "rank", "topic", anchor.alias("anchor"))


def with_new_ids(rows: DataFrame, table: DataFrame, order: Sequence[str], id_col: str = "id") -> DataFrame:
    """Rows numbered on from the table's largest id, in order; no task holds all rows."""
    # broadcast: one row
    last = table.agg(F.coalesce(F.max(id_col), F.lit(-1)).cast("long").alias("_last"))
    return positions(rows, order).join(F.broadcast(last)).withColumn(id_col, F.col("_last") + 1 + F.col("_pos")).drop("_pos", "_size", "_last")


def live_benchmark(pages: DataFrame, table: DataFrame, generate: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame], threshold: float = 5.0, per_subtask: int = 50) -> DataFrame:
    """The table with new items of captured pages.

    ``generate`` makes (url, subtask, question, answer) of pages that no item
    is from, ``check`` adds a score; what passes is numbered on from the table.
    """
    fresh = pages.join(table.select("url").distinct(), "url", "left_anti")
    scored = check(generate(fresh))
    numbered = with_new_ids(scored, table, ["url", "subtask", "question"])
    good = quality_checked(numbered, threshold, per_subtask)
    return table.unionByName(good.select(*table.columns))


def quality_checked(items: DataFrame, threshold: float = 5.0, per_subtask: int = 50, dropped: Sequence[str] = ()) -> DataFrame:
    """Items scored above the threshold, without dropped subtasks, the best of each subtask."""
    good = items.where((F.col("score") > threshold) & ~F.col("subtask").isin(list(dropped)))
    return top_per_group(good, per_subtask, ["subtask"], [F.desc("score"), F.col("id")]).drop("rank")
