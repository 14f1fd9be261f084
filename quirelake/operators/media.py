"""Media: scene logs, keyframes, scenes, content-addressed assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scene_candidates(log: DataFrame, key: str) -> DataFrame:
    """(key, t, score) from log lines (key, line_no, line): a time line, then the score that follows it. A time counts once."""
    t = F.regexp_extract("line", r"pts_time:([0-9.]+)", 1)
    s = F.regexp_extract("line", r"scene_score=([0-9.]+)", 1)
    rows = log.select(key, "line_no", F.when(t != "", t.cast("double")).alias("t"), F.when(s != "", s.cast("double")).alias("score"))
    w = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("at", F.last("t", True).over(w)).withColumn("group", F.count("t").over(w))
    first = rows.where("score is not null and at is not null").groupBy(key, "group", "at").agg(F.min_by("score", "line_no").alias("score"), F.min("line_no").alias("line_no"))
    return first.groupBy(key, F.col("at").alias("t")).agg(F.min_by("score", "line_no").alias("score"))


def bucket_top1(candidates: DataFrame, key: str, frames: int = 24) -> DataFrame:
    """The best candidate of each of ``frames`` equal spans of a video: highest score, then earliest."""
    bucket = F.least(F.lit(frames - 1), F.floor(F.col("t") / F.greatest(F.col("duration") / frames, F.lit(0.001)))).cast("int")
    w = Window.partitionBy(key, "bucket").orderBy(F.desc("score"), "t")
    return candidates.withColumn("bucket", bucket).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def keyframe_select(videos: DataFrame, key: str, frames: int = 24, spacing: float = 2.0) -> DataFrame:
    """(key, t) of keyframes from videos (key, duration, frame_rate, candidates array<struct<t,score>>).

    The start and the last decodable moment are fixed; candidates, best first, follow if they keep
    the spacing to all that were taken. Too many candidates are thinned to the best of each span, and evenly
    spaced moments without a score fill up."""
    dur = F.col("duration")
    tail = F.when(F.col("frame_rate") > 0, F.least(F.greatest(F.lit(0.05), F.lit(1.25) / F.col("frame_rate")), dur / 2)).otherwise(F.least(F.lit(0.05), dur / 100))
    rows = videos.withColumn("end", F.greatest(F.lit(0.0), dur - tail)).withColumn("room", F.when(F.col("end") > 0, frames - 2).otherwise(frames - 1))
    order = lambda xs: F.transform(F.array_sort(F.transform(xs, lambda x: F.struct((-x["score"]).alias("s"), x["t"].alias("t")))), lambda x: x)
    span = lambda t: F.least(F.lit(frames - 1), F.floor(t / F.greatest(dur / frames, F.lit(0.001))).cast("int"))
    ranked = order(F.col("candidates"))
    thin = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda k: F.slice(F.filter(ranked, lambda x: span(x["t"]) == k), 1, 1)))
    chosen = F.when(F.size("candidates") > F.col("room"), thin).otherwise(ranked)
    target = F.least(F.lit(frames), F.greatest(F.lit(3), F.ceil(dur / 10).cast("int") + 2))
    even = F.transform(F.sequence(F.lit(1), target - 2), lambda i: F.struct(F.lit(0.0).alias("s"), (dur * i / (target - 1)).alias("t")))
    everything = F.array_sort(F.concat(chosen, even))
    start = F.when(F.col("end") > 0, F.array(F.lit(0.0), F.col("end"))).otherwise(F.array(F.lit(0.0)))
    clamp = lambda t: F.least(F.col("end"), F.greatest(F.lit(0.0), t))
    most = F.least(F.lit(frames), F.col("room") + 2)
    free = lambda taken, t: F.forall(taken, lambda k: F.abs(t - k) >= spacing)
    picked = F.aggregate(everything, start, lambda taken, x: F.when((F.size(taken) < most) & free(taken, clamp(x["t"])), F.array_append(taken, clamp(x["t"]))).otherwise(taken))
    return rows.withColumn("picked", picked).select(key, F.explode(F.array_sort("picked")).alias("t"))


def keyframe_scenes(frames: DataFrame, key: str) -> DataFrame:
    """Scenes around keyframes (key, ms, duration_ms): bounds are integer midpoints."""
    w = Window.partitionBy(key).orderBy("ms")
    mid = lambda a, b: F.floor((a + b) / 2).cast("long")
    return frames.select(
        key,
        F.row_number().over(w).alias("scene"),
        F.coalesce(mid(F.lag("ms").over(w), F.col("ms")), F.lit(0).cast("long")).alias("start_ms"),
        F.coalesce(mid(F.col("ms"), F.lead("ms").over(w)), F.col("duration_ms")).alias("end_ms"),
    )


def asset_dedup(assets: DataFrame) -> DataFrame:
    """Assets (ord, content, location) by digest: id, first position, and all distinct locations."""
    sha = F.sha2("content", 256)
    return assets.groupBy(sha.alias("sha256")).agg(F.min("ord").alias("first_ord"), F.array_sort(F.collect_set("location")).alias("locations")).withColumn("asset_id", F.concat(F.lit("asset_"), F.left("sha256", F.lit(26))))


def running_bytes(items: DataFrame, key: str, cap: int) -> DataFrame:
    """Total so far in order, and whether it is still within the cap."""
    total = F.sum("size").over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("total", total).withColumn("within", F.col("total") <= cap)
