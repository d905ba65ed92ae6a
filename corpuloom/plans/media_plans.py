"""What each media encoder reads: windows, frame times and their batches, as rows.

Plans need only metadata, so they are columns; what decodes the media is a
registered encoder (see encoders.py) that takes a plan's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import midpoints, sampled, uniform_times, windows

# Encoders by kind, with what they plan.  windows: seconds and overlap; frames: how many at most (or a
# second), how many a message, how many a mosaic.
PLANS: dict[str, dict] = {
    "image/resize": {"box": 1024},
    "image/tile": {"tile": 512},
    "audio/native": {"window": 120, "overlap": 10},
    "audio/transcribe": {"speed": 2.0, "final": True},
    "audio/gemini-native": {},
    "document/page-text": {"pages": 4, "final": True},
    "document/rasterize": {"pages": 4},
    "document/rasterize-text": {"pages": 4},
    "document/gemini-native": {},
    "video/mosaic": {"frames": 128, "mosaic": 16},
    "video/frames": {"per_second": 1.0, "message": 16},
    "video/keyframes": {"per_second": 1.0, "message": 16},
    "video/shots": {"per_shot": 8},
    "video/shot-mosaic": {"per_shot": 16},
    "video/chunked": {"window": 60, "overlap": 5, "frames": 16},
    "video/clips": {"window": 120, "overlap": 10},
    "video/summary": {"frames": 12},
    "video/transcript": {"final": True},
    "video/captions": {"final": True},
    "video/native": {},
    "video/gemini-native": {},
    "video/gemini-chunked": {"window": 120, "overlap": 10},
}
#: Video encoders that also come with a transcript.
WITH_TRANSCRIPT = ("mosaic", "frames", "keyframes", "shots", "shot-mosaic", "clips", "summary")
PLANS |= {f"video/{x}-w-transcript": PLANS[f"video/{x}"] | {"transcript": True} for x in WITH_TRANSCRIPT}


def encoder_table(spark) -> DataFrame:
    """kind, name, transcript and final of every encoder."""
    rows = [(*k.split("/"), bool(v.get("transcript")), bool(v.get("final"))) for k, v in sorted(PLANS.items())]
    return spark.createDataFrame(rows, "kind string, name string, transcript boolean, final boolean")


def window_rows(files: DataFrame, encoder: str, duration: str = "duration_s") -> DataFrame:
    """uri, message, start, end of each window; files without a duration give none."""
    plan = PLANS[encoder]
    spans = windows(F.col(duration), plan["window"], plan["overlap"])
    return files.where(F.col(duration).isNotNull()).select("uri", F.posexplode(spans).alias("message", "w")).select("uri", "message", "w.start", "w.end")


def frame_times(duration: Column, encoder: str, scenes: Column | None = None) -> Column:
    """The times of the frames that an encoder takes: as many in each shot, scene midpoints where scenes are known, or else uniform.

    Without scenes the whole is one shot.
    """
    plan = PLANS[encoder]
    if "per_second" in plan:
        step = 1.0 / plan["per_second"]
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(duration / step) - 1).cast("int")), lambda i: i * F.lit(step))
    if "per_shot" in plan:
        n, whole = plan["per_shot"], F.array(F.struct(F.lit(0.0).alias("start"), duration.cast("double").alias("end")))
        shots = whole if scenes is None else F.when(F.size(scenes) > 0, scenes).otherwise(whole)
        return F.flatten(F.transform(shots, lambda s: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: s["start"] + (s["end"] - s["start"]) * (i + 0.5) / n)))
    uniform = uniform_times(duration, plan["frames"])
    if scenes is None:
        return uniform
    return F.when(F.size(scenes) > 1, sampled(midpoints(scenes), plan["frames"])).otherwise(uniform)


def frame_rows(files: DataFrame, encoder: str, duration: str = "duration_s", scenes: str | None = None) -> DataFrame:
    """uri, message, part, time of each frame, in batches of a message or a mosaic."""
    plan = PLANS[encoder]
    size = plan.get("message") or plan.get("mosaic") or plan.get("per_shot") or plan["frames"]
    times = frame_times(F.col(duration), encoder, F.col(scenes) if scenes else None)
    rows = files.where(F.col(duration) > 0).select("uri", F.posexplode(times).alias("n", "time"))
    return rows.select("uri", F.floor(F.col("n") / size).cast("int").alias("message"), (F.col("n") % size).alias("part"), "time")


def tile_rows(files: DataFrame, tile: int = 512) -> DataFrame:
    """uri, part, left, top, right, bottom: an overview (part 0), then crops row by row; one tile is the overview alone."""
    across, down = F.ceil(F.col("width") / tile).cast("int"), F.ceil(F.col("height") / tile).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.col("width").alias("right"), F.col("height").alias("bottom")))
    crops = F.flatten(
        F.transform(
            F.sequence(F.lit(0), down - 1),
            lambda y: F.transform(F.sequence(F.lit(0), across - 1), lambda x: F.struct((x * tile).alias("left"), (y * tile).alias("top"), F.least((x + 1) * tile, F.col("width")).alias("right"), F.least((y + 1) * tile, F.col("height")).alias("bottom"))),
        )
    )
    boxes = F.when(across * down > 1, F.concat(whole, crops)).otherwise(whole)
    return files.where("width > 0 AND height > 0").select("uri", F.posexplode(boxes).alias("part", "box")).select("uri", "part", "box.*")


def page_rows(files: DataFrame, encoder: str, pages: str = "pages") -> DataFrame:
    """uri, message, first_page, last_page of each batch of pages."""
    size = PLANS[encoder]["pages"]
    starts = F.sequence(F.lit(0), F.ceil(F.col(pages) / size).cast("int") - 1)
    rows = files.where(F.col(pages) > 0).select("uri", F.col(pages).alias("_n"), F.explode(starts).alias("message"))
    return rows.select("uri", "message", (F.col("message") * size + 1).alias("first_page"), F.least((F.col("message") + 1) * size, F.col("_n")).alias("last_page"))


def fitted(width: Column, height: Column, box: int = 1024) -> tuple[Column, Column]:
    """Width and height scaled down to fit in a square, never up."""
    scale = F.least(F.lit(1.0), F.lit(float(box)) / F.greatest(width, height))
    return F.greatest(F.lit(1), F.round(width * scale)).cast("int"), F.greatest(F.lit(1), F.round(height * scale)).cast("int")


def transcript(segments: Column, speed: Column | float = 1.0) -> Column:
    """Lines [12.0s - 15.5s] text of segments that were transcribed at a speed."""
    factor = F.lit(float(speed)) if isinstance(speed, (int, float)) else speed
    return F.array_join(F.transform(segments, lambda s: F.concat(F.format_string("[%.1fs - %.1fs] ", s["start"] * factor, s["end"] * factor), s["text"])), "\n")
