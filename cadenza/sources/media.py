"""Which frames of a video a sampled decode reads, as DataFrame arithmetic.

Decoding, optical flow and detection belong to a vision library and are not part of this one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_RATE = 6.0
MAX_FRAMES = 96
DEFAULT_FPS = 25.0
LEAST_FRAMES = 12


def sampling(total: Column, fps: Column, rate: float = SAMPLE_RATE, most: int = MAX_FRAMES) -> dict[str, Column]:
    """Duration, target number and stride of a video's sampled frames."""
    speed = F.when(fps > 0, fps).otherwise(DEFAULT_FPS)
    duration = total / speed
    wanted = F.floor(F.greatest(duration, F.lit(1.0)) * rate)
    target = F.greatest(F.lit(LEAST_FRAMES), F.least(F.lit(most), wanted)).cast("int")
    return {"duration": duration, "target": target, "stride": F.greatest(F.lit(1), F.floor(total / target)).cast("int")}


def sampled_indices(df: DataFrame, total: str, fps: str, rate: float = SAMPLE_RATE, most: int = MAX_FRAMES) -> DataFrame:
    """A row per sampled frame: seq, frame_idx, ts; at most ``most`` of a video."""
    s = sampling(F.col(total).cast("double"), F.col(fps).cast("double"), rate, most)
    rows = df.withColumn("stride", s["stride"]).where(F.col(total) > 0)
    indices = F.slice(F.sequence(F.lit(0), (F.col(total) - 1).cast("int"), F.col("stride")), 1, most)
    rows = rows.select("*", F.posexplode(indices).alias("seq", "frame_idx"))
    return rows.withColumn("ts", F.col("frame_idx") / F.when(F.col(fps) > 0, F.col(fps)).otherwise(DEFAULT_FPS))
