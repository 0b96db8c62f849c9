"""Grey histograms of pictures, for cuts between scenes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The weights of red, green and blue in a grey of 16 bits.
GREY = {"red": 19595, "green": 38470, "blue": 7471}
BINS = 256


def grey(data: bytes, channels: int) -> np.ndarray:
    """Grey values of a picture's bytes, which are grey, blue-green-red, or that and opacity."""
    pixels = np.frombuffer(data, np.uint8).reshape(-1, channels)
    if channels == 1:
        return pixels[:, 0]
    blue, green, red = pixels[:, :3].astype(np.uint32).T
    return ((red * GREY["red"] + green * GREY["green"] + blue * GREY["blue"] + 0x8000) >> 16).astype(np.uint8)


def grey_histograms(images: DataFrame) -> DataFrame:
    """``images`` (image, as Spark's image source reads it) as origin, width, height and histogram, the share of pixels for each of
    256 grey values. Pictures of one to four bytes a pixel are read, all else is an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, height, width, channels, data = (c.to_pylist() for c in batch.columns)
            shares = []
            for name, h, w, c, raw in zip(origin, height, width, channels, data, strict=True):
                if c not in (1, 3, 4) or len(raw) != h * w * c:
                    raise ValueError(f"{name}: a picture of {h} x {w} x {c} in {len(raw)} bytes is not read")
                shares.append(np.bincount(grey(raw, c), minlength=BINS) / max(1, h * w))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(shares) + 1) * BINS, pa.int32()), pa.array(np.concatenate(shares) if shares else np.zeros(0)))
            yield pa.RecordBatch.from_pydict({"origin": pa.array(origin, pa.string()), "width": pa.array(width, pa.int32()), "height": pa.array(height, pa.int32()), "histogram": lists})

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, "origin string, width int, height int, histogram array<double>")


def frame_histograms(spark: SparkSession, path: str, fps: float) -> DataFrame:
    """Histograms of the numbered frames of videos, one folder of pictures each: video_id (the folder), frame_number (the last
    digits of the name), timestamp (frames from 1, ``fps`` a second), histogram."""
    read = grey_histograms(spark.read.format("image").load(path))
    number = F.regexp_extract("origin", r"([0-9]+)\.[A-Za-z]+$", 1).try_cast("long")
    return read.select(F.regexp_extract("origin", r"([^/]+)/[^/]+$", 1).alias("video_id"), number.alias("frame_number"), ((number - 1) / F.lit(float(fps))).alias("timestamp"), "histogram")
