"""Sound, pictures and named files: written, read back and compared byte by byte."""

from __future__ import annotations

import io
import math
import os
import struct
import wave
import zlib

import numpy as np
import pytest
from framewell.plans import camera
from framewell.sources import sound
from framewell.sources.files import indented, write_files
from framewell.sources.pictures import frame_histograms, grey
from pyspark.sql import functions as F


def wav(values: np.ndarray, rate: int = 8000, channels: int = 1) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes(values.astype("<i2").tobytes())
    return out.getvalue()


def raw_wav(tag: int, bits: int, channels: int, data: bytes, size: int | None = None, extra: bytes = b"") -> bytes:
    form = struct.pack("<HHIIHH", tag, channels, 8000, 8000 * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF\0\0\0\0WAVE" + extra + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(data) if size is None else size) + data


def test_samples_of_several_partitions_give_the_energies_of_the_windows(spark, tmp_path) -> None:
    rng = np.random.default_rng(3)
    values = (rng.normal(0, 3000, 21_345) * np.linspace(0.1, 1, 21_345)).astype(np.int16)
    (tmp_path / "a.wav").write_bytes(wav(values))
    (tmp_path / "b.WAV").write_bytes(wav(np.zeros(100, np.int16)))
    (tmp_path / "notes.txt").write_text("no sound")
    samples = sound.read_wav(spark, str(tmp_path), 7001)
    assert samples.rdd.getNumPartitions() == -(-(44 + 2 * len(values)) // 7001) + 1
    mine = samples.filter("path LIKE '%a.wav'").orderBy("n").collect()
    assert [r.n for r in mine] == list(range(len(values))) and [r.value for r in mine] == values.tolist()
    got = {(r.path[-5:], r.timestamp): r.energy for r in sound.loudness(samples).collect()}
    rms = [math.sqrt(sum(int(v) ** 2 for v in values[i : i + 2000]) / len(values[i : i + 2000])) for i in range(0, len(values), 2000)]
    want = {("a.wav", i * 0.25): r / max(rms) for i, r in enumerate(rms)} | {("b.WAV", 0.0): 0.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    windows = camera.audio_energy(samples.filter("path LIKE '%a.wav'").withColumnRenamed("path", "video_id"), 2000).collect()
    assert {r.window * 0.25: round(r.energy, 9) for r in windows} == {t: round(e, 9) for (p, t), e in got.items() if p == "a.wav"}


def test_kinds_of_sound(spark, tmp_path) -> None:
    whole = [-32768, -256, 0, 256, 32512]
    files = {
        "u8": raw_wav(1, 8, 1, bytes(v // 256 + 128 for v in whole)),
        "i24": raw_wav(1, 24, 1, b"".join((v * 256).to_bytes(3, "little", signed=True) for v in whole)),
        "i32": raw_wav(1, 32, 1, np.array([v * 65536 for v in whole], "<i4").tobytes()),
        "f32": raw_wav(3, 32, 1, np.array([v / 32768 for v in whole], "<f4").tobytes()),
        "f64": raw_wav(3, 64, 1, np.array([v / 32768 for v in whole], "<f8").tobytes(), extra=b"LIST\x03\0\0\0abc\0"),
        "stereo": raw_wav(1, 16, 2, np.array([x for v in whole for x in (v, 0)], "<i2").tobytes()),
        "open": raw_wav(1, 16, 1, np.array(whole, "<i2").tobytes(), size=0xFFFFFFFF),
        "empty": raw_wav(1, 16, 1, b""),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    got: dict = {}
    for r in sound.read_wav(spark, str(tmp_path), 64).collect():
        got.setdefault(os.path.basename(r.path)[:-4], {})[r.n] = r.value
    want = {name: dict(enumerate(whole)) for name in files if name != "empty"} | {"stereo": {i: v / 2 for i, v in enumerate(whole)}}
    assert got == want
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.wav").write_bytes(b"not a sound")
    with pytest.raises(Exception, match="no WAV file"):
        sound.read_wav(spark, str(tmp_path / "bad")).count()
    (tmp_path / "none").mkdir()
    assert sound.read_wav(spark, str(tmp_path / "none")).count() == 0


def png(pixels: np.ndarray) -> bytes:
    """A picture of 8-bit grey (h, w) or red-green-blue (h, w, 3)."""
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[i].astype(np.uint8).tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_cuts_of_written_pictures(spark, tmp_path) -> None:
    rng = np.random.default_rng(1)
    dark, light = rng.integers(0, 90, (12, 16, 3)), rng.integers(160, 256, (12, 16, 3))
    for video, order in (("a", [dark, dark, light, light, dark]), ("b", [light, light])):
        (tmp_path / video).mkdir()
        for i, pixels in enumerate(order, 1):
            (tmp_path / video / f"frame_{i:06d}.png").write_bytes(png(pixels))
    found = frame_histograms(spark, f"{tmp_path}/*", 4.0)
    rows = {(r.video_id, r.frame_number): r for r in found.collect()}
    assert {k: r.timestamp for k, r in rows.items()} == {("a", i): (i - 1) / 4 for i in range(1, 6)} | {("b", 1): 0.0, ("b", 2): 0.25}
    values = (dark[..., 0] * 19595 + dark[..., 1] * 38470 + dark[..., 2] * 7471 + 0x8000) >> 16
    assert rows["a", 1].histogram == (np.bincount(values.ravel(), minlength=256) / values.size).tolist()
    cuts = sorted((r.video_id, r.timestamp, r.confidence) for r in camera.scene_cuts(found).collect())
    assert [c[:2] for c in cuts] == [("a", 0.5), ("a", 1.0)] and all(c[2] == pytest.approx(1.0) for c in cuts)


def test_grey_and_refused_pictures(spark) -> None:
    assert grey(bytes([0, 128, 255]), 1).tolist() == [0, 128, 255]
    assert grey(bytes([255, 0, 0, 9, 255, 255, 255, 9]), 4).tolist() == [29, 255]
    bad = spark.createDataFrame([(1, 0.0, [1.0]), (1, 1.0, [0.5, 0.5])], "video_id long, timestamp double, histogram array<double>")
    with pytest.raises(Exception, match="unequal"):
        camera.scene_cuts(bad).collect()


def tree(root) -> dict:  # noqa: ANN001
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs}


def test_files_have_their_names_and_bytes(spark, tmp_path) -> None:
    rows = [(f"ep{i % 3}/clips/clip{i}.srt", f"1\n00:00:0{i},000\nñ 😀 {i}\n".encode()) for i in range(7)] + [("empty.txt", None)]
    files = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    write_files(files, str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {n: c or b"" for n, c in rows} | {"_SUCCESS": b""}
    with pytest.raises(Exception, match="there already"):
        write_files(files.limit(1), str(tmp_path / "out"))
    write_files(spark.createDataFrame([("empty.txt", "now text"), ("new", "x")], "name string, content string"), str(tmp_path / "out"), overwrite=True)
    got = tree(tmp_path / "out")
    assert (got["empty.txt"], got["new"], len(got)) == (b"now text", b"x", 10)


@pytest.mark.parametrize(("bad", "says"), [("../out", "no name"), ("", "no name"), ("a//b", "no name"), ("/x", "no name"), ("f3", "there twice")])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad: str, says: str) -> None:
    files = spark.createDataFrame([(f"f{i}", "x") for i in range(20)] + [(bad, "y")], "name string, content string")
    with pytest.raises(Exception, match=says):
        write_files(files, str(tmp_path / "out"))
    assert tree(tmp_path) == {}


def test_failing_rows_leave_nothing(spark, tmp_path) -> None:
    files = spark.range(100).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 57, F.raise_error(F.lit("broken row"))).otherwise("x").alias("content"))
    with pytest.raises(Exception, match="broken row"):
        write_files(files, str(tmp_path / "out"))
    assert tree(tmp_path) == {}


def test_indented_json(spark) -> None:
    row = spark.sql("""SELECT to_json(named_struct('a', 1, 'b', array(0.5D, 1e-7D), 'c', named_struct('d', 'é'))) AS j, CAST(NULL AS STRING) AS n""").select(indented(F.col("j")).alias("j"), indented(F.col("n")).alias("n")).first()
    assert row.j == '{\n  "a": 1,\n  "b": [\n    0.5,\n    1e-07\n  ],\n  "c": {\n    "d": "\\u00e9"\n  }\n}' and row.n is None
