"""WARC archives: a gzip member for each record, pages without ids, and what is shuffled."""

from __future__ import annotations

import glob
import gzip
import zlib

import pytest
from framewell.llm import warc

SCHEMA = "page_id long, url string, html string"


def members(raw: bytes) -> list[bytes]:
    out = []
    while raw:
        unpack = zlib.decompressobj(31)
        out.append(unpack.decompress(raw) + unpack.flush())
        assert unpack.eof
        raw = unpack.unused_data
    return out


def test_each_record_is_a_member(spark, tmp_path) -> None:
    long = "\x00é😀 page " * 40
    rows = [(i, f"http://{i}", long if i % 3 else f"{long}{i}") for i in range(50)] + [(None, "http://n", long)] * 5 + [(99, "u", "")]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path / "w"), warc.Warc(archive_mb=1))
    seen = []
    for path in glob.glob(str(tmp_path / "w" / "part-*")):
        raw = open(path, "rb").read()
        parts = members(raw)
        assert parts[1::2] == [b"\r\n\r\n"] * (len(parts) // 2) and all(x.startswith(b"WARC/1.1\r\n") for x in parts[::2])
        assert gzip.decompress(raw) == b"".join(parts)
        seen += parts[::2]
    assert len(seen) == len(rows)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted(-1 if r.page_id is None else r.page_id for r in got) == sorted(-1 if r[0] is None else r[0] for r in rows)
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {1} and sum(r.record_type == "revisit" for r in got) == 33 - 1 + 5
    assert all(bytes(r.payload).decode() == (long if r.page_id % 3 else f"{long}{r.page_id}" if r.page_id != 99 else "") for r in got if r.record_type == "response")


def test_unpacking_members_of_any_size() -> None:
    parts = [b"", b"a", b"b" * 100_000, bytes(range(256)) * 300, b"\r\n\r\n"] * 3
    raw = b"".join(warc.member(x) for x in parts)
    assert bytes(warc.unpacked(memoryview(raw))) == b"".join(parts)
    with pytest.raises(ValueError, match="within a member"):
        warc.unpacked(memoryview(raw[:-3]))


def test_small_archives(spark, tmp_path) -> None:
    rows = [(i, "u", "x" * 5000) for i in range(1000)]
    warc.write_archives(spark.createDataFrame([(i, u, f"{i}{t}") for i, u, t in rows], SCHEMA).coalesce(1), str(tmp_path / "w"), warc.Warc(archive_mb=1))
    sizes = [len(gzip.decompress(open(p, "rb").read())) for p in glob.glob(str(tmp_path / "w" / "part-*"))]
    assert len(sizes) >= 5 and max(sizes) < 1.3 * (1 << 20)


def test_only_pages_without_ids_are_all_responses(spark, tmp_path) -> None:
    warc.write_archives(spark.createDataFrame([(None, "u", "y" * 200)] * 3, SCHEMA), str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(None, "response", None)] * 3


def test_archives_of_one_member_and_plain_ones_are_read(spark, tmp_path) -> None:
    warc.write_archives(spark.createDataFrame([(1, "u", "some page"), (2, "v", "other")], SCHEMA).coalesce(1), str(tmp_path / "w"))
    whole = b"".join(gzip.decompress(open(p, "rb").read()) for p in sorted(glob.glob(str(tmp_path / "w" / "part-*"))))
    for name, raw in (("one", gzip.compress(whole)), ("plain", whole)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(raw)
        assert sorted((r.page_id, bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path / name)).collect()) == [(1, b"some page"), (2, b"other")]
