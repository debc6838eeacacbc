import base64
import hashlib
import random
import struct

import pytest

from lamina.llm import warc
from lamina.llm.common import new_path

PAGES = "page_id bigint, url string, html string"


def written(spark, rows, payload=True, **kw):
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), path, **kw)
    return path, {(r.page_id, r.url): r for r in warc.read_archives(spark, path, payload).collect()}


def test_round_trip_with_nulls_repeats_and_odd_texts(spark):
    rows = [(1, "u", "<a>"), (2, None, "<a>"), (3, "x\ny", None), (None, "z", "<a>"), (-4, "z", ""), (5, "long", "é" * 300_000), (6, "r", "\r\n\r\nWARC/1.1\x00\U0001f600")]
    _, got = written(spark, rows)
    assert len(got) == len(rows)
    for page, url, html in rows:
        r = got[page, url and url.replace("\n", "%0A")]
        data = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        if r.record_type == "response":
            assert bytes(r.payload) == data and r.refers_to is None
    assert got[1, "u"].record_type == got[-4, "z"].record_type == "response"
    assert (got[2, None].refers_to, got[None, "z"].refers_to, got[3, "x%0Ay"].refers_to) == (1, 1, -4)


def test_small_payloads_can_be_left_alone(spark):
    _, got = written(spark, [(1, "a", "x"), (2, "b", "x"), (3, "c", "long one"), (4, "d", "long one")], min_bytes=5)
    assert [got[k].record_type for k in ((1, "a"), (2, "b"), (3, "c"), (4, "d"))] == ["response", "response", "response", "revisit"]


def test_repeated_rows_and_empty_table(spark):
    path, _ = written(spark, [(1, "a", "x"), (1, "a", "x"), (2, "a", "x")])
    assert sorted((r.page_id, r.record_type) for r in warc.read_archives(spark, path).collect()) == [(1, "response"), (1, "response"), (2, "revisit")]
    assert written(spark, [])[1] == {}


def test_dictionary_leads_the_archive():
    data = [warc.record(i, f"http://x/{i}", f"<html><body>page {i} {'shared words ' * 200}</body></html>".encode(), hashlib.sha1(b"").hexdigest(), None, True) + bytes([i % 251]) * 3000 for i in range(2000)]
    frames = list(warc.frames(iter(data)))
    magic, size = struct.unpack_from("<II", frames[0])
    assert magic == warc.DICT_MAGIC and size == len(frames[0]) - 8 and len(frames) == len(data) + 1
    joined = warc.SEPARATOR.encode().join(frames) + warc.SEPARATOR.encode()
    assert list(warc.records(joined)) == data


@pytest.mark.parametrize("long, short", [(5, 2000), (12, 0), (0, 40), (1, 7), (1, 0), (0, 1), (0, 3)])
def test_dictionary_of_long_or_few_records(long, short):
    rng = random.Random(3)
    data = [" ".join(f"word{rng.randrange(3000)}" for _ in range(n)).encode() for n in [200_000] * long + [400] * short]
    frames = list(warc.frames(iter(data)))
    assert struct.unpack_from("<I", frames[0])[0] == warc.DICT_MAGIC and len(frames) == len(data) + 1
    assert list(warc.records(warc.SEPARATOR.encode().join(frames))) == data


@pytest.mark.parametrize("most_bytes, most_rows", [(1 << 26, 10), (20_000, 1 << 14)])
def test_archives_are_bounded(spark, tmp_path, most_bytes, most_rows):
    rng = random.Random(4)
    rows = [(i, f"http://x/{i}", " ".join(f"w{rng.randrange(10**6)}" for _ in range(400 if most_rows == 10 else 20_000))) for i in range(120)]
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), path, 0, most_bytes, most_rows)
    files = [f.read_bytes() for f in sorted((tmp_path / "warc").glob("part-*"))]
    assert len(files) >= (8 if most_rows == 10 else 4)
    for data in files:
        assert struct.unpack_from("<I", data)[0] == warc.DICT_MAGIC
        every = list(warc.records(data))
        assert b"warcinfo" in every[0] and len(every) <= most_rows - 1
        assert most_rows == 10 or len(data) < most_bytes + warc.SAMPLE_BYTES + 8 * most_rows
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path, True).collect()}
    assert got == {i: h for i, _, h in rows}


def test_damage_is_found():
    frame = b"".join(warc.frames(iter([b"one record"])))
    with pytest.raises(ValueError, match="no frame"):
        list(warc.records(frame + b"damaged!"))


@pytest.mark.parametrize("page", [None, 0, 1, -1, 2**63 - 1, -(2**63)])
def test_record_ids(page):
    assert warc.page_of(warc.record_id(page)) == page
