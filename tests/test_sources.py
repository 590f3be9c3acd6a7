"""Paged sources and downloads with clients that read from dictionaries."""

import hashlib
import json
import sys

import pytest
from pyspark import cloudpickle

from canvass.sources import downloads, paged
from canvass.sources.paged import Response

# Workers don't know this module; what it defines goes to them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def records(n, stamp=lambda i: f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z"):
    return [{"id": f"c{i}", "attributes": {"lastModifiedDate": stamp(i)}} for i in range(n)]


def regulations(rows):
    """Serves rows from a cursor on, in the source's time, in pages."""
    def client(path, params):
        since = params.get("filter[lastModifiedDate][ge]", "")
        left = [r for r in rows if paged.eastern(r["attributes"]["lastModifiedDate"]) >= since]
        size, page = params["page[size]"], params["page[number]"]
        some = left[(page - 1) * size : page * size]
        return Response(200, {"data": some, "meta": {"hasNextPage": page * size < len(left)}})

    return client


def test_windows_follow_each_other_until_all_is_read():
    rows = records(150)
    got = [r["id"] for r in paged.regulations_records(regulations(rows), "D", page_size=3)]
    assert sorted(set(got), key=lambda x: int(x[1:])) == [r["id"] for r in rows] and len(got) > 150
    assert [r["id"] for r in paged.regulations_records(regulations([]), "D")] == []


def test_a_cursor_that_does_not_move_is_an_error():
    with pytest.raises(paged.StalledCursor):
        list(paged.regulations_records(regulations(records(100, lambda i: "2024-01-01T00:00:00Z")), "D", page_size=3))


def test_eastern_time():
    assert paged.eastern("2024-07-01T12:00:00Z") == "2024-07-01 08:00:00" and paged.eastern("2024-01-01T02:00:00+00:00") == "2023-12-31 21:00:00"
    assert paged.eastern("odd") == "odd"


def ecfs(n, text=False):
    def client(path, params):
        if text and params["offset"] > 0:
            return Response(200, "Result window is too large", {"content-type": "text/plain"})
        rows = [{"id_submission": str(i)} for i in range(n)]
        return Response(200, {"filing": rows[params["offset"] : params["offset"] + params["limit"]], "q": params.get("q")})

    return client


def test_filings_by_offset():
    assert len(list(paged.ecfs_filings(ecfs(501), "D"))) == 501 and len(list(paged.ecfs_filings(ecfs(500), "D"))) == 500
    with pytest.raises(paged.OffsetCeiling, match="beyond"):
        list(paged.ecfs_filings(ecfs(10_500), "D"))
    with pytest.raises(paged.OffsetCeiling, match="text"):
        list(paged.ecfs_filings(ecfs(600, text=True), "D"))


def test_errors_are_tried_again_with_growing_waits():
    waits, left = [], [500, 429, 503, 200]
    client = lambda path, params: Response(left.pop(0), {"ok": 1})
    assert paged.fetched(client, "/x", {}, waits.append).body == {"ok": 1} and waits == [2.0, 4.0, 8.0]
    with pytest.raises(paged.Unavailable, match="404"):
        paged.fetched(lambda p, q: Response(404, None), "/x", {}, waits.append)
    waits.clear()
    with pytest.raises(paged.Unavailable, match="500"):
        paged.fetched(lambda p, q: Response(500, None), "/x", {}, waits.append)
    assert waits == [2.0, 4.0, 8.0, 16.0]


def test_dockets_and_details_on_executors(spark):
    both = lambda path, params: regulations(records(30))(path, params) if path == "/comments" else ecfs(300)(path, params)
    dockets = spark.createDataFrame([("A", "regulations_gov"), ("B", "ecfs")], "docket_id string, source string")
    found = paged.read_dockets(dockets, both).collect()
    assert {d: sum(r.docket_id == d for r in found) for d in "AB"} == {"A": 30, "B": 300} and json.loads(found[0].json)
    detail = lambda path, params: Response(404, None) if path.endswith("bad") else Response(200, {"data": {"id": path.split("/")[-1]}})
    comments = spark.createDataFrame([("x", "A"), ("bad", "A"), ("x", "A"), (None, "A")], "comment_id string, docket_id string")
    got = {r.comment_id: (r.enrichment_status, r.raw_detail_json) for r in paged.fetch_details(comments, detail, lambda s: None).collect()}
    assert got == {"x": ("enriched", json.dumps({"data": {"id": "x"}})), "bad": ("failed", None)}


def test_downloads(spark, tmp_path):
    body = b"abc" * 1000

    def opener(url):
        return {"ok": (3000, [body[:1000], body[1000:]]), "short": (9, [b"abc"]), "long": (None, [b"x" * (1 << 20)] * 2), "huge": (1 << 40, [])}[url]

    given = [("a/../1", "ok", "PDF"), ("2", "short", "txt"), ("3", "long", "txt"), ("4", "huge", "txt"), ("5", "ok", "exe"), ("6", None, "pdf"), ("7", "none", "pdf")]
    files = spark.createDataFrame([(a, "c", "D", u, f) for a, u, f in given], "attachment_id string, comment_id string, docket_id string, file_url string, format string")
    go = lambda **k: {r.attachment_id: r for r in downloads.fetch_attachments(files, str(tmp_path), opener, max_mb=1, **k).collect()}
    got = go()
    assert {k: r.download_status for k, r in got.items()} == {"a/../1": "downloaded", "2": "failed", "3": "failed", "4": "skipped", "5": "skipped", "6": "failed", "7": "failed"}
    one = got["a/../1"]
    assert one.checksum_sha256 == hashlib.sha256(body).hexdigest() and one.size_bytes_actual == 3000 and one.local_path == str(tmp_path / "D" / "c" / "a1.pdf")
    assert [p.name for p in tmp_path.rglob("*") if p.is_file()] == ["a1.pdf"]  # no parts are left
    (tmp_path / "D" / "c" / "a1.pdf").write_bytes(b"cached")
    assert go()["a/../1"].size_bytes_actual == 6 and go(force=True)["a/../1"].size_bytes_actual == 3000
