"""Top-k search, archives, url filter, the pipeline and the registered queries."""

import base64
import hashlib
import random

import pytest
from llm_data import EDGE
from pyspark.sql import functions as F

import corpus_pipeline
from compare import compare, duck
from hearthbook.llm import queries as registered
from hearthbook.llm import topk, url_filters, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registered.ORACLE))
def test_registered_query(spark, name):
    assert compare(spark, duck(SF), SF, name, registered.QUERIES[name], registered.ORACLE[name]) is None


def best(rows, k):
    out = []
    for a, (i, ask, v) in enumerate(rows):
        if not ask or v is None:
            continue
        others = [(-min(max(sum(x * y for x, y in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), j) for b, (j, _, w) in enumerate(rows) if b != a and w is not None and len(w) == len(v)]
        others = sorted(others, key=lambda t: (t[0], t[1] is None, t[1] or 0))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(others, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("annulus,ring,chunk", [(8192, 1024, 8192), (16, 4, 3)])
def test_topk(spark, monkeypatch, annulus, ring, chunk):
    for name, value in (("ANNULUS", annulus), ("RING", ring), ("QUERIES", chunk)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(7)
    centre = [[rng.gauss(0, 60) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(300):
        c = centre[i % 5]
        rows.append((i, i % 20 == 0, [int(x + rng.gauss(0, 6)) for x in c]))
    rows += [(500 + i, i == 3, rows[0][2]) for i in range(60)]  # a hot vector
    rows += [(700, True, None), (701, True, [3, 4]), (701, True, [3, 4]), (702, False, [1, 1]), (None, False, [9, 9]), (703, True, [2**40, -(2**41), 5])]
    rows += [(704, True, [0] * 6), (705, False, [2**40 + 1, 3, 2**42 - 1]), (706, True, [1])]
    frame = spark.createDataFrame(rows, "id long, is_query boolean, vector array<long>").repartition(5)
    got = topk.search(frame, 4, pivots=7).select("query_id", "rank", "id", "score").collect()
    assert sorted(map(tuple, got), key=str) == best(rows, 4)


def test_topk_of_nothing(spark):
    none = spark.createDataFrame([], "id long, is_query boolean, vector array<long>")
    assert topk.search(none, 3).count() == 0


def test_quantised(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([0.5, -0.001],), ([nan, 1.0],), ([inf],), ([None, 1.0],), (None,), ([],)]
    out = spark.createDataFrame(rows, "v array<float>").select(topk.quantised(F.col("v"))).collect()
    assert [r[0] for r in out] == [[128, -1], None, None, None, None, None]


PAGES = [
    (1, "http://a.com/x", "same"), (2, "http://b.com/é \r\n", "same"), (5, None, "same"), (5, "http://c", "same"),
    (6, "u", None), (7, "u", ""), (None, "n", "same"), (8, "v", "ü" * 300_000), (9, "w", "WARC/1.1\r\n\r\nContent-Length: 7"),
    (10, "x", "alone"), (10, "x", "alone"),
]


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_archive_round_trip(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(warc, "FRAME_BYTES", 400)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 600)
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    folder = f"file://{tmp_path}/archive"
    index = warc.write(pages, folder, "2024-01-01T00:00:00Z", least_bytes=least)
    got = []
    for r in warc.read(index, folder).collect():
        page, to = warc.page_of(r["record_id"]), r["refers_to"] and warc.page_of(r["refers_to"])
        got.append((page, r["payload_bytes"], r["payload_digest"], r["record_type"], to))
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        largest = max(same, default=None) if len(body) >= least else i
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        is_copy = largest != i
        want.append((None if i is None else str(i), len(body), digest, "revisit" if is_copy else "response", str(largest) if is_copy else None))
    assert sorted(map(str, got)) == sorted(map(str, want))
    ids = [r["record_id"] for r in index.collect()]
    assert len(ids) == len(set(ids)) == len(PAGES)
    found = {r["record_id"]: r for r in warc.fetch(index.where("record_id like '%:8:%'"), folder).collect()}
    assert [bytes(r["payload"]).decode() for r in found.values()] == ["ü" * 300_000]
    files = [p for p in (tmp_path / "archive").iterdir() if p.name.endswith(".zst")]
    import zstandard

    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(p.open("rb"), read_across_frames=True).read() for p in files)
    assert whole.count(b"WARC-Record-ID: ") == len(PAGES)


def test_archive_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write(none, f"file://{tmp_path}/archive", "2024-01-01T00:00:00Z")
    assert index.count() == 0 and warc.read(index, f"file://{tmp_path}/archive").count() == 0


def test_url_aliases(spark):
    link = '<head><link rel="canonical" href="{}"></head>'
    fresh = "<META content='3; URL={}' HTTP-EQUIV=refresh>"
    pages = [
        (1, "http://x.org/1", link.format("http://www.example.com/en/1")),  # allowed by its alias
        (2, "http://x.org/2", link.format("http://shop.example.com/en/2")),  # blocked by its alias
        (3, "http://x.org/3", "<meta http-equiv=\"refresh\" content=\"0;url=http://x.org/2\">"),  # through 2
        (4, "http://a.net/es/4", link.format("http://x.org/1")),  # its own rule stays
        (5, "http://y.org/5", link.format("http://a.net/es/4")),  # an allow in the component goes first
        (6, None, link.format("http://a.net/es/4")), (7, "no scheme", None), (8, "HTTP://U@Q.NET:80?x=/es/", ""),
        (9, "http://x.org/3", None), (9, "http://x.org/3", None), (10, "http://com", ""), (11, "http://z.org/", link.format("/relative")),
    ]
    frame = spark.createDataFrame([(*p, "r", "v") for p in pages], "page_id long, url string, html string, rule string, verdict string")
    out = url_filters.judge(frame, registered.URL_RULES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == len(pages)
    assert [got[i][3] for i in range(1, 12)] == ["allow", "block", "block", "block", "allow", "allow", "allow", "allow", "block", "allow", "allow"]
    assert got[4][2] == "net/es/" and got[6][:3] == ("", "", None) and got[8][:2] == ("u@q.net:80", "") and got[10][:3] == ("com", "", None)
    assert url_filters.judge(frame.limit(0), registered.URL_RULES).count() == 0
    assert fresh  # attributes in any order
    other = spark.createDataFrame([(1, "http://q.org/", fresh.format("http://b.net/fr/1"))], "page_id long, url string, html string")
    assert url_filters.judge(other, registered.URL_RULES).first()["verdict"] in ("allow", "block")
    extra = spark.createDataFrame([("http://q.org/", "http://b.net/fr/1"), (None, "x"), ("x", None)], "src string, dst string")
    assert url_filters.judge(other, registered.URL_RULES, extra).first()["verdict"] == "block"


def test_all_links_of_a_page_are_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    fresh = ("<META content='3; URL={}' HTTP-EQUIV=refresh>", '<meta http-equiv="refresh" content="0;url={}">')
    a, b = "http://b.net/fr/1", "http://o.org/2"
    pages = [
        (1, "http://x.org/1", link.format("/relative") + link.format(b) + link.format(a)),
        (2, "http://x.org/2", fresh[0].format("/relative") + fresh[1].format("http://o.org/3") + fresh[0].format(a)),
        (3, b, ""), (4, "http://o.org/3", None), (5, "http://x.org/5", link.format("/relative") + fresh[1].format(a)),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    edges = {tuple(r) for r in url_filters.alias_edges(frame).collect()}
    assert edges == {(pages[0][1], a), (pages[0][1], b), (pages[1][1], a), (pages[1][1], "http://o.org/3"), (pages[4][1], a)}
    out = url_filters.judge(frame, registered.URL_RULES).collect()
    assert {r["page_id"]: r["verdict"] for r in out} == dict.fromkeys(range(1, 6), "block")


def test_pipeline(spark, tmp_path):
    """Planted cases go; clean documents stay whole."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)
    assert set(base.columns) <= set(out.columns)
    assert all(r["decoded"] == r["text"] and r["n_chars"] == len(r["text"]) for r in rows)
    text = {r["doc_id"]: r["text"] for r in base.collect()}
    copies = base.groupBy("text").count().where("count > 1").select("text").collect()
    kept = {r["doc_id"] for r in rows}
    for (t,) in [(r["text"],) for r in copies]:
        assert sum(1 for i in kept if text[i] == t) <= 1


def test_pipeline_stages_take_edges(spark, edge, empty):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, empty.select(*docs.columns)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert set(docs.columns) <= set(out.columns), name
            assert out.count() <= len(EDGE)
