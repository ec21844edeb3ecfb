"""Other programs' stores: pages, pushed filters, resumed streams, coercion; over files and over HTTP."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from memoglyph.sources import external as E
from memoglyph.sources.commits import Store, follow

ITEMS = [
    {"id": 1, "title": " A  title ", "content": "", "narrative": "told  so", "project": "p1", "type": "Decision", "created_at": "2024-01-01", "facts": ["x", 2, None, {"k": 1}], "memory_session_id": "s1", "subtitle": "sub"},
    {"id": "b", "content": "some\ncontent", "project": "home", "type": "note", "t": "2024-01-02", "facts": ' ["y", "z"] ', "session": "s2"},
    {"id": "c", "title": "only a title", "project": "p2", "facts": " plain, text ", "concepts": '"quoted"'},
    {"id": "  ", "title": "no id", "project": "p1"},
    {"title": "null id", "project": "p1"},
    {"id": "f", "project": None, "type": "workflow-rule", "facts": "[1, broken", "concepts": "7"},
]


def pages(folder, number, items, done=True):
    d = folder / f"{number:012d}"
    d.mkdir(parents=True)
    for i, item in enumerate(items):
        (d / f"part-{i:05d}").write_text((item if isinstance(item, str) else json.dumps(item)) + "\n")
    if done:
        (d / "_SUCCESS").touch()


def load(spark, path, **options):
    E.register(spark)
    return spark.read.format(E.FORMAT).options(path=str(path), **options).load()


def test_records(spark, tmp_path):
    pages(tmp_path, 1, [*ITEMS, "not json", "[1]", ""])
    got = {r["id"]: r.asDict(recursive=True) for r in E.structured(load(spark, tmp_path), "notes", "notes-db", home="home").collect()}
    assert sorted(got) == ["1", "b", "c", "f"]
    a, b, c, f = (got[k] for k in ("1", "b", "c", "f"))
    assert (a["title"], a["content"], a["scope"], a["t"], a["session"], a["facts"]) == ("A title", "told so", "feedback", "2024-01-01", "s1", ["x", "2", '{"k":1}'])
    assert a["metadata"] == {"subtitle": "sub", "narrative": "told so"} and a["workspace"] == "p1" and a["concepts"] == []
    assert (b["title"], b["content"], b["scope"], b["t"], b["session"], b["facts"]) == ("some content", "some content", "summary", "2024-01-02", "s2", ["y", "z"])
    assert (c["content"], c["scope"], c["type"], c["facts"], c["concepts"]) == ("only a title", "project", "memory", ["plain, text"], ["quoted"])
    assert (f["title"], f["content"], f["scope"], f["workspace"], f["facts"], f["concepts"]) == ("f", "", "feedback", "notes-db", ["[1, broken"], ["7"])


def test_filters_reach_the_store(spark, tmp_path):
    pages(tmp_path, 1, ITEMS)
    pages(tmp_path, 2, [{"id": "late", "project": "p1"}])
    pages(tmp_path, 3, [{"id": "unfinished", "project": "p1"}], done=False)
    rows = load(spark, tmp_path)
    assert rows.count() == 7
    found = rows.where("project = 'p1' AND id IN ('1', 'late')")
    assert sorted(r["id"] for r in found.collect()) == ["1", "late"]
    assert "Filter" not in found._jdf.queryExecution().optimizedPlan().toString().split("RelationV2")[0]
    r = E.Reader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = GreaterThan(("id",), "a")
    assert list(r.pushFilters([EqualTo(("page",), "000000000002/part-00000"), left])) == [left]
    assert [p.names for p in r.partitions()] == [["000000000002/part-00000"]]
    assert load(spark, tmp_path / "none").count() == 0 and rows.where("project = 'p1' AND project = 'p2'").count() == 0


def test_stream_resumes(spark, tmp_path):
    source = tmp_path / "in"
    E.register(spark)

    def run():
        stream = E.structured(spark.readStream.format(E.FORMAT).option("path", str(source)).load(), "notes")
        q = follow(stream, Store(spark, str(tmp_path / "s")), lambda df: {"records": df}, "notes", str(tmp_path / "c"), available=False)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r["id"] for r in Store(spark, str(tmp_path / "s")).read("records").collect())

    pages(source, 1, ITEMS[:2])
    assert run() == ["1", "b"]
    pages(source, 2, ITEMS[2:])
    pages(source, 3, [{"id": "z"}], done=False)
    assert run() == ["1", "b", "c", "f"]
    (source / f"{3:012d}" / "_SUCCESS").touch()
    assert run() == ["1", "b", "c", "f", "z"]


@pytest.fixture
def web():
    class Answer(BaseHTTPRequestHandler):
        asked, failures = [], [503, 429]

        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            self.asked.append(q)
            if self.failures:
                self.send_error(self.failures.pop())
                return
            items = [x for x in ITEMS if "project" not in q or x.get("project") == q["project"]]
            body = json.dumps({"items": items[int(q["offset"]) :][: int(q["limit"])], "total": len(items)}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/observations", Answer
    server.shutdown()


def test_pages_over_http(spark, web):
    url, answer = web
    rows = load(spark, url, items=2)
    assert sorted(str(r["id"]) for r in rows.collect()) == sorted(["1", "b", "c", "  ", "None", "f"])
    assert {q["offset"] for q in answer.asked} >= {"0", "2", "4"}
    answer.asked.clear()
    assert [r["id"] for r in rows.where("project = 'p2'").collect()] == ["c"] and all(q["project"] == "p2" for q in answer.asked)
