import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexloom.plans.tasks import Pipeline, Registry, Scripted, Task, complete, failed_documents, prompt
from lexloom.sources import exports, files, web
from lexloom.streaming import audit


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("hello")
    (tmp_path / "b.txt").write_text("  \n")
    (tmp_path / "c.xyz").write_text("x")
    body = '<w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(buf.getvalue())
    got = {r.filename: (r.full_text, r.error) for r in files.load_files(spark, str(tmp_path)).collect()}
    assert got["a.TXT"] == ("hello", None) and got["d.docx"] == ("One\na | b", None)
    assert got["b.txt"][1] == "the file is empty" and "unsupported" in got["c.xyz"][1]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><p>A &amp; B</p><script>x()</script><div>C<br>D</div><noscript>no</noscript></body></html>"
    df = spark.createDataFrame([(page,), (None,)], "h string")
    assert [r.x for r in df.select(files.html_text("h").alias("x")).collect()] == ["A & B\nC\nD", None]


def test_json_paths_and_links(spark):
    df = spark.createDataFrame([('{"a": {"b": "x"}, "next": "/2"}', '</3>; rel="next"'), ('{"next_url": "/4"}', ""), ("{}", None)], "body string, link string")
    got = df.select(files.json_text(F.col("body"), "a.b").alias("t"), files.next_link(F.col("link"), F.col("body")).alias("n")).collect()
    assert [(r.t, r.n) for r in got] == [("x", "/3"), (None, "/4"), (None, None)]


def test_fetch(spark):
    pages = {"http://93.184.216.34/a": (200, {"ETag": "e1"}, "text"), "http://93.184.216.34/old": (304, {}, ""), "http://93.184.216.34/gone": (404, {}, ""), "http://93.184.216.34/evil": (302, {"Location": "http://10.0.0.1/"}, "")}
    urls = spark.createDataFrame([(u, None, None, "h0") for u in pages], "url string, etag string, last_modified string, content_hash string")
    got = {r.url.rsplit("/", 1)[1]: r for r in web.fetch(urls, lambda u, h: pages[u], backoff=0).collect()}
    assert got["a"].changed and got["a"].etag == "e1" and not got["old"].changed and got["old"].content_hash == "h0"
    assert got["gone"].error == "HTTP 404" and "not followed" in got["evil"].error


def test_retry_and_guard():
    calls = []
    assert web.fetch_one("http://x/", None, None, lambda u, h: (calls.append(u), (503, {}, "") if len(calls) < 3 else (200, {}, "ok"))[1], backoff=0)["body"] == "ok"
    public = lambda h: ["93.184.216.34"]
    assert web.may_follow("http://a.example/", "http://a.example/x", public)
    assert not web.may_follow("http://93.184.216.34/", "http://127.0.0.1/") and web.may_follow("http://10.0.0.1/", "http://127.0.0.1/")
    assert not web.may_follow("http://93.184.216.34/", "ftp://93.184.216.35/") and not web.may_follow("http://93.184.216.34/", "http://a\\@b/")


def test_paging():
    pages = {"http://h/1": (200, {}, json.dumps({"d": {"t": "one"}, "next": "/2"})), "http://h/2": (200, {"Link": '</3>; rel="next"'}, json.dumps({"d": {"t": ""}})), "http://h/3": (200, {}, json.dumps({"d": {"t": "three"}, "next": "/3"}))}
    assert web.fetch_pages("http://h/1", lambda u, h: pages[u], "d.t") == "one\n\nthree"


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("=x", 1), (None, 2)], "a string, b int")
    exports.write_csv(df, str(tmp_path / "c"))
    assert sorted((r.a or "", r.b) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()) == [("", "2"), ("'=x", "1")]
    exports.write_csv(df.limit(0), str(tmp_path / "e"))
    assert [p.read_text() for p in (tmp_path / "e").glob("*.csv")] == ["a,b\n"]
    ev = spark.createDataFrame([("d", 1, datetime.date(2024, 5, 6), "Buyer; Co")], "doc string, ord int, due date, who string")
    ev = ev.withColumn("event", exports.ical_event(F.lit("u1"), F.col("due"), F.col("who"), F.lit("pay"), F.lit("1"), F.lit("soon"), F.lit(None)))
    cal = exports.ical(ev, "doc", "ord", "event").first().calendar
    assert "DTSTART;VALUE=DATE:20240506" in cal and "SUMMARY:Buyer\\; Co: pay" in cal and cal.endswith("END:VEVENT\r\nEND:VCALENDAR")


def test_audit_is_idempotent(spark, tmp_path):
    at = str(tmp_path / "log")
    rows = spark.createDataFrame([("e1", datetime.datetime(2024, 1, 1), "extraction", "d", None, ["a"], 0.5, "{}")], exports.AUDIT_SCHEMA)
    exports.append_audit(rows, at)
    exports.append_audit(rows, at, exports.read_audit(spark, at))
    assert exports.read_audit(spark, at).count() == 1


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "src")
    events.unionByName(events.limit(50)).repartition(3).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    audit.append_to(audit.distinct_events(stream, "60 days"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    q = audit.windowed_counts(stream, late="60 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.events for r in spark.table("w").collect()) == events.count() + 50


def test_pipeline_shows_a_model_only_what_it_may_see(spark):
    docs = spark.createDataFrame([(1, "contract", "any", "open"), (2, "contract", "blocked", "secret"), (3, "memo", "any", "memo"), (4, "contract", "local_only", "local"), (5, None, None, "odd")], "id long, doc_type string, route string, text string")
    seen = Scripted(lambda p: p.upper())

    def ask(d, mine):
        p, cut = prompt("Q: ", F.when(mine, F.col("text")), 3)
        return complete(d.select("*", p, cut), seen).drop("error")

    reg = Registry()
    reg.register("ask", lambda: Task("ask", ask, ("contract",), True))
    with pytest.raises(KeyError):
        reg.register("ask", lambda: None)
    for local, want in ((True, {1: "Q: OPE", 4: "Q: LOC"}), (False, {1: "Q: OPE"})):
        out = {r.id: r.answer for r in reg.pipeline("ask", provider_is_local=local)(docs).collect()}
        assert {k: v for k, v in out.items() if v} == want and set(out) == {1, 2, 3, 4, 5}


def test_failures_are_counted(spark):
    def answer(p):
        if "bad" in p:
            raise ValueError("no\nmore")
        return "ok"

    calls = complete(spark.createDataFrame([("a", "bad"), ("a", "bad too"), ("b", "bad"), ("b", "good")], "doc string, prompt string"), Scripted(answer))
    assert {r.error for r in calls.collect()} == {"no", None} and [r.doc for r in failed_documents(calls, "doc").collect()] == ["a"]
