"""Folders of mixed files, repositories, messages, archives; connectors and the data source."""

import base64
import io
import os
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veridiff.sources import archive, connectors, scan

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(text):
    return "<w:p><w:r>" + "".join(f'<w:t xml:space="preserve">{t}</w:t>' for t in text.split("|")) + "</w:r></w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{c if c.startswith('<') else p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def docx(body, member="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member, f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_archives():
    body = p("Intro |text") + table(["Max Users", "500", "peak"], ["alone", ""], ["", ""]) + p("Port: 8080") + p("Port: 8080") + p(" ") + table(["Outer", table(["Inner", "1"])])
    assert archive.document_text(docx(body), 10**6) == "- Max Users: 500 peak\nalone\n- Outer: Inner1\nIntro text\nPort: 8080"
    assert archive.document_text(docx(p("a &amp; b")), 10**6) == "a & b"
    whole = docx(body)
    for broken in (b"", b"no zip", whole[: len(whole) // 2], docx(body, "other.xml"), None, docx("<w:p>")):
        assert archive.document_text(broken, 10**6) is None
    assert archive.document_text(docx(p("x" * 5000)), 1000) is None
    assert archive.document_text(docx(""), 1000) == ""


MESSAGE = "From: a@x.org\r\nSubject: folded\r\n\tline\r\nDate: Tue,\r\n 15 Jan 2024 23:30:00 -0500 (EST)\r\n\r\nport: 8080\r\n- **Timeout**: 30s\r\n"


def test_messages(spark):
    one = lambda x: spark.range(1).select(scan.message_parts(F.lit(x)).alias("m")).select("m.*").first()
    got = one(MESSAGE)
    assert got.body == "port: 8080\n- **Timeout**: 30s\n" and got.sent == datetime(2024, 1, 16, 4, 30)
    assert one("From: a\nDate: soon\nport: 1").sent is None and one("From: a\nDate: soon\nport: 1").body == "From: a\nDate: soon\nport: 1"
    assert one("Date: 3 Feb 2024\n\nx").sent == datetime(2024, 2, 3) and one("Date: 3 Feb 2024 10:00:00 GMT\n\nx").sent == datetime(2024, 2, 3, 10)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    for name, content in {
        "run.md": "## Cache\nport: 6379\n", "conf.json": '{"db": {"port": 5432}}', "app.yaml": "timeout: 30s\n", "t.csv": "name,port\ngate,443\n", "mail.eml": MESSAGE, "note.txt": MESSAGE.replace("8080", "9090"),
        "sub/plain.TXT": "memory: 4 GB\n", "broken.docx": "no zip", "big.md": "port: 1\n" + "x" * 5000, "paper.pdf": "%PDF",
    }.items():
        (root / name).write_bytes(content.encode())
    (root / "arch.docx").write_bytes(docx(table(["Owner", "team red"]) + p("Port: 7000")))
    (tmp_path / "outside.md").write_text("port: 666\n")
    os.symlink(tmp_path / "outside.md", root / "link.md")
    return root


def test_routed_scan(spark, folder):
    found = scan.document_claims(spark, str(folder), [str(folder)], max_bytes=4000)
    got = sorted((r.path.split("/")[-1], r.predicate, r.value, r.source_role) for r in found.collect())
    assert got == sorted([
        ("run.md", "cache_port", "6379", "documentation"), ("conf.json", "db_port", "5432", "configuration"), ("app.yaml", "timeout", "30s", "configuration"), ("t.csv", "port", "443", "documentation"),
        ("mail.eml", "port", "8080", "documentation"), ("mail.eml", "timeout", "30s", "documentation"), ("note.txt", "port", "9090", "documentation"), ("note.txt", "timeout", "30s", "documentation"),
        ("plain.TXT", "memory", "4 GB", "documentation"), ("arch.docx", "owner", "team red", "documentation"), ("arch.docx", "port", "7000", "documentation"),
    ])
    assert {r.observed_at for r in found.where("path LIKE '%mail.eml'").collect()} == {datetime(2024, 1, 16, 4, 30)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BinaryFile" not in plan and str(folder) not in plan  # the folder itself was read by one job before
    why = {r.path.split("/")[-1]: r.reason for r in scan.refused(spark, str(folder), [str(folder)], 4000).collect()}
    assert why == {"big.md": "too large", "link.md": "outside", "paper.pdf": "pages needed"}
    files = scan.listing(spark, str(folder)).where("length <= 4000")
    assert "LessThanOrEqual(length,4000)" in files._jdf.queryExecution().executedPlan().toString()


def test_repositories(spark):
    code = lambda x: base64.encodebytes(x.encode()).decode()
    rows = [
        ("o/r", "package.json", code('{"engines": {"node": ">=18"}}'), "base64"), ("o/r", "docker/Dockerfile.dev", "FROM node:20-alpine\n", None), ("o/r", "README.md", code("Requires Node 18"), "base64"),
        ("o/r", ".github/workflows/ci.yml", "runs-on: ubuntu-22.04", "utf-8"), ("o/r", "src/a.ts", "port: 1", None), ("o/s", "Dockerfile", "?", "base64"), ("o/s", "dockerfile", None, None),
    ]
    got = scan.repository_claims(spark.createDataFrame(rows, "repository string, path string, content string, encoding string"))
    assert sorted((r.subject, r.path, r.predicate, r.value, r.scope) for r in got.collect()) == [
        ("o/r", "o/r/.github/workflows/ci.yml", "ci_runner_os", "ubuntu-22.04", "workflow"), ("o/r", "o/r/README.md", "node_version", "18", "repository"),
        ("o/r", "o/r/docker/Dockerfile.dev", "node_version", "20", "service"), ("o/r", "o/r/package.json", "node_version", ">=18", "package"),
    ]


def test_page_tables(spark):
    rows = spark.createDataFrame([("a/spec.pdf", 2, "Max Users: `500`\r\n# no: 1\n Port=80\nurl: http://x\nab: 1\nno pair")], "path string, page int, text string")
    got = [(r.subject, r.predicate, r.value, r.external_id) for r in scan.page_table_claims(rows).collect()]
    assert got == [("spec", "max_users", "500", "document:a/spec.pdf:max_users:p2_l1"), ("spec", "port", "80", "document:a/spec.pdf:port:p2_l3")]


def test_registry(spark, folder, tmp_path):
    registry = connectors.Registry()
    registry.register(connectors.DocumentConnector([str(folder)], 4000))
    registry.register(connectors.WebsiteConnector(str(tmp_path / "none")))
    with pytest.raises(ValueError, match="already"):
        registry.register(connectors.DocumentConnector())
    assert registry.has("DOCUMENT") and registry.get("x") is None and [m.type for m in registry.list()] == ["document", "website"]
    with pytest.raises(LookupError):
        registry.require("x")
    registry.set_enabled("Document", False)
    assert registry.list()[0].enabled is False
    assert {r.type: r.status for r in registry.health(spark).collect()} == {"document": "healthy", "website": "unhealthy"}
    c = registry.require("document")
    assert c.test(spark, str(folder)).found and not c.test(spark, str(tmp_path / "gone")).accessible
    assert {r.value for r in c.claims(c.fetch(spark, str(folder), "*.yaml")).collect()} == {"30s"}
    registry.clear()
    assert registry.list() == []


def test_folder_data_source(spark, folder):
    connectors.register_formats(spark)
    read = lambda **o: spark.read.format("claim_files").options(folder=str(folder), **o).load()
    every = read(numPartitions="3", maxBytes="4000")
    assert every.rdd.getNumPartitions() == 3 and every.count() == 11
    some = every.where("extension IN ('md', 'yaml') AND length < 100 AND content IS NOT NULL")
    assert {r.path.split("/")[-1] for r in some.collect()} == {"run.md", "app.yaml", "link.md"}
    assert some.rdd.getNumPartitions() == 3  # of three files; what is ruled out is in no partition
    assert every.where("extension = 'csv'").rdd.getNumPartitions() == 1
    assert read().where("extension = 'none'").count() == 0
    with pytest.raises(Exception, match="folder"):
        spark.read.format("claim_files").load().count()
