"""Readers of files: what each of them must not lose."""

import pytest
from pyspark.sql import functions as F

from veridiff.sources import extract


def found(spark, reader, path, content):
    return sorted((r.predicate, r.value) for r in reader(spark.createDataFrame([(path, content)], "path string, content string")).collect())


@pytest.mark.parametrize(
    "reader, path, content, want",
    [
        ("yaml_claims", "a.yaml", "endpoint: https://x.org/v1\nos: linux\nnone: ''", [("endpoint", "https://x.org/v1"), ("os", "linux")]),
        ("csv_claims", "a.csv", "service,url,ip,\ngate,http://g,10.0.0.1,x\nauth,,10.0.0.2,", [("ip", "10.0.0.1"), ("ip", "10.0.0.2"), ("url", "http://g")]),
        ("json_claims", "a.json", '{"endpoint": "https://x.org", "db": {"ip": "10.0.0.1"}, "os": "", "\u540d": 1}', [("_", "1"), ("db_ip", "10.0.0.1"), ("endpoint", "https://x.org"), ("os", "")]),
        ("package_claims", "package.json", '{"engines": {"node": "https://x.org/n.tgz"}}', [("node_version", "https://x.org/n.tgz")]),
        ("markdown_claims", "a.md", "os: linux\nendpoint: https://x.org\nport: 80", [("port", "80")]),
    ],
)
def test_only_markdown_drops_urls_and_short_keys(spark, reader, path, content, want):
    assert found(spark, getattr(extract, reader), path, content) == want


def test_json_has_no_depth_limit_and_takes_named_items(spark):
    keys = [f"k{i}" for i in range(300)]
    deep = "".join(f'{{"{k}": ' for k in keys) + '"end"' + "}" * len(keys)
    assert found(spark, extract.json_claims, "a.json", deep) == [("_".join(keys), "end")]
    pod = '{"spec": {"env": [{"name": "DB_HOST", "value": "a.b"}, {"name": "Max-Conn", "value": 10}, {"name": 1, "value": 2}, {"name": "x"}, 5], "off": null, "on": true, "n": 1.50}}'
    assert found(spark, extract.json_claims, "a.json", pod) == [("db_host", "a.b"), ("max_conn", "10"), ("spec_n", "1.5"), ("spec_on", "true")]
    assert found(spark, extract.json_claims, "a.json", '[{"a": 1}, {"a": 12345678901234567890}]') == [("0_a", "1"), ("1_a", "12345678901234567890")]
    for broken in ('{"a": 1', '{"a": NaN}', "", "7", '"text"', "null"):
        assert found(spark, extract.json_claims, "a.json", broken) == []


def test_html_table_rows(spark):
    html = "<p>Intro text</p><table><TR class='x'><th>\n <b>OS</b>&nbsp;</th><td>a&gt;b</td><td>more text</td></TR><tr><td>only cell</td></tr><tr><td>ip</td><td></td><td>::1</td></tr></table><p>After</p>"
    pages = spark.createDataFrame([(1, html), (2, "<p>no table</p>"), (3, None), (4, "<tr><td>open</td><p>tail line</p>")], "page_id int, html string")
    got = [(r.page_id, r.line) for r in extract.html_lines(pages).collect()]
    assert got == [(1, "Intro text"), (1, "OS: a>b"), (1, "only cell"), (1, "ip: ::1"), (1, "After"), (2, "no table"), (4, "open"), (4, "tail line")]


def test_package_dependencies_and_ports(spark):
    pkg = """{"engines": {"node": ">=18"}, "dependencies": {"react": "^18.2.0", "left-pad": "1.0.0", "@modelcontextprotocol/sdk": "1.0.0"},
        "devDependencies": {"typescript": "5.4.2"}, "scripts": {"start": "PORT=8080 node .", "dev": "next dev --port 3000", "lint": "eslint ."}}"""
    rows = extract.package_claims(spark.createDataFrame([("package.json", pkg), ("b/package.json", "{}"), ("c/package.json", "{")], "path string, content string")).collect()
    assert sorted((r.predicate, r.value, r.confidence, r.environment) for r in rows) == [
        ("mcp_sdk_version", "1.0.0", 0.9, "production"), ("node_version", ">=18", 0.95, "production"), ("port", "3000", 0.85, "development"),
        ("port", "8080", 0.85, "production"), ("react_version", "^18.2.0", 0.9, "production"), ("typescript_version", "5.4.2", 0.9, "development"),
    ]


def test_workflow_runner(spark):
    assert found(spark, extract.workflow_claims, "ci.yml", "jobs:\n  a:\n    runs-on: ubuntu-22.04\n    node-version: [18.x, 20]") == [("ci_runner_os", "ubuntu-22.04"), ("node_version", "18"), ("node_version", "20")]


def test_markdown_wide_tables(spark):
    text = """## Ports
| Service | Port | Home page | Notes |
|---|---|---|---|
| gateway | `443` | https://g.org | - |

| cache | 6379 | | x |
| Name | 1 | 2 | 3 |
plain line
| db | 5432 | late |
| Key | Value |
|---|---|
| region | eu |"""
    assert found(spark, extract.markdown_claims, "a.md", text) == [
        ("ports_cache_notes", "x"), ("ports_cache_port", "6379"), ("ports_gateway_home_page", "https://g.org"), ("ports_gateway_port", "443"), ("ports_region", "eu"),
    ]


def test_dockerfile_images_and_ports(spark):
    text = "FROM --platform=linux/amd64 node:lts-alpine AS build\r\n  from bitnami/postgresql:15.2-debian\nFROM node:v20\nFROM my-python-base:3.12.1-slim\nFROM node\nFROM redis:7\nEXPOSE 8\n\tEXPOSE 8080/tcp 9090\nRUN FROM node:1"
    rows = extract.dockerfile_claims(spark.createDataFrame([("Dockerfile", text)], "path string, content string")).collect()
    assert [(r.line_no, r.predicate, r.value, r.value_type, r.confidence) for r in rows] == [
        (1, "node_version", "lts", "version", 0.9), (2, "postgres_version", "15.2", "version", 0.9), (3, "node_version", "v20", "version", 0.9), (4, "python_version", "3.12.1", "version", 0.9), (8, "port", "8080", "quantity", 0.9),
    ]


def test_workflow_versions(spark):
    text = """node-version: ${{ matrix.node }}
      node-version: 20 # lts
      with: { node-version: 14 }
      node-version: '18.x'
      node-version: [16.x, "20", ]
      node-version: lts/*
      Runs-On: [self-hosted]
      runs-on: windows-2022"""
    rows = extract.workflow_claims(spark.createDataFrame([("ci.yml", text)], "path string, content string")).collect()
    assert [(r.line_no, r.predicate, r.value, r.multi_value_context) for r in rows] == [
        (2, "node_version", "20", "ci_step"), (3, "node_version", "14", "ci_step"), (4, "node_version", "18", "ci_step"), (5, "node_version", "16", "ci_matrix"), (5, "node_version", "20", "ci_matrix"), (8, "ci_runner_os", "windows-2022", "ci_runner"),
    ]


def test_white_space_and_references(spark):
    assert found(spark, extract.csv_claims, "a.csv", "name,port\r\n\tgate\t,\t80\u00a0\r\n") == [("port", "80")]
    assert found(spark, extract.yaml_claims, "a.yaml", "port:\t80\t\r\n") == [("port", "80")]
    one = lambda x: spark.range(1).select(extract.decoded(F.lit(x)).alias("x")).first()["x"]
    assert one("&#38;#39; &#x26;#39; &#55357; &#65601; &#99999999999999999999; &#x1F600; &copy;") == "&#39; &#39; \ufffd A \u1b3f".replace("\u1b3f", chr(99999999999999999999 % 65536)) + " " + chr(0xF600) + " &copy;"
