"""Chunking and parsing against literal documents and sequential restatements."""

import hashlib
import random
from statistics import median

from pyspark.sql import functions as F

from conftest import rows
from lorebase.operators import chunk, parse

BLOCK = "struct<id:string,kind:string,`order`:int,level:int,text:string,page:int,box:struct<x0:double,y0:double,x1:double,y1:double,space:string>,heading_path:array<string>>"


def documents(spark, docs):
    data = []
    for name, blocks in docs.items():
        data.append(("t0", name, [
            (f"b{i}", kind, i, None, text, page, box, path)
            for i, (kind, text, page, box, path) in enumerate(blocks)]))
    return spark.createDataFrame(data, f"tenant_id string, document_version_id string, blocks array<{BLOCK}>")


def contents(spark, blocks, strategy, **kw):
    df = chunk.chunk_documents(documents(spark, {"v": blocks}), strategy, **kw)
    return [r["content"] for r in df.orderBy("sequence").collect()]


def b(kind, text, page=1, box=None, path=()):
    return (kind, text, page, box, list(path))


def test_sections_match_sequential_rule(spark):
    rng = random.Random(3)
    docs = {f"v{n}": [b(rng.choice(["heading", "text", "text", "table", "image"]), f"w{n}x{i}") for i in range(rng.randint(1, 14))] for n in range(40)}

    def sections(blocks, isolate):
        groups, current = [], []
        for kind, text, *_ in blocks:
            if isolate and kind in ("table", "image"):
                if current:
                    groups.append(current)
                groups.append([text])
                current = []
            elif kind == "heading" and current:
                groups.append(current)
                current = [text]
            else:
                current.append(text)
        return ["\n\n".join(g) for g in groups + ([current] if current else [])]

    for strategy, isolate in (("manual", True), ("resume", False)):
        got = {}
        for r in chunk.chunk_documents(documents(spark, docs), strategy).orderBy("sequence").collect():
            got.setdefault(r["document_version_id"], []).append(r["content"])
        assert got == {v: sections(blocks, isolate) for v, blocks in docs.items()}


def test_laws_table_picture_qa(spark):
    assert contents(spark, [b("text", "Intro\nArticle 1 a\nmore\n第二条 b")], "laws") == ["Intro", "Article 1 a\nmore", "第二条 b"]
    assert contents(spark, [b("table", "h1\th2\na\tb\n\nc\td"), b("table", "only"), b("text", " t ")], "table") == ["h1\th2\na\tb", "h1\th2\nc\td", "only", "t"]
    assert contents(spark, [b("text", "x", 1), b("image", "pic", 1), b("text", "y", 2), b("text", "z", 2)], "picture") == ["pic\nx", "y", "z"]
    assert contents(spark, [b("text", "Q: one?\nA: yes\nQuestion: two?\nAnswer: no\nway"), b("table", "q\ta\nhow\tso\nx"), b("text", "plain")], "qa") == [
        "Question: one?\nAnswer: yes", "Question: two?\nAnswer: no\nway", "Question: how\nAnswer: so", "plain"]


def test_metadata_and_ids(spark):
    box = lambda x: (x, 1.0, x + 5, 3.0, "point")
    df = chunk.chunk_documents(documents(spark, {"v": [
        b("heading", "H", 1, box(2.0), ["H"]), b("text", "t", 1, box(9.0), ["H"]), b("table", "a\tb", 2, None, ["H"])]}), "manual")
    first, second = df.orderBy("sequence").collect()
    assert first["metadata"]["box"] == (2.0, 1.0, 14.0, 3.0, "point") and first["metadata"]["block_kinds"] == ["heading", "text"]
    assert second["metadata"]["contains_table"] and second["metadata"]["box"] is None and second["metadata"]["page_start"] == 2
    parts = ["sha256-v2", "t0", "v", "manual", "1", "0", "b0,b1", hashlib.sha256(b"H\n\nt").hexdigest()]
    assert first["chunk_id"] == "chk_" + hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:32]


def test_dispatch_errors(spark):
    docs = documents(spark, {n: [b("text", "x")] for n in ("a", "b", "c", "d")})
    asked = spark.createDataFrame([("a", "auto", "7"), ("b", "nope", "1"), ("c", "book", "7"), ("d", "book", "auto")], "document_version_id string, strategy_id string, strategy_version string")
    done, rejected = chunk.dispatch(docs.join(asked, "document_version_id").withColumn("recommended_chunk_strategy", F.lit("general")))
    assert rows(done.select("document_version_id", "chosen_strategy"), "document_version_id") == [("a", "general"), ("d", "book")]
    assert rows(rejected.select("document_version_id", "error_code"), "document_version_id") == [("b", "chunk_strategy_unknown"), ("c", "chunk_strategy_version_unknown")]


def test_light_markdown_path_collapses(spark):
    df = spark.createDataFrame([(1, "intro\r\n\r\n# A\n\n### C\n\n## B\n\nx\ny\n\n####### no\n\n# \n\n# two\nlines")], "id int, text string")
    got = rows(parse.parse_markdown(df, "id").select("kind", "text", "heading_path", "block_order"), "block_order")
    assert [(k, t, p) for k, t, p, _ in got] == [
        ("text", "intro", []), ("heading", "A", ["A"]), ("heading", "C", ["A", "C"]), ("heading", "B", ["A", "B"]), ("text", "x\ny", ["A", "B"]),
        ("text", "####### no", ["A", "B"]), ("text", "#", ["A", "B"]), ("text", "# two\nlines", ["A", "B"])]


def test_markdown_blocks_golden(spark):
    source = "# T\n\npara one\nline\n\n- item\n\n```py\nx = 1\n\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## S\n\ntail"
    df = spark.createDataFrame([(1, source)], "id int, text string")
    got = parse.parse_markdown_blocks(df, "id").orderBy("block_order").collect()
    assert [(r["kind"], r["text"]) for r in got] == [
        ("heading", "T"), ("text", "para one\nline"), ("list", "item"), ("text", "item"), ("code", "x = 1"), ("table", "a\tb\n1\t2"), ("heading", "S"), ("text", "tail")]
    assert (got[5]["table_rows"], got[5]["table_columns"], got[5]["has_header"], got[7]["heading_path"]) == (2, 2, True, ["T", "S"])


def test_html_golden(spark):
    html = ("<html><script>bad()</script><h1>A <b>B</b></h1><p>one<p>two</p><ul><li>x<ul><li>nested</li></ul></li></ul>"
            "<table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td><p>2</p></td></tr><tr><td></td></tr></table><h2>C</h2><img src=r.png><pre>code</pre></html>")
    got = parse.parse_html(spark.createDataFrame([(1, html)], "id int, html string"), "id").orderBy("block_order").collect()
    assert [(r["kind"], r["text"]) for r in got if r["kind"] != "list"] == [
        ("heading", "A B"), ("text", "one"), ("text", "two"), ("table", "h\tk\n1\t2"), ("heading", "C"), ("image", "embedded image"), ("code", "code")]
    assert [r["text"] for r in got if r["kind"] == "list"] == ["x nested"]
    assert [(r["table_rows"], r["has_header"], r["image_ref"]) for r in got if r["kind"] in ("table", "image")] == [(2, True, None), (None, None, "r.png")]


def test_words_to_lines_sequential(spark):
    rng = random.Random(5)
    words = [(p, i, f"w{i}", float(rng.randint(0, 90)), float(y), 0.0, float(y + rng.choice([8, 10, 12])), round(rng.random(), 3))
             for p in range(6) for i, y in enumerate(rng.choices(range(0, 60), k=25))]
    df = spark.createDataFrame(words, "page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, confidence double").withColumn("doc_id", F.lit(1))
    got = rows(parse.words_to_lines(df).select("page", "line_no", "text"), "page", "line_no")
    want = []
    for p in range(6):
        page = [w for w in words if w[0] == p]
        tol = max(4.0, 0.65 * median(w[6] - w[4] for w in page))
        centre = lambda w: (w[4] + w[6]) / 2
        lines = []
        for w in sorted(page, key=lambda w: (round(centre(w) / tol), w[3], w[1])):
            if lines and abs(centre(w) - sum(map(centre, lines[-1])) / len(lines[-1])) <= tol:
                lines[-1].append(w)
            else:
                lines.append([w])
        want += [(p, n, " ".join(w[2] for w in sorted(line, key=lambda w: (w[3], w[1])))) for n, line in enumerate(lines)]
    assert got == want


def test_sheet_limit_and_trimming(spark):
    cells = spark.createDataFrame([("s", 1, 0, "a"), ("s", 1, 1, ""), ("s", 2, 0, ""), ("s", 3, 1, "b"), ("s", 3, 0, None), ("big", 1, 0, "x"), ("big", 2, 0, "y"), ("big", 3, 0, "y"), ("big", 4, 0, "y")], "sheet string, row int, col int, value string")
    tables, rejected = parse.cells_to_tables(cells, max_rows=3)
    assert rows(tables.select("sheet", "text", "table_rows", "table_columns")) == [("s", "a\n\tb", 2, 2)]
    assert rows(rejected.select("sheet", "error_code")) == [("big", "parser_resource_limit")]


def test_html_blocks_come_in_opening_order():
    scan = lambda markup: [(b[0], b[2], b[3]) for b in parse.scan_html(markup)]
    assert scan("<p>hello <img alt=pic> tail</p>") == [("text", "hello tail", []), ("image", "pic", [])]
    assert scan("<ul><li>a <h2>H</h2> b</li></ul><p>c") == [("list", "a H b", []), ("heading", "H", ["H"]), ("text", "c", ["H"])]
    got = scan("<table><tr><th>k</th><td>v <img alt=i></td></tr></table>")
    assert [kind for kind, _, _ in got] == ["table", "image"] and got[0][1] == "k\tv"
    assert scan("<ul><li>out<ul><li>in</li></ul></li></ul>") == [("list", "out in", [])]
    assert scan("<script>x</script><p>a<p>b<div>c</div>") == [("text", "a", []), ("text", "b", [])]
