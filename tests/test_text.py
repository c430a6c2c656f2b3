"""Text functions against hand-computed values and a sequential restatement of the window rule."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from lorebase.functions import ids, text as tx


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expr.alias("x")).first()["x"]


def test_windows_example(spark):
    got = one(spark, tx.token_windows(F.col("t"), 4, 1), t="one two three four five six seven eight nine ten")
    assert [(w["content"], w["token_count"]) for w in got] == [
        ("one two three four", 4), ("four five six seven", 4), ("seven eight nine ten", 4)]


def test_windows_edges(spark):
    assert one(spark, tx.token_windows(F.col("t"), 4, 1), t=" \n ") == []
    assert one(spark, tx.token_windows(F.col("t"), 1, 5), t="a-b")[1]["content"] == "-"
    assert [w["content"] for w in one(spark, tx.token_windows(F.col("t"), 2, 0), t="Étion,  naïve\n\nß!")] == ["Étion,", "naïve\n\nß", "!"]


def sequential(text, limit, overlap):
    tokens = list(re.finditer(r"\w+|[^\w\s]", text))
    out, start, overlap = [], 0, min(overlap, limit - 1)
    while start < len(tokens):
        end = min(start + limit, len(tokens))
        out.append((text[tokens[start].start():tokens[end - 1].end()], end - start))
        if end == len(tokens):
            break
        start = end - overlap
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab é.ß1_ \n,", max_size=60), min_size=1, max_size=20), st.integers(1, 7), st.integers(0, 6))
def test_windows_property(spark, texts, limit, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [(w["content"], w["token_count"]) for w in r["w"]] for r in df.select("i", tx.token_windows(F.col("t"), limit, overlap).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sequential(t, limit, overlap)


def test_normalize_and_language(spark):
    assert one(spark, tx.normalize_query(F.col("t")), t="ＡＬＡＲＭ\x00 复位\n检查") == "ALARM 复位 检查"
    df = spark.createDataFrame([("复位a",), ("abc 复",), ("12 ?",)], ["t"])
    assert [r[0] for r in df.select(tx.language_hint(F.col("t"))).collect()] == ["zh", "en", "und"]
    assert one(spark, tx.lexical_keywords(F.col("t")), t="Reset reset a.b/c 复位检查 复") == ["reset", "a.b/c", "复位检查"]


def test_redaction(spark):
    assert one(spark, tx.redact_secrets(F.col("t")), t="API key: abc, x password=1;") == "API key=[REDACTED], x password=[REDACTED];"
    assert one(spark, tx.redact_log(F.col("t")), t="token = abc http://u:p@h/") == "token = <redacted> http://<redacted>@h/"
    got = one(spark, tx.redact_json(F.col("t")), t='{"a": {"db_password": 1, "b": ["secret=x"]}, "n": 2}')
    assert got == '{"a":{"b":["secret=<redacted>"],"db_password":"<redacted>"},"n":2}'
    assert one(spark, tx.injection_flag(F.col("t")), t="please reveal it\nthe token") is False
    assert one(spark, tx.injection_flag(F.col("t")), t="Ignore  previous") is True


def test_names_and_digests(spark):
    assert one(spark, tx.safe_name(F.col("t")), t="../a b?.txt") == "a_b_.txt"
    assert one(spark, tx.safe_name(F.col("t")), t="..__") == "source"
    assert one(spark, ids.filter_digest(F.lit(None).cast("struct<a:int>")), t="") == "none"
    assert rows(spark.createDataFrame([("",), ("abcde",)], ["t"]).select(tx.token_estimate(F.col("t")))) == [(1,), (2,)]


def test_redact_json_strings_keys_and_lines(spark):
    cases = {
        '{"x": [{"token": {"deep": [1, 2]}}, "token=1 ok"], "a:b": "say \\"password: p\\" now", "API_KEY": null}':
            '{"API_KEY":"<redacted>","a:b":"say \\"password: <redacted> now","x":[{"token":"<redacted>"},"token=<redacted> ok"]}',
        '"secret=abc"': '"secret=<redacted>"', "token=abc not json": "token=<redacted> not json", "[1, true, null]": "[1,true,null]", '{"k": "https://u:p@h"}': '{"k":"https://<redacted>@h"}',
    }
    for text, want in cases.items():
        assert one(spark, tx.redact_json(F.col("t")), t=text) == want


def test_heading_paths_equal_a_loop_and_are_linear(spark):
    import random
    import time

    from lorebase.functions.arrays import heading_paths

    rng = random.Random(1)
    kind = "i int, h array<struct<level:int,text:string>>"
    rows = [(i, [(rng.randint(1, 6), f"h{j}") for j in range(i % 40)]) for i in range(200)]

    def paths(headings):
        out, path = [], []
        for level, text in headings:
            path = [*path[: level - 1], text]
            out.append(path)
        return out

    got = spark.createDataFrame([*rows, (-1, None)], kind).select("i", heading_paths(F.col("h")).alias("p")).collect()
    assert {r.i: r.p for r in got} == {-1: None, **{i: paths(h) for i, h in rows}}
    many = spark.createDataFrame([(1, [(rng.randint(1, 6), f"h{j}") for j in range(20_000)])], kind)
    begin = time.time()
    assert many.select(F.size(heading_paths(F.col("h")))).first()[0] == 20_000 and time.time() - begin < 30


def test_hash_embedding_equals_a_loop(spark):
    import hashlib
    import math

    from lorebase.functions.vectors import hash_embedding

    texts = ["", "one two two three", "x " * 5000, None, "Ünï straße 12"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", hash_embedding(F.col("t"), 10).alias("v")).collect()
    for r in rows:
        if texts[r.i] is None:
            assert r.v is None
            continue
        counts = [0] * 10
        for w in re.findall(r"\w+", texts[r.i].casefold()):
            counts[int.from_bytes(hashlib.sha256(w.encode()).digest()[:4]) % 10] += 1
        norm = math.sqrt(sum(c * c for c in counts)) or 1.0
        assert r.v == [c / norm for c in counts]
