"""Quality rules against brute force and SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from lorebase.llm import quality


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(words)
    failed = n < 10 or 100 * len(hit) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def texts():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(rng.randint(40, 400)), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "b"])) for i in range(240)]
    rows += [(1000 + i, " ".join(w + "***#" for w in prose(80).split()), "en", "hot") for i in range(5)]
    loop = prose(6)
    rows += [(2000, None, "en", "hot"), (2001, "", "en", None), (2002, " \n\t ", None, None), (2003, (loop + " ") * 40, "en", "b"), (None, prose(50), "xx", "lone")]
    rows += [(2004, f"{loop}\n{loop}\n\n\n{prose(200)}", "en", "b"), (2005, prose(9), "en", "b"), (2006, prose(30_000), "en", "hot"), (5, prose(60), "en", "hot")]
    rows += [(2007, "\x1c \x0b a\x85b c\x0cd", "en", "b"), (2008, "x " * 5 + "y", "en", "b"), (2009, " ".join(words[:20]), "en", "b"), rows[7], rows[7]]
    return rows


@pytest.fixture(scope="module")
def rated(spark):
    rows = texts()
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, source string, kept boolean").repartition(5)
    return rows, df, quality.rate(df).collect()


def test_base_equals_brute_force(rated):
    rows, _, got = rated
    assert sorted(map(str, ((r.doc_id, *tuple(r)[1:7]) for r in got))) == sorted(map(str, ((i, *brute(t)) for i, t, _, _ in rows)))
    assert not any(r.kept and r.base_failed for r in got)


def test_equals_sql(rated):
    rows, _, got = rated
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(quality.check_sql()).fetchall()))


def test_rejects_outliers_and_keeps_prose(rated):
    rows, df, got = rated
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[1000 + i] for i in range(5)) and not kept[2003] and all(kept[i] for i in range(240))
    marked = quality.annotate(df).collect()
    assert sorted(map(str, ((r.doc_id, *r.base) for r in marked))) == sorted(map(str, map(tuple, got)))
    assert sorted(map(str, (tuple(r)[:5] for r in marked))) == sorted(map(str, ((*r, True) for r in rows)))
    assert quality.rate(df.limit(0)).count() == 0


def test_no_python_in_the_plan(rated):
    plan = quality.rate(rated[1])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("ExistingRDD", ""))
