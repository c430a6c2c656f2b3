"""Spelling variants against brute force over all pairs and against SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from lorebase.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, rarest=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= rarest and len(w) >= 5}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_error(w, v)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: v if v and words[v] >= 2 * words[w] else None for w, v in form.items()}
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def texts():
    rng = random.Random(3)
    stems = ["".join(rng.choice("abé÷ÿ") for _ in range(rng.randint(4, 8))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab"]
    weights = [1 / (k + 1) for k in range(len(stems))]
    rows = []
    for i in range(120):
        words = rng.choices(stems, weights, k=rng.randint(0, 60))
        for k in range(0, len(words), 5):  # typing errors
            w, at = words[k], rng.randrange(len(words[k]))
            words[k] = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1:]])
        rows.append((i, rng.choice([" ", ", ", "\n", "1", "ſ", "Ā", "漢"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rows += [(400 + k, "qqqqq " * 8 + "qqqqqb " * 4 + "qqqqqbc " * 2) for k in range(3)]
    long = "".join(rng.choice("abcde") for _ in range(3_000))
    rows += [(None, "Ébène ébène abaab " * 4), (500, None), (501, ""), (502, "12 \t!"), rows[3], rows[3], (503, f"{long} {long} x{long} {long}")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "x", 1) for r in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n long").repartition(5)


@pytest.mark.parametrize("group_words", [3, 20, spelling.GROUP_WORDS])
def test_equals_brute_force(docs, group_words):
    """Also with groups that are divided again and again."""
    got = sorted(map(tuple, spelling.variants(docs, group_words=group_words).collect()), key=lambda r: r[0])
    assert got == brute(texts()) and sum(r[1] is not None for r in got) > 20 and any(r[2] != r[1] and r[1] for r in got)


def test_equals_sql(docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in texts() if len(r[1] or "") < 3_000])
    got = spelling.variants(docs.filter("length(text) < 3000 OR text IS NULL")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(spelling.check_sql()).fetchall()))


def test_large_group_is_divided_to_the_end(spark):
    """Half of all words share all but one place; deletions are seen across the border of the halves."""
    letters = [chr(c) for c in range(0xE0, 0xF7)]
    words = [f"aaaa{x}{y}aaaa" for x in letters for y in letters[:6]] + [f"aaaa{x}aaaa" for x in letters]
    counted = spark.createDataFrame([(w, k + 3) for k, w in enumerate(words)], "word string, n long")
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(counted, 16).collect()}
    n = dict(zip(words, range(3, len(words) + 3)))
    for w in words:
        near = [v for v in words if one_error(w, v)]
        best = min(near, key=lambda v: (-n[v], v))
        assert got[w] == (len(near), n[best], best)


def test_recurrence_on_a_random_index():
    rng = random.Random(5)
    for _ in range(60):
        m = rng.randint(1, 7)
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([m, m + 1]))) for _ in range(30)})
        letters = [{} for _ in range(m + 2)]
        for k, w in enumerate(words):
            for p, c in enumerate(w):
                letters[p][c] = letters[p].get(c, 0) | 1 << k
        for w in (w for w in words if len(w) == m):
            replaced, longer = spelling.reached(w, letters, (1 << len(words)) - 1)
            assert {words[k] for k in spelling.ones(replaced) if len(words[k]) == m} == {v for v in words if len(v) == m and one_error(v, w)}
            assert {words[k] for k in spelling.ones(longer) if len(words[k]) > m} == {v for v in words if len(v) > m and one_error(v, w)}


def test_empty(docs):
    assert spelling.variants(docs.limit(0)).collect() == [] and spelling.variants(docs.filter("doc_id = 501")).collect() == []
