"""Decontamination and the pipeline against brute force."""

import random
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from lorebase.llm import decontaminate, quality
from tests.llm.test_jaccard import brute as brute_components

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefghijklmné") for _ in range(rng.randint(2, 8))) for _ in range(900)]


def prose(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


ITEMS = [(i, " ".join(prose(rng.randint(15, 40)))) for i in range(12)]
ITEMS += [(50, "tiny item here"), (51, None), (52, " .. "), (53, ITEMS[0][1]), (54, "rep rep rep rep rep rep rep rep stop")]


ITEMS += [(60 + i, " ".join(prose(60 + 10 * i))) for i in range(3)]


def reworked(text, edits):
    """Words replaced, inserted and deleted, also at both ends."""
    words = text.split()
    if rng.random() < 0.5:
        words[0] = words[-1] = rng.choice(VOCABULARY)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at:at + rng.choice([0, 1, 2])] = prose(rng.choice([0, 1, 2]))
    return " ".join(words)


def edited(text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


def documents():
    rows = [(i, " ".join(prose(rng.randint(40, 200)))) for i in range(40)]
    rows += [(100 + i, " ".join(prose(50)) + ". " + edited(ITEMS[i % 12][1].upper(), i // 12) + "!\n" + " ".join(prose(60))) for i in range(30)]
    rows += [(200, ITEMS[3][1]), (201, "a tiny ITEM here"), (202, " ".join(ITEMS[4][1].split()[:8]) + " " + " ".join(prose(40)))]
    rows += [(203, None), (204, ""), (None, ITEMS[2][1]), (205, ITEMS[0][1] + " " + ITEMS[1][1] + " " + ITEMS[1][1]), (206, "rep " * 60 + "stop")]
    rows += [(207, " ".join(prose(20_000)) + " " + ITEMS[5][1]), (208, " ".join(ITEMS[6][1].split()[:-1])), rows[41], rows[41], (0, ITEMS[7][1])]
    rows += [(500 + i, " ".join(prose(30)) + " " + reworked(ITEMS[-1 - i % 3][1], 1 + i % 3) + " " + " ".join(prose(20 * (i % 2)))) for i in range(60)]
    return rows


def brute_leaks(rows):
    """All windows of every item's size in every document; the largest similarity by document and item."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n: Counter(tuple(w[k:k + n]) for k in range(len(w) - n + 1))
    items = [(j, w, min(5, len(w)), grams(w, min(5, len(w)))) for j, w in ((j, cut(t)) for j, t in ITEMS) if w]
    found = {}
    for i, text in rows:
        words = cut(text)
        for j, w, n, want in items:
            parts = {s for s in want}
            if i is None or not any(tuple(words[k:k + n]) in parts for k in range(len(words) - n + 1)):
                continue
            for k in range(max(1, len(words) - len(w) + 1)):
                have = grams(words[k:k + len(w)], n)
                if 100 * (have & want).total() >= 75 * (have | want).total():
                    found[i, j] = max(found.get((i, j), 0), (have & want).total() / (have | want).total())
    return found


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["hot", "b"]), len(t or "")) for i, t in documents()]
    rows += [(300 + i, edited(rows[i][1], 2), "en", "hot", 0) for i in range(8)] + [(400, "word***# " * 40, "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_leaks_equal_brute_force(spark, tables):
    folder, rows = tables
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontaminate.leaks(docs.withColumn("item_id", docs.doc_id), items).collect()
    wanted = brute_leaks([r[:2] for r in rows])
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in wanted.items()} and len(got) == len(wanted)
    assert sum(i is not None and i >= 500 for i, _ in wanted) > 15
    assert all(0.75 <= r.similarity <= 1 and r.distance <= decontaminate.RADIUS for r in got)
    for empty in ((docs.limit(0), items), (docs, items.limit(0))):
        assert decontaminate.leaks(*empty).count() == 0


def test_block_radius_covers_the_hamming_radius():
    """Pigeonhole: whatever bits differ, one block has at most RADIUS // blocks of them."""
    assert sum(decontaminate.BLOCKS) == 64 and decontaminate.RADIUS // len(decontaminate.BLOCKS) == 3
    share = decontaminate.RADIUS // len(decontaminate.BLOCKS)
    assert len(decontaminate.BLOCKS) * (share + 1) > decontaminate.RADIUS
    assert len(decontaminate._near_masks(13, 3)) == 1 + 13 + 78 + 286


def test_no_python_in_the_plan(spark, tables):
    docs, items = (spark.read.parquet(f"{tables[0]}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_equals_brute_force(spark, tables):
    folder, rows = tables
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    judged = Counter(con.execute(f"SELECT doc_id, n_words, word_chars FROM ({quality.check_sql()}) WHERE kept").fetchall())
    good = []
    for i, t, *_ in rows:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        if judged[(i, len(words), sum(map(len, words)))] > 0:
            good.append((i, t))
    assert len(good) == judged.total()
    unique = {i for i, _, c in brute_components(good) if i is None or i == c}
    alone = [(i, t) for i, t in good if i in unique]
    dirty = {i for i, _ in brute_leaks(alone)}
    want = [(i, t) for i, t in alone if i not in dirty]
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(i for i, _ in want) and 0 < len(want) < len(alone) < len(good) < len(rows)
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_stages_keep_the_columns_and_survive_nothing(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    clashing = ["base", "kept", "g", "row", "component_id", "first", "start", "m", "item_id", "bucket", "rank"]
    wide = docs.limit(40).withColumns({c: docs.doc_id for c in clashing})
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, wide, tables[0])
        assert out.dtypes == wide.dtypes and 0 < out.count() <= 40
        assert all(r[c] == r.doc_id for r in out.collect() for c in clashing)
    assert corpus_pipeline.STAGES[-1][1](spark, wide, tables[0]).count() >= 40
    for _, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs.limit(0), tables[0]).dtypes == docs.dtypes
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), tables[0]).count() == 0
