"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

The vocabulary is cut into groups that hold every near pair: two words with one error share either all before
or all behind the middle of the shorter one. A group is indexed by bitsets, one per (position, letter), over its words; a word is
compared with the whole group at once by recurrences on these bitsets that carry the sets of words reached with no error
and with one error, the latter also at positions shifted by one. A group of too many words is divided again in the middle
of the part that may hold the error, so no group exceeds a fixed number of words and no pair is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import stage, stage_lookup

RUN = re.compile(rb"[a-z\xc0-\xff]{5,}")  # in Latin-1, where a code point is a byte
SHORTEST, RAREST, DAMAGE = 5, 3, 97
FLUSH = 300_000  # words that a task counts before it hands them on
GROUP_WORDS = 16_384


def damaged(run: bytes, prefix: int) -> bytes:
    """The run (Latin-1) with one letter deleted if its checksum, carried on from that of ``<doc_id>:``, says so."""
    mark = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if mark % DAMAGE:
        return run
    at = mark % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, rarest: int = RAREST) -> DataFrame:
    """``word, n`` of all words of whole texts that occur ``rarest`` times or more; counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                runs = RUN.findall((text.as_py() or "").encode("latin-1", "replace").lower())  # bytes lower A-Z only
                for found, n in Counter(runs).items():
                    word = damaged(found, prefix)
                    if len(word) >= SHORTEST:
                        held[word] += n
                if len(held) >= FLUSH:
                    yield handed()
                    held.clear()
        yield handed()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


def reached(word: str, letters: list[dict[str, int]], everything: int) -> tuple[int, int]:
    """Bitsets of the indexed words that equal ``word`` but for one replaced letter, and but for one letter more.

    ``letters[p][c]`` holds the words with letter ``c`` at position ``p``. ``exact`` are the words without an error so far,
    ``replaced`` those with one at the same positions, ``longer`` those whose positions are shifted by one since their extra letter.
    """
    exact, replaced, longer = everything, 0, 0
    for p, c in enumerate(word):
        same = letters[p].get(c, 0)
        longer = (longer | exact) & letters[p + 1].get(c, 0)
        replaced = replaced & same | exact & ~same
        exact &= same
        if not (exact or replaced or longer):
            break
    return replaced, longer | exact


def ones(bits: int) -> Iterator[int]:
    while bits:
        lowest = bits & -bits
        yield lowest.bit_length() - 1
        bits ^= lowest


def near_in_group(m: int, lo: int, hi: int, words: list[str], counts: list[int]) -> list[tuple[str, int, int, str]]:
    """``word, near words, largest count, smallest near word of that count`` within one group.

    The group compares its words of length ``m`` with each other and with those of length m + 1. A pair counts in the one group
    whose part ``lo..hi`` holds its first difference; a letter appended at the end belongs to the last part.
    """
    letters: list[dict[str, int]] = [{} for _ in range(m + 2)]
    equal_length = 0
    for k, word in enumerate(words):
        bit = 1 << k
        if len(word) == m:
            equal_length |= bit
        for p, c in enumerate(word):
            letters[p][c] = letters[p].get(c, 0) | bit
    everything = (1 << len(words)) - 1
    near = [0] * len(words)
    best: list[tuple[int, str] | None] = [None] * len(words)
    for k in ones(equal_length):
        word = words[k]
        replaced, longer = reached(word, letters, everything)
        # a replacement shows on both sides, so it is counted from the lower one
        for other in ones((replaced & equal_length) >> (k + 1) << (k + 1) | longer & ~equal_length):
            first = next((p for p in range(m) if word[p] != words[other][p]), m)
            if first >= hi and hi < m:
                continue
            for one, two in ((k, other), (other, k)):
                near[one] += 1
                offer = (-counts[two], words[two])
                best[one] = min(best[one] or offer, offer)
    return [(words[k], near[k], -best[k][0], best[k][1]) for k in range(len(words)) if near[k]]


NEAR = "word string, n_near long, best_n long, best string"


def search_groups(copies: DataFrame) -> DataFrame:
    """Run every group of ``copies`` (``key, m, lo, hi, word, n``); groups stream through sorted partitions one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        now, words, counts, out = None, [], [], []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "n_near", "best_n", "best"])

        for batch in batches:
            for key, m, lo, hi, word, n in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if (key, m, lo, hi) != now:
                    if len(words) > 1:
                        out += near_in_group(*now[1:], words, counts)
                    now, words, counts = (key, m, lo, hi), [], []
                words.append(word)
                counts.append(n)
            if len(out) > 10_000:
                yield packed()
                out.clear()
        if len(words) > 1:
            out += near_in_group(*now[1:], words, counts)
        yield packed()

    names = ["key", "m", "lo", "hi", "word", "n"]
    return copies.select(*names).repartition("key").sortWithinPartitions("key", "m", "lo", "hi").mapInArrow(run, NEAR)


def _keyed(copies: DataFrame) -> DataFrame:
    """The key of a copy hashes what its group shares: all before ``lo`` and, counted in the shorter word, all from ``hi`` on."""
    shared = F.xxhash64("m", "lo", "hi", F.expr("substring(word, 1, lo)"), F.expr("substring(word, length(word) - (m - hi) + 1)"))
    return copies.withColumn("key", shared)


def _halves(copies: DataFrame) -> DataFrame:
    """Two copies of every row: the error lies behind the middle of its part, or before."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi")))
    return _keyed(copies.select("word", "n", "m", F.explode(parts).alias("part")).select("word", "n", "m", "part.lo", "part.hi"))


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """``word, n_near, best_n, best`` of every word of ``words`` (``word, n``) that has a near word.

    A word takes part in groups of its own length and, as the longer one, of one less. Groups over ``group_words`` are divided
    until they fit or leave one place open, where at most 90 words of a length and 90 * 90 of the next can differ.
    """
    length = F.length("word")
    spread = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).filter(F.col("m") >= SHORTEST)
    copies, found = _halves(spread.withColumn("lo", F.lit(0)).withColumn("hi", F.col("m"))), None
    while True:
        sizes = copies.filter("hi - lo > 1").groupBy("key").count().filter(F.col("count") > group_words).select("key")
        large = stage(sizes, "large-groups")
        divided = not large.isEmpty()
        if divided:
            large = stage_lookup(large, "divided")
            copies = stage(copies, "copies")
        part = search_groups(copies.join(large, "key", "left_anti") if divided else copies)
        found = part if found is None else found.unionByName(part)
        if not divided:
            break
        copies = _halves(copies.join(large, "key", "left_semi").select("word", "n", "m", "lo", "hi"))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best")
    )


def follow(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: every step doubles the way, so a chain of n forms takes log n joins."""
    links = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = links.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        step = stage(step, "roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        links = step.select("word", "root")


def variants(docs: DataFrame, *, rarest: int = RAREST, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least twice its own; counts
    at least double along forms, so roots exist. Null and empty texts have no words, a null doc_id counts as an empty one, rows
    that repeat a doc_id count each, texts of any length are read whole. Very long runs are words as others. An empty table gives no
    rows; other columns are ignored.
    """
    words = stage(word_counts(docs, rarest), "words")
    judged = stage(
        words.join(near_words(words, group_words), "word", "left")
        .withColumn("formed", F.col("best_n") >= 2 * F.col("n"))
        .select(
            "word", F.when(F.col("formed"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("formed"), F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = follow(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def check_sql() -> str:
    """The same rows in SQL: checksums byte by byte, near words by the strings that one deletion leaves."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    octets = """flatten(list_transform(string_split(k, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)]
        ELSE [192 | (ord(c) >> 6), 128 | (ord(c) & 63)] END))"""
    return f"""
    WITH RECURSIVE crc AS (
        SELECT list(list_reduce([i] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
        FROM (SELECT unnest(range(256))::BIGINT AS i)
    ), runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[a-z\u00C0-\u00FF]+')) AS r FROM documents
    ), own AS (
        SELECT coalesce(doc_id::VARCHAR, '') || ':' || r AS k, r, count(*) AS n FROM runs WHERE length(r) >= {SHORTEST} GROUP BY ALL
    ), marked AS (
        SELECT r, n, xor(list_reduce([4294967295::BIGINT] || {octets}::BIGINT[], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
        FROM own, crc
    ), cut AS (
        SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM marked
    ), words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {SHORTEST} GROUP BY 1 HAVING sum(n) >= {RAREST}
    ), shorter AS (
        SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM words, unnest(range(1, length(word) + 1)) AS u(i)
    ), pairs AS (
        SELECT a.word AS u, b.word AS v FROM shorter a JOIN shorter b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
        UNION SELECT word, s FROM shorter WHERE s IN (SELECT word FROM words)
        UNION SELECT s, word FROM shorter WHERE s IN (SELECT word FROM words)
    ), ranked AS (
        SELECT u, v, n, count(*) OVER (PARTITION BY u) AS n_near, row_number() OVER (PARTITION BY u ORDER BY n DESC, v) AS k
        FROM pairs JOIN words ON v = word
    ), judged AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN v END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
        FROM words w LEFT JOIN ranked r ON u = w.word AND k = 1
    ), ways AS (
        SELECT word, word AS root, form AS onward FROM judged
        UNION ALL SELECT ways.word, judged.word, judged.form FROM ways JOIN judged ON onward = judged.word
    )
    SELECT judged.word, form, root, n, n_near, form_n FROM judged JOIN ways ON ways.word = judged.word AND onward IS NULL"""
