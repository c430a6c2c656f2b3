"""Benchmark decontamination by SimHash windows, in DataFrame and SQL functions only.

A document is read through windows of a benchmark item's size that begin at a shingle of some item: any other window shifts
right to its first such shingle without losing one. Windows with too few of these shingles, or with none that the window before
lacks, are left out. Windows and items get 64-bit SimHash fingerprints. A
multi-index finds all pairs within a Hamming radius: the fingerprint is cut into blocks, and of two
fingerprints within the radius at least one block pair is within radius / blocks (pigeonhole), so
items are listed under all block values that near. Candidates are verified by the exact
similarity of their weighted shingles.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.text import let
from lorebase.llm.common import stage, stage_lookup

WORD = r"[\p{L}\p{N}]+"
WIDTH, PERCENT = 5, 75
BITS, RADIUS = 64, 19
BLOCKS = (13, 13, 13, 13, 12)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def shingles_of(words: Column, width: Column) -> Column:
    """64-bit hashes of all runs of ``width`` words, in order; empty where there are fewer words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when((width > 0) & (F.size(words) >= width), runs).otherwise(F.array().cast("array<long>"))


def simhash(hashes: Column) -> Column:
    """A bit is set where more than half of the shingles, each weighted by its count, have it set."""
    return let(hashes, _folded)


def _has(mask: Column):
    return lambda h: h.bitwiseAND(mask) != 0


def _runs(width: int):
    return lambda words: shingles_of(words, F.lit(width))


def _entries(own: Column, block: int):
    return lambda mask: F.struct(F.lit(block).alias("block"), own.bitwiseXOR(mask).alias("value"))


def _folded(held: Column) -> Column:
    value = F.lit(0).cast("long")
    for b in range(BITS):
        mask = F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")
        ones = F.size(F.filter(held, _has(mask)))
        value = value.bitwiseOR(F.when(2 * ones > F.size(held), mask).otherwise(F.lit(0).cast("long")))
    return value


def _near_masks(bits: int, radius: int) -> list[int]:
    """All bit masks of at most ``radius`` set bits."""
    return [sum(1 << b for b in chosen) for k in range(radius + 1) for chosen in combinations(range(bits), k)]


def _blocks(fingerprint: Column, probes: bool) -> Column:
    """Array of (block, value) entries: the own values, or for ``probes`` all values within the block radius."""
    share, at, parts = RADIUS // len(BLOCKS), 0, []
    for k, bits in enumerate(BLOCKS):
        own = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        at += bits
        if probes:
            masks = F.expr(f"array({', '.join(map(str, _near_masks(bits, share)))})")
            parts.append(F.transform(masks, _entries(own, k)))
        else:
            parts.append(F.array(F.struct(F.lit(k).alias("block"), own.alias("value"))))
    return F.concat(*parts)


def overlap(a: Column, b: Column) -> Column:
    """Summed minimum of the counts of every shingle in two arrays."""
    count = lambda held, x: F.size(F.filter(held, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, m, width, shingles, fingerprint`` of every item that has words."""
    sized = benchmark.select("item_id", words_of(F.col("text")).alias("w")).withColumn("m", F.size("w")).filter("m > 0")
    cut = sized.withColumn("width", F.least(F.lit(WIDTH), F.col("m"))).select(
        "item_id", "m", "width", shingles_of(F.col("w"), F.col("width")).alias("shingles")
    )
    return cut.withColumn("fingerprint", simhash(F.col("shingles")))


def window_starts(hits: DataFrame) -> DataFrame:
    """``doc_id, m, width, start``: the shingles (``doc_id, m, width, p``) where a window of ``m`` words is worth a look.

    A window is similar only if it holds three quarters of its size in shingles of items (repeated ones count at each place), and
    one whose shingles all lie in the window before cannot be more similar than that. Both follow from the running
    number of shingles up to each window's end.
    """
    runs = F.col("m") - F.col("width") + 1
    ends = F.array(F.struct(F.col("p").alias("at"), F.lit(0).alias("end")), F.struct((F.col("p") + runs - 1).alias("at"), F.lit(1).alias("end")))
    one = Window.partitionBy("doc_id", "m", "width")
    passed = F.sum(1 - F.col("end")).over(one.orderBy("at", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = hits.select("doc_id", "m", "width", "p", F.explode(ends).alias("e")).select("doc_id", "m", "width", "p", "e.at", "e.end")
    counted = counted.withColumn("passed", passed).filter("end = 1")
    inside = F.col("passed") - F.row_number().over(one.orderBy("p")) + 1
    fresh = F.col("passed") > F.coalesce(F.lag("passed").over(one.orderBy("p")), F.lit(0))
    judged = counted.withColumn("enough", 100 * inside >= PERCENT * runs).withColumn("fresh", fresh)
    return judged.filter("enough AND fresh").select("doc_id", "m", "width", F.col("p").alias("start"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item it holds: ``doc_id, item_id, start, similarity, distance``.

    A document holds an item when a window of the item's size (in words; the whole text if that is
    shorter) has a weighted-shingle similarity of 0.75 or more with it and their fingerprints lie
    within the radius. Of several windows the most similar, then the first, is reported. Shingles
    have five words, or all words of a shorter item. Null or wordless texts hold nothing and
    wordless items are held by nothing; rows with a null doc_id are not judged; rows that repeat a doc_id are
    judged as one document; equal items are each reported. Empty tables give no rows; other columns are ignored.
    """
    items = stage(benchmark_items(benchmark), "items")
    places = items.select("m", "width", F.explode("shingles").alias("h")).distinct()
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most five values
    known = stage_lookup(places, "known")
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = None
    for width in widths:
        runs = let(words_of(F.col("text")), _runs(width))
        spread = rows.select("doc_id", F.posexplode(runs).alias("p", "h")).withColumn("width", F.lit(width))
        met = spread.join(known, ["h", "width"]).select("doc_id", "m", "width", "p")
        hits = met if hits is None else hits.unionByName(met)
    if hits is None:
        empty = "doc_id long, item_id long, start int, similarity double, distance int"
        return docs.sparkSession.createDataFrame([], empty)
    starts = stage(window_starts(hits.distinct()), "starts")
    window = F.struct("start", "m", "width")
    laid = stage_lookup(starts.groupBy("doc_id").agg(F.collect_set(window).alias("windows")), "windows")
    begin = F.greatest(F.lit(0), F.least(F.col("v.start"), F.size("w") - F.col("v.m")))
    windows = (
        rows.join(laid, "doc_id").select("doc_id", words_of(F.col("text")).alias("w"), "windows")
        .select("doc_id", "w", F.explode("windows").alias("v"))
        .select("doc_id", begin.alias("start"), "v.m", "v.width", F.slice("w", begin + 1, F.col("v.m")).alias("w"))
        .withColumn("shingles", shingles_of(F.col("w"), F.col("width"))).filter(F.size("shingles") > 0)
    )
    seen = stage(windows.select("doc_id", "start", "m", "shingles", simhash(F.col("shingles")).alias("seen")), "seen")
    keyed = seen.select("doc_id", "start", "m", "seen", F.explode(_blocks(F.col("seen"), False)).alias("e")).select("*", "e.*").drop("e")
    index = items.select("item_id", "m", "fingerprint", F.explode(_blocks(F.col("fingerprint"), True)).alias("e")).select("*", "e.*").drop("e")
    distance = F.bit_count(F.col("seen").bitwiseXOR(F.col("fingerprint")))
    candidates = (
        keyed.join(index, ["m", "block", "value"]).withColumn("distance", distance).filter(F.col("distance") <= RADIUS)
        .select("doc_id", "start", "m", "item_id", "distance").distinct()
    )
    both = candidates.join(seen.drop("seen"), ["doc_id", "start", "m"]).join(
        items.select("item_id", F.col("shingles").alias("wanted")), "item_id"
    )
    counted = both.withColumn("common", overlap(F.col("shingles"), F.col("wanted")))
    total = F.size("shingles") + F.size("wanted") - F.col("common")
    similar = counted.withColumn("total", total).filter(100 * F.col("common") >= PERCENT * F.col("total"))
    best = F.max(F.struct((F.col("common") / F.col("total")).alias("similarity"), (-F.col("start")).alias("s"), (-F.col("distance")).alias("d")))
    return similar.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.s")).cast("int").alias("start"), "b.similarity", (-F.col("b.d")).cast("int").alias("distance")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; rows with a null doc_id stay."""
    dirty = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(stage_lookup(dirty, "dirty"), "doc_id", "left_anti").select(*docs.columns)
