"""Packing token sequences by column generation for the cutting-stock problem.

Documents longer than a sequence are cut into full sequences and one rest. The rests form a
histogram over length classes, exact where rounding would waste most. A linear program over patterns (how many pieces of each class one
sequence takes) is solved by the simplex method; new patterns are priced by an unbounded knapsack
dynamic program on the dual values. The rounded pattern counts are then assigned to the ranked
pieces by arithmetic on their rank. Only the histogram, whose size is bounded by the number of
classes, reaches the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import stage, tokenizer_path, word_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
BUCKET_ROWS = 4096
LEAST_BUCKETS = 8


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences, each with ``counts[class]`` pieces of every class."""

    counts: dict[int, int]
    times: int


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes within the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            worth = best[c - sizes[:n]] + values[:n]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], choice[c] = worth[k], k
    taken, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            taken[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), taken


def solve_lp(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3):
    """Fractional pattern counts that cover the demand with (nearly) the fewest sequences.

    Revised simplex from one-class patterns. It ends when no pattern prices in, or when the dual
    bound shows that the value is within ``gap`` of the optimum.
    """
    m = len(sizes)
    columns = np.diag(np.floor(capacity / sizes))
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    bound = 0.0
    while True:
        duals = inverse.sum(axis=0)
        value, column = _best_pattern(sizes, np.maximum(duals, 0.0), capacity)
        bound = max(bound, x.sum() / max(value, 1.0))
        if value <= 1 + 1e-9 or x.sum() <= (1 + gap) * bound:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1.0), np.inf)
        row = int(ratio.argmin())
        step = ratio[row]
        if not np.isfinite(step):
            break
        pivot = inverse[row] / direction[row]
        inverse -= np.outer(direction, pivot)
        inverse[row] = pivot
        x = np.maximum(x - step * direction, 0.0)
        x[row] = step
        columns[:, row] = column
    return [(x[k], columns[:, k].astype(np.int64)) for k in range(m) if x[k] > 1e-9]


def patterns(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Integer patterns that take every piece of the histogram (class size -> pieces) exactly once.

    Fractional counts are rounded down; what is left over (a bounded number of pieces, whatever the
    input) is packed first-fit decreasing.
    """
    rest = {c: int(n) for c, n in sorted(histogram.items()) if n > 0}
    if not rest:
        return []
    unit = math.gcd(capacity, *rest)  # whole grains make the knapsack that much smaller
    sizes, demand = np.array(list(rest)), np.array(list(rest.values()), dtype=float)
    out = []

    def take(counts: dict[int, int], times: int) -> None:
        times = min([times, *(rest[c] // k for c, k in counts.items())])
        if times > 0:
            out.append(Pattern(counts, times))
            for c, k in counts.items():
                rest[c] -= k * times

    for x, column in sorted(solve_lp(sizes // unit, demand, capacity // unit), key=lambda p: -p[0]):
        take({int(sizes[k]): int(column[k]) for k in np.flatnonzero(column)}, int(x + 1e-6))
    while any(rest.values()):
        counts, room = {}, capacity
        for c in sorted(rest, reverse=True):
            if k := min(rest[c], room // c):
                counts[c], room = k, room - k * c
        take(counts, max(1, min(rest[c] // k for c, k in counts.items())))
    return out


def length_classes(counts: dict[int, int], grain: int, share: float) -> dict[int, int]:
    """The class of every length: the next multiple of ``grain``, or the length itself where rounding up would waste most.

    Lengths are kept exact in the order of what their rounding wastes, until the rest adds at most ``share`` of all ids.
    """
    allowed = share * sum(length * n for length, n in counts.items())
    waste = {length: -length % grain * n for length, n in counts.items()}
    left, classes = sum(waste.values()), {}
    for length in sorted(counts, key=lambda x: (-waste[x], x)):
        classes[length] = length if left > allowed else length + -length % grain
        left -= waste[length] if left > allowed else 0
    return classes


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Tokenise every text once, close it with ``end_id`` and cut it every ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer_path(vocabulary))
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encoder.ids(text.as_py() or "") + end)
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", *, end_id: int = 1, capacity: int = 2048, grain: int = 16, waste: float = 0.01
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Every id
    lies in exactly one piece and a sequence holds its pieces gapless from offset 0. Rests are packed
    by their length rounded up to ``grain``, but exact lengths where rounding wastes most, until it adds at most ``waste`` of
    all ids; so the linear program has some capacity / grain rows, and never more than there are lengths.
    A null text is empty, so its document is the single end id. Rows that repeat a ``doc_id`` (or have a null one)
    are packed each on its own; ties rank by doc_id, start, checksum and length, and rows equal in all of these are
    interchangeable. An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = stage(cut_pieces(docs, vocabulary, end_id, capacity), "pieces")
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    size_of = {length: min(size, capacity) for length, size in length_classes(lengths, grain, waste).items()}
    histogram: dict[int, int] = {}
    for length, size in sorted(size_of.items()):
        histogram[size] = histogram.get(size, 0) + lengths[length]
    full = histogram.pop(capacity, 0)
    plan = ([Pattern({capacity: 1}, full)] if full else []) + patterns(histogram, capacity)
    rows, sequence, ranks = [], 0, dict.fromkeys([*histogram, capacity], 0)
    for pattern in plan:
        slot = 0
        for c, k in sorted(pattern.counts.items(), reverse=True):
            rows.append((c, ranks[c], ranks[c] + k * pattern.times, k, sequence, slot))
            ranks[c] += k * pattern.times
            slot += k
        sequence += pattern.times
    # one row per class and pattern, and one per length: bounded by the capacity
    shares = spark.createDataFrame(rows, "size int, first long, beyond long, each long, base long, slot long")
    histogram[capacity] = full
    spread = spark.createDataFrame(
        [(length, c, max(LEAST_BUCKETS, -(-histogram[c] // BUCKET_ROWS))) for length, c in size_of.items()], "length long, size int, buckets long"
    )
    # a class may hold most pieces: rank inside hashed buckets, then add the sizes of the buckets before
    mark = F.xxhash64("doc_id", "start", "ids_crc32")
    bucketed = cut.join(F.broadcast(spread), "length").withColumn("bucket", F.pmod(mark, F.col("buckets"))).drop("buckets")
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        bucketed.groupBy("size", "bucket").agg(F.count("*").alias("n"))
        .select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    )
    inside = Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        bucketed.withColumn("rank", F.row_number().over(inside) - 1)
        .join(buckets, ["size", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("skipped"))
    )
    share = F.col("rank") - F.col("first")
    placed = (
        ranked.join(F.broadcast(shares), "size")
        .filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond")))
        .withColumn("sequence_id", (F.col("base") + F.floor(share / F.col("each"))).cast("long"))
        .withColumn("slot", F.col("slot") + share % F.col("each"))
    )
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset"),
    )
