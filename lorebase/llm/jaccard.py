"""N-gram Jaccard join by a token-group matrix.

Similar documents share a group (size band and min-hash over frequent shingles). The matrix says which
groups hold which token; of each document only the prefix counts, its rarest tokens, four of which any
similar document must share. A document opens the groups whose union holds enough of its prefix. Two groups that open
each other are compared in tiles: the union of tokens of one side bounds the overlap of every document of the
other, and only documents within the bound are compared, exactly. Links become connected components.

Tokens travel packed, as arrays of one bucket of the hash space, so a shuffle row holds thousands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import release, small_batches, stage, stage_lookup
from lorebase.llm.components import components

WIDTH, PERCENT = 5, 75
BUCKET_BYTES = 8 << 20  # of text, about 1.3 million tokens
FLUSH = 1_000_000  # tokens that a task holds before it hands on its buckets
FREQUENT = 1 << 19  # most tokens in the list of frequent ones; bounds what is broadcast to 6 MB
BLOOM_BITS, BLOOM_CHUNKS = 26, 256  # 8 MB; a full filter lets more sets through, never fewer
TILE_DOCS, TILE_TOKENS = 512, 1_000_000
EXPAND = 4_000_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of an ASCII-lowered text; shorter texts are one shingle."""
    words = (text or "").encode().lower().split()  # on bytes both touch ASCII only
    if not words:
        return np.array([], dtype=np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - WIDTH + 1
    rolled = h[:n] * _FACTORS[0]
    for k in range(1, WIDTH):
        rolled += h[k : k + n] * _FACTORS[k]
    return np.unique(_mix(rolled))


def needed(size: int) -> int:
    """Least overlap of a set of this size with any similar set."""
    return -(-PERCENT * size // 100)


SHARED = 4  # prefix tokens that similar sets must share; longer prefixes pay for asking more than one


def shared_at_least(size: float) -> int:
    """Prefix tokens that a set of at least this size shares with any similar set (which has 0.75 of its size or more)."""
    return max(1, min(SHARED, math.ceil(PERCENT * PERCENT * size / 10_000 - 1e-6)))


def _packed(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Leading hash bits: the bucket (of a power of two) above, the next 32 bits below; the order stays."""
    return tokens >> np.uint64(32 - (buckets.bit_length() - 1))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _by_bucket(packed: np.ndarray, *others: np.ndarray) -> Iterator[tuple]:
    """Cuts parallel arrays into one row per bucket: (bucket, low bits, ...) as bytes."""
    order = np.argsort(packed)
    packed = packed[order]
    bucket = (packed >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    low = (packed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    columns = [low, *(o[order] for o in others)]
    for a, b in zip([0, *cuts], [*cuts, len(packed)], strict=True):
        if b > a:
            yield (int(bucket[a]), *(c[a:b].tobytes() for c in columns))


def _joined(table: pa.Table, name: str, dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype=dtype) for x in table.column(name)]
    return np.concatenate(parts) if parts else np.array([], dtype=dtype)


def frequent_tokens(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens with their document frequencies, at most FREQUENT of them.

    Counted over all documents. The list only orders tokens and picks groups, so its bound costs no link.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            rows = list(_by_bucket(np.concatenate(held)))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "tokens"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if doc_id.is_valid:
                    found = _packed(shingles(text.as_py()), buckets)
                    held.append(found)
                    size += len(found)
                    if size > FLUSH:
                        yield flush()
                        held, size = [], 0
        if size:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        tokens, counts = np.unique(_joined(table, "tokens", np.uint32), return_counts=True)
        again = counts > 1
        tokens, counts = tokens[again].astype(np.uint64) | np.uint64(bucket << 32), counts[again].astype(np.int64)
        at_least = [int((counts >= 1 << k).sum()) for k in range(48)]
        return pa.table({"tokens": [tokens.tobytes()], "counts": [counts.tobytes()], "at_least": [at_least]}, schema=schema)

    schema = pa.schema([("tokens", pa.binary()), ("counts", pa.binary()), ("at_least", pa.list_(pa.int64()))])
    counted = stage(
        _texts(docs).mapInArrow(emit, "bucket long, tokens binary").groupBy("bucket")
        .applyInArrow(count, "tokens binary, counts binary, at_least array<long>"), "frequencies",
    )
    totals = dict(counted.select(F.posexplode("at_least")).groupBy("pos").agg(F.sum("col")).collect())
    least = 1 << next((k for k in range(1, 48) if totals.get(k, 0) <= FREQUENT), 47)

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, c in zip(batch.column(0), batch.column(1), strict=True):
                counts = np.frombuffer(c.as_buffer(), dtype=np.int64)
                keep = counts >= least
                rows.append((np.frombuffer(t.as_buffer(), dtype=np.uint64)[keep].tobytes(), counts[keep].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows, strict=True)], ["tokens", "counts"])

    rows = counted.select("tokens", "counts").mapInArrow(most, "tokens binary, counts binary").collect()
    tokens = np.frombuffer(b"".join(bytes(r.tokens) for r in rows), dtype=np.uint64)
    counts = np.frombuffer(b"".join(bytes(r.counts) for r in rows), dtype=np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _group(size: int, least: int) -> int:
    """Group of a set: size band (6 bits) and min-hash (26 bits)."""
    band = min(63, int(math.log(size) / math.log(100 / PERCENT)))
    return band << 26 | (least * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 38


def _prefix_and_group(tokens: np.ndarray, buckets: int, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The packed prefix (rarest tokens first, then by hash) and the group."""
    packed, size = _packed(tokens, buckets), len(tokens)
    length = min(size, size - needed(size) + min(SHARED, needed(size)))
    if not len(frequent):
        return packed[:length], _group(size, int(packed[0]))
    at = np.minimum(np.searchsorted(frequent, packed), len(frequent) - 1)  # tokens are sorted by hash
    known = frequent[at] == packed
    rare, common = np.flatnonzero(~known)[:length], np.flatnonzero(known)
    if not len(common):
        return packed[rare], _group(size, int(packed[0]))
    group = _group(size, int(packed[common[0]]))  # min-hash over frequent tokens: what near copies share
    if len(rare) < length:
        rarest = common[np.argsort(counts[at[common]], kind="stable")]
        rare = np.concatenate([rare, rarest[: length - len(rare)]])
    return packed[rare], group


def matrix_pairs(docs: DataFrame, buckets: int, frequent) -> DataFrame:
    """Meets documents and groups in the matrix: prefix tokens of the document that the group's union holds, by bucket of the hash space.

    Packed by buckets of the document: ``bucket, ids, own, partner, counts`` (own group, met group, tokens).
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            prefix = np.concatenate([p for p, _, _ in held])
            ids = np.concatenate([np.full(len(p), i, dtype=np.int64) for p, i, _ in held])
            groups = np.concatenate([np.full(len(p), g, dtype=np.uint32) for p, _, g in held])
            columns = list(zip(*_by_bucket(prefix, ids, groups), strict=True))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "tokens", "ids", "groups"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = shingles(text.as_py()) if doc_id is not None else ()
                if len(tokens):
                    prefix, group = _prefix_and_group(tokens, buckets, known, counts)
                    held.append((prefix, doc_id, group))
                    size += len(prefix)
                    if size > FLUSH:
                        yield flush()
                        held, size = [], 0
        if size:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        tokens, ids, groups = (_joined(table, n, t) for n, t in (("tokens", np.uint32), ("ids", np.int64), ("groups", np.uint32)))
        order = np.lexsort((ids, groups, tokens))
        tokens, ids, groups = tokens[order], ids[order], groups[order]
        fresh = np.ones(len(tokens), dtype=bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1]) | (groups[1:] != groups[:-1])
        tokens, ids, groups = tokens[fresh], ids[fresh], groups[fresh]
        shared = np.zeros(len(tokens), dtype=bool)
        same = tokens[1:] == tokens[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        tokens, ids, groups = tokens[shared], ids[shared], groups[shared]
        # cells of the matrix: one per token and group, with the documents that put it there
        starts = np.ones(len(tokens), dtype=bool)
        starts[1:] = (tokens[1:] != tokens[:-1]) | (groups[1:] != groups[:-1])
        cell = np.flatnonzero(starts)
        held = np.diff(np.append(cell, len(tokens)))
        run, group = tokens[cell], groups[cell]
        band = (group >> np.uint32(26)).astype(np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def opens(cells: np.ndarray, partner: np.ndarray) -> None:
            """The documents of each cell open the partner's group."""
            n = held[cells]
            at = np.repeat(cell[cells] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            rows = np.rec.fromarrays([ids[at], groups[at], np.repeat(partner, n)], names="id,own,partner")
            found.append(np.unique(rows, return_counts=True))

        twice = np.flatnonzero(held > 1)  # a group meets itself where two of its documents share the token
        opens(twice, group[twice])
        step = 1
        while step < len(run):
            met = np.flatnonzero(run[step:] == run[:-step])
            if not len(met):
                break
            met = met[np.abs(band[met] - band[met + step]) <= 1]
            opens(met, group[met + step])
            opens(met + step, group[met])
            step += 1
        rows, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([f[1] for f in found]), minlength=len(rows)).astype(np.int32)
        ids, own, partner = (np.ascontiguousarray(rows[n]) for n in ("id", "own", "partner"))
        bucket = (_mix(ids.view(np.uint64)) % np.uint64(buckets)) << np.uint64(32)
        cut = list(_by_bucket(bucket, ids, own, partner, counts))
        columns = [[r[k] for r in cut] for k in (0, 2, 3, 4, 5)]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("bucket", "ids", "own", "partner", "counts"), columns, kinds, strict=True)})

    rows = _texts(docs).mapInArrow(emit, "bucket long, tokens binary, ids binary, groups binary")
    return rows.groupBy("bucket").applyInArrow(meet, "bucket long, ids binary, own binary, partner binary, counts binary")


def openings(met: DataFrame) -> DataFrame:
    """``doc_id, own, partner`` of every group that a document opens: it shares enough prefix tokens with the group's union."""
    least = np.array([shared_at_least((100 / PERCENT) ** band) for band in range(64)])

    def add_up(table: pa.Table) -> pa.Table:
        keys = np.rec.fromarrays(
            [_joined(table, n, t) for n, t in (("ids", np.int64), ("own", np.uint32), ("partner", np.uint32))], names="doc_id,own,partner"
        )
        rows, where = np.unique(keys, return_inverse=True)
        counts = np.bincount(where, weights=_joined(table, "counts", np.int32), minlength=len(rows))
        rows = rows[counts >= least[(rows["own"] >> np.uint32(26)).astype(np.int64)]]
        return pa.table({n: pa.array(np.ascontiguousarray(rows[n]).astype(np.int64)) for n in rows.dtype.names})

    return met.groupBy("bucket").applyInArrow(add_up, "doc_id long, own long, partner long")


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Two places per document in a filter of 2 ** bits bits."""
    h = _mix(ids.astype(np.int64).view(np.uint64))
    shift = np.uint64(64 - bits)
    return np.concatenate([h >> shift, (h << np.uint64(bits)) >> shift]).astype(np.int64)


def _bloom(opened: DataFrame) -> np.ndarray:
    """Bits of the documents that open a group; made in chunks on the executors, 8 MB in all."""
    size, chunks = BLOOM_BITS, BLOOM_CHUNKS
    per_chunk = (1 << size) // chunks

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_places(batch.column(0).to_numpy(zero_copy_only=False), size))
            chunk = bits // per_chunk
            cuts = np.searchsorted(chunk, np.arange(chunks + 1))
            rows = [(c, bits[a:b].tobytes()) for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "bits"]
            )

    def fill(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        flags = np.zeros(per_chunk, dtype=np.uint8)
        flags[_joined(table, "bits", np.int64) - chunk * per_chunk] = 1
        return pa.table({"chunk": [chunk], "bits": [np.packbits(flags).tobytes()]})

    parts = opened.select("doc_id").mapInArrow(emit, "chunk long, bits binary").groupBy("chunk").applyInArrow(fill, "chunk long, bits binary")
    out = np.zeros((1 << size) // 8, dtype=np.uint8)
    for row in parts.collect():
        out[row.chunk * per_chunk // 8 : (row.chunk + 1) * per_chunk // 8] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return out


SETS = "doc_id long, n_shingles long, sign_a long, sign_b long, grp long, tokens binary"


def document_sets(docs: DataFrame, buckets: int, frequent, bloom) -> DataFrame:
    """Size, 128-bit signature and group of every document; the set itself only where it may have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        bits = bloom.value
        size = (len(bits) * 8).bit_length() - 1
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = shingles(text.as_py())
                if doc_id is None or not len(tokens):
                    rows.append((doc_id, len(tokens), None, None, None, None))
                    continue
                data = tokens.tobytes()
                sign = xxhash.xxh3_128_intdigest(data)
                place = _places(np.array([doc_id], dtype=np.int64), size)
                partner = bool(np.all(bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1))
                group = _prefix_and_group(tokens, buckets, known, counts)[1] if partner else None
                signs = ((sign >> 64) - (1 << 63), (sign & (1 << 64) - 1) - (1 << 63))
                rows.append((doc_id, len(tokens), *signs, group, data if partner else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_shingles", "sign_a", "sign_b", "grp", "tokens"]
            )

    return _texts(docs).mapInArrow(run, SETS)


def open_tile(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, alone: bool) -> list[tuple[int, int]]:
    """Links inside one tile as a spanning forest of (doc_id, smaller doc_id).

    Side 0 is compared with side 1, or with itself when the tile is ``alone``.
    """
    left = np.flatnonzero(side == 0)
    right = left if alone else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return []
    sizes = np.array([len(s) for s in sets])
    least = -(-PERCENT * sizes // 100)

    def bounded(members: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Members whose overlap with the union of the others' tokens can reach similarity."""
        tokens, owner = np.concatenate([sets[k] for k in members]), np.repeat(np.arange(len(members)), sizes[members])
        if alone:  # a document's own tokens are in the union; what counts is who else has them
            values, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            inside = counts[inverse] > 1
        else:
            union = np.unique(np.concatenate([sets[k] for k in others]))
            at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
            inside = union[at] == tokens
        return members[np.bincount(owner, weights=inside, minlength=len(members)) >= least[members]]

    left, right = bounded(left, right), (None if alone else bounded(right, left))
    right = left if alone else right
    if not len(left) or not len(right):
        return []
    a_tokens, a_owner = np.concatenate([sets[k] for k in left]), np.repeat(np.arange(len(left)), sizes[left])
    b_tokens, b_owner = np.concatenate([sets[k] for k in right]), np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(b_tokens, kind="stable")
    b_tokens, b_owner = b_tokens[order], b_owner[order]
    low, high = np.searchsorted(b_tokens, a_tokens, "left"), np.searchsorted(b_tokens, a_tokens, "right")
    widths = high - low
    overlap = np.zeros(len(left) * len(right), dtype=np.int64)
    ends = np.cumsum(widths)
    start = 0
    while start < len(widths):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + EXPAND, "right")))
        w = widths[start:stop]
        if total := int(w.sum()):
            within = np.arange(total) - np.repeat(np.cumsum(w) - w, w)
            other = b_owner[np.repeat(low[start:stop], w) + within]
            overlap += np.bincount(np.repeat(a_owner[start:stop], w) * len(right) + other, minlength=len(overlap))
        start = stop
    overlap = overlap.reshape(len(left), len(right))
    union = sizes[left][:, None] + sizes[right][None, :] - overlap
    i, j = np.nonzero(100 * overlap >= PERCENT * union)
    return _forest(ids[left[i]], ids[right[j]])


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Links (node, smallest node of its part) that connect what u-v links connect."""
    if not len(u):
        return []
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        following = label.copy()
        np.minimum.at(following, a, least)
        np.minimum.at(following, b, least)
        following = following[following]
        if (following == label).all():
            break
        label = following
    return [(int(nodes[k]), int(nodes[label[k]])) for k in np.flatnonzero(label != np.arange(len(nodes)))]


def links(sets: DataFrame, opened: DataFrame) -> DataFrame:
    """Links ``u, v`` between representatives of different sets.

    A document is compared with those documents of a group it opens that open its own group. The two
    sides of a pair of groups are cut into parts of bounded size; a tile is one part against another.
    """

    own, partner = F.col("own"), F.col("partner")
    opened = stage(
        opened.join(sets.select("doc_id", "n_shingles"), "doc_id").select(
            "doc_id", "n_shingles", F.least(own, partner).alias("low"), F.greatest(own, partner).alias("high"), (own > partner).cast("int").alias("side")
        ), "opened",
    )
    sizes = opened.groupBy("low", "high", "side").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("tokens"))
    parts = F.ceil(F.greatest(F.col("n") / TILE_DOCS, F.col("tokens") / TILE_TOKENS)).cast("int")
    sizes = sizes.select("low", "high", "side", parts.alias("parts")).groupBy("low", "high").agg(
        F.max(F.when(F.col("side") == 0, F.col("parts"))).alias("p"), F.max(F.when(F.col("side") == 1, F.col("parts"))).alias("q")
    )
    itself = F.col("low") == F.col("high")
    mine = F.when(F.col("side") == 0, F.col("p")).otherwise(F.col("q"))
    others = F.when(itself | (F.col("side") == 1), F.col("p")).otherwise(F.col("q"))
    spread = (
        opened.drop("n_shingles").join(stage_lookup(sizes.filter("low = high OR (p > 0 AND q > 0)"), "sizes"), ["low", "high"])
        .withColumn("x", F.pmod(F.xxhash64("doc_id"), mine).cast("int"))
        .withColumn("y", F.explode(F.sequence(F.lit(0), others - 1)))
        .withColumn("swap", F.when(itself, F.col("x") > F.col("y")).otherwise(F.col("side") == 1))
    )
    first, second = F.when(F.col("swap"), F.col("y")).otherwise(F.col("x")), F.when(F.col("swap"), F.col("x")).otherwise(F.col("y"))
    placed = spread.select(
        "doc_id", F.xxhash64("low", "high", first, second).alias("tile"), F.col("swap").cast("int").alias("side"),
        (itself & (F.col("x") == F.col("y"))).alias("alone"),
    )
    members = sets.select("doc_id", "tokens").join(stage_lookup(placed, "placed"), "doc_id")

    def run(table: pa.Table) -> pa.Table:
        found = open_tile(
            np.array(table.column("doc_id").to_pylist(), dtype=np.int64),
            [np.frombuffer(t.as_buffer(), dtype=np.uint64) for t in table.column("tokens")],
            np.array(table.column("side").to_pylist()), table.column("alone")[0].as_py(),
        )
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return members.groupBy("tile").applyInArrow(run, "u long, v long")


def join(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Two documents link when the Jaccard similarity of their shingle sets is 0.75 or more;
    ``component_id`` is the smallest doc_id reachable, itself included. A null or wordless text has an
    empty set and links with nothing. Rows with a null doc_id get a null component and link with
    nothing; rows that repeat a doc_id are one document whose links add up. Equal sets are collapsed to one
    before any comparison. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    buckets = 1 << (buckets - 1).bit_length()
    with small_batches(spark):
        frequent = spark.sparkContext.broadcast(frequent_tokens(docs, buckets))
        opened = stage(openings(stage(matrix_pairs(docs, buckets, frequent), "met")), "openings")
        release(spark)
        bloom = spark.sparkContext.broadcast(_bloom(opened))
        sets = stage(document_sets(docs, buckets, frequent, bloom), "sets")
    signs = ["sign_a", "sign_b", "n_shingles"]
    named = sets.filter("sign_a IS NOT NULL")
    copies = stage_lookup(
        named.groupBy(*signs).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copies"
    )
    first = F.coalesce("first", "doc_id")
    narrow = sets.drop("tokens", "grp").join(copies, signs, "left").select("doc_id", "n_shingles", first.alias("first"))
    distinct = sets.filter("tokens IS NOT NULL").join(copies, signs, "left").filter(F.col("doc_id") == first)
    found = links(distinct.select("doc_id", "n_shingles", "tokens"), opened)
    repeated = narrow.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("first").alias("u"), F.max("first").alias("v")).filter("u < v")
    parts = components(found.unionByName(repeated.select("u", "v")))
    return narrow.join(stage(parts, "components").withColumnRenamed("node", "first"), "first", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id")
    )
