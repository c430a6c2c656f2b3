"""Vector columns: the default hash embedding and similarity."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase.functions.text import let, words


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """Counts of word hashes modulo ``dims``, L2-normalised (zero vector stays zero).

    The bucket of a word is the first four digest bytes, big-endian. Buckets are sorted together with one entry for each of them,
    so the lengths of the runs, less one, are the counts of all buckets in order, whatever their number.
    """

    def counts(slots: Column) -> Column:
        n = F.size(slots)
        heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(slots, i) != F.get(slots, i - 1)))
        return let(heads, lambda h: F.transform(h, lambda p, k: (F.coalesce(F.get(h, k + 1), n) - p - 1).cast("double")))

    slots = F.transform(
        words(text),
        lambda w: (F.conv(F.left(F.sha2(w, 256), F.lit(8)), 16, 10).cast("long") % dims).cast("int"),
    )
    every = F.when(text.isNotNull(), F.sequence(F.lit(0), F.lit(dims - 1)))
    return let(F.sort_array(F.concat(slots, every)), lambda s: let(counts(s), unit))


def hash_embedding_of(tokens: Column, dims: int = 64) -> Column:
    """:func:`hash_embedding` of an array of words. A batch hashes each of its distinct words once and counts buckets of all rows together."""

    @F.arrow_udf("array<double>")
    def embed(held: pa.Array) -> pa.Array:
        known = pc.dictionary_encode(held.flatten())
        slots = np.array([int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") % dims for w in known.dictionary.to_pylist()], dtype=np.int64)
        sizes = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(held)), sizes)
        counts = np.bincount(rows * dims + slots[known.indices.to_numpy()], minlength=len(held) * dims).reshape(len(held), dims).astype(float)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        values = pa.array((counts / np.where(length == 0, 1.0, length)).ravel())
        offsets = pa.array(np.arange(len(held) + 1) * dims, pa.int32())
        return pa.ListArray.from_arrays(offsets, values, mask=held.is_null()) if held.null_count else pa.ListArray.from_arrays(offsets, values)

    return embed(tokens)


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    return let(
        norm(vector),
        lambda n: F.transform(
            vector, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)
        ),
    )
