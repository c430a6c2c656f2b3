"""Token counts, packing and binary records against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lorebase.llm import packing, records
from lorebase.llm.common import WordIds
from lorebase.llm.tokens import MergeCounter, token_counts

ALPHABET = "aàéßΣσİ'stdmrev \n\t\r  \u0085\x1c\u001fᰀ012٣९²漢字한ᄀ가🙂̀-,.!"
SCHEMA = "doc_id long, text string, n_tokens string, start string"
TEXTS = [
    (1, "Hello world, it's a test."), (2, None), (3, ""), (4, "word " * 3000), (5, "x" * 5000), (None, "no key"),
    (7, "same same"), (7, "same same"), (8, "a<|endoftext|>b <|startoftext|>"), (9, " \n\t "), (7, "other"),
]


def random_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>x"]) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in TEXTS], SCHEMA).repartition(3)


def test_merge_counts_equal_the_library():
    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), MergeCounter(P.path("byte_bpe_50k.json"), limit=50)
    for text in random_texts(3000):
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_word_ids_equal_the_library():
    library, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), WordIds(P.path("word_bpe_49k.json"), limit=50)
    for text in random_texts(3000):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_counts(docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, token_counts(docs).collect()), key=str)
    want = []
    for i, t in TEXTS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)


def encoded(end):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, end]) for i, t in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_pack_covers_every_id_once(docs):
    rows = packing.pack(docs, capacity=256, grain=4).collect()
    want = sorted((str(i), s, len(ids[s:s + 256]), crc(ids[s:s + 256]), len(ids)) for i, ids in encoded(1) for s in range(0, len(ids), 256))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 256 and sorted(ends) == list(range(len(ends)))


@pytest.mark.parametrize("seed", range(4))
def test_patterns_take_every_piece(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(c): int(n) for c, n in zip(rng.choice(np.arange(1, 64), 20, replace=False), rng.integers(1, 400, 20), strict=True)}
    plan = packing.patterns(histogram, 64)
    for size, n in histogram.items():
        assert sum(p.times * p.counts.get(size, 0) for p in plan) == n
    assert all(sum(c * k for c, k in p.counts.items()) <= 64 for p in plan)
    sizes = np.array(sorted(histogram))
    fractional = sum(x for x, _ in packing.solve_lp(sizes, np.array([histogram[c] for c in sizes], float), 64))
    assert sum(p.times for p in plan) <= fractional + len(sizes)


def test_pack_one_length_and_empty(spark, docs):
    same = spark.createDataFrame([(i, "one two three") for i in range(500)], "doc_id long, text string")
    rows = packing.pack(same, capacity=64, grain=4).collect()
    assert len(rows) == 500 and len({r.sequence_id for r in rows}) <= 500 // (64 // 4) + 1
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("words, bound", [((13,), 0.02), ((0,), 0.02), ((1, 2, 5, 13, 40), 0.02), ((1100, 3), 0.03)])
def test_padding_at_production_parameters(spark, words, bound):
    rows = [(i, "one " * words[i % len(words)]) for i in range(9000 if max(words) < 100 else 600)]
    if max(words) == 0:
        rows = [(i, None) for i in range(20480)]
    elif len(words) == 2:  # a long one and many short ones fill each sequence
        rows += [(1000 + i, "one two three four") for i in range(60_000)]
    placed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    ids, sequences = sum(r.length for r in placed), {r.sequence_id for r in placed}
    assert ids == sum(r.doc_tokens for r in placed if r.start == 0) and len(sequences) * 2048 * (1 - bound) <= ids + 2048


def test_exact_classes_bound_the_rounding():
    rng = np.random.default_rng(5)
    for high in (2, 30, 257, 2048):
        lengths, n = np.unique(rng.integers(1, high, 5000), return_counts=True)
        classes = packing.length_classes(dict(zip(lengths.tolist(), n.tolist(), strict=True)), 16, 0.01)
        added = sum((classes[x] - x) * k for x, k in zip(lengths.tolist(), n.tolist(), strict=True))
        assert all(c in (x, -(-x // 16) * 16) for x, c in classes.items()) and 0 <= added <= 0.01 * (lengths * n).sum()


def test_file_order_follows_numbers(spark, monkeypatch):
    names = ["part-99998-a-c000.txt", "part-99999-a-c000.txt", "part-99999-a-c999.txt", "part-99999-a-c1000.txt", "part-100000-a-c000.txt"]
    rows = spark.createDataFrame([(f, 0, 10, k, 1 << k, 0, True) for k, f in enumerate(names)], records.INDEX)
    monkeypatch.setattr(records, "read_frames", lambda *_: rows)
    assert [(r.doc_id, r.start) for r in records.write_index(spark, "").orderBy("doc_id").collect()] == [(k, (1 << k) - 1) for k in range(5)]


def test_records_round_trip(docs):
    rows = records.write_and_read(docs).collect()
    assert all(r.valid for r in rows)
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((str(i), len(x), crc(x)) for i, x in encoded(2))
    total = 0
    for r in rows:
        assert r.start == total
        total += r.n_tokens
    assert records.write_and_read(docs.limit(0)).count() == 0


def test_frames_detect_damage_and_seek():
    data = bytearray(b"".join(records.frame(i, np.arange(i), 2) for i in range(1, 5)))
    offsets, at = [], 0
    while at < len(data):
        offsets.append(at)
        at += records.unframe(memoryview(bytes(data)), at)[0]
    assert records.read_at(bytes(data), offsets[2])[1].tolist() == [0, 1, 2]
    data[offsets[1] + 20] ^= 1
    assert [records.unframe(memoryview(bytes(data)), o)[3] for o in offsets] == [True, False, True, True]
    data[offsets[2]] ^= 1
    size, doc_id, ids, valid = records.unframe(memoryview(bytes(data)), offsets[2])
    assert (size, doc_id, valid) == (len(data) - offsets[2], None, False)
    with pytest.raises(ValueError):
        records.read_at(bytes(data), offsets[1])
