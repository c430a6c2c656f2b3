"""Token counts by byte-pair merging, without building any token id.

A pre-token starts as one symbol per byte. Adjacent pairs that have a merge rank wait in a heap;
the lowest rank is popped, leftmost first, and joins two neighbours of a doubly linked list. The
number of tokens is the number of initial symbols minus the number of merges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import tokenizer_path

# Fixed values of byte-level BPE: the split pattern and the printable stand-ins of bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same split for texts of ASCII and Latin letters only, where plain character classes say the same.
SIMPLE = r"[\t-\r -~À-ÖØ-öø-ɏ]*"
SPLIT_SIMPLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\s0-9A-Za-zÀ-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+"""
PRINTABLE = (range(33, 127), range(161, 173), range(174, 256))


def _byte_symbols() -> list[str]:
    """The stand-in character of every byte value: itself if printable, else the next from 256 on."""
    plain = {b for span in PRINTABLE for b in span}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts tokens of texts under the merge ranks of a tokenizer file.

    Counts of pre-tokens are memoised up to ``limit`` entries (then the memory starts anew), so the
    memory of a worker is bounded. Pre-tokens over ``longest`` bytes are never kept.
    """

    def __init__(self, path: str, limit: int = 1_000_000, longest: int = 64):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbol: dict[str, int] = {}
        number = symbol.setdefault
        self.first = [number(s, len(symbol)) for s in _byte_symbols()]
        self.ranks: dict[int, int] = {}  # left and right symbol in one key
        self.joined: list[int] = []  # by rank
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = (number(s, len(symbol)) for s in (left, right, left + right))
            self.ranks.setdefault(a << 20 | b, rank)
            self.joined.append(c)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if self.special else None
        self.split = regex.compile(SPLIT).findall
        self.simple, self.split_simple = re.compile(SIMPLE).fullmatch, re.compile(SPLIT_SIMPLE).findall
        self.limit, self.longest = limit, longest
        self.known: dict[str, int] = {}

    def count_bytes(self, data: bytes) -> int:
        """Symbols left after all merges of one pre-token."""
        n = len(data)
        symbols = [self.first[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, joined, merges = self.ranks.get, self.joined, 0
        # heap entries: rank and left position in one integer, so the lowest rank pops leftmost first
        heap = [
            rank << 32 | i
            for i in range(n - 1)
            if (rank := rank_of(symbols[i] << 20 | symbols[i + 1])) is not None
        ]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or rank_of(symbols[i] << 20 | symbols[j]) != rank:
                continue  # one of the two has been merged meanwhile
            merges += 1
            whole = symbols[i] = joined[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(whole << 20 | symbols[k])) is not None:
                    heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0 and (rank := rank_of(symbols[h] << 20 | whole)) is not None:
                heappush(heap, rank << 32 | h)
        return n - merges

    def _plain(self, text: str) -> int:
        parts = self.split_simple(text) if self.simple(text) else self.split(text)
        known = self.known
        new = set(parts).difference(known)
        if not new:
            return sum(map(known.__getitem__, parts))
        if len(known) + len(new) > self.limit:
            known.clear()
            new = set(parts)
        found = {p: self.count_bytes(p.encode()) for p in new}
        total = sum([found[p] if p in found else known[p] for p in parts])
        for part, tokens in found.items():
            if len(part) <= self.longest and len(known) < self.limit:
                known[part] = tokens
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; the tokenizer's special strings inside it are one token each."""
        if not text:
            return 0
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        pieces = self.cut(text)
        return len(pieces) - 1 + sum(self._plain(p) for p in pieces if p)


@lru_cache(maxsize=2)
def _counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", budget: int = 512) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit`` (n_tokens > budget).

    Row-local, so nothing is shuffled. A null text counts as empty (0 bytes, 0 tokens); a null
    ``doc_id`` and repeated rows are kept as they are; other columns are ignored. An empty table
    gives an empty table. ``vocabulary`` is the name of a public byte-level BPE file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path(vocabulary))
        for batch in batches:
            tokens = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", size.alias("n_bytes")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > budget)
