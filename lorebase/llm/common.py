"""Helpers shared by the corpus operators: staged tables and memoised tokenizers."""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.session import shared_dir


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the folder that all executors share and read it again.

    This cuts the lineage, survives lost executors, and gives later joins the true size.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_lookup(df: DataFrame, purpose: str, limit: int = 32 << 20) -> DataFrame:
    """Stage a lookup table; where its files measure at most ``limit`` bytes, a join broadcasts it.

    Beyond the limit the same join shuffles both sides, so nothing unbounded is ever broadcast.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    staged = spark.read.schema(df.schema).parquet(path)
    return F.broadcast(staged) if size <= limit else staged


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are staged; it does so when their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Arrow batches of few rows for the jobs that run inside; long texts then fill less memory outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# fixed value: the pre-tokens of a tokenizer whose letter runs and punctuation runs never merge, after it lowers the text
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS_THEN_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*#$%&<>()\"-]*)").fullmatch


def _letters_apart(tokenizer) -> bool:
    """Whether the tokenizer lowers texts and keeps letters and punctuation apart."""
    config = json.loads(tokenizer.to_str())
    steps = [n["type"] for n in (config["normalizer"] or {}).get("normalizers", [])]
    first = ((config["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    return steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first["pattern"] == {"Regex": LETTERS_APART}


class WordIds:
    """Token ids of whole texts for a tokenizer that drops white space between its pieces.

    Such a tokenizer never merges across white space, so the ids of a text are those of its words
    in order. Words are memoised, and so are their parts where the tokenizer lowers words and splits punctuation off. Each memory
    is bounded in bytes; when one is full, its later half goes, as frequent words are met first.
    """

    ENTRY = 180  # bytes of a string, a bytes object and their place in the dictionary, without their content

    def __init__(self, path: str, limit: int = 144 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut, self.merges = _letters_apart(self.tokenizer), self.tokenizer.model
        self.separators, self.plain_words = re.compile("[\x1c-\x1f]").search, re.compile(r"[^ \t\n\r]+").findall
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.limits, self.sizes = (limit // 3, limit - limit // 3), [0, 0]

    def words(self, text: str) -> list[str]:
        """Pieces between white space; U+001C-1F separate for str.split() but not for tokenizers."""
        return self.plain_words(text) if self.separators(text) else text.split()

    def _learn(self, words: set[str]) -> None:
        cut = []
        for word in words:
            match = LETTERS_THEN_MARKS(word) if self.cut else None
            cut.append((word, match[1].lower(), match[2]) if match else (word, word, ""))
        fresh = {p for _, *parts in cut for p in parts if p}.difference(self.parts)
        # lowered ASCII letters are one pre-token as they stand: the merges alone apply
        plain = [p for p in fresh if p.isascii() and p.isalpha() and p.islower()] if self.cut else []
        other = list(fresh.difference(plain))
        merged = self.merges.tokenize
        ids = [array("I", [t.id for t in merged(p)]).tobytes() for p in plain]
        ids += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        new = plain + other
        self.parts.update(zip(new, ids, strict=True))
        self.sizes[1] += self.ENTRY * len(new) + sum(map(len, new)) + sum(map(len, ids))
        known, parts, held = self.known, self.parts, 0
        for word, letters, marks in cut:
            whole = parts[letters] + parts[marks] if marks else parts[letters]
            known[word] = whole
            held += len(word) + len(whole)
        self.sizes[0] += self.ENTRY * len(cut) + held

    def _halved(self, which: int, memory: dict[str, bytes]) -> dict[str, bytes]:
        while memory and self.sizes[which] > self.limits[which]:
            memory = dict(islice(memory.items(), len(memory) // 2))
            self.sizes[which] = self.ENTRY * len(memory) + sum(map(len, memory)) + sum(map(len, memory.values()))
        return memory

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words = self.words(text)
        if new := set(words).difference(self.known):
            self._learn(new)
        joined = b"".join(map(self.known.__getitem__, words))
        self.known, self.parts = self._halved(0, self.known), self._halved(1, self.parts)
        return joined


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """One tokenizer per Python worker."""
    return WordIds(path)
