"""Derived artifacts: keywords, questions, summaries, contents, summary trees, transcripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorebase.functions import ids
from lorebase.functions.text import KEYWORD_TOKEN, fold, let, matches, strip

# fixed values: stop words, sentence rule, question templates and limits
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "into", "以及", "一个", "进行")
SENTENCE_END = r"(?<=[。.!?])\s+"
QUESTION_OPEN, QUESTION_CLOSE = "文档对“", "”说明了什么?"
DEFAULT_QUESTION = "该片段的主要信息是什么?"
KEYWORD_LIMIT, QUESTION_LIMIT, SUBJECT_LENGTH, FALLBACK_LENGTH = 10, 5, 72, 80
TREE_LEVELS, TREE_WORDS = 4, 96


def keywords(content: Column, limit: int = KEYWORD_LIMIT) -> Column:
    """``struct<text,keyword_count>``: terms by falling count, then first position, then spelling.

    Positions are those of the full token list, stop words included. A chunk is one row, so the
    counting is an expression on its token array.
    """

    def rank(tokens: Column) -> Column:
        kept = F.filter(F.array_distinct(tokens), lambda t: ~t.isin(*STOP_WORDS))
        counted = F.transform(
            kept,
            lambda t: F.struct(
                (F.size(F.array_remove(tokens, t)) - F.size(tokens)).alias("minus_count"),
                F.array_position(tokens, t).alias("position"),
                t.alias("term"),
            ),
        )
        return F.transform(F.slice(F.array_sort(counted), 1, limit), lambda s: s["term"])

    tokens = F.transform(matches(content, KEYWORD_TOKEN), fold)
    return let(
        let(tokens, rank),
        lambda top: F.struct(
            F.when(F.size(top) > 0, F.array_join(top, "\n")).otherwise(F.substring(content, 1, FALLBACK_LENGTH)).alias("text"),
            F.size(top).alias("keyword_count"),
        ),
    )


def questions(content: Column, limit: int = QUESTION_LIMIT) -> Column:
    """``struct<text,question_count>``: one templated question per distinct leading sentence."""
    sentences = F.filter(F.split(content, SENTENCE_END), lambda s: strip(s) != "")
    asked = F.array_distinct(
        F.transform(
            sentences,
            lambda s: F.concat(
                F.lit(QUESTION_OPEN), F.substring(F.trim(s, F.lit(" 。.!?")), 1, SUBJECT_LENGTH), F.lit(QUESTION_CLOSE)),
        )
    )
    chosen = let(asked, lambda q: F.when(F.size(q) > 0, F.slice(q, 1, limit)).otherwise(F.array(F.lit(DEFAULT_QUESTION))))
    return let(chosen, lambda q: F.struct(F.array_join(q, "\n").alias("text"), F.size(q).alias("question_count")))


def _split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def chunk_summaries(chunks: DataFrame, max_tokens: int) -> DataFrame:
    """First words of every chunk."""
    return chunks.select(
        "chunk_id", "document_version_id", "tenant_id", F.lit("chunk").alias("level"),
        let(_split_words(F.col("content")), lambda w: F.struct(
            F.array_join(F.slice(w, 1, max_tokens), " ").alias("text"),
            F.least(F.size(w), F.lit(max_tokens)).alias("token_count"))).alias("s"),
    ).select("chunk_id", "document_version_id", "tenant_id", "level", F.concat_ws(": ", "level", "s.text").alias("text"), "s.token_count")


def document_summaries(chunks: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """First words over the ordered chunks of a document version, for every level and its budget.

    Only chunks that start within the largest budget can contribute, because every chunk has at
    least one word: what is gathered per document is bounded by that budget however large the
    document is. All levels come from one aggregation.
    """
    key = ["tenant_id", "document_version_id"]
    most = max(budgets.values())
    words = _split_words(F.col("content"))
    part = F.when(F.col("sequence") < most, F.struct("sequence", F.slice("words", 1, most).alias("words")))
    gathered = chunks.select(*key, "sequence", words.alias("words")).groupBy(*key).agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.sum(F.size("words")).alias("all_words"))
    joined = gathered.select(
        *key, "all_words", F.slice(F.flatten(F.transform("parts", lambda p: p["words"])), 1, most).alias("words"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(b).alias("budget")) for n, b in budgets.items()])).alias("b"))
    return joined.select(
        *key, "b.level",
        F.concat_ws(": ", "b.level", F.array_join(F.slice("words", F.lit(1), F.col("b.budget")), " ")).alias("text"),
        F.least("all_words", F.col("b.budget")).cast("int").alias("token_count"),
    )


def artifacts(df: DataFrame, capability: str, build: str, sources: Column, text: Column) -> DataFrame:
    """Attach the idempotent artifact id of a derived text."""
    return df.withColumn(
        "artifact_id",
        ids.artifact_id(F.lit(capability), F.col("tenant_id"), F.col("document_version_id"), F.lit(build), sources, text),
    )


def table_of_contents(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Heading blocks in document order with their level and the chunks made from them.

    ``links``: document_version_id, block_id, chunk_id. A heading belongs to the chunks of one
    block, so the gathered list is small.
    """
    per_block = links.groupBy("document_version_id", "block_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return (
        blocks.filter(F.col("kind") == "heading")
        .withColumnRenamed("id", "block_id")
        .join(per_block, ["document_version_id", "block_id"], "left")
        .select(
            F.concat_ws("_", F.lit("toc"), "document_version_id", "order").alias("node_id"), "document_version_id",
            strip(F.col("text")).alias("title"), F.greatest(F.lit(1), F.size("heading_path")).alias("level"),
            "order", "block_id", "page",
            F.coalesce("chunk_ids", F.expr("cast(array() as array<string>)")).alias("chunk_ids"),
        )
    )


def summary_tree(chunks: DataFrame, *, levels: int = TREE_LEVELS, words: int = TREE_WORDS, build: str = "b1") -> DataFrame:
    """Pairwise summary tree of every document version: leaves plus up to ``levels - 1`` rounds.

    A node of level ``n`` covers ``2^n`` neighbouring leaves. Truncating at every round to the
    first ``words`` words gives the same text as truncating once over those leaves, so all levels
    come from one grouping with at most ``2^(levels-1)`` leaves each, instead of round after
    round. A level exists while the level below has more than one node.
    """
    counts = chunks.groupBy("document_version_id").agg(F.count(F.lit(1)).alias("leaves"))
    leaf_id = F.concat(F.lit("raptor_leaf_"), "chunk_id")
    node = lambda level, position: F.concat_ws("_", F.lit("raptor"), F.lit(build), "document_version_id", level, position)
    leaves = chunks.select(
        "document_version_id", F.lit(0).alias("level"), F.col("sequence").cast("long").alias("position"), leaf_id.alias("node_id"),
        F.col("content").alias("text"), F.array("chunk_id").alias("sources"), F.expr("cast(array() as array<string>)").alias("children"))
    spread = chunks.join(counts, "document_version_id").select(
        "document_version_id", "sequence", "chunk_id", "leaves",
        F.slice(_split_words(F.col("content")), 1, words).alias("words"),
        F.explode(F.sequence(F.lit(1), F.lit(levels - 1))).alias("level"))
    below = F.pow(F.lit(2), F.col("level") - 1)
    nodes = (
        spread.filter(F.ceil(F.col("leaves") / below) > 1)
        .groupBy("document_version_id", "level", F.floor(F.col("sequence") / (below * 2)).alias("position"))
        .agg(F.array_sort(F.collect_list(F.struct("sequence", "chunk_id", "words"))).alias("kids"))
    )
    child = F.transform("kids", lambda k: F.when(
        F.col("level") == 1, F.concat(F.lit("raptor_leaf_"), k["chunk_id"])
    ).otherwise(node(F.col("level") - 1, F.floor(k["sequence"] / F.pow(F.lit(2), F.col("level") - 1)))))
    parents = nodes.select(
        "document_version_id", "level", "position", node(F.col("level"), F.col("position")).alias("node_id"),
        F.array_join(F.slice(F.flatten(F.transform("kids", lambda k: k["words"])), 1, words), " ").alias("text"),
        F.array_distinct(F.transform("kids", lambda k: k["chunk_id"])).alias("sources"),
        F.array_distinct(child).alias("children"))
    return leaves.unionByName(parents)


@F.pandas_udf(StringType())
def _three_decimals(values: pd.Series) -> pd.Series:
    """Correctly rounded decimals of the exact binary value; JVM formatting rounds its shortest form."""
    return values.map("{:.3f}".format)


def transcript_segments(media: DataFrame) -> DataFrame:
    """Split the duration evenly over ``segments``; times in seconds with three decimals."""
    n = F.size("segments")
    at = lambda i: _three_decimals(i * (F.col("duration") / n))
    return media.select("media_id", "duration", "segments", F.posexplode("segments").alias("segment", "text")).select(
        "media_id", "segment", "text", at(F.col("segment")).alias("start_seconds"), at(F.col("segment") + 1).alias("end_seconds"))
