"""Chunking strategies over one row per document with an ordered ``blocks`` array.

Grouping, windowing and numbering are expressions on that array, so parsing to chunks needs no
shuffle: the only row-multiplying step is one ``posexplode`` per document, and its position is the
chunk sequence. Work per document is linear in its text.

A block is ``struct<id,kind,order,level,text,page,box,heading_path>`` with kinds
heading/text/list/table/image/code and ``box = struct<x0,y0,x1,y1,space>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions import ids
from lorebase.functions.arrays import split_at
from lorebase.functions.text import let, matches, strip, token_windows

# fixed values: defaults, markers and the question/answer pattern
DEFAULT_LIMIT = 384
DEFAULT_OVERLAP = 48
STRATEGY_VERSION = "1"
LAW_ARTICLE = r"(?i)^(?:第[一二三四五六七八九十百千万零〇\d]+条|Article\s+\d+)"
QA_PAIR = (
    r"(?is)(?:^|\n)(?:Q(?:uestion)?|问(?:题)?)[：:]\s*(.+?)"
    r"(?:\n+)(?:A(?:nswer)?|答(?:案)?)[：:]\s*(.+?)(?=\n(?:Q|问)|$)"
)

EMPTY_STRINGS = "cast(array() as array<string>)"


def flatten_paths(pairs: Column) -> Column:
    """Bring ``array<struct<block,heading_path>>`` into the block shape used here."""
    return F.transform(
        pairs,
        lambda p: F.struct(
            *[
                p["block"][name].alias(name)
                for name in ("id", "kind", "order", "level", "text", "page", "box")
            ],
            p["heading_path"].alias("heading_path"),
        ),
    )


def _group(members: Column, content: Column) -> Column:
    return F.struct(members.alias("members"), content.alias("content"))


def _single(block: Column, content: Column) -> Column:
    return _group(F.array(block), content)


def _paragraphs(members: Column) -> Column:
    texts = F.filter(F.transform(members, lambda b: strip(b["text"])), lambda t: t != "")
    return F.array_join(texts, "\n\n")


def _visual(block: Column) -> Column:
    return block["kind"].isin("table", "image")


def _sections(blocks: Column, isolate: bool) -> Column:
    def starts(cur: Column, prev: Column) -> Column:
        heading = cur["kind"] == "heading"
        return (heading | _visual(cur) | _visual(prev)) if isolate else heading

    return F.transform(split_at(blocks, starts), lambda m: _group(m, _paragraphs(m)))


def _general(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: _single(b, b["text"]))


def _laws(blocks: Column) -> Column:
    def articles(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block["text"], "\n"), strip), lambda s: s != "")
        runs = split_at(lines, lambda cur, prev: cur.rlike(LAW_ARTICLE))
        return F.transform(runs, lambda r: _single(block, F.array_join(r, "\n")))

    return F.flatten(F.transform(blocks, articles))


def _pair(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), strip(question), F.lit("\nAnswer: "), strip(answer))


def _qa(blocks: Column) -> Column:
    def table_pairs(text: Column) -> Column:
        rows = F.transform(F.split(text, "\n"), lambda r: F.split(r, "\t"))
        body = F.when(F.size(rows) > 1, F.slice(rows, F.lit(2), F.size(rows))).otherwise(rows)
        full = F.filter(
            body,
            lambda r: (strip(F.coalesce(F.get(r, F.lit(0)), F.lit(""))) != "")
            & (strip(F.coalesce(F.get(r, F.lit(1)), F.lit(""))) != ""),
        )
        return F.transform(full, lambda r: _pair(F.get(r, F.lit(0)), F.get(r, F.lit(1))))

    def text_pairs(text: Column) -> Column:
        asked, answered = matches(text, QA_PAIR, 1), matches(text, QA_PAIR, 2)
        pairs = F.zip_with(asked, answered, _pair)
        whole = F.filter(F.array(strip(text)), lambda t: t != "")
        return let(pairs, lambda p: F.when(F.size(p) > 0, p).otherwise(whole))

    def contents(block: Column) -> Column:
        return F.when(block["kind"] == "table", table_pairs(block["text"])).otherwise(
            text_pairs(block["text"])
        )

    return F.flatten(
        F.transform(blocks, lambda b: F.transform(contents(b), lambda c: _single(b, c)))
    )


def _table(blocks: Column) -> Column:
    def rows(text: Column) -> Column:
        filled = F.filter(F.split(text, "\n"), lambda r: strip(r) != "")
        return let(
            filled,
            lambda xs: F.when(F.size(xs) < 2, xs).otherwise(
                F.transform(
                    F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))),
                    lambda r: F.concat_ws("\n", F.get(xs, F.lit(0)), r),
                )
            ),
        )

    def contents(block: Column) -> Column:
        return F.when(block["kind"] == "table", rows(block["text"])).otherwise(
            F.filter(F.array(strip(block["text"])), lambda t: t != "")
        )

    return F.flatten(
        F.transform(blocks, lambda b: F.transform(contents(b), lambda c: _single(b, c)))
    )


def _picture(blocks: Column) -> Column:
    def page_groups(members: Column) -> Column:
        images = F.filter(members, lambda b: b["kind"] == "image")
        others = F.filter(members, lambda b: b["kind"] != "image")
        bound = F.concat(images, others)
        joined = F.array_join(
            F.filter(F.transform(bound, lambda b: b["text"]), lambda t: t != ""), "\n"
        )
        return F.when(F.size(images) > 0, F.array(_group(bound, joined))).otherwise(
            F.transform(others, lambda b: _single(b, strip(b["text"])))
        )

    # sorted by page, a page is one run; runs then go in the order of their first block
    placed = F.array_sort(F.transform(blocks, lambda b, i: F.struct(b["page"].alias("page"), i.alias("at"), b.alias("block"))))
    runs = split_at(placed, lambda cur, prev: ~cur["page"].eqNullSafe(prev["page"]))
    ordered = F.array_sort(F.transform(runs, lambda r: F.struct(F.get(r, F.lit(0))["at"].alias("at"), r.alias("members"))))
    return F.flatten(F.transform(ordered, lambda r: let(F.transform(r["members"], lambda m: m["block"]), page_groups)))


STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "general": _general,
    "paper": lambda blocks: _sections(blocks, isolate=True),
    "manual": lambda blocks: _sections(blocks, isolate=True),
    "resume": lambda blocks: _sections(blocks, isolate=False),
    "book": lambda blocks: _sections(blocks, isolate=False),
    "laws": _laws,
    "qa": _qa,
    "table": _table,
    "picture": _picture,
}


def combined_box(members: Column) -> Column:
    """Union box when all boxes share one page and one coordinate space, else null."""
    boxes = F.filter(F.transform(members, lambda b: b["box"]), lambda x: x.isNotNull())
    pages = F.array_distinct(
        F.filter(F.transform(members, lambda b: b["page"]), lambda p: p.isNotNull())
    )

    def union(xs: Column) -> Column:
        def edge(name: str, pick) -> Column:
            return pick(F.transform(xs, lambda x: x[name])).alias(name)

        spaces = F.array_distinct(F.transform(xs, lambda x: x["space"]))
        return F.when(
            (F.size(pages) == 1) & (F.size(spaces) == 1),
            F.struct(
                edge("x0", F.array_min), edge("y0", F.array_min),
                edge("x1", F.array_max), edge("y1", F.array_max),
                F.get(spaces, F.lit(0)).alias("space"),
            ),
        )

    return let(boxes, union)


def group_metadata(members: Column) -> Column:
    """Heading path, page and order range, kinds and box of a group of blocks."""
    kinds = F.array_distinct(F.transform(members, lambda b: b["kind"]))
    return F.struct(
        F.coalesce(
            F.get(
                F.filter(F.transform(members, lambda b: b["heading_path"]), lambda h: F.size(h) > 0),
                F.lit(0),
            ),
            F.expr(EMPTY_STRINGS),
        ).alias("heading_path"),
        F.array_min(F.transform(members, lambda b: b["page"])).alias("page_start"),
        F.array_max(F.transform(members, lambda b: b["page"])).alias("page_end"),
        F.array_min(F.transform(members, lambda b: b["order"])).alias("source_order_start"),
        F.array_max(F.transform(members, lambda b: b["order"])).alias("source_order_end"),
        kinds.alias("block_kinds"),
        combined_box(members).alias("box"),
        F.array_contains(kinds, "table").alias("contains_table"),
        F.array_contains(kinds, "image").alias("contains_image"),
    )


def _pieces(groups: Column, limit: int, overlap: int) -> Column:
    def of_group(group: Column) -> Column:
        described = F.struct(
            F.array_distinct(F.transform(group["members"], lambda b: b["id"])).alias("source_block_ids"),
            group_metadata(group["members"]).alias("metadata"),
        )
        return let(
            described,
            lambda g: F.transform(
                token_windows(group["content"], limit, overlap),
                lambda w: F.struct(
                    w["content"].alias("content"),
                    w["token_count"].alias("token_count"),
                    g["source_block_ids"].alias("source_block_ids"),
                    g["metadata"].alias("metadata"),
                ),
            ),
        )

    return F.flatten(F.transform(groups, of_group))


def _explode(documents: DataFrame, groups: Callable[[Column], Column], limit: int, overlap: int) -> DataFrame:
    carried = [c for c in documents.columns if c != "blocks"]
    return documents.select(
        *carried,
        F.posexplode(let(F.col("blocks"), lambda b: _pieces(groups(b), limit, overlap))).alias(
            "sequence", "piece"
        ),
    ).select(*carried, "sequence", "piece.*")


def _chunk_id(strategy: Column) -> Column:
    parts = (F.col("sequence"), F.col("source_block_ids"), F.col("content"))
    scope = (F.col("tenant_id"), F.col("document_version_id"))
    return F.when(strategy == "general", ids.chunk_id_v1(*scope, *parts)).otherwise(
        ids.chunk_id_v2(*scope, strategy, F.lit(STRATEGY_VERSION), *parts)
    )


def chunk_documents(
    documents: DataFrame,
    strategy: str,
    *,
    limit: int = DEFAULT_LIMIT,
    overlap: int = DEFAULT_OVERLAP,
) -> DataFrame:
    """Cut every document into chunks; other columns of the input are carried along.

    ``general`` ids use algorithm v1, all other strategies the strategy-aware v2.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"chunk strategy is not registered: {strategy}")
    return (
        _explode(documents, STRATEGIES[strategy], limit, overlap)
        .withColumn("chunk_id", _chunk_id(F.lit(strategy)))
        .withColumn("chunk_strategy_id", F.lit(strategy))
    )


def dispatch(
    requests: DataFrame,
    *,
    limit: int = DEFAULT_LIMIT,
    overlap: int = DEFAULT_OVERLAP,
) -> tuple[DataFrame, DataFrame]:
    """Route documents to strategies; returns ``(chunks, rejected)``.

    ``auto`` takes the recommendation of the parser. An unknown strategy, or a version other than
    ``auto`` or the registered one, becomes an error row instead of a failed job. All strategies
    run in one scan: a lazy CASE evaluates only the branch a document asks for.
    """
    chosen = F.when(
        F.col("strategy_id") == "auto", F.col("recommended_chunk_strategy")
    ).otherwise(F.col("strategy_id"))
    error = (
        F.when(~chosen.isin(*STRATEGIES), "chunk_strategy_unknown")
        .when(
            (F.col("strategy_id") != "auto")
            & ~F.col("strategy_version").isin("auto", STRATEGY_VERSION),
            "chunk_strategy_version_unknown",
        )
    )
    routed = requests.withColumn("chosen_strategy", chosen).withColumn("error_code", error)
    rejected = routed.filter(F.col("error_code").isNotNull()).drop("blocks")

    def groups(blocks: Column) -> Column:
        branches = F.when(F.lit(False), _general(blocks))
        for name, build in STRATEGIES.items():
            branches = branches.when(F.col("chosen_strategy") == name, build(blocks))
        return branches

    chunks = _explode(routed.filter(F.col("error_code").isNull()), groups, limit, overlap)
    return chunks.withColumn("chunk_id", _chunk_id(F.col("chosen_strategy"))), rejected


def chunk_violations(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Contract checks as rows: duplicate ids, order defects, sequence gaps, empty content.

    Density and order are decided by counts (n distinct values from 0 to n-1), which aggregate
    partially and need no sorted group.
    """
    key = "document_version_id"
    per_block = blocks.groupBy(key, "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        key, F.lit("duplicate_block_id").alias("violation"), F.col("id").alias("item")
    )
    per_order = blocks.groupBy(key, "order").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        key, F.lit("duplicate_block_order").alias("violation"), F.col("order").cast("string").alias("item")
    )
    per_chunk = chunks.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias(key)
    ).filter("n > 1").select(
        key, F.lit("duplicate_chunk_id").alias("violation"), F.col("chunk_id").alias("item")
    )
    sequence = (
        chunks.groupBy(key, "sequence").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(key)
        .agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"),
             F.count(F.lit(1)).alias("distinct_n"), F.sum("n").alias("n"))
        .filter("lo <> 0 or hi + 1 <> distinct_n or n <> distinct_n")
        .select(key, F.lit("sequence_not_dense").alias("violation"), F.col("hi").cast("string").alias("item"))
    )
    empty = chunks.filter(strip(F.col("content")) == "").select(
        key, F.lit("empty_content").alias("violation"), F.col("chunk_id").alias("item")
    )
    return per_block.unionByName(per_order).unionByName(per_chunk).unionByName(sequence).unionByName(empty)
