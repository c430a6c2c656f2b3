"""Parsers: raw text, Markdown, HTML, grids and positioned words to ordered blocks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.functions.arrays import with_heading_paths
from lorebase.functions.text import let, text_sections

BLOCK_SCHEMA = (
    "kind string, block_order int, text string, heading_path array<string>, "
    "table_rows int, table_columns int, has_header boolean, image_ref string"
)

# fixed values: the registered parsers
PARSERS = (
    ("independent-text", ("text/plain",), (".txt",), 0, "general"),
    ("independent-markdown", ("text/markdown",), (".md", ".markdown"), 0, "manual"),
    ("independent-html", ("text/html",), (".html", ".htm"), 0, "manual"),
    ("independent-docx", ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), (".docx",), 0, "manual"),
    ("independent-pptx", ("application/vnd.openxmlformats-officedocument.presentationml.presentation",), (".pptx",), 0, "manual"),
    ("independent-xlsx", ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",), (".xlsx",), 0, "table"),
    ("independent-pdf-layout", ("application/pdf",), (".pdf",), 0, "paper"),
    ("independent-image-ocr", ("image/png", "image/jpeg", "image/tiff", "image/webp", "image/bmp"),
     (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".bmp"), 0, "picture"),
)
MAX_ROWS_PER_SHEET = 100_000


def parse_text(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Plain text to text blocks (sections between blank lines)."""
    return df.select(key, F.posexplode(text_sections(F.col(text))).alias("block_order", "text"))


def markdown_sections(text: Column) -> Column:
    """Light Markdown as ``array<struct<block,heading_path>>``.

    A section that is exactly one ``#`` line of level 1 to 6 with a title is a heading.
    """

    def block(section: Column) -> Column:
        def classify(parts: Column) -> Column:
            heading = (
                (parts["level"] >= 1) & (parts["level"] <= 6) & (parts["title"] != "")
                & ~F.contains(section, F.lit("\n"))
            )
            return F.struct(
                F.when(heading, "heading").otherwise("text").alias("kind"),
                F.when(heading, parts["level"]).alias("level"),
                F.when(heading, parts["title"]).otherwise(section).alias("text"),
            )

        return let(
            F.struct(
                F.length(F.regexp_extract(section, "^(#*)", 1)).alias("level"),
                F.trim(F.regexp_replace(section, "^#*", ""), F.lit(" \t")).alias("title"),
            ),
            classify,
        )

    return with_heading_paths(F.transform(text_sections(text), block))


def parse_markdown(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.select(
        key, F.posexplode(markdown_sections(F.col(text))).alias("block_order", "b")
    ).select(key, "block_order", "b.block.kind", "b.block.text", "b.heading_path")


# ---- scanners without a SQL form (one input row to many block rows, Arrow batches) -------------


class _Blocks(list):
    """Collected block rows of one document, with the current heading path."""

    def __init__(self) -> None:
        super().__init__()
        self.path: list[str] = []

    def heading(self, level: int, text: str) -> None:
        self.path = [*self.path[: level - 1], text]
        self.put("heading", text)

    def put(self, kind: str, text: str, rows=None, columns=None, header=None, image=None) -> None:
        self.append((kind, len(self), text, list(self.path), rows, columns, header, image))

    def grid(self, rows: list[list[str]], header: bool) -> None:
        if rows:
            text = "\n".join("\t".join(row) for row in rows)
            self.put("table", text, len(rows), max(map(len, rows)), header)


def scan_markdown(text: str) -> _Blocks:
    """Headings, fenced code, lists and pipe tables of a documented Markdown subset.

    As in the token stream of a CommonMark parser, a list item gives a list block and the
    paragraph inside it gives a text block with the same words.
    """
    import re

    blocks, paragraph = _Blocks(), []
    lines = text.lstrip("﻿").splitlines()
    heading = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
    fence = re.compile(r" {0,3}(`{3,}|~{3,})")
    item = re.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(.*)$")
    ruler = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
    cells = lambda row: [c.strip() for c in row.strip().strip("|").split("|")]

    def flush() -> None:
        value = "\n".join(paragraph).strip()
        paragraph.clear()
        if value:
            blocks.put("text", value)

    i = 0
    while i < len(lines):
        line = lines[i]
        opened, head, listed = fence.match(line), heading.match(line), item.match(line)
        if opened:
            flush()
            mark, body = opened.group(1), []
            i += 1
            while i < len(lines) and not re.match(rf" {{0,3}}{mark[0]}{{{len(mark)},}}\s*$", lines[i]):
                body.append(lines[i])
                i += 1
            code = "\n".join(body).rstrip()
            if code.strip():
                blocks.put("code", code)
        elif head:
            flush()
            title = (head.group(2) or "").strip()
            if title:
                blocks.heading(len(head.group(1)), title)
        elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and "|" in lines[i + 1] and ruler.match(lines[i + 1]):
            flush()
            rows = [cells(line)]
            i += 2
            while i < len(lines) and lines[i].strip() and "|" in lines[i]:
                rows.append((cells(lines[i]) + [""] * len(rows[0]))[: len(rows[0])])
                i += 1
            blocks.grid(rows, True)
            continue
        elif listed:
            flush()
            value = [listed.group(1).strip()]
            while (
                i + 1 < len(lines) and lines[i + 1].strip()
                and not item.match(lines[i + 1]) and not heading.match(lines[i + 1])
                and not fence.match(lines[i + 1])
            ):
                i += 1
                value.append(lines[i].strip())
            joined = "\n".join(value).strip()
            if joined:
                blocks.put("list", joined)
                blocks.put("text", joined)
        elif line.strip():
            paragraph.append(line.strip())
        else:
            flush()
        i += 1
    flush()
    return blocks


HTML_SKIPPED = ("script", "style", "noscript", "template")
HTML_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
HTML_BLOCKS = {**dict.fromkeys(HTML_HEADINGS, "heading"), "p": "text", "li": "list", "pre": "code", "table": "table"}
HTML_CLOSES_P = (
    *HTML_BLOCKS, "ul", "ol", "div", "article", "section", "nav", "footer", "header", "main", "aside", "blockquote", "form", "hr",
)


class _HtmlEvents(HTMLParser):
    """Elements that make blocks, in opening order; text goes to every element that is open around it.

    ``p`` is closed by the next block element, as in HTML5.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[dict] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in HTML_SKIPPED
        if self.skip:
            return
        if tag in HTML_CLOSES_P:
            self._close("p")
        around = {e["tag"] for e in self.open}
        if tag == "img":
            known = dict(attrs)
            self.found.append({"tag": tag, "parts": [(known.get("alt") or "embedded image").strip()], "source": known.get("src")})
        elif tag in HTML_BLOCKS:
            inner = tag == "table" and "table" in around or tag in ("p", "li", "pre") and not around.isdisjoint(("li", "table"))
            element = {"tag": tag, "parts": [], "rows": [], "header": False, "inner": inner}
            self.open.append(element)
            self.found.append(element)
        elif tag == "tr":
            self._grid(lambda e: e["rows"].append([]))
        elif tag in ("td", "th"):
            self._grid(lambda e: ((e["rows"] or e["rows"].append([]) or e["rows"])[-1].append([]), e.update(header=e["header"] or tag == "th")))

    def _grid(self, change) -> None:
        for element in self.open:
            if element["tag"] == "table":
                change(element)
                return

    def _close(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == tag:
                del self.open[depth:]
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in HTML_SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif not self.skip:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if (value := data.strip()) and not self.skip:
            for element in self.open:
                element["parts"].append(value)
                if element["tag"] == "table" and element["rows"] and element["rows"][-1]:
                    element["rows"][-1][-1].append(value)


def scan_html(markup: str) -> _Blocks:
    """Blocks of a page in the order in which their elements open."""
    events, blocks = _HtmlEvents(), _Blocks()
    events.feed(markup)
    events.close()
    for element in events.found:
        tag, text = element["tag"], " ".join(element["parts"])
        if tag == "img":
            blocks.put("image", text, image=element["source"] or f"image-{len(blocks)}")
        elif tag == "table":
            if not element["inner"]:
                rows = [[" ".join(cell) for cell in row] for row in element["rows"]]
                blocks.grid([row for row in rows if any(row)], element["header"])
        elif text and tag in HTML_HEADINGS:
            blocks.heading(int(tag[1]), text)
        elif text and not element["inner"]:
            blocks.put(HTML_BLOCKS[tag], text)
    return blocks


def _scanned(df: DataFrame, key: str, source: str, scanner) -> DataFrame:
    names = ["kind", "block_order", "text", "heading_path", "table_rows", "table_columns", "has_header", "image_ref"]
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (ident, *block)
                for ident, value in zip(batch[key], batch[source], strict=True)
                if value is not None
                for block in scanner(value)
            ]
            frame = pd.DataFrame(rows, columns=[key, *names])
            for column in ("table_rows", "table_columns"):
                frame[column] = frame[column].astype("Int32")
            yield frame

    return df.select(key, source).mapInPandas(run, f"{key} {key_type}, {BLOCK_SCHEMA}")


def parse_markdown_blocks(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return _scanned(df, key, text, scan_markdown)


def parse_html(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    return _scanned(df, key, html, scan_html)


# ---- grids and positioned words ---------------------------------------------------------------


def cells_to_tables(cells: DataFrame, max_rows: int = MAX_ROWS_PER_SHEET) -> tuple[DataFrame, DataFrame]:
    """``(sheet,row,col,value)`` cells to one table block per sheet; returns (tables, rejected).

    Trailing empty cells and empty rows are dropped. Sheets above the row limit are reported, not
    collected, which bounds what is gathered for one block.
    """
    rows = cells.groupBy("sheet", "row").agg(
        F.max(F.when(F.col("value") != "", F.col("col"))).alias("last_col"),
        F.array_sort(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("value")))).alias("cells"),
    )
    counts = cells.groupBy("sheet").agg(F.count_distinct("row").alias("sheet_rows"))
    rejected = counts.filter(F.col("sheet_rows") > max_rows).select(
        "sheet", F.lit("parser_resource_limit").alias("error_code"), "sheet_rows"
    )
    kept = rows.filter(F.col("last_col").isNotNull()).join(
        counts.filter(F.col("sheet_rows") <= max_rows).select("sheet"), "sheet", "left_semi"
    )
    line = F.array_join(
        F.transform(
            F.filter("cells", lambda c: c["col"] <= F.col("last_col")), lambda c: c["value"]
        ),
        "\t",
    )
    tables = (
        kept.select("sheet", "row", line.alias("line"), (F.size(F.filter("cells", lambda c: c["col"] <= F.col("last_col")))).alias("width"))
        .groupBy("sheet")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n"
            ).alias("text"),
            F.count(F.lit(1)).alias("table_rows"),
            F.max("width").alias("table_columns"),
        )
    )
    return tables, rejected


def words_to_lines(words: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Visual lines of positioned words ``(ord,text,x0,y0,x1,y1,confidence)`` per page.

    Tolerance is max(4, 0.65 x median height). Words are visited by half-even rounded centre band,
    then x0, then order; a word joins the last line while it is within tolerance of the running
    mean centre of that line.
    """
    tolerance = F.greatest(F.lit(4.0), F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5)) * 0.65)
    member = F.struct("ord", "text", "x0", "y0", "x1", "y1", "confidence")
    pages = words.groupBy(*keys).agg(tolerance.alias("tol"), F.collect_list(member).alias("words"))
    centre = lambda w: (w["y0"] + w["y1"]) / 2
    ordered = F.array_sort(
        F.transform(
            "words",
            lambda w: F.struct(
                F.bround(centre(w) / F.col("tol")).alias("band"),
                w["x0"].alias("x0"), w["ord"].alias("ord"), centre(w).alias("centre"), w.alias("w"),
            ),
        )
    )
    state = "cast(struct(0 as i, 0D as total, 0 as n, cast(array() as array<int>) as starts) as struct<i:int,total:double,n:int,starts:array<int>>)"

    def visit(acc: Column, w: Column) -> Column:
        # only line starts are appended, so the fold stays linear in the words of a page
        fresh = (acc["n"] == 0) | (F.abs(w["centre"] - acc["total"] / F.greatest(acc["n"], F.lit(1))) > F.col("tol"))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(fresh, w["centre"]).otherwise(acc["total"] + w["centre"]).alias("total"),
            F.when(fresh, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
            F.when(fresh, F.concat(acc["starts"], F.array(acc["i"] + 1))).otherwise(acc["starts"]).alias("starts"),
        )

    def line(members: Column) -> Column:
        of = lambda name: F.transform(members, lambda m: m["w"][name])
        placed = F.array_sort(F.transform(members, lambda m: F.struct(m["x0"], m["ord"], m["w"]["text"].alias("text"))))
        return F.struct(
            F.array_join(F.transform(placed, lambda m: m["text"]), " ").alias("text"),
            F.array_min(of("x0")).alias("x0"), F.array_min(of("y0")).alias("y0"),
            F.array_max(of("x1")).alias("x1"), F.array_max(of("y1")).alias("y1"),
            (F.aggregate(of("confidence"), F.lit(0.0), lambda a, x: a + x) / F.size(members)).alias("confidence"),
        )

    def cut(ws: Column) -> Column:
        return let(
            F.aggregate(ws, F.expr(state), visit, lambda acc: acc["starts"]),
            lambda starts: F.transform(
                starts,
                lambda s, j: line(F.slice(ws, s, F.coalesce(F.get(starts, j + 1), F.size(ws) + 1) - s)),
            ),
        )

    return pages.select(*keys, F.posexplode(let(ordered, cut)).alias("line_no", "l")).select(*keys, "line_no", "l.*")


def page_columns(words: DataFrame, page_width: float, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Assign ``column`` 0 or 1: split at the widest horizontal gap when it is wide enough.

    Gaps come from a running maximum of right edges; ties go to the larger divider. A page keeps
    one column when the gap is under max(48, 8 % of the width) or one side would be empty.
    """
    sweep = Window.partitionBy(*keys).orderBy("x0", "x1", "ord").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("x1").over(sweep)
    gaps = words.select(
        *keys, "x0", "x1", reached.alias("reached")
    ).withColumn("gap", F.when(F.col("x0") > F.col("reached"), F.col("x0") - F.col("reached")))
    best = gaps.groupBy(*keys).agg(
        F.max(
            F.when(F.col("gap").isNotNull(), F.struct(F.col("gap"), ((F.col("x0") + F.col("reached")) / 2).alias("divider")))
        ).alias("best")
    )
    threshold = max(48.0, page_width * 0.08)
    sided = words.join(best, list(keys)).withColumn(
        "side",
        F.when(
            (F.col("best.gap") >= threshold) & ((F.col("x0") + F.col("x1")) / 2 >= F.col("best.divider")), 1
        ).otherwise(0),
    )
    # a page whose words all fall right of the divider stays one column
    any_left = sided.groupBy(*keys).agg(F.min("side").alias("lowest"))
    return sided.join(any_left, list(keys)).withColumn(
        "column", F.when(F.col("lowest") == 1, 0).otherwise(F.col("side"))
    ).drop("best", "side", "lowest")


def reading_order(items: DataFrame, document: str, page: str, order: list[str]) -> DataFrame:
    """Zero-based reading order over the whole document.

    Ranks are taken per page and shifted by the words on earlier pages, so even a document that
    holds a large share of all rows is never sorted in one task.
    """
    per_page = items.groupBy(document, page).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(document).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_page.select(document, page, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(document, page).orderBy(*order)
    return (
        items.withColumn("rank_in_page", F.row_number().over(within))
        .join(offsets, [document, page])
        .withColumn("reading_order", F.col("offset") + F.col("rank_in_page") - 1)
        .drop("offset", "rank_in_page")
    )


# ---- routing, limits, warnings ----------------------------------------------------------------


def parser_table(spark: SparkSession, parsers=PARSERS) -> DataFrame:
    """Capabilities, one row per (parser, media type, extension). Size fixed by the registry."""
    rows = [
        (name, media, ext, priority, strategy)
        for name, medias, exts, priority, strategy in parsers
        for media in medias
        for ext in exts
    ]
    return spark.createDataFrame(rows, "parser_id string, media_type string, extension string, priority int, default_strategy string")


def route_parser(requests: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Choose a parser per request ``(request_id,media_type,extension,parser_override)``."""
    matched = (
        requests.join(F.broadcast(capabilities), ["media_type", "extension"], "left")
        .groupBy("request_id")
        .agg(
            F.max("priority").alias("top"),
            F.collect_list(F.struct("priority", "parser_id", "default_strategy")).alias("found"),
        )
    )
    known = capabilities.select(F.col("parser_id").alias("parser_override")).distinct().withColumn("override_known", F.lit(True))
    typed = capabilities.select("media_type").distinct().withColumn("type_known", F.lit(True))
    found = F.filter("found", lambda f: f["parser_id"].isNotNull())
    best = F.filter(found, lambda f: f["priority"] == F.col("top"))
    override = F.filter(found, lambda f: f["parser_id"] == F.col("parser_override"))
    asked = F.col("parser_override").isNotNull()
    error = (
        F.when(asked & F.col("override_known").isNull(), "parser_override_unknown")
        .when(asked & (F.size(override) == 0), "parser_override_incompatible")
        .when(asked, F.lit(None).cast("string"))
        .when((F.size(found) == 0) & F.col("type_known").isNotNull(), "parser_extension_media_type_mismatch")
        .when(F.size(found) == 0, "parser_media_type_unsupported")
        .when(F.size(best) > 1, "parser_route_ambiguous")
    )
    chosen = F.when(asked, F.get(override, F.lit(0))).otherwise(F.get(best, F.lit(0)))
    return (
        requests.join(matched, "request_id")
        .join(F.broadcast(known), "parser_override", "left")
        .join(F.broadcast(typed), "media_type", "left")
        .withColumn("error_code", error)
        .withColumn("chosen", chosen)
        .select(
            "request_id", "media_type", "extension",
            F.when(F.col("error_code").isNull(), F.col("chosen.parser_id")).alias("parser_id"),
            F.when(F.col("error_code").isNull(), F.col("chosen.default_strategy")).alias("chunk_strategy"),
            "error_code",
        )
    )


def limit_guard(df: DataFrame, limits: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Split by resource limits; rejected rows name the first exceeded resource."""
    resource = F.lit(None).cast("string")
    for column, limit in reversed(list(limits.items())):
        resource = F.when(F.col(column) > limit, F.lit(column)).otherwise(resource)
    checked = df.withColumn("resource", resource)
    rejected = checked.filter(F.col("resource").isNotNull()).withColumn(
        "error_code", F.lit("parser_resource_limit")
    )
    return checked.filter(F.col("resource").isNull()).drop("resource"), rejected


def parse_warnings(df: DataFrame) -> Column:
    """Degradation codes of a parse: foreign encoding, kept formulas, merged cells."""
    return F.array_compact(
        F.array(
            F.when(~F.lower("encoding").isin("utf_8", "utf_8_sig", "ascii"), "text_encoding_detected"),
            F.when(F.col("formula_cells") > 0, "xlsx_formula_preserved_not_evaluated"),
            F.when(F.col("merged_ranges") > 0, "xlsx_merged_cells_present"),
        )
    )


def warning_counts(df: DataFrame, by: str) -> DataFrame:
    return (
        df.select(by, F.explode(parse_warnings(df)).alias("code"))
        .groupBy(by, "code").agg(F.count(F.lit(1)).alias("documents"))
    )
