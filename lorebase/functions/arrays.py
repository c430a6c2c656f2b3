"""Array helpers for per-document ordered data. All are single-row expressions: no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase.functions.text import let


def indices(items: Column) -> Column:
    """1-based positions; empty for an empty array (``sequence(1, 0)`` would count down)."""
    return F.slice(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))), F.lit(1), F.size(items))


def split_at(items: Column, starts_here: Callable[[Column, Column], Column]) -> Column:
    """Cut an array into runs; a run starts at the first item and wherever the rule says so.

    ``starts_here(current, previous)`` sees two neighbours only, so the cost is linear.
    """

    def cut(xs: Column) -> Column:
        heads = F.filter(
            indices(xs),
            lambda i: (i == 1) | starts_here(F.get(xs, i - 1), F.get(xs, i - 2)),
        )
        return let(
            heads,
            lambda hs: F.transform(
                hs,
                lambda h, j: F.slice(xs, h, F.coalesce(F.get(hs, j + 1), F.size(xs) + 1) - h),
            ),
        )

    return let(items, cut)


def heading_paths(headings: Column, deepest: int = 6) -> Column:
    """Paths for ``array<struct<level,text>>``: ``path[:level-1] + [text]``, levels (1 to ``deepest``) may collapse.

    A path is at most one longer than the one before, so its length is the least of ``level + distance`` over the last
    ``deepest`` headings. Its entry ``k`` is the last heading whose path is ``k`` long: one pass per level cuts the array there
    and hands the text to the run behind it. Linear in the headings.
    """

    def sized(hs: Column) -> Column:
        back = lambda i, d: F.get(hs, i - d)["level"] + d  # noqa: E731  null before the first heading
        return F.transform(hs, lambda h, i: F.struct(
            F.least(i + 1, *(back(i, d) for d in range(deepest))).alias("depth"), h["text"].alias("text"),
            F.expr("cast(array() as array<string>)").alias("path"),
        ))

    def entry(items: Column, k: int) -> Column:
        def hand_on(run: Column) -> Column:
            return let(F.get(run, F.lit(0)), lambda head: F.when(head["depth"] == k, F.transform(run, lambda x: F.struct(
                x["depth"].alias("depth"), x["text"].alias("text"), F.array_append(x["path"], head["text"]).alias("path"),
            ))).otherwise(run))

        return F.flatten(F.transform(split_at(items, lambda cur, _: cur["depth"] <= k), hand_on))

    def passes(items: Column, k: int) -> Column:
        return items["path"] if k > deepest else let(entry(items, k), lambda done: passes(done, k + 1))

    return let(let(headings, sized), lambda items: passes(items, 1))


def with_heading_paths(blocks: Column) -> Column:
    """Turn ``array<block>`` into ``array<struct<block,heading_path>>`` in one pass.

    The array is cut at headings; every block of a section shares the path of its heading.
    """
    is_heading = lambda b: b["kind"] == "heading"

    def attach(sections: Column) -> Column:
        heads = F.transform(
            F.filter(sections, lambda s: is_heading(F.get(s, F.lit(0)))),
            lambda s: F.struct(
                F.get(s, F.lit(0))["level"].alias("level"), F.get(s, F.lit(0))["text"].alias("text")
            ),
        )
        return let(
            heading_paths(heads),
            lambda paths: F.flatten(
                F.transform(
                    sections,
                    lambda s, j: F.transform(
                        s,
                        lambda b: F.struct(
                            b.alias("block"),
                            F.coalesce(
                                # a document may open without a heading
                                F.get(paths, j - (F.size(sections) - F.size(paths))),
                                F.expr("cast(array() as array<string>)"),
                            ).alias("heading_path"),
                        ),
                    ),
                )
            ),
        )

    return let(split_at(blocks, lambda cur, prev: is_heading(cur)), attach)
