"""Finding repeated blocks in pages: candidate selectors with a score, per page and over a corpus.

A page's elements are counted by shape, what a selector of a parent and a child can tell: the tags, classes and ids of both.
Candidates come from groups of like siblings and are matched with the shapes, not with the elements; both are found in the
one pass that reads the page.
"""
from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.naming import col
from .elements import Element, Parsed, parse_pages, plain, shape_classes

# Elements that are no content blocks, and tags typical of lists.
SKIPPED = frozenset("script style noscript svg path meta link head br hr input button option".split())
LIST_TAGS = ("li", "tr", "article", "section", "item", "a", "h1", "h2", "h3", "h4")
# Score weights and limits.
FULL_COUNT = 40
COUNT_POINTS, TEXT_POINTS, LINK_POINTS = 45.0, 30.0, 15.0
LIST_BONUS, CLASS_BONUS, BARE_PENALTY = 8.0, 6.0, 12.0
MIN_SCORE = 8.0
SAMPLE_LENGTH = 80


@dataclass
class _Shape:
    """Elements that no candidate can tell apart."""
    classes: frozenset[str]
    parent_id: str
    parent_classes: frozenset[str]
    count: int = 0
    with_text: int = 0
    with_link: int = 0
    heads: list[int] = field(default_factory=list)


def _short(text: str) -> str:
    flat = re.sub(r"\s+", " ", text, flags=re.ASCII).strip(" ")
    return flat[:SAMPLE_LENGTH - 1] + "…" if len(flat) > SAMPLE_LENGTH else flat


def _compound(tag: str, classes: tuple[str, ...]) -> str:
    return tag + "".join("." + c for c in classes)


def candidates(page: Parsed, least: int, samples: int) -> list[dict]:
    """Counts and samples of every candidate selector of a page whose matches are as many as its groups let expect."""
    elements = page.elements
    shapes: dict[tuple, _Shape] = {}
    groups: Counter = Counter()
    own = [tuple(shape_classes(e.classes)) for e in elements]
    for i, e in enumerate(elements):
        if e.parent < 0:
            continue
        parent = elements[e.parent]
        groups[e.parent, e.tag, own[i]] += 1
        key = (e.tag, parent.tag, frozenset(e.classes), parent.attrs.get("id", ""), frozenset(parent.classes))
        shape = shapes.get(key)
        if shape is None:
            shape = shapes[key] = _Shape(*key[2:])
        shape.count += 1
        shape.with_text += e.last > e.first
        shape.with_link += e.link is not None
        if len(shape.heads) < samples:
            shape.heads.append(i)
    # Of sibling groups with one selector the largest sets the limit.
    wanted: dict[tuple, int] = {}
    for (at, tag, classes), n in groups.items():
        parent = elements[at]
        if n >= least and tag not in SKIPPED and parent.tag not in SKIPPED and parent.tag not in ("html", "body"):
            own_id = parent.attrs.get("id", "")
            above = ("#" + own_id, None, ()) if plain(own_id) else (None, parent.tag, own[at])
            key = (tag, classes, above)
            wanted[key] = max(wanted.get(key, 0), n)
    # Shapes by the tags and by one class of the child, or its parent's id, so that a candidate looks at few of them.
    by_class: dict[tuple, list[_Shape]] = {}
    for (tag, above, classes, own_id, _), shape in shapes.items():
        for name in (None, *classes):
            by_class.setdefault((tag, above, name), []).append(shape)
            by_class.setdefault((tag, "#" + own_id, name), []).append(shape)
    out = []
    for (tag, classes, (own_id, above, above_classes)), largest in wanted.items():
        near = by_class.get((tag, own_id or above, classes[0] if classes else None), [])
        matched = [s for s in near if s.classes.issuperset(classes) and s.parent_classes.issuperset(above_classes)]
        count = sum(s.count for s in matched)
        if not least <= count <= max(largest * 3, largest + 10):
            continue
        heads = [elements[i] for i in sorted(i for s in matched for i in s.heads)[:samples]]
        out.append({
            "selector": f"{own_id or _compound(above, above_classes)} > {_compound(tag, classes)}", "tag": tag,
            "classes": len(classes), "count": count, "with_text": sum(s.with_text for s in matched),
            "with_link": sum(s.with_link for s in matched), "samples": _samples(page, heads)})
    return out


def _samples(page: Parsed, heads: list[Element]) -> list[str]:
    texts = [t for e in heads if (t := _short(page.text(e)))]
    return texts or [e.link for e in heads if e.link is not None]


_FOUND = ("array<struct<selector: string, tag: string, classes: int, count: int, with_text: int, with_link: int, "
          "samples: array<string>>>")


def _score(c: Column) -> Column:
    n = c["count"].cast("double")
    return F.round(
        F.least(n, F.lit(float(FULL_COUNT))) / FULL_COUNT * COUNT_POINTS
        + c["with_text"] / n * TEXT_POINTS + c["with_link"] / n * LINK_POINTS
        + F.when(c["tag"].isin(*LIST_TAGS), LIST_BONUS).otherwise(0.0)
        + F.when(c["classes"] > 0, CLASS_BONUS).when(c["tag"].isin("div", "span"), -BARE_PENALTY).otherwise(0.0), 2)


def _scored(pages: DataFrame, min_items: int, samples: int, html: str) -> DataFrame:
    """The pages with ``__good``: all their candidates with a score that is high enough, best first."""
    found = parse_pages(pages, html, [("__found", _FOUND)], lambda page: (candidates(page, min_items, samples),))
    scored = F.transform("__found", lambda c: F.struct(
        (-_score(c)).alias("minus_score"), (-c["count"]).alias("minus_count"), c["selector"].alias("selector"),
        F.when(c["with_link"] / c["count"] >= 0.5, "href").otherwise("text").alias("suggested_attr"), c["samples"].alias("samples")))
    good = F.filter(scored, lambda s: s["minus_score"] <= -MIN_SCORE)
    return found.withColumn("__good", F.array_sort(good)).drop("__found")


def scan_structure(
    pages: DataFrame, *, min_items: int = 3, most: int | None = 12, samples: int = 3, html: str = "html"
) -> DataFrame:
    """Candidates per page, best first: rank, selector, count, score, suggested attribute, sample texts.

    ``most`` of each page are listed, all of them for None.
    """
    keep = [c for c in pages.columns if c != html]
    best = F.col("__good") if most is None else F.slice("__good", 1, most)
    return _scored(pages, min_items, samples, html).select(*[col(c) for c in keep], F.posexplode(best).alias("pos", "c")).select(
        *[col(c) for c in keep], (F.col("pos") + 1).alias("rank"), F.col("c.selector").alias("selector"),
        (-F.col("c.minus_count")).alias("count"), (-F.col("c.minus_score")).alias("score"),
        F.col("c.suggested_attr").alias("suggested_attr"), F.col("c.samples").alias("samples"))


def corpus_structure(pages: DataFrame, *, min_items: int = 3, html: str = "html") -> DataFrame:
    """All candidates of all pages by their selector: (selector, pages, items, score), the score averaged over pages."""
    each = _scored(pages, min_items, 0, html).select(F.explode("__good").alias("c"))
    return each.groupBy(F.col("c.selector").alias("selector")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(-F.col("c.minus_count")).alias("items"), F.avg(-F.col("c.minus_score")).alias("score"))
