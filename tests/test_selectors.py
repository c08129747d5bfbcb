"""Selectors against a plain matcher that follows each definition, spans in tables, and structure counts."""
import itertools
import random
import time

import pytest

from tablewright.pages import elements as E, structure as S
from tablewright.pages.css import Compound, Selectors, compile_selector


class Plain:
    """Matches one element at a time by looking around it."""

    def __init__(self, page: E.Parsed):
        self.page, self.all = page, page.elements

    def siblings(self, e: int) -> list[int]:
        return [i for i, x in enumerate(self.all) if x.parent == self.all[e].parent]

    def ancestors(self, e: int) -> list[int]:
        out = []
        while (e := self.all[e].parent) >= 0:
            out.append(e)
        return out

    def compound(self, e: int, c: Compound) -> bool:
        x = self.all[e]
        if c.tag not in (None, x.tag) or any(x.attrs.get("id") != i for i in c.ids) or any(k not in x.classes for k in c.classes):
            return False
        if not all(a.holds(x.attrs) for a in c.attributes):
            return False
        if "empty" in c.flags and (x.has_text or any(y.parent == e for y in self.all)):
            return False
        if "root" in c.flags and (x.parent >= 0 or len(self.siblings(e)) > 1):
            return False
        for p in c.places:
            among = [i for i in self.siblings(e) if not p.same_tag or self.all[i].tag == x.tag]
            if p.among is not None:
                among = [i for i in among if self.listed(i, p.among)]
            if p.from_end:
                among = among[::-1]
            if e not in among or not any(among.index(e) + 1 == p.step * n + p.start for n in range(200)):
                return False
        for kind, some in c.lists:
            if kind == "has":
                if not any(self.relative(e, chain) for chain in some.chains):
                    return False
            elif self.listed(e, some) != (kind == "is"):
                return False
        return True

    def around(self, e: int, link: str, ahead: bool) -> list[int]:
        """The elements that stand to ``e`` as the combinator says, behind it or before it."""
        if link in "+~":
            near = [i for i in self.siblings(e) if (i > e if ahead else i < e)]
            return near if link == "~" else near[:1] if ahead else near[-1:]
        if ahead:
            return [i for i, x in enumerate(self.all) if (x.parent == e if link == ">" else e in self.ancestors(i))]
        return self.ancestors(e)[:1] if link == ">" else self.ancestors(e)

    def chain(self, e: int, chain) -> bool:
        (link, last), rest = chain[-1], chain[:-1]
        return self.compound(e, last) and (not rest or any(self.chain(i, rest) for i in self.around(e, link, False)))

    def relative(self, e: int, chain) -> bool:
        if not chain:
            return True
        return any(self.compound(i, chain[0][1]) and self.relative(i, chain[1:]) for i in self.around(e, chain[0][0], True))

    def listed(self, e: int, some: Selectors) -> bool:
        return any(self.chain(e, c) for c in some.chains)


def random_page(rng: random.Random, depth: int = 0) -> str:
    out = ""
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["div", "span", "em", "section"])
        attrs = "".join([rng.choice(["", ' class="a"', ' class="b a"', ' class="c"']), rng.choice(["", "", ' id="k"']),
                         rng.choice(["", ' lang="en-US"', ' lang="en"', ' data-v="x y"', ' type="TEXT"'])])
        inside = random_page(rng, depth + 1) if depth < 4 and rng.random() < 0.6 else rng.choice(["", " ", "t"])
        out += f"<{tag}{attrs}>{inside}</{tag}>"
    return out


def random_selector(rng: random.Random, depth: int = 0, relative: bool = False) -> str:
    def compound() -> str:
        out = rng.choice(["", "div", "span", "em", "*", "section"])
        for _ in range(rng.randint(0 if out else 1, 2)):
            inner = random_selector(rng, depth + 1) if depth < 2 else "span"
            out += rng.choice([".a", ".b", ".c", "#k", "[lang]", "[lang|=en]", "[lang!=en]", "[data-v~=y]", "[type=text]", "[lang^='en']",
                               "[data-v$=y]", "[data-v*=' ']", "[lang=EN i]", ":first-child", ":last-child", ":only-child", ":first-of-type",
                               ":last-of-type", ":only-of-type", ":empty", ":root", ":nth-child(2)", ":nth-child(2n+1)", ":nth-child(even)",
                               ":nth-last-child(-n+2)", ":nth-of-type(odd)", ":nth-last-of-type(2)", ":nth-child( 3n - 1 )",
                               f":nth-child(2 of {inner})", f":not({inner})", f":is({inner}, em)",
                               f":has({random_selector(rng, depth + 1, True) if depth < 2 else '> em'})"])
        return out
    first = rng.choice(["", "> ", "+ ", "~ "]) if relative else ""
    return first + rng.choice([" ", " > ", " + ", "~", ">"]).join(compound() for _ in range(rng.randint(1, 3)))


@pytest.mark.parametrize("seed", range(6))
def test_selectors_against_plain_matching(seed):
    rng = random.Random(seed)
    hits = 0
    for _ in range(40):
        page = E.read_markup(random_page(rng))
        plain = Plain(page)
        texts = [", ".join(random_selector(rng) for _ in range(rng.randint(1, 2))) for _ in range(5)]
        lists = [compile_selector(t) for t in texts]
        for text, some, found in zip(texts, lists, page.select(lists)):
            want = [x for i, x in enumerate(page.elements) if plain.listed(i, some)]
            assert [id(x) for x in found] == [id(x) for x in want], text
            hits += len(want)
    assert hits > 300


@pytest.mark.parametrize("selector, want", [
    ("li + li", "BC"), ("li ~ li", "BC"), ("ul > :not(li)", ""), ("li:not(:last-child)", "AB"), (":is(ul, ol) > li.x", "B"),
    ("ul:has(> .x) > li:last-of-type", "C"), ("li:has(+ .x)", "A"), ("li:nth-child(odd)", "AC"), ("li:nth-last-child(2)", "B"),
    ("li[data-n|='2']", "B"), ("li[data-n]:nth-child(-n+2)", "AB"), (r"#a\:b li:first-child", "A"), (r"[id='a\3a b'] > ul li:nth-of-type(3)", "C"),
    ("li:nth-child(2 of [data-n])", "B"), ("LI.x", "B"), ("li:empty", ""), ("p:empty ~ p", "")])
def test_known_selectors(selector, want):
    page = E.read_markup('<div id="a:b"><ul><li data-n="1">A<li class=x data-n="2-b">B<li data-n=3>C</ul><p></p></div>')
    [found] = page.select([compile_selector(selector)])
    assert "".join(page.text(e) for e in found) == want


@pytest.mark.parametrize("bad", ["", "  ", "a >", "> a", "a:hover", "a[", "a,,b", ":not()", ":nth-child()", ":nth-child(x)", "a:has(", "a)", "a b >",
                                 ":nth-of-type(2 of a)", "a~", "..a", "a::before", ":first", "[=x]"])
def test_unknown_selectors(bad):
    with pytest.raises(ValueError):
        compile_selector(bad)


def test_deep_page_in_proportion():
    def seconds(depth: int) -> float:
        start = time.perf_counter()
        page = E.read_markup("<b>" * depth + "<em>x</em>" + "</b>" * depth)
        lists = [compile_selector(s) for s in ("b b b em", "b:has(em) > b", "b:not(b b b)", "em:nth-child(1), b + b ~ em")]
        assert [len(f) for f in page.select(lists)] == [1, depth - 1, 2, 1]
        return time.perf_counter() - start
    assert seconds(10_000) < 1.0


def test_links_of_open_elements():
    page = E.read_markup("<div><p><a href=1>x</a><a href=2>y</a></p><p>z<a href=3></a></p></div>")
    assert [(e.tag, e.link) for e in page.elements] == [("div", "1"), ("p", "1"), ("a", "1"), ("a", "2"), ("p", "3"), ("a", "3")]


@pytest.mark.parametrize("html, want", [
    ("<tr><th>a<th>b<tr><td rowspan=2>1<td>2<tr><td>4", ["ab", "12", "14"]),
    ("<tr><td colspan=2>x<td>y<tr><td>1<td>2<td>3", ["xxy", "123"]),
    ("<tr><td>1<td rowspan=3>2<td>3<tr><td>4<td rowspan=2>5<tr><td>6<td>7", ["123", "425", "6257"]),
    ("<tr><td rowspan=2 colspan=2>q<td>r<tr><td>s", ["qqr", "qqs"]),
    ("<tr><td rowspan=3>k<td>v", ["kv", "k", "k"]),
    ("<tr><td rowspan=x colspan=-1>k<td rowspan=0>v", ["kv"]),
    ("<tr><td>1<table><tr><td>in</table><td>2<tr><td>3", ["1 in2", "3"]),
    ("<td>1<td>2<tr><tr><td>5", ["12", "5"]), ("", [])])
def test_table_spans(html, want):
    grid = E.table_grid(E.read_markup(f"<table>{html}</table>"))
    rows = [[(c, t) for _, c, _, t in row] for _, row in itertools.groupby(sorted(grid), key=lambda x: x[0])]
    assert ["".join(t for _, t in row) for row in rows] == want
    assert all([c for c, _ in row] == list(range(len(row))) for row in rows)


def plain_candidates(page: E.Parsed, least: int) -> dict[str, tuple]:
    """Selector -> (matches, with text, with link), by selecting with every candidate's own selector."""
    out = {}
    for i, e in enumerate(page.elements):
        if e.parent < 0:
            continue
        parent = page.elements[e.parent]
        twins = [x for x in page.elements if x.parent == e.parent and x.tag == e.tag and E.shape_classes(x.classes) == E.shape_classes(e.classes)]
        if len(twins) < least or e.tag in S.SKIPPED or parent.tag in S.SKIPPED or parent.tag in ("html", "body"):
            continue
        above = "#" + parent.attrs["id"] if E.plain(parent.attrs.get("id", "")) else ".".join([parent.tag, *E.shape_classes(parent.classes)])
        selector = f"{above} > {'.'.join([e.tag, *E.shape_classes(e.classes)])}"
        [found] = page.select([compile_selector(selector)])
        if least <= len(found) <= max(len(twins) * 3, len(twins) + 10):
            out[selector] = (len(found), sum(x.last > x.first for x in found), sum(x.link is not None for x in found))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_structure_counts(seed):
    rng = random.Random(seed)

    def block(depth: int) -> str:
        tag, cls = rng.choice(["div", "li", "p", "td"]), rng.choice(["", "a", "a b", "b", "c d e", "x.y a"])
        inner = "".join(block(depth + 1) for _ in range(rng.randint(0, 5))) if depth < 4 else rng.choice(["", "t", "<a href=/q>l</a>"])
        return f'<{tag} class="{cls}"{rng.choice(["", "", " id=k", " id=u.v"])}>{inner}</{tag}>'
    for _ in range(12):
        page = E.read_markup("<body>" + block(0) + block(0) + "</body>")
        got = {c["selector"]: (c["count"], c["with_text"], c["with_link"]) for c in S.candidates(page, 2, 3)}
        assert got == plain_candidates(page, 2)


def test_structure_over_all_candidates(spark):
    """More candidates on one page than a listing shows."""
    html = "<body>" + "".join(f"<ul id=u{i}>" + "<li>x</li>" * 4 + "</ul>" for i in range(21)) + "</body>"
    df = spark.createDataFrame([(html,), (html,)], "html string")
    assert S.scan_structure(df).count() == 24
    got = S.corpus_structure(df).collect()
    assert len(got) == 21 and {(r["pages"], r["items"]) for r in got} == {(2, 8)}


def test_structure_time_in_proportion():
    def seconds(n: int) -> float:
        html = "<body>" + "".join(f"<div class='g{i} h'>" + f"<p class='c{i}'>x</p>" * 3 + "</div>" for i in range(n)) + "</body>"
        page, start = E.read_markup(html), time.perf_counter()
        assert len(S.candidates(page, 3, 3)) == n
        return time.perf_counter() - start
    seconds(50)
    assert seconds(4000) < 20 * seconds(400) + 0.3
