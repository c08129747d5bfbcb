"""CSS selectors as automata that run once over the elements of a page, in document order.

A selector is a chain of compounds; state i of its automaton means that the chain up to compound i ends at an element. The
states of an element, its ancestors, its parent and its earlier siblings are sets of bits, so an element costs one step for
each state that its tag can take, however deep it lies. ``:has`` runs its chains backwards, from the last element to the
first, over the sets of children, descendants and later siblings. Lists inside ``:is``, ``:not`` and ``:has`` run before the
selectors they stand in.

Covered: tags, ``*``, ``#id``, ``.class``, ``[attr]`` with ``= ~= |= ^= $= *= !=`` and the flags ``i`` and ``s``; descendant,
``>``, ``+``, ``~``, lists; ``:is``, ``:where``, ``:not``, ``:has``, ``:empty``, ``:root``, first, last, only and nth
places among children or elements of one tag, with ``an+b``, ``odd``, ``even`` and ``of``.
"""
from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

_NAME = r"(?:[\w\-\u0080-\U0010ffff]|\\[0-9A-Fa-f]{1,6}\s?|\\[^0-9A-Fa-f\n])+"
_PART = re.compile(
    rf"""(?P<tag>\*|{_NAME})
      | \#(?P<id>{_NAME})
      | \.(?P<cls>{_NAME})
      | \[\s*(?P<attr>{_NAME.replace('-', '-:', 1)})\s*
            (?:(?P<op>[~|^$*!]?=)\s*(?P<val>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\]\s]+)\s*(?P<flag>[isIS])?\s*)?\]
      | :(?P<pseudo>[\w-]+)(?P<open>\()?
    """,
    re.VERBOSE,
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_PLACE = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*", re.IGNORECASE)
_ESCAPE = re.compile(r"\\(?:([0-9A-Fa-f]{1,6})\s?|(.))")
# Pseudo-classes that are a place, as (of one tag, counted from the end).
_PLACES = {"child": (False, False), "last-child": (False, True), "of-type": (True, False), "last-of-type": (True, True)}


@dataclass(frozen=True)
class Place:
    """The element's number among its siblings is a n + b for some n >= 0."""
    step: int
    start: int
    same_tag: bool = False
    from_end: bool = False
    among: Selectors | None = None

    def holds(self, number: int) -> bool:
        away = number - self.start
        return away == 0 if self.step == 0 else away * self.step >= 0 and away % self.step == 0


@dataclass(frozen=True)
class Attribute:
    name: str
    op: str | None = None
    value: str = ""
    any_case: bool = False

    def holds(self, attrs: dict[str, str]) -> bool:
        found = attrs.get(self.name)
        if found is None:
            return self.op == "!="
        if self.op is None:
            return True
        if self.name == "class":
            found = " ".join(found.split())
        wanted = self.value
        if self.any_case:
            found, wanted = found.lower(), wanted.lower()
        match self.op:
            case "=":
                return found == wanted
            case "!=":
                return found != wanted
            case "^=":
                return found.startswith(wanted)
            case "$=":
                return found.endswith(wanted)
            case "*=":
                return wanted in found
            case "|=":
                return found == wanted or found.startswith(wanted + "-")
        return wanted in found.split()


@dataclass(frozen=True)
class Compound:
    tag: str | None = None
    ids: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    attributes: tuple[Attribute, ...] = ()
    places: tuple[Place, ...] = ()
    flags: tuple[str, ...] = ()  # "empty", "root"
    lists: tuple[tuple[str, Selectors], ...] = ()  # ("is" | "not" | "has", list)


@dataclass(frozen=True)
class Selectors:
    """A list of chains, each of (combinator before it, compound); the first combinator counts inside ``:has`` only."""
    chains: tuple[tuple[tuple[str, Compound], ...], ...]

    def nested(self) -> list[tuple[str, Selectors]]:
        """The lists that have to run before this one, innermost first."""
        out: list[tuple[str, Selectors]] = []
        for chain in self.chains:
            for _, compound in chain:
                inner = [*compound.lists, *[("is", p.among) for p in compound.places if p.among is not None]]
                for kind, some in inner:
                    out += some.nested()
                    out.append(("has" if kind == "has" else "is", some))
        return out


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else m[2], text) if "\\" in text else text


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self):
        raise ValueError(f"unsupported CSS selector: {self.text!r} at {self.text[self.at:]!r}")

    def blanks(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def more(self, until: str) -> bool:
        return self.at < len(self.text) and self.text[self.at] not in until

    def selectors(self, relative: bool = False) -> Selectors:
        chains = [self.chain(relative)]
        while self.at < len(self.text) and self.text[self.at] == ",":
            self.at += 1
            chains.append(self.chain(relative))
        return Selectors(tuple(chains))

    def chain(self, relative: bool):
        self.blanks()
        link, out = " ", []
        if relative and self.more("") and self.text[self.at] in ">+~":
            link = self.text[self.at]
            self.at += 1
            self.blanks()
        while True:
            out.append((link, self.compound()))
            end = self.at
            m = _COMBINATOR.match(self.text, self.at)
            if m is None:
                return tuple(out)
            self.at = m.end()
            if not self.more(",)"):
                if m[1]:
                    self.at = end
                    self.fail()
                return tuple(out)
            link = m[1] or " "

    def compound(self) -> Compound:
        parts: dict[str, list] = defaultdict(list)
        tag, begin = None, self.at
        while m := _PART.match(self.text, self.at):
            if m["tag"] is not None:
                if self.at > begin:
                    self.fail()
                tag = None if m["tag"] == "*" else _plain(m["tag"]).lower()
            self.at = m.end()
            if m["id"]:
                parts["ids"].append(_plain(m["id"]))
            elif m["cls"]:
                parts["classes"].append(_plain(m["cls"]))
            elif m["attr"]:
                parts["attributes"].append(self.attribute(m))
            elif m["pseudo"]:
                kind, made = self.pseudo(m["pseudo"].lower(), bool(m["open"]))
                parts[kind].append(made)
        if self.at == begin:
            self.fail()
        return Compound(tag, **{k: tuple(v) for k, v in parts.items()})

    @staticmethod
    def attribute(m: re.Match) -> Attribute:
        name, value = _plain(m["attr"]).lower(), m["val"] or ""
        value = _plain(value[1:-1] if value[:1] in ("'", '"') else value)
        flag = (m["flag"] or "").lower()
        return Attribute(name, m["op"], value, flag == "i" or (name == "type" and flag != "s"))

    def pseudo(self, name: str, opened: bool):
        if not opened:
            if name in ("empty", "root"):
                return "flags", name
            which, _, kind = name.partition("-")
            if which in ("first", "last") and kind in ("child", "of-type"):
                return "places", Place(0, 1, kind == "of-type", which == "last")
            if which == "only" and kind in ("child", "of-type"):
                ends = [Place(0, 1, kind == "of-type", e) for e in (False, True)]
                return "lists", ("is", Selectors((((" ", Compound(places=tuple(ends))),),)))
            self.fail()
        if name.startswith("nth-") and (where := _PLACES.get(name[4:])) is not None:
            made = self.place(*where)
        elif name in ("is", "where", "matches", "not", "has"):
            kind = name if name in ("not", "has") else "is"
            made = (kind, self.selectors(relative=kind == "has"))
        else:
            self.fail()
        self.blanks()
        if self.text[self.at:self.at + 1] != ")":
            self.fail()
        self.at += 1
        return ("places" if isinstance(made, Place) else "lists"), made

    def place(self, same_tag: bool, from_end: bool) -> Place:
        m = _PLACE.match(self.text, self.at)
        if m is None:
            self.fail()
        self.at = m.end()
        if m[1]:
            step, start = 2, 1 if m[1].lower() == "odd" else 0
        elif m[5]:
            step, start = 0, int(m[5])
        else:
            step = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
            start = int(m[3] + m[4]) if m[3] else 0
        among = None
        if self.text[self.at:self.at + 3].lower() == "of " and not same_tag:
            self.at += 3
            among = self.selectors()
        return Place(step, start, same_tag, from_end, among)


def compile_selector(text: str) -> Selectors:
    source = (text or "").strip()
    if not source:
        raise ValueError("the CSS selector is empty")
    reader = _Reader(source)
    made = reader.selectors()
    if reader.at < len(source):
        reader.fail()
    return made


@dataclass
class Page:
    """What selectors look at: elements in document order with the number of their parent, -1 for none."""
    tags: list[str]
    attrs: list[dict[str, str]]
    classes: list[list[str]]
    parents: list[int]
    has_text: list[bool]  # text other than white space right inside the element
    numbers: dict = field(default_factory=dict)

    def number(self, place: Place, among: Sequence[bool] | None) -> list[int]:
        """For each element its number among its siblings, 0 where it is not counted."""
        key = (place.same_tag, place.from_end, place.among)
        if key not in self.numbers:
            count, out = Counter(), [0] * len(self.tags)
            order = range(len(self.tags) - 1, -1, -1) if place.from_end else range(len(self.tags))
            for e in order:
                if among is None or among[e]:
                    group = (self.parents[e], self.tags[e]) if place.same_tag else self.parents[e]
                    count[group] += 1
                    out[e] = count[group]
            self.numbers[key] = out
        return self.numbers[key]


def _tests(compound: Compound, page: Page, found: dict) -> list[Callable[[int], bool]]:
    """The tests of a compound beyond its tag, the cheap ones first."""
    out: list[Callable[[int], bool]] = []
    for name in compound.ids:
        out.append(lambda e, name=name: page.attrs[e].get("id") == name)
    for name in compound.classes:
        out.append(lambda e, name=name: name in page.classes[e])
    for attribute in compound.attributes:
        out.append(lambda e, a=attribute: a.holds(page.attrs[e]))
    if "empty" in compound.flags:
        parents = set(page.parents)
        out.append(lambda e: e not in parents and not page.has_text[e])
    if "root" in compound.flags:
        single = page.parents.count(-1) == 1
        out.append(lambda e: single and page.parents[e] == -1)
    for place in compound.places:
        number = page.number(place, None if place.among is None else found["is", place.among])
        out.append(lambda e, p=place, n=number: n[e] > 0 and p.holds(n[e]))
    for kind, some in compound.lists:
        hits = found["has" if kind == "has" else "is", some]
        out.append((lambda e, h=hits: not h[e]) if kind == "not" else (lambda e, h=hits: h[e]))
    return out


class _States:
    """States of several chains as bits, by the tag they need."""

    def __init__(self, chains, page: Page, found: dict):
        self.ends, self.by_tag, self.anywhere, self.starts = [], defaultdict(list), [], []
        bit = 1
        for chain in chains:
            for i, (link, compound) in enumerate(chain):
                after = chain[i + 1][0] if i + 1 < len(chain) else None
                state = (bit, link if i else None, bit >> 1, after, bit << 1, _tests(compound, page, found))
                (self.by_tag[compound.tag] if compound.tag is not None else self.anywhere).append(state)
                if i == 0:
                    self.starts.append((link, bit))
                bit <<= 1
            self.ends.append(bit >> 1)
        self.of = {}

    def at(self, tag: str) -> list:
        found = self.of.get(tag)
        if found is None:
            found = self.of[tag] = [*self.by_tag.get(tag, ()), *self.anywhere]
        return found


def _forward(chains, page: Page, found: dict) -> tuple[list[int], list[int]]:
    """The states of every element, and the last state of each chain."""
    states = _States(chains, page, found)
    n = len(page.tags)
    # Sets of the element itself and of it with its ancestors, then of its last child so far and of all its children so far;
    # the place behind the last element stands for the page.
    own, line, last, before = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for e, (tag, p) in enumerate(zip(page.tags, page.parents)):
        here = 0
        for bit, link, need, _, _, tests in states.at(tag):
            if link is not None:
                held = line[p] if link == " " else own[p] if link == ">" else last[p] if link == "+" else before[p]
                if not held & need:
                    continue
            if all(t(e) for t in tests):
                here |= bit
        own[e], line[e] = here, line[p] | here
        last[p] = here
        before[p] |= here
    return own[:n], states.ends


def _backward(chains, page: Page, found: dict) -> list[bool]:
    """Whether a chain begins behind each element as its first combinator says."""
    states = _States(chains, page, found)
    n = len(page.tags)
    # Sets of the children and of all descendants, of the next child and of all later ones.
    below, inside, coming, later = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    out = [False] * n
    for e in range(n - 1, -1, -1):
        p, here = page.parents[e], 0
        around = {" ": inside[e], ">": below[e], "+": coming[p], "~": later[p]}
        out[e] = any(around[link] & bit for link, bit in states.starts)
        for bit, _, _, after, following, tests in states.at(page.tags[e]):
            if (after is None or around[after] & following) and all(t(e) for t in tests):
                here |= bit
        below[p] |= here
        inside[p] |= here | inside[e]
        coming[p] = here
        later[p] |= here
    return out


def select(page: Page, lists: Sequence[Selectors]) -> list[list[int]]:
    """For each list the numbers of the elements it selects, in document order."""
    found: dict = {}
    for some in lists:
        for kind, inner in some.nested():
            if (kind, inner) not in found:
                if kind == "has":
                    found[kind, inner] = _backward(inner.chains, page, found)
                else:
                    own, ends = _forward(inner.chains, page, found)
                    mask = sum(ends)
                    found[kind, inner] = [bool(x & mask) for x in own]
    own, ends = _forward([c for some in lists for c in some.chains], page, found)
    out, at = [], 0
    for some in lists:
        mask = sum(ends[at:at + len(some.chains)])
        at += len(some.chains)
        out.append([e for e, x in enumerate(own) if x & mask])
    return out
