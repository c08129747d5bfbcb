"""Plain versions of the corpus operators for small tables: no Spark, no short cuts."""
from __future__ import annotations

import hashlib
from collections import Counter
from fractions import Fraction

SPACE = " \t\n\x0b\x0c\r"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def lower(text: bytes) -> bytes:
    return text.lower()


def quality(text: str | None, stop_words) -> dict:
    body, w = text or "", [x.decode() for x in words(text)]
    lines = [l for l in body.split("\n") if words(l)]
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for k in range(8)}
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in body),
         "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    stop = sum(x in stop_words or x in {s.capitalize() for s in stop_words} for x in w)
    m["base_failed"] = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    m["kept"] = (not m["base_failed"] and 2 * len(w) <= m["word_chars"] <= 15 * len(w) and m["n_symbols"] <= 0.5 * len(w)
                 and stop >= 0.02 * len(w) and m["n_dup_lines"] <= 0.5 * len(lines))
    return m


def line_key(line: str) -> bytes:
    return line.encode().strip(SPACE.encode()).lower()


def drop_lines(texts: list[str | None], least: int) -> list[tuple[str, int, int]]:
    """(text, lines, dropped) of each text."""
    found = Counter(k for t in texts for k in {line_key(l) for l in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [l for l in lines if found[line_key(l)] < least]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def shingles(text: str | None) -> frozenset:
    w = lower((text or "").encode()).split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def roots(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_copies(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, int, int | None]]:
    """(id, shingles, component) of each row."""
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
             if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    root = roots(len(rows), links)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id))
    return out


def mixed(rows: list[tuple[int | None, str | None, int]], weights=(5, 2, 1), most: int = 3, seed: int = 42) -> list[int]:
    """Words taken of each (id, source, size)."""
    sizes = Counter()
    for _, source, n in rows:
        sizes[source] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), Fraction(sum(sizes.values()))
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * rate > most * sizes[s]}
        if not full:
            target |= {s: weight[s] * rate for s in open_}
            break
        for s in full:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        open_ -= full

    def key(doc_id) -> int:
        return int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:15], 16)

    taken = [0] * len(rows)
    for s in order:
        budget = int(target[s])
        epochs, rest = (budget // sizes[s], budget % sizes[s]) if sizes[s] else (0, 0)
        by_key: dict[int, list[int]] = {}
        for i, (doc_id, source, n) in enumerate(rows):
            if source == s:
                taken[i] = epochs * n
                by_key.setdefault(key(doc_id), []).append(i)
        for k in sorted(by_key):
            total = sum(rows[i][2] for i in by_key[k])
            part = min(rest, total)
            for i in by_key[k]:
                taken[i] += part * rows[i][2] // total if total else 0
            rest -= part
    return taken
