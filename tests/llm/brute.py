"""The pipeline's stages by brute force, for small tables."""

from __future__ import annotations

import re
from itertools import combinations


def _components(sets: list[set], threshold: float = 0.8) -> list[int]:
    up = list(range(len(sets)))

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))]


def _first(i: int | None) -> tuple[bool, int]:
    return i is not None, i or 0


def dedup_lines(rows: list[tuple]) -> list[tuple]:
    """rows: doc_id, text. A line stays if its document is its component's first and it is that row's first line of it."""
    lines = [(r, k, x) for r, (_, t) in enumerate(rows) if t is not None for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\v\f\r")]
    of = _components([{x[i : i + 6] for i in range(max(1, len(x) - 5))} for _, _, x in lines])
    first = {}
    for (r, _, _), c in zip(lines, of, strict=True):
        first[c] = min(first.get(c, (True, 1 << 62)), _first(rows[r][0]))
    gone, seen = set(), set()
    for (r, k, _), c in zip(lines, of, strict=True):
        if _first(rows[r][0]) != first[c] or (r, c) in seen:
            gone.add((r, k))
        seen.add((r, c))
    out = []
    for r, (i, t) in enumerate(rows):
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r, k) not in gone)
        if t is None or left.strip(" \t\n\v\f\r") or not t.strip(" \t\n\v\f\r"):
            out.append((i, left))
    return out


def keep_distinct(rows: list[tuple]) -> set[tuple]:
    """rows: doc_id, text. Those of which one must stay: by class the ones of the least doc_id; texts without words are classes of their own."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    by: dict[int, list[tuple]] = {}
    for row, s, c in zip(rows, sets, _components(sets), strict=True):
        by.setdefault(c if s else -1 - len(by), []).append(row)
    return {frozenset(x for x in group if _first(x[0]) == min(_first(y[0]) for y in group)) for group in by.values()}


def contaminated(text: str | None, items: list[str | None]) -> bool:
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit = split(text), set()
    for x in map(split, items):
        k = min(13, len(x))
        for s in range(len(x) - k + 1) if x else ():
            for p in range(len(w) - k + 1):
                if w[p : p + k] == x[s : s + k]:
                    hit.update(range(p, p + k))
    return bool(hit) and 20 * len(hit) >= len(w)
