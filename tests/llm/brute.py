"""Plain versions of the operators, for comparison."""

from __future__ import annotations

import re
from collections import defaultdict

import xxhash


def words(t):
    return [x for x in (re.sub(r"[\W_]+", "", y.lower()) for y in (t or "").split()) if x]


def shingle_set(t, n=5):
    w = words(t)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def jaccard_classes(rows, threshold=0.8):
    """rows (id, text) -> id: (class, links)."""
    sets = {i: shingle_set(t) for i, t in rows}
    inv = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            inv[x].add(i)
    link = {i: set() for i in sets}
    for i in sets:
        shared = defaultdict(int)
        for x in sets[i]:
            for j in inv[x]:
                shared[j] += j != i
        for j, n in shared.items():
            if j != i and n >= threshold * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                link[i].add(j)
    out = {}
    for i in sorted(sets):
        if i in out:
            continue
        out[i], todo = (i, len(link[i])), [i]
        while todo:
            for y in link[todo.pop()]:
                if y not in out:
                    out[y] = (i, len(link[y]))
                    todo.append(y)
    return out


def units(t):
    toks = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", t)]
    found = []
    for k, (w, a, b) in enumerate(toks):
        gap = t[b : toks[k + 1][1] if k + 1 < len(toks) else len(t)]
        plain = re.sub(r"[\W_]+", "", w.lower())
        end = bool(re.search(r"[.!?…]+[\"'»”’)\]]*$", w)) or "\n" in gap
        if plain:
            found.append([plain, a, end])
        elif found and end:
            found[-1][2] = True
    out, cur, inner = [], [], 0
    for x in found:
        cur.append(x)
        inner += 1
        if x[2] or inner > 12 and (xxhash.xxh3_64_intdigest(x[0]) >> 32) % 8 == 0:
            out.append(cur)
            cur = []
            if x[2]:
                inner = 0
    return [*out, cur] if cur else out


def runs(u):
    out = set()
    for i in range(len(u)):
        for step in (1, -1):
            j, n = i, len(u[i])
            while 0 <= j + step < len(u) and (abs(j - i) + 1 < 3 or n < 16):
                j += step
                n += len(u[j])
            if abs(j - i) + 1 >= 3 and n >= 16:
                out.add((min(i, j), max(i, j)))
    return out


def dedup(rows):
    """rows (id, text) -> id: text without repeated spans."""
    first, made = {}, {}
    say = lambda u, a, b: " ".join(w[0] for x in u[a : b + 1] for w in x)
    for i, t in sorted(rows):
        made[i] = u = units(t)
        for a, b in sorted(runs(u)):
            first.setdefault(say(u, a, b), (i, a))
    out = {}
    for i, t in rows:
        u, drop = made[i], set()
        for a, b in runs(u):
            if first[say(u, a, b)] != (i, a):
                drop |= set(range(a, b + 1))
        at = [x[0][1] for x in u] + [len(t)]
        out[i] = (t[: at[0]] + "".join(t[at[k] : at[k + 1]] for k in range(len(u)) if k not in drop)) if u else t
    return out


def edits_within(pattern, text):
    """The fewest edits of the pattern anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)
