"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text, own = text or "", words(text)
    n, seen, repeats, covered = len(own), set(), 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(own[k:k + 8]) for k in range(n - 7))
    for k in range(n - 7):
        if windows[tuple(own[k:k + 8])] > 1:
            covered.update(range(k, k + 8))
    return n, sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered), n < 20 or 100 * len(covered) > 30 * n


def exact_keep(rows):
    """Digest -> (keep_id, rows) of (doc_id, text) rows."""
    groups = collections.defaultdict(list)
    for key, text in rows:
        groups[hashlib.sha256("".join(words(text)).encode()).hexdigest()].append((-len(text or ""), key is None, key or 0, key))
    return {d: (min(g)[3], len(g)) for d, g in groups.items()}


def shingles(text, width):
    own = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return frozenset()
    return frozenset([tuple(own)] if len(own) < width else [tuple(own[k:k + width]) for k in range(len(own) - width + 1)])


def components(rows, width, percent):
    """doc_id -> smallest id of its component, by comparing all pairs."""
    sets = [(key, shingles(text, width)) for key, text in rows]
    parent = {key: key for key, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    return {key: find(key) for key in parent}


def targets(sizes, repeats=3):
    """Source -> target by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > repeats * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


def mixed(rows, repeats=3):
    """(doc_id, source, words taken per copy) of (doc_id, text, source) rows, in queue order of the digest."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    goal = {s: math.floor(t + 0.5) for s, t in targets(dict(sizes), repeats).items()}
    at, out = collections.Counter(), []
    for key, text, source in sorted(rows, key=lambda r: md5(("" if r[0] is None else str(r[0])) + md5(r[1] or ""))):
        n = len(words(text))
        copies = [max(0, min(n, goal[source] - at[source] - turn * sizes[source])) for turn in range(repeats)]
        out.append((key, text, source, [c for c in copies if c]))
        at[source] += n
    return out
