"""Operators as plain loops over all rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from flowlens.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def brute_links(rows):
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n, group = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                n[i] += 1
                n[j] += 1
                group[max(root(i), root(j))] = min(root(i), root(j))
    return n, [root(i) for i in range(len(rows))]


def brute_mix(rows, weight=None):
    """How often each row (id, text, source) is taken, as a multiset with id and text, and the targets, by sorting each source as a whole.
    weight: of a text; else as the operator takes it from signs."""
    size = lambda t: len(words(t))
    by = defaultdict(list)
    for key, text, source, *_ in rows:
        u = (int(hashlib.md5(f"{'' if key is None else key}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        own = 1 - 4 * sum(c in mixing.SIGNS for c in text or "") / max(len(text or ""), 1) if weight is None else weight(text)
        by[source].append((-math.log(u) / max(mixing.LEAST_QUALITY, own), "" if key is None else str(key), hashlib.md5((text or "").encode()).hexdigest(), key, text))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(r[4]) for r in by[s]) for s in names}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, left, total = {}, set(names), 1.5 * sum(sizes.values())
    while left:
        level = (total - sum(2 * sizes[s] for s in names if s not in left)) / sum(weights[s] for s in left)
        over = {s for s in left if weights[s] * level > 2 * sizes[s]}
        goal |= {s: min(2 * sizes[s], weights[s] * level) for s in left}
        if not over:
            break
        left -= over
    out = Counter()
    for s in names:
        epochs = int(goal[s] // sizes[s]) if sizes[s] else 0
        budget, start = goal[s] - epochs * sizes[s], 0
        for *_, key, text in sorted(by[s], key=lambda r: r[:3]):
            n = size(text)
            out[key, text, epochs + (n > 0 and start + n / 2 <= budget)] += 1
            start += n
    return out, goal


def brute_lines(rows, least=6):
    """Text and number of removed lines of each row (id, text, source)."""
    trim = lambda x: x.strip(" \t\n\v\f\r")
    sites, whole = defaultdict(set), defaultdict(set)
    for _, text, source, *_ in rows:
        if text is not None and source is not None:
            whole[text].add(source)
            for x in text.split("\n"):
                sites[trim(x)].add(source)
    out = []
    for _, text, *_ in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if not trim(x) or len(sites[trim(x)]) < least]
        clear = text is not None and len(kept) < len(own) and any(map(trim, kept)) and len(whole[text]) < least
        out.append(("\n".join(kept), len(own) - len(kept)) if clear else (text, 0))
    return out
