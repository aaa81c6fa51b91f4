"""Straightforward versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def sha(text: bytes | str) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def repeats(docs, length):
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k:k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = [True] * length
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def simhash(text):
    import xxhash
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def components(n, links):
    """Smallest member of each node's component."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for start in range(n):
        if start in out:
            continue
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in out:
                out[x] = start
                stack += near[x]
    return out


def contamination(docs, items, window=13):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in [tuple(w[k:k + window]) for k in range(len(w) - window + 1)] or ([tuple(w)] if w else []):
            windows[s].add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(s) for s in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        found = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(found), sha(",".join(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def base_spans(text):
    """(start, rank, kind, end), sorted."""
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(s):
        total = 0
        for i, x in enumerate(reversed(digits(s))):
            total += int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x))))
        return 12 <= len(digits(s)) <= 19 and total % 10 == 0

    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15))
    return sorted((m.start(), r, kind, m.end()) for r, (kind, rule, ok) in enumerate(rules)
                  for m in re.finditer(rule, text or "") if ok(m.group()))
