"""Fuzzy comparison of texts inside a worker; plain Python, so that tasks can import it."""

from __future__ import annotations


def close(line: str, others: dict, threshold: float) -> bool:
    """Whether ``line`` has a ratio above the threshold with any of ``others`` (texts by length). Lengths that allow no
    such ratio are not looked at, nor is more of a pair than its upper bounds ask for."""
    from difflib import SequenceMatcher

    n = len(line)
    for m, texts in others.items():
        if n + m and 2 * min(n, m) <= threshold * (n + m):
            continue
        for other in texts:
            if line == other and n < 200:  # difflib leaves out frequent characters of longer texts
                return True
            sm = SequenceMatcher(None, line, other)
            if sm.real_quick_ratio() > threshold and sm.quick_ratio() > threshold and sm.ratio() > threshold:
                return True
    return False


def by_length(texts) -> dict:
    out = {}
    for t in texts:
        out.setdefault(len(t), set()).add(t)
    return out
