"""Label-map functions: filters, renames, library filter (row-local column expressions)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.operators.rates import max_range_label


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


# P7 -------------------------------------------------------------------------
def has_label(freq_map, label: str, kind: str, use_max: bool = False) -> Column:
    """Reason: key equality. Horizon: the label is a word of a key, or -- for
    a range label with ``use_max`` -- it is the row's greatest range."""
    m = _c(freq_map)
    if kind == "reason":
        return F.coalesce(F.map_contains_key(m, F.lit(label)), F.lit(False))
    if use_max and label in ("Short-Range", "Medium-Range", "Long-Range"):
        return F.coalesce(max_range_label(m) == label, F.lit(False))
    return F.coalesce(F.exists(F.map_keys(m), lambda k: F.array_contains(F.split(k, " "), label)), F.lit(False))


# P19 / P20 ------------------------------------------------------------------
def _last_wins(entries: Column) -> Column:
    """Keep, per key, the entry at the greatest position (``dict`` assignment order)."""
    n = F.size(entries)
    kept = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(kept)


def _summed(entries: Column) -> Column:
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.aggregate(
        F.filter(entries, lambda e: e["key"] == k), F.lit(0), lambda a, e: a + e["value"])))


def rename_labels(freq_map, mapping: Mapping[str, str], sum_values: bool = False) -> Column:
    """Rewrite map keys by ``mapping``; on collisions the last entry wins (the
    counts are *not* added) unless ``sum_values``."""
    m, lm = _c(freq_map), _lit_map(mapping)
    ent = F.transform(F.map_entries(m), lambda e: F.struct(
        F.coalesce(lm[e["key"]], e["key"]).alias("key"), e["value"].alias("value")))
    return _summed(ent) if sum_values else _last_wins(ent)


def rename_first_word(freq_map, mapping: Mapping[str, str]) -> Column:
    """Rewrite the first word of each key; collisions: last wins."""
    m, lm = _c(freq_map), _lit_map(mapping)

    def new_key(k):
        first = F.substring_index(k, " ", 1)
        rest = F.when(F.instr(k, " ") > 0, F.substring(k, F.instr(k, " ") + 1, F.length(k))).otherwise(F.lit(None))
        return F.concat_ws(" ", F.coalesce(lm[first], first), rest)

    ent = F.transform(F.map_entries(m), lambda e: F.struct(new_key(e["key"]).alias("key"),
                                                           e["value"].alias("value")))
    return _last_wins(ent)


# P14 ------------------------------------------------------------------------
def report_library(path, classes: Sequence[str], packages: Sequence[str]) -> Column:
    """True unless the import is a well-known class, ends in ``.Class`` or
    starts with a well-known package (a trailing ``*`` is stripped first)."""
    p = _c(path)
    cls = F.array(*[F.lit(c) for c in classes])
    pkg = F.array(*[F.lit(x) for x in packages])
    known = (F.array_contains(cls, p)
             | F.exists(cls, lambda c: p.endswith(F.concat(F.lit("."), c)))
             | F.exists(pkg, lambda k: p.startswith(k)))
    wild = p.endswith("*") & F.exists(pkg, lambda k: F.regexp_replace(p, r"\*$", "").startswith(k))
    return ~(known | wild)
