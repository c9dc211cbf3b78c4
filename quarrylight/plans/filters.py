"""Filters: a JSON-like tree compiled to one Spark predicate.

The logic has two values: a comparison with a missing field is false, and its
negation true.  SQL's logic has three.  Rather than wrap leaves in coalesce,
which would keep them from the Parquet reader, negation is pushed down to the
leaves, where "not (a = v)" is "a is null or a <> v".
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT, NUMBER = "text", "number"
#: Fields that searches can filter on.
SEARCH_FIELDS = {"kind": TEXT, "modality": TEXT, "doc_id": TEXT, "collection": TEXT, "tenant": TEXT, "page": NUMBER, "section_id": NUMBER, "time_start_ms": NUMBER, "time_end_ms": NUMBER}
#: Fields of rows of the chunk table itself.
ROW_FIELDS = {"kind": TEXT, "modality": TEXT, "doc_id": TEXT, "tenant": TEXT, "page": NUMBER, "section_id": NUMBER, "chunk_id": NUMBER, "char_len": NUMBER, "searchable": "bool"}

_COMPARE: dict[str, tuple[Callable, Callable]] = {
    "eq": (lambda c, v: c == v, lambda c, v: c != v),
    "ne": (lambda c, v: c != v, lambda c, v: c == v),
    "gt": (lambda c, v: c > v, lambda c, v: c <= v),
    "gte": (lambda c, v: c >= v, lambda c, v: c < v),
    "lt": (lambda c, v: c < v, lambda c, v: c >= v),
    "lte": (lambda c, v: c <= v, lambda c, v: c > v),
}


def _type(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return NUMBER
    if isinstance(value, str):
        return TEXT
    raise ValueError(f"not a filter value: {value!r}")


def _leaf(op: str, field: str, value: Any, negated: bool, fields: dict[str, str]) -> Column:
    kind = fields.get(field)
    col = F.col(field) if kind else None
    missing = col.isNull() if kind else F.lit(True)
    if op == "exists":
        return (missing if negated else ~missing) if kind else F.lit(negated)
    if op == "in":
        same = [v for v in value if _type(v) == kind]
        if not same:
            return F.lit(negated)
        return missing | ~col.isin(same) if negated else col.isin(same)
    if not kind:
        return F.lit(negated)
    if _type(value) != kind:
        # different types are unequal, and have no order
        return missing if op == "ne" and negated else ~missing if op == "ne" else F.lit(negated)
    if kind == "bool" and op not in ("eq", "ne"):
        return F.lit(negated)
    plain, opposite = _COMPARE[op]
    return missing | opposite(col, F.lit(value)) if negated else plain(col, F.lit(value))


def compile_filter(tree: dict | None, fields: dict[str, str] = SEARCH_FIELDS, negated: bool = False) -> Column:
    """A predicate that is true where the filter holds, and false or null elsewhere.  An unknown field is missing everywhere; an unknown operator raises."""
    if tree is None:
        return F.lit(not negated)
    if not isinstance(tree, dict) or len(tree) != 1:
        raise ValueError(f"a filter has one operator: {tree!r}")
    (op, arg), = tree.items()
    if op in ("and", "or"):
        parts = [compile_filter(t, fields, negated) for t in arg]
        if (op == "and") != negated:
            return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
    if op == "not":
        return compile_filter(arg, fields, not negated)
    if op == "heading_prefix":
        if not arg:
            return F.lit(not negated)
        at = F.slice("heading_path", 1, len(arg)) == F.array(*[F.lit(x) for x in arg])
        return F.col("heading_path").isNull() | ~at if negated else F.col("heading_path").isNotNull() & at
    if op == "exists":
        return _leaf(op, arg, None, negated, fields)
    if op == "in" or op in _COMPARE:
        field, value = arg
        return _leaf(op, field, value, negated, fields)
    raise ValueError(f"unknown filter operator: {op!r}")


def targets_image(tree: dict | None) -> bool:
    """Whether a filter asks for images in so many words."""
    if not tree:
        return False
    (op, arg), = tree.items()
    if op in ("and", "or"):
        return any(map(targets_image, arg))
    if op == "eq":
        return list(arg) == ["modality", "image"]
    return op == "in" and arg[0] == "modality" and "image" in arg[1]


def visible(tenant: str | None, tags: Sequence[str] = ()) -> Column:
    """What a caller may see: rows of its tenant (any, for a caller without one) that are public or share a tag."""
    open_to = F.array_contains("acl", "public")
    if tags:
        open_to = open_to | F.arrays_overlap("acl", F.array(*[F.lit(t) for t in tags]))
    return open_to if tenant is None else (F.col("tenant") == tenant) & open_to
