"""Search requests and callers."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..model import decode_cursor

MODES = ("keyword", "vector", "hybrid")
FUSIONS = ("rrf", "normalized", "weighted")


@dataclass(frozen=True)
class Caller:
    """Who asks.  Access follows from this alone, never from the request."""

    tenant: str | None = None
    tags: tuple[str, ...] = ()

    @classmethod
    def table(cls, text: str) -> dict[str, Caller]:
        """Callers by key, from "key=tenant:tag,tag;key=:tag"."""
        out = {}
        for entry in filter(None, (x.strip() for x in text.split(";"))):
            key, eq, rest = entry.partition("=")
            if not key or not eq:
                raise ValueError(f"not key=tenant:tags: {entry!r}")
            tenant, _, tags = rest.partition(":")
            out[key.strip()] = cls(tenant.strip() or None, tuple(t.strip() for t in tags.split(",") if t.strip()))
        return out


@dataclass(frozen=True)
class SearchRequest:
    query: str = ""
    mode: str = "hybrid"
    fusion: str = "rrf"
    rank_constant: float = 60.0
    ratio: float = 0.5
    filter: dict | None = None
    vector: list[float] | None = None
    candidates: int = 150
    top_k: int = 20
    k1: float = 1.2
    b: float = 0.75
    text_boost: float = 1.0
    heading_boost: float = 2.0
    probes: int | None = None
    rerank: int | None = None
    auto_merge: bool = False
    collapse: str | None = None
    max_per_group: int = 1
    search_after: str | None = None
    highlight: bool = False
    include_text: bool = False
    include_metadata: bool = False
    facets: tuple[str, ...] = ()
    ignored: dict[str, Any] = field(default_factory=dict)

    def validate(self) -> SearchRequest:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.mode in MODES, f"mode is one of {MODES}")
        need(self.fusion in FUSIONS, f"fusion is one of {FUSIONS}")
        need(1 <= self.top_k <= 10_000, "top_k is from 1 to 10000")
        need(self.top_k <= self.candidates <= 100_000, "candidates are from top_k to 100000")
        need(self.rank_constant > 0, "rank_constant is positive")
        need(0 <= self.ratio <= 1, "ratio is from 0 to 1")
        need(self.k1 >= 0 and 0 <= self.b <= 1, "k1 is not negative, b from 0 to 1")
        need(self.rerank is None or self.rerank > 0, "rerank is positive")
        need(self.max_per_group > 0, "max_per_group is positive")
        if self.search_after is not None:
            decode_cursor(self.search_after)
        return self

    @classmethod
    def parse(cls, body: dict) -> SearchRequest:
        """From the JSON form, in which fusion, rerank and collapse are objects."""
        body = dict(body)
        fusion = body.pop("fusion", None) or {}
        rerank, collapse = body.pop("rerank", None), body.pop("collapse", None)
        known = {k: body.pop(k) for k in list(body) if k in cls.__dataclass_fields__ and k != "ignored"}
        if fusion:
            known["fusion"] = fusion.get("method", "rrf")
            known |= {to: fusion[k] for k, to in (("k", "rank_constant"), ("rank_constant", "rank_constant"), ("semantic_ratio", "ratio"), ("alpha", "ratio")) if k in fusion}
        if rerank:
            known["rerank"] = rerank.get("top_k", 50)
        if collapse:
            known |= {"collapse": collapse["field"], "max_per_group": collapse.get("max_per_group", 1)}
        if "facets" in known:
            known["facets"] = tuple(known["facets"])
        return cls(**known, ignored=body).validate()
