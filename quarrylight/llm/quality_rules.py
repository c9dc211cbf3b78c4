"""Quality rules: decision lists learned by sequential covering.

From a few statistics of labelled documents rules are learned for the bad
class, one after another: conditions "statistic <= or >= threshold" are added
while they gain information on two thirds of the examples, dropped from the
end while that helps on the other third, and what a rule covers is taken out.
The list is applied as one Spark CASE expression over the same statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import fresh

#: Labelled documents of each class that training reads at most.
TRAIN_ROWS = 5000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_SYMBOLS = "#$%&*@^~_=+<>{}[]\\/"


def statistics(text: Column) -> dict[str, Column]:
    """Each is a number for any text; of an empty text 0."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    without = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("double")
    words = without(" \n\t") + F.when(t == "", 0.0).otherwise(1.0)
    lines = F.split(t, "\n")
    return {
        "chars": F.length(t).cast("double"),
        "word_length": F.round(n / F.greatest(words, F.lit(1.0)), 4),
        "upper": F.round(without(_UPPER) / n, 4),
        "digits": F.round(without("0123456789") / n, 4),
        "symbols": F.round(without(_SYMBOLS) / n, 4),
        "pipes": F.round(without("|") / n, 4),
        "exclamations": F.round(without("!?") / n, 4),
        "stops": F.round(without(".,;:") / n, 4),
        "distinct_lines": F.round(F.size(F.array_distinct(lines)).cast("double") / F.size(lines), 4),
    }


@dataclass(frozen=True)
class Rule:
    """All conditions (statistic, at most, threshold) hold: the document is bad."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, [stats[s] <= v if most else stats[s] >= v for s, most, v in self.conditions])

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([x[s] <= v if most else x[s] >= v for s, most, v in self.conditions])

    def __str__(self) -> str:
        return " and ".join(f"{s} {'<=' if most else '>='} {v:g}" for s, most, v in self.conditions)


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    return p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2((p0 + 1e-9) / (p0 + n0 + 1e-9)))


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, tuple[str, bool, float]]:
    best = (0.0, ("", True, 0.0))
    p0, n0 = float(bad.sum()), float((~bad).sum())
    for s in sorted(x):
        o = np.argsort(x[s], kind="stable")
        v, y = x[s][o], bad[o]
        p, n = np.cumsum(y).astype(float), np.cumsum(~y).astype(float)
        edge = np.flatnonzero(v[1:] != v[:-1])
        if not len(edge):
            continue
        for most, pp, nn in ((True, p[edge], n[edge]), (False, p0 - p[edge], n0 - n[edge])):
            g = _gain(p0, n0, pp, nn)
            k = int(np.argmax(g))
            if g[k] > best[0] + 1e-9:
                best = (float(g[k]), (s, most, float(v[edge[k]] if most else v[edge[k] + 1])))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 3, seed: int = 11) -> list[Rule]:
    """Ordered rules for the bad examples; only rules of that precision on held-out examples, too, are kept.

    Without ``least`` bad examples, or where no statistic tells them, there are
    none.  Of thresholds that gain equally the first statistic by name wins, and
    its least threshold.
    """
    rules: list[Rule] = []
    held = np.random.default_rng(seed).permutation(len(bad)) % 3 == 0
    left = np.ones(len(bad), bool)
    tried: set[str] = set()
    while (bad & left & ~held).sum() >= least:
        grow, prune = left & ~held, left & held
        conditions: list[tuple[str, bool, float]] = []
        inside = grow.copy()
        while (~bad & inside).any() or not conditions:
            # after rules that didn't hold up, one that begins with another statistic
            gain, c = _best_condition({s: v[inside] for s, v in x.items() if conditions or s not in tried}, bad[inside])
            if gain <= 0:
                break
            conditions.append(c)
            inside &= Rule((c,)).covers(x)
        if not conditions:
            break

        def worth(k: int) -> float:
            c = Rule(tuple(conditions[:k])).covers(x) & prune
            p, n = (c & bad).sum(), (c & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        keep = max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))
        rule = Rule(tuple(conditions[:keep]))
        c = rule.covers(x) & left
        p, n = (c & bad).sum(), (c & ~bad).sum()
        ph, nh = (c & bad & held).sum(), (c & ~bad & held).sum()
        if p < least or p < precision * (p + n) or ph < precision * (ph + nh):
            tried.add(conditions[0][0])
            continue
        rules.append(rule)
        left &= ~c
        tried = set()
    return rules


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, precision: float = 0.9, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Rules from labelled documents: of each class about ``train_rows`` at most, chosen by the hash of the id.

    Only their statistics reach the driver.  Rows with a null id or label teach
    nothing; without examples of both classes there are no rules.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i")).agg((F.min(label_col) <= 0).alias("bad"))
    counts = {r["bad"]: r["n"] for r in known.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return []
    share = F.when(F.col("bad"), min(1.0, train_rows / counts[True])).otherwise(min(1.0, train_rows / counts[False]))
    chosen = known.where(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < share * 1_000_000)
    stats = statistics(F.col("t"))
    # about 2 x train_rows ids, so that no text is shuffled
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "i").select("i", "bad", *[c.alias(s) for s, c in stats.items()]).toArrow().sort_by([("i", "ascending"), ("chars", "ascending")])
    return learn({s: np.asarray(rows[s]) for s in stats}, np.asarray(rows["bad"]).astype(bool), precision)


def decision(rules: list[Rule], stats: dict[str, Column]) -> Column:
    """The number (from 1) of the first rule that holds, or 0: one CASE expression."""
    out = None
    for k, r in enumerate(rules, 1):
        out = F.when(r.column(stats), k) if out is None else out.when(r.column(stats), k)
    return F.lit(0) if out is None else out.otherwise(0)


def apply_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs with rule (0: none), reason (the rule in words, null if none) and keep; such columns are replaced.

    Null and empty texts have statistics of 0 and are judged by the same rules.
    Repeated rows are judged alike; an empty table gives an empty one.  Narrow,
    inside code generation: no shuffle, no Python.  Only statistics that a rule
    names are computed, once for each row.
    """
    rest = [c for c in docs.columns if c.lower() not in ("rule", "reason", "keep")]
    reasons = F.array(F.lit(None).cast("string"), *[F.lit(str(r)) for r in rules])
    used = sorted({s for r in rules for s, _, _ in r.conditions})
    names = dict(zip(used, fresh(docs, *(f"q_{s}" for s in used))))
    stats = statistics(F.col(text_col))
    with_stats = docs.select(*rest, *[stats[s].alias(n) for s, n in names.items()])
    judged = with_stats.select(*rest, decision(rules, {s: F.col(n) for s, n in names.items()}).cast("int").alias("rule"))
    return judged.select("*", F.element_at(reasons, F.col("rule") + 1).alias("reason"), (F.col("rule") == 0).alias("keep"))
