"""Near duplicates of embeddings by NN-descent.

A graph of k neighbours for each vector is refined by joining neighbours of
neighbours: whatever two vectors are near a third are compared, if one of them
is new to it.  The first graph comes from vectors sorted by the signs of random
hyperplanes: each is compared with those beside it, so a hot bucket is many
tasks' work.  A vector whose list is full of neighbours that reach the
threshold is saturated and gets a list twice as long, until it is WIDEST times
the first length.  Rounds end when they find hardly any more edges.

Lists of a large group of copies are full of the group's own kind, however long
they are.  So the vectors that stay saturated search again among themselves for
neighbours in other groups only (groups are the components of the edges so
far), level by level until none is saturated or no groups meet.

While the graph is refined vectors travel as 8-bit codes, and the graph of a
range of vectors is one packed row.  At the end all vectors that edges connect
are compared with each other exactly, tile by tile: so no link is lost to the
length of lists, and a group's links are counted, not listed.  The recall is
audited: sampled vectors, for each of which a neighbour is planted, are
compared with all others, and their links must lie within the groups found.
Equal vectors are one vector with a number of rows throughout.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpoint, pack, partitions, unpack
from .components import components, local_components
from .textkernel import mix

#: What 8-bit codes may be off by.
MARGIN = 0.03
#: How far lists grow; vectors compared with each other in the first sorted lists; vectors of a tile; vectors of a packed row.
WIDEST, BLOCK, TILE, RANGE = 4, 64, 1500, 20_000
#: Kinds of packed rows: the graph of a range; a vector that begins; who lists a vector; whose code is asked for; that code; an edge that may be better.
STATE, BEGIN, REVERSE, ASK, TELL, EDGE = range(6)
_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("body", pa.binary()), ("near", pa.int64()), ("found", pa.int64())])
_ROWS = "part int, kind int, body binary, near long, found long"
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _row(part: int, kind: int, body: bytes, near: int = 0, found: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, kind, body, near, found), _PACKED)], schema=_PACKED)


def _part(u: np.ndarray, parts: int) -> np.ndarray:
    return (mix(u.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _send(kind: int, to: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Columns, the first of them ``to``, packed by the range of ``to``."""
    part = _part(to, parts)
    o = np.argsort(part, kind="stable")
    b = np.append(np.searchsorted(part[o], np.arange(parts)), len(o))
    for p in range(parts):
        x = o[b[p] : b[p + 1]]
        if len(x):
            yield _row(p, kind, pack(to[x], *(c[x] for c in columns)))


def _void(x: np.ndarray) -> np.ndarray:
    """Codes as one value each."""
    return np.ascontiguousarray(x).view(f"V{x.shape[1]}").reshape(len(x))


def _unit(code: np.ndarray) -> np.ndarray:
    x = code.view(np.int8).reshape(len(code), -1).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _read(batches: Iterator[pa.RecordBatch], dtypes: dict[int, tuple]) -> tuple[list, dict[int, list[np.ndarray] | None], int]:
    """The graph (or None), the columns of each kind of row, and the number of the range."""
    graph, held, part = None, {k: [] for k in dtypes}, 0
    for batch in batches:
        for p, kind, body in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "body"))):
            part = p
            if kind == STATE:
                graph = pickle.loads(body)
            else:
                held[kind].append(unpack(body, *dtypes[kind]))
    return graph, {k: [np.concatenate(c) for c in zip(*v)] if v else None for k, v in held.items()}, part


class Graph:
    """Of a range: ids in order, groups, codes, list lengths; edges (row, neighbour, similarity, new) out and in."""

    def __init__(self, u, g, code, k):
        o = np.argsort(u)
        self.u, self.g, self.code, self.k = u[o], g[o], code[o], np.full(len(u), k, np.int32)
        none = lambda: [np.zeros(0, t) for t in (np.int32, np.int64, np.float32, bool)]
        self.out, self.back = none(), none()

    def rows(self, u: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.u, u).astype(np.int32)

    def best(self, have: list[np.ndarray], more: list[np.ndarray], length: np.ndarray) -> list[np.ndarray]:
        """Of the edges there and those that come (of equal ones the former) the best of each row, ties by id."""
        row, v, s, new = (np.concatenate(x) for x in zip(have, more))
        o = np.lexsort((new, v, row))
        row, v, s, new = row[o], v[o], s[o], new[o]
        one = np.ones(len(row), bool)
        one[1:] = (row[1:] != row[:-1]) | (v[1:] != v[:-1])
        row, v, s, new = row[one], v[one], s[one], new[one]
        o = np.lexsort((v, -s, row))
        row, v, s, new = row[o], v[o], s[o], new[o]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        ok = rank < length[row]
        return [row[ok], v[ok], s[ok], new[ok]]

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each list is full, and the least similarity in it."""
        row, _, s, _ = self.out
        least = np.full(len(self.u), 2.0, np.float32)
        np.minimum.at(least, row, s)
        return np.bincount(row, minlength=len(self.u)) >= self.k, least

    def dump(self, part: int, near: int = 0, found: int = 0) -> pa.RecordBatch:
        return _row(part, STATE, pickle.dumps(self, 5), near, found)


def _encode(dim: int, planes: np.ndarray):
    schema = pa.schema([("u", pa.int64()), ("code", pa.binary()), ("key", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("vec").flatten(), np.float32).reshape(-1, dim)
            code = np.round(x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30) * 127).astype(np.int8)
            sign = (x @ planes.reshape(-1, dim).T > 0).reshape(len(x), *planes.shape[:2])
            key = (sign * (1 << np.arange(planes.shape[1], dtype=np.int64))).sum(axis=2)
            yield pa.RecordBatch.from_arrays([b.column("u"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(list(key), pa.list_(pa.int64()))], schema=schema)

    return run


def _begin(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = np.asarray(b.column("u"))
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(len(u), -1)
                yield from _send(BEGIN, u, parts, np.asarray(b.column("g")), _void(code))

    return run


def _better(u, v, s, most: int) -> np.ndarray:
    """The first of equal edges, and of each u the best ``most``."""
    o = np.lexsort((v, u))
    one = np.ones(len(o), bool)
    one[1:] = (u[o][1:] != u[o][:-1]) | (v[o][1:] != v[o][:-1])
    o = o[one]
    o = o[np.lexsort((v[o], -s[o], u[o]))]
    rank = np.arange(len(o)) - np.searchsorted(u[o], u[o])
    return o[rank < most]


def _sorted_blocks(parts: int, k: int):
    """Edges among vectors that are beside each other in the order of a table of hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, codes = [], []
        for b in batches:
            if b.num_rows:
                held.append([np.asarray(b.column(c)) for c in ("t", "key", "salt", "u", "g")])
                codes.append(np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(b.num_rows, -1))
        if not held:
            return
        t, key, salt, u, g = (np.concatenate(c) for c in zip(*held))
        code = np.concatenate(codes)
        o = np.lexsort((u, salt, key, t))
        u, g, x = u[o], g[o], _unit(code[o])
        found = []
        for at in range(0, max(1, len(u) - BLOCK // 2), BLOCK // 2):
            to = min(len(u), at + BLOCK)
            sim = x[at:to] @ x[at:to].T
            sim[g[at:to, None] == g[None, at:to]] = -2
            most = min(k, to - at - 1)
            if most < 1:
                continue
            j = np.argpartition(-sim, most - 1, axis=1)[:, :most]
            i = np.repeat(np.arange(to - at), most)
            s = sim[i, j.ravel()]
            ok = s > -2
            found.append((u[at:to][i[ok]], u[at:to][j.ravel()[ok]], s[ok]))
        if found:
            a, b, s = (np.concatenate(c) for c in zip(*found))
            o = _better(a, b, s, 2 * k)
            yield from _send(EDGE, a[o], parts, b[o], s[o])

    return run


def _reverse(parts: int, k: int):
    """New edges tell those they lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, _, part = _read(batches, {})
        if graph is not None:
            yield graph.dump(part)
            row, v, s, new = graph.out
            v, u, s = v[new], graph.u[row[new]], s[new]
            o = _better(v, u, s, 2 * k * WIDEST)
            yield from _send(REVERSE, v[o], parts, u[o], s[o])

    return run


def _ask(parts: int):
    """Who has a neighbour that is new to it asks all of them for their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, got, part = _read(batches, {REVERSE: (np.int64, np.int64, np.float32)})
        if graph is None:
            return
        if got[REVERSE]:
            v, u, s = got[REVERSE]
            graph.back = graph.best(graph.back, [graph.rows(v), u, s, np.ones(len(u), bool)], graph.k)
        row, v, _, new = (np.concatenate(x) for x in zip(graph.out, graph.back))
        graph.out[3], graph.back[3] = np.zeros(len(graph.out[0]), bool), np.zeros(len(graph.back[0]), bool)
        yield graph.dump(part)
        live = np.zeros(len(graph.u), bool)
        live[row[new]] = True
        of = live[row]
        row, v, new = row[of], v[of], new[of]
        o = np.lexsort((~new, v, row))
        row, v, new = row[o], v[o], new[o]
        one = np.ones(len(row), bool)
        one[1:] = (row[1:] != row[:-1]) | (v[1:] != v[:-1])
        yield from _send(ASK, v[one], parts, graph.u[row[one]], new[one])

    return run


def _tell(parts: int, near: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, got, part = _read(batches, {ASK: (np.int64, np.int64, bool)})
        if graph is None:
            return
        yield graph.dump(part)
        if got[ASK]:
            m, pivot, new = got[ASK]
            row = graph.rows(m)
            full, least = graph.full()
            # a list that will be longer takes any edge
            low = np.where(full & ((least < near) | (graph.k >= k * WIDEST)), least, -2).astype(np.float32)
            for at in range(0, len(m), 500_000):
                x = slice(at, at + 500_000)
                yield from _send(TELL, pivot[x], parts, m[x], graph.g[row[x]], low[row[x]], new[x], graph.code[row[x]])

    return run


def _join(parts: int, k: int, dim: int):
    """Pairs of the neighbours of each vector, of different groups, one of them new, that are better than what either has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, got, part = _read(batches, {TELL: (np.int64, np.int64, np.int64, np.float32, bool, f"V{dim}")})
        if graph is not None:
            yield graph.dump(part)
        if not got[TELL]:
            return
        pivot, m, g, low, new, code = got[TELL]
        o = np.argsort(pivot, kind="stable")
        pivot, m, g, low, new, code = (c[o] for c in (pivot, m, g, low, new, code))
        b = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1], [True]]))
        held, count = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            u, v, s = (np.concatenate(c) for c in zip(*held))
            o = _better(u, v, s, 2 * k * WIDEST)
            yield from _send(EDGE, u[o], parts, v[o], s[o])

        for s, e in zip(b[:-1], b[1:]):
            x = _unit(code[s:e])
            sim = x @ x.T
            ok = (g[s:e, None] != g[None, s:e]) & (new[s:e, None] | new[None, s:e])
            i, j = np.nonzero(ok & (sim > low[s:e, None]))
            if len(i):
                held.append((m[s:e][i], m[s:e][j], sim[i, j]))
                count += len(i)
            if count > 2_000_000:
                yield from flush()
                held, count = [], 0
        if held:
            yield from flush()

    return run


def _update(parts: int, k: int, near: float, dim: int):
    """Lists take the better edges; saturated ones grow.  near: edges that may reach the threshold; found: those of them that are new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, got, part = _read(batches, {BEGIN: (np.int64, np.int64, f"V{dim}"), EDGE: (np.int64, np.int64, np.float32)})
        if got[BEGIN]:
            graph = Graph(*got[BEGIN], k)
        if graph is None:
            return
        full, least = graph.full()
        graph.k = np.where(full & (least >= near) & (graph.k < k * WIDEST), graph.k * 2, graph.k).astype(np.int32)
        if got[EDGE]:
            u, v, s = got[EDGE]
            graph.out = graph.best(graph.out, [graph.rows(u), v, s, np.ones(len(u), bool)], graph.k)
        close = graph.out[2] >= near
        yield graph.dump(part, int(close.sum()), int((close & graph.out[3]).sum()))

    return run


def _edges(near: float):
    """Of each range: kind 0, a forest of the edges that may reach the threshold; kind 1, the saturated vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, _, _ = _read(batches, {})
        if graph is not None:
            row, v, s, _ = graph.out
            close = s >= near
            nodes, at = np.unique(np.concatenate([graph.u[row[close]], v[close]]), return_inverse=True)
            half = len(at) // 2
            label = local_components(len(nodes), at[:half], at[half:])
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            full, least = graph.full()
            held = graph.u[full & (least >= near)]
            kind = np.concatenate([np.zeros(len(moved), np.int32), np.ones(len(held), np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([nodes[label[moved]], held])), pa.array(np.concatenate([nodes[moved], held]))], schema=_FOUND)

    return run


def _search(codes: DataFrame, n: int, k: int, near: float, rounds: int, dim: int) -> DataFrame:
    """codes (u, g, code, key) -> rows of _edges, after rounds that end when they find less than a thousandth more."""
    parts = partitions(codes.sparkSession, n, RANGE)
    to = lambda df: df.repartitionById(parts, F.col("part"))
    tables = codes.select("u", "g", "code", F.posexplode("key").alias("t", "key")).withColumn("salt", F.xxhash64("u", "t"))
    first = tables.repartitionByRange(parts, "t", "key", "salt").mapInArrow(_sorted_blocks(parts, k), _ROWS)
    begin = codes.select("u", "g", "code").mapInArrow(_begin(parts), _ROWS)
    update = _update(parts, k, near, dim)
    at = checkpoint(to(begin.unionByName(first)).mapInArrow(update, _ROWS))
    for _ in range(rounds):
        asked = to(to(at.mapInArrow(_reverse(parts, k), _ROWS)).mapInArrow(_ask(parts), _ROWS))
        told = to(asked.mapInArrow(_tell(parts, near, k), _ROWS))
        at = checkpoint(to(told.mapInArrow(_join(parts, k, dim), _ROWS)).mapInArrow(update, _ROWS))
        known, found = at.agg(F.coalesce(F.sum("near"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0))).first()
        if found <= 0.001 * known:
            return checkpoint(at.mapInArrow(_edges(near), "kind int, a long, b long"))
    raise RuntimeError(f"edges are still found after {rounds} rounds; give larger k or more tables")


def _exact(threshold: float):
    """Of the pairs of one tile of a group, or of two, that reach the threshold: kind 0, how many rows a vector is linked to by them; kind 1, a forest of them."""

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        own = np.asarray(table.column("tile"))
        ids, rows = np.asarray(table.column("u")), np.asarray(table.column("rows"))
        x = _double(table.column("vec"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        ok = x[left] @ x[right].T >= threshold
        if i == j:
            ok &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        p, q = np.nonzero(ok)
        p, q = left[p], right[q]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, p, rows[q])
        np.add.at(links, q, rows[p])
        label = local_components(len(ids), p, q)
        some, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
        kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(moved), np.int32)])
        return pa.Table.from_arrays([pa.array(kind), pa.array(ids[np.concatenate([some, moved])]), pa.array(np.concatenate([links[some], ids[label[moved]]]))], schema=_FOUND)

    return run


def _double(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scan(ids: np.ndarray, x: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.asarray(b.column("u"))
                i, j = np.nonzero((_double(b.column("vec")) @ x.T >= threshold) & (v[:, None] != ids[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(v[i])], names=["u", "v"])

    return run


def _planted(x: np.ndarray, threshold: float, seed: int) -> np.ndarray:
    """For each vector another whose cosine with it is halfway between the threshold and 1."""
    c = (1 + threshold) / 2
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = np.random.default_rng(seed).standard_normal(x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(y, axis=1, keepdims=True)
    return c * x + np.sqrt(1 - c * c) * y / np.maximum(length, 1e-9)


def near_duplicate_classes(
    vectors: DataFrame, threshold: float = 0.9, k: int = 12, tables: int = 8, audit: int = 200, recall: float = 0.97, rounds: int = 30, attempts: int = 3, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, class_id, n_links) of every vector: which others its cosine with reaches the threshold.

    n_links is the number of other vectors it is linked to, equal ones
    included; class_id is the least id among those that links connect it to,
    directly or through others.  Links are exact among the vectors that the
    search brings together, and the search is approximate: ``audit`` vectors,
    chosen by hash, each with a planted neighbour, are compared with all, and
    the share of their links it brings together must reach ``recall``; if not
    it goes on with twice as many tables, ``attempts`` times (then it raises).

    ids are integers.  A row without id gives no row.  Null vectors, vectors
    with null, non-finite or no components and zero vectors have no link; of
    several rows of one id the least vector counts.  All other vectors must be
    of one length.  An empty table gives an empty one.  Other columns are not
    read.
    """
    spark = vectors.sparkSession
    vec = F.col(vector_col).cast("array<float>")
    ok = (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e18)) & F.exists(vec, lambda x: F.abs(x) > 1e-12)
    rows = vectors.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.when(ok, vec)).alias("vec"))
    # an id without a vector is a value of its own: two hashes tell values apart
    same = F.struct(*[F.when(F.col("vec").isNull(), F.xxhash64("id", F.lit(s))).otherwise(F.xxhash64("vec", F.lit(s))) for s in (1, 2)])
    rows = checkpoint(rows.withColumn("same", same))
    own = checkpoint(rows.groupBy("same").agg(F.min("id").alias("u"), F.count(F.lit(1)).alias("rows"), F.min("vec").alias("vec")))
    valid = own.where("vec is not null")
    n, dim, least, low = valid.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.min(F.size("vec")), F.min("u")).first()
    if n and dim != least:
        raise ValueError("vectors differ in length")
    found = spark.createDataFrame([], "kind int, a long, b long")
    if n > 1:
        # planted ids lie below all others
        sample = valid.orderBy(F.xxhash64("u", F.lit(seed)), "u").limit(audit).select("u", "vec").toArrow()
        ids, x = np.asarray(sample["u"]), _double(sample["vec"])
        plants = [(int(low) - 1 - i, y.tolist()) for i, y in enumerate(_planted(x, threshold, seed))]
        every = valid.select("u", "vec").unionByName(spark.createDataFrame(plants, "u long, vec array<float>"))
        truth = checkpoint(every.mapInArrow(_scan(ids, x, threshold), "u long, v long"))
        wanted, near = truth.count(), threshold - MARGIN
        edges, bits = None, max(8, min(60, int(np.ceil(np.log2(n))) + 4))
        for attempt in range(attempts):
            planes = np.random.default_rng(seed + attempt).standard_normal((tables << attempt, bits, dim)).astype(np.float32)
            codes = checkpoint(every.mapInArrow(_encode(dim, planes), "u long, code binary, key array<bigint>").withColumn("g", F.col("u")))
            at, held = _search(codes, n + audit, k, near, rounds, dim), n
            while True:
                more = at.where("kind = 0").select("a", "b")
                edges = more if edges is None else more.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
                groups = components(edges)
                active = checkpoint(at.where("kind = 1").select(F.col("a").alias("u")).join(groups.select(F.col("node").alias("u"), F.col("component").alias("g")), "u"))
                now, apart = active.agg(F.count(F.lit(1)), F.count_distinct("g")).first()
                if apart < 2 or (held < n and more.isEmpty()):
                    break
                held = now
                at = _search(checkpoint(codes.drop("g").join(active, "u")), now, k, near, rounds, dim)
            one, other = (groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "uv")
            share = truth.join(one, "u").join(other, "v").where("of_u = of_v").count() / max(1, wanted)
            if share >= recall:
                break
        else:
            raise RuntimeError(f"audited recall {share:.3f}; give larger k or more tables")
        tiles = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
        placed = groups.join(tiles, "component").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        found = checkpoint(
            valid.join(placed, F.col("u") == F.col("node"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .select("component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "u", "rows", "vec")
            .groupBy("component", "i", "j")
            .applyInArrow(_exact(threshold), "kind int, a long, b long")
        )
    degree = found.where("kind = 0").groupBy(F.col("a").alias("u")).agg(F.sum("b").alias("links"))
    joined = components(found.where("kind = 1").select("a", "b")).select(F.col("node").alias("u"), "component")
    info = own.select("same", "u", "rows").join(degree, "u", "left").join(joined, "u", "left")
    info = info.select("same", F.coalesce("component", "u").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    return rows.select("id", "same").join(info, "same").select(F.col("id").alias("vec_id"), "class_id", "n_links")
