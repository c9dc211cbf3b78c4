"""Capture index of crawled pages: external merge of sorted runs.

Each task sorts its captures by (URL key, timestamp, id) into a run and cuts it
at splitters that all tasks share.  A reducer gets one piece of every run for
its key range, about RANGE_ROWS captures, and merges the k pieces with a loser
tree, so nothing is sorted twice.  Ranges are in order, so is the whole.  A
capture's place in the history of its key is counted while merging; what a key
that goes on from the range before has there comes from one row a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Captures of one range, and keys sampled for each splitter.
RANGE_ROWS, OVERSAMPLE = 200_000, 64

_PIECE = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("urlkey", pa.list_(pa.string())), ("ts", pa.list_(pa.int64())), ("page_id", pa.list_(pa.int64())), ("url", pa.list_(pa.string())), ("digest", pa.list_(pa.string())), ("length", pa.list_(pa.int64()))])
_PIECES = "part int, run long, urlkey array<string>, ts array<bigint>, page_id array<bigint>, url array<string>, digest array<string>, length array<bigint>"
_OUT = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("nth", pa.int64()), ("again", pa.bool_()), ("urlkey", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("length", pa.int64())])


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, path, sorted query without tracking parameters.

    Scheme, user, "www." and port, fragment, a final slash and case go.
    """
    u = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "#.*$", ""), "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(u, "^([^/?]*)", 1), "^.*@", ""), ":[0-9]*$", ""), "^www[0-9]*\\.", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(u, "\\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.startswith("utm_"))), "&")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


class LoserTree:
    """Merges sorted sequences: one comparison a level for each item taken."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.at = [0] * len(runs)
        self.head = [(0, r[0]) if r else (1, ()) for r in runs] or [(1, ())]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i, i)

    def _play(self, i: int, at: int) -> None:
        """Run i goes up from its leaf; at each node the loser stays."""
        node = (at + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i
                return
            if (self.head[other], other) < (self.head[i], i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while True:
            i = self.tree[0]
            done, item = self.head[i]
            if done:
                return
            yield item
            self.at[i] += 1
            self.head[i] = (0, self.runs[i][self.at[i]]) if self.at[i] < len(self.runs[i]) else (1, ())
            self._play(i, i)


def _runs(splitters: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        from pyspark import TaskContext

        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches)
        table = table.take(pc.sort_indices(table, [("urlkey", "ascending"), ("ts", "ascending"), ("page_id", "ascending"), ("url", "ascending"), ("digest", "ascending")]))
        keys = list(zip(table["urlkey"].to_pylist(), table["ts"].to_pylist(), table["page_id"].to_pylist()))
        context = TaskContext.get()
        run_no = context.partitionId() if context else 0
        cuts = [0, *(bisect.bisect_left(keys, s) for s in splitters), len(keys)]
        for part, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
            if e > s:
                x = table.slice(s, e - s)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([run_no], pa.int64()), *(pa.array([x[f.name].to_pylist()], f.type) for f in list(_PIECE)[2:])], schema=_PIECE)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs, part = [], 0
    names = [f.name for f in _PIECE][2:]
    for batch in batches:
        for row in batch.to_pylist():
            part = row["part"]
            runs.append(list(zip(*(row[n] for n in names))))
    held, place, nth, key, digest = [], 0, 0, None, None
    for item in LoserTree(runs):
        nth, again = (nth + 1, item[4] == digest) if item[0] == key else (1, False)
        key, digest = item[0], item[4]
        held.append((part, place, nth, again, *item))
        place += 1
        if len(held) == 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _OUT)], schema=_OUT)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _OUT)], schema=_OUT)


def capture_index(pages: DataFrame, ts: Column | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """All captures in the global order of (urlkey, ts, page_id), with their history.

    Columns: position (from 0, over all), urlkey, ts (seconds), page_id, url,
    digest (of the body), length (bytes), capture (1, 2, ... of the urlkey) and
    revisit (the body is that of the capture before).  ts: an expression;
    without one captures are 37 seconds apart by id from 2024-01-01 on.

    A null or empty URL isn't indexed.  A null id or time counts as -1 or 0, a
    null body as empty.  Repeated rows are captures of their own.  An empty
    table gives an empty one; other columns are not read.  Rows come in range
    partitions; collect them in order by position.  The driver gets OVERSAMPLE
    keys for each RANGE_ROWS captures, to choose splitters from.
    """
    from pyspark.sql import Window

    from .cluster import checkpoint

    spark = pages.sparkSession
    when = ts if ts is not None else F.lit(1704067200) + F.coalesce(F.col(id_col), F.lit(0)).cast("long") * 37
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.where(F.coalesce(F.trim(F.col(url_col)), F.lit("")) != "").select(
        url_key(F.col(url_col)).alias("urlkey"), F.coalesce(when.cast("long"), F.lit(0)).alias("ts"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("length")
    )
    n = pages.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-n // RANGE_ROWS))
    # where to cut: only balance depends on it; fewer keys than OVERSAMPLE for each range
    sample = rows.select("urlkey", "ts", "page_id").where(F.pmod(F.xxhash64("urlkey", "ts", "page_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, OVERSAMPLE * parts / max(1, n)))).collect()
    keys = sorted((r[0], r[1], r[2]) for r in sample)
    splitters = sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []
    merged = checkpoint(rows.mapInArrow(_runs(splitters), _PIECES).repartitionById(len(splitters) + 1, F.col("part")).mapInArrow(_merge, "part int, place long, nth long, again boolean, urlkey string, ts long, page_id long, url string, digest string, length long"))
    # one row a range: windows over these have little to hold
    at = F.struct("place", "urlkey", "nth", "digest")
    ranges = merged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"))
    order, same = Window.orderBy("part"), Window.partitionBy("last.urlkey").orderBy("part")
    ranges = ranges.withColumns({"start": F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "so_far": F.sum("last.nth").over(same)})
    before = F.lag(F.struct("last", "so_far")).over(order)
    ranges = ranges.withColumn("before", before).select("part", "start", F.col("first.urlkey").alias("key"), *[F.when(F.col("before.last.urlkey") == F.col("first.urlkey"), F.col(f"before.{c}")).alias(n) for c, n in (("so_far", "carried"), ("last.digest", "shown"))])
    goes_on = F.col("urlkey") == F.col("key")
    return merged.join(ranges, "part").select(
        (F.col("start") + F.col("place")).alias("position"), "urlkey", "ts", "page_id", "url", "digest", "length",
        (F.col("nth") + F.when(goes_on, F.coalesce("carried", F.lit(0))).otherwise(0)).cast("int").alias("capture"),
        F.when(F.col("place") == 0, F.coalesce(F.col("shown") == F.col("digest"), F.lit(False))).otherwise(F.col("again")).alias("revisit"),
    )
