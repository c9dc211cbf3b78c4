"""A replication log as a stream of change events.

The log is a folder of JSON lines {"lsn": "X/Y", "data": base64}, one for each
pgoutput message, as a logical slot gives them; files are in the order of their
names and appear whole.  The reader's offset is the last LSN of a whole
transaction, so that a batch never splits one, and Spark's checkpoint of it
stands for the slot's position: what isn't committed is read again.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .pgoutput import UNCHANGED, Decoder, Message, lsn_of, text_array

SCHEMA = (
    "lsn long, seq int, op string, collection string, doc_id string, chunk_id long, kind string, text string, page int, heading_path array<string>, section_id long, char_len int, "
    "media string, image_vector_status string, tenant string, acl array<string>, metadata string, searchable boolean, incomplete boolean"
)
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_NUMBERS = {"chunk_id", "page", "section_id", "char_len"}
_LISTS = {"heading_path", "acl"}
#: Messages of a batch at most, but for a longer transaction.
BATCH = 10_000


def event_of(m: Message, lsn: int, seq: int) -> tuple | None:
    """A row of SCHEMA for an insert, update or delete.

    A delete of a key without chunk_id is one of a document.  Large values that
    an update didn't change aren't sent: such a row is incomplete.  Raises
    ValueError for a row without its identifier or with a value of another type.
    """
    if m.tag not in "IUD":
        return None
    row = dict(m.old or {}) if m.tag == "D" else dict(m.row)
    for name in ("collection", "doc_id"):
        if row.get(name) in (None, UNCHANGED):
            raise ValueError(f"a row without {name}")
    if m.tag == "D":
        chunk = row.get("chunk_id")
        known = {"collection": row["collection"], "doc_id": row["doc_id"], "chunk_id": None if chunk in (None, UNCHANGED) else int(chunk), "op": "delete_doc" if chunk in (None, UNCHANGED) else "delete", "incomplete": False}
    else:
        if row.get("chunk_id") in (None, UNCHANGED):
            raise ValueError("a row without chunk_id")
        incomplete = any(v is UNCHANGED for v in row.values())
        known = {k: None if v is UNCHANGED else v for k, v in row.items() if k in _NAMES}
        for k, v in known.items():
            if v is not None:
                known[k] = int(v) if k in _NUMBERS else text_array(v) if k in _LISTS else v in ("t", "true", "1") if k == "searchable" else v
        known |= {"op": "upsert", "incomplete": incomplete}
        known.setdefault("metadata", "{}")
        if known.get("searchable") is None:
            known["searchable"] = True
    known |= {"lsn": lsn, "seq": seq}
    return tuple(known.get(n) for n in _NAMES)


def events_of(messages: list[tuple[int, bytes]], decoder: Decoder | None = None) -> tuple[list[tuple], list[tuple[int, str]]]:
    """(rows of SCHEMA, dead letters) of messages in order; seq counts those of one LSN."""
    decoder, rows, bad = decoder or Decoder(), [], []
    last, seq = None, 0
    for lsn, data in messages:
        seq, last = (seq + 1 if lsn == last else 0), lsn
        try:
            row = event_of(decoder.decode(data), lsn, seq)
        except ValueError as e:
            bad.append((lsn, str(e)))
            continue
        if row:
            rows.append(row)
    return rows, bad


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:  # noqa: N802
        return {"lsn": 0}

    def _messages(self) -> Iterator[tuple[int, bytes]]:
        for name in sorted(os.listdir(self.path)):
            if name.endswith(".json"):
                with open(os.path.join(self.path, name)) as lines:
                    for line in lines:
                        m = json.loads(line)
                        yield lsn_of(m["lsn"]), base64.b64decode(m["data"])

    def _decoded(self, start: int, stop: int) -> list[tuple]:
        # relations are announced once, before the rows that refer to them
        decoder = Decoder()
        before, inside = [], []
        for lsn, data in self._messages():
            if lsn > stop:
                break
            if lsn <= start:
                if data[:1] == b"R":
                    before.append((lsn, data))
            else:
                inside.append((lsn, data))
        events_of(before, decoder)
        return events_of(inside, decoder)[0]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at, whole, n = start["lsn"], start["lsn"], 0
        for lsn, data in self._messages():
            if lsn <= at:
                continue
            n += 1
            if data[:1] == b"C":  # a commit ends a transaction
                whole = lsn
                if n >= self.most:
                    break
        return iter(self._decoded(at, whole)), {"lsn": whole}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._decoded(start["lsn"], end["lsn"]))


class ReplicationLog(DataSource):
    """spark.dataSource.register(ReplicationLog); spark.readStream.format("replication_log").load(folder).

    The reading itself is the driver's: a slot has one reader and messages have
    an order.  What follows is distributed as any stream is.
    """

    @classmethod
    def name(cls) -> str:
        return "replication_log"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _Reader:  # noqa: N802
        return _Reader(self.options["path"], int(self.options.get("batch", BATCH)))
