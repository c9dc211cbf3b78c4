"""The pgoutput logical replication messages (public PostgreSQL protocol), decoded."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

UNCHANGED = object()


def lsn_of(text: str) -> int:
    """"X/Y" in hex to 64 bits."""
    high, slash, low = text.partition("/")
    if not slash:
        raise ValueError(f"not an LSN: {text!r}")
    return int(high, 16) << 32 | int(low, 16)


def lsn_text(lsn: int) -> str:
    return f"{lsn >> 32:X}/{lsn & 0xFFFFFFFF:X}"


def text_array(literal: str) -> list[str | None]:
    """A one-dimensional array literal, {a,"b \\" c",NULL}."""
    if not (literal.startswith("{") and literal.endswith("}")):
        raise ValueError(f"not an array: {literal!r}")
    out, i, body = [], 0, literal[1:-1]
    while i < len(body):
        word, quoted = [], body[i] == '"'
        i += quoted
        while i < len(body) and (body[i] != '"' if quoted else body[i] != ","):
            i += body[i] == "\\"
            word.append(body[i])
            i += 1
        i += quoted
        value = "".join(word)
        out.append(None if not quoted and value.upper() == "NULL" else value)
        i += 1
    return out


@dataclass
class Message:
    tag: str
    lsn: int = 0
    relation: str = ""
    row: dict = field(default_factory=dict)
    old: dict | None = None


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, fmt: str):
        value = struct.unpack_from(">" + fmt, self.data, self.at)
        self.at += struct.calcsize(">" + fmt)
        return value[0] if len(value) == 1 else value

    def string(self) -> str:
        end = self.data.index(0, self.at)
        text, self.at = self.data[self.at : end].decode(), end + 1
        return text

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("message ends early")
        out, self.at = self.data[self.at : self.at + n], self.at + n
        return out


class Decoder:
    """Decodes messages in order; it remembers relations, which rows refer to."""

    def __init__(self):
        self.relations: dict[int, tuple[str, list[str]]] = {}

    def _tuple(self, r: _Reader, columns: list[str]) -> dict:
        row = {}
        for k in range(r.take("H")):
            kind = chr(r.take("B"))
            if kind == "n":
                value = None
            elif kind == "u":
                value = UNCHANGED
            elif kind in "tb":
                raw = r.raw(r.take("I"))
                value = raw.decode() if kind == "t" else raw
            else:
                raise ValueError(f"unknown column kind {kind!r}")
            row[columns[k]] = value
        return row

    def decode(self, data: bytes) -> Message:
        r = _Reader(data)
        tag = chr(r.take("B"))
        try:
            if tag == "B":
                return Message(tag, lsn=r.take("Q"))
            if tag == "C":
                r.take("B")
                return Message(tag, lsn=r.take("QQ")[0])
            if tag == "R":
                rel, _, name = r.take("I"), r.string(), r.string()
                r.take("B")
                columns = []
                for _ in range(r.take("H")):
                    r.take("B")
                    columns.append(r.string())
                    r.take("Ii")
                self.relations[rel] = (name, columns)
                return Message(tag, relation=name)
            if tag in "IUD":
                rel = r.take("I")
                if rel not in self.relations:
                    raise ValueError(f"relation {rel} was not announced")
                name, columns = self.relations[rel]
                m = Message(tag, relation=name)
                mark = chr(r.take("B"))
                if mark in "KO":
                    m.old = self._tuple(r, columns)
                    mark = chr(r.take("B")) if tag == "U" else ""
                if mark == "N":
                    m.row = self._tuple(r, columns)
                return m
            if tag in "OYT":
                return Message(tag)
        except (struct.error, IndexError, UnicodeDecodeError) as e:
            raise ValueError(f"malformed {tag} message") from e
        raise ValueError(f"unknown message {tag!r}")


def decode_all(messages: list[tuple[int, bytes]]) -> tuple[list[tuple[int, Message]], list[tuple[int, str]]]:
    """(decoded, dead letters): a message that can't be read is set aside, and the rest goes on."""
    decoder, good, bad = Decoder(), [], []
    for lsn, data in messages:
        try:
            good.append((lsn, decoder.decode(data)))
        except ValueError as e:
            bad.append((lsn, str(e)))
    return good, bad
