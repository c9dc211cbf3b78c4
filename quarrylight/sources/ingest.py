"""Chunks from text: Markdown, plain text, HTML, CSV, subtitles, mail, and JSON."""

from __future__ import annotations

import csv
import email
import email.policy
import html.parser
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KINDS, chunk_schema

PIECE = "chunk_id bigint, kind string, text string, page int, heading_path array<string>, section_id bigint, char_len int"
_HEADING = re.compile(r"^\s*(#{1,6})\s+(\S.*?)\s*$")


def chunk_markdown(text: str) -> Iterator[tuple]:
    """Headings and paragraphs.  A blank line ends a paragraph; a heading closes those of its level and below."""
    path: list[tuple[int, str]] = []
    held: list[str] = []
    n = 0

    def piece(kind: str, body: str):
        return (n, kind, body, 1, [t for _, t in path], 0, len(body))

    for line in [*(text or "").splitlines(), ""]:
        m = _HEADING.match(line)
        if (m or not line.strip()) and held:
            yield piece("paragraph", " ".join(held))
            n += 1
            held = []
        if m:
            level = len(m[1])
            path = [(k, t) for k, t in path if k < level] + [(level, m[2])]
            yield piece("heading", m[2])
            n += 1
        elif line.strip():
            held.append(line.strip())


def pack_paragraphs(text: str, target: int = 900) -> Iterator[tuple]:
    """Paragraphs together up to about ``target`` characters a chunk."""
    held, n = "", 0
    for p in [x.strip() for x in re.split(r"\n\s*\n", text or "")]:
        if not p:
            continue
        if held and len(held) + 2 + len(p) > target:
            yield (n, "paragraph", held, 1, [], 0, len(held))
            held, n = "", n + 1
        held = f"{held}\n\n{p}" if held else p
    if held:
        yield (n, "paragraph", held, 1, [], 0, len(held))


class _Html(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.level, self.skip = 0, 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        if re.fullmatch("h[1-6]", tag):
            self.level = int(tag[1])
            self.lines += ["", "#" * self.level + " "]
        elif tag in ("p", "div", "li", "br", "tr", "article", "section", "ul", "ol", "table", "nav"):
            self.lines += ["", ""]

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head") and self.skip > 0
        if re.fullmatch("h[1-6]", tag) or tag in ("p", "div", "li", "tr"):
            self.lines += ["", ""]

    def handle_data(self, data):
        if not self.skip and data.strip():
            if not self.lines:
                self.lines.append("")
            self.lines[-1] += " ".join(data.split()) + " "


def chunk_html(text: str) -> Iterator[tuple]:
    parser = _Html()
    parser.feed(text or "")
    return chunk_markdown("\n".join(x.rstrip() for x in parser.lines))


def chunk_csv(text: str) -> Iterator[tuple]:
    """A table chunk for each row, "column: value" by column."""
    rows = list(csv.reader(io.StringIO(text or "")))
    for n, row in enumerate(rows[1:]):
        body = "; ".join(f"{k}: {v}" for k, v in zip(rows[0], row))
        yield (n, "table", body, 1, [], 0, len(body))


def chunk_srt(text: str) -> Iterator[tuple]:
    """A paragraph for each cue of subtitles."""
    for n, cue in enumerate(x for x in re.split(r"\n\s*\n", text or "") if "-->" in x):
        body = " ".join(x.strip() for x in cue.split("-->", 1)[1].splitlines()[1:] if x.strip())
        yield (n, "paragraph", body, 1, [], 0, len(body))


def chunk_mail(text: str) -> Iterator[tuple]:
    m = email.message_from_string(text or "", policy=email.policy.default)
    part = m.get_body(("plain", "html"))
    body = part.get_content() if part else ""
    head = f"# {m['subject']}\n\n" if m["subject"] else ""
    return chunk_markdown(head + body) if not part or part.get_content_type() == "text/plain" else chunk_html(f"<h1>{m['subject'] or ''}</h1>{body}")


CHUNKERS = {"md": chunk_markdown, "markdown": chunk_markdown, "txt": chunk_markdown, "text": chunk_markdown, "packed": pack_paragraphs, "html": chunk_html, "htm": chunk_html, "csv": chunk_csv, "srt": chunk_srt, "eml": chunk_mail}


def chunk_texts(docs: DataFrame, kind: str = "md", doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk) rows of documents of one format."""
    make = CHUNKERS[kind]
    names = ["doc_id", *(x.split()[0] for x in PIECE.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(d, *p) for d, t in zip(f["d"], f["t"]) for p in make(t)], columns=names)

    return docs.select(F.col(doc_col).cast("string").alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).mapInPandas(run, f"doc_id string, {PIECE}")


def read_folder(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("md", "markdown", "txt", "text")) -> DataFrame:
    """Chunks of all files of the kinds under a folder; doc_id is the path within it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/").alias("doc_id"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"), F.decode("content", "UTF-8").alias("text"))
    base = path.rstrip("/") + "/"
    rows = rows.withColumn("doc_id", F.regexp_replace("doc_id", "^" + re.escape(base), ""))
    out = None
    for k in kinds:
        part = chunk_texts(rows.where(F.col("kind") == k), k)
        out = part if out is None else out.unionByName(part)
    return out.orderBy("doc_id", "chunk_id")


def read_json_chunks(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Chunks from NDJSON, or a JSON array; "id" may stand for chunk_id.  A bad line or an unknown kind fails the read."""
    df = spark.read.schema(f"{chunk_schema()}, id bigint").option("mode", "FAILFAST").option("multiLine", str(array).lower()).json(path)
    df = df.withColumn("chunk_id", F.coalesce("chunk_id", "id")).drop("id")
    return df.withColumn("kind", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce(F.col("kind"), F.lit("null"))))))
