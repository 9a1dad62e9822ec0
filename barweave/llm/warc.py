"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

Both refer to the response by its record id and target URI. The metadata record keeps the headers of
the HTTP response, the digests of the response's block and payload, and what the page says of itself
(title, language, links); the conversion record is the text without markup. Record ids follow from the
response's id, so a rerun writes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.llm.token_ids import filesystem

#: pages carry no date of their own
NO_DATE = "1970-01-01T00:00:00Z"
RECORD = (
    "doc_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "content_length long, block_digest string, source_block_digest string, source_payload_digest string, source_headers string, block string"
)
#: comments (one may be as short as <!--> or <!--->) and the tags of elements that are not shown
HIDDEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)(script|style|noscript|template|svg)(?=[\s/>])[^>]*(?:>|\Z)", re.S | re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in ("script", "style")}
HEAD = re.compile(r"<head\b.*?</head\s*>", re.S | re.I)
BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>",
    re.I,
)
TAG = re.compile(r"</?[A-Za-z!?][^>]*>")
BLANKS, LINES = re.compile(r"[^\S\n]+"), re.compile(r" ?\n[ \n]*")
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
LANGUAGE = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
LINK = re.compile(r"<(a|link|img|script|iframe)\b[^>]*?\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def visible(page: str) -> str:
    """A page less comments, scripts, styles and whole svg, template and noscript elements.

    A comment, script or style without an end reaches to the end of the page. Of any other element without an end tag,
    and of a self-closed svg, only the tag itself is not shown.
    """
    cut: list[tuple[int, int]] = []
    open_: list[tuple[str, int]] = []
    waiting = dict.fromkeys(("noscript", "template", "svg"), 0)
    at = 0
    while m := HIDDEN.search(page, at):
        name, start, at = (m[2] or "").lower(), m.start(), m.end()
        if not name:
            cut.append((start, at))
        elif name in RAW_END:
            if not m[1]:
                end = RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            cut.append((start, at))
        elif not m[1]:
            cut.append((start, at))
            if not (name == "svg" and m[0].endswith("/>")):
                open_.append((name, start))
                waiting[name] += 1
        elif waiting[name]:
            inner = None
            while inner != name:
                inner, start = open_.pop()
                waiting[inner] -= 1
            while cut and cut[-1][0] >= start:
                cut.pop()
            cut.append((start, at))
        else:
            cut.append((start, at))
    kept, at = [], 0
    for start, end in cut:
        kept.append(page[at:start])
        at = end
    return "".join(kept) + page[at:]


def plain_text(page: str) -> str:
    """The text of a page: scripts, styles, comments and the head go, blocks end lines, entities are resolved."""
    return _plain(visible(page))


def _plain(shown: str) -> str:
    body = TAG.sub("", BREAK.sub("\n", HEAD.sub("", shown)))
    return LINES.sub("\n", BLANKS.sub(" ", html.unescape(body))).strip(" \n")


def one_line(text: str) -> str:
    return " ".join(html.unescape(TAG.sub("", text)).split())


def links(page: str, uri: str | None) -> list[str]:
    return _links(visible(page), uri)


def _links(shown: str, uri: str | None) -> list[str]:
    out = []
    for m in LINK.finditer(shown):
        target = html.unescape(m[3] or m[4] or m[5] or "").strip()
        if target and not target.startswith("#"):
            try:
                out.append(f"{' '.join(urljoin(uri or '', target).split())} {m[1].upper()}/{m[2].lower()}")
            except ValueError:  # no URI at all
                continue
    return out


def derive(record_id: str, uri: str | None, headers: str, payload: str) -> list[tuple[str, str, str]]:
    """(type, content type, block) of the derivatives of one response."""
    block = headers.encode() + payload.encode()
    fields = [("source-record-id", record_id), ("source-block-digest", digest(block)), ("source-payload-digest", digest(payload.encode()))]
    fields += [("source-header", line) for line in headers.split("\r\n") if line]
    shown = visible(payload)
    if m := TITLE.search(shown):
        fields.append(("title", one_line(m[1])))
    if m := LANGUAGE.search(shown):
        fields.append(("language", m[1]))
    fields += [("outlink", x) for x in _links(shown, uri)]
    return [
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)),
        ("conversion", "text/plain; charset=utf-8", _plain(shown)),
    ]


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORD.split(", ")]
    for batch in batches:
        rows, size = [], 0
        for r in range(batch.num_rows):
            doc, record_id, uri, date, headers, payload = (batch.column(k)[r].as_py() for k in range(6))
            source = payload.encode()
            block_digest, payload_digest = digest(headers.encode() + source), digest(source)
            for kind, content_type, block in derive(record_id, uri, headers, payload):
                data = block.encode()
                own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} of {record_id}')}>"
                rows.append((doc, kind, own, record_id, uri, date, content_type, len(data), digest(data), block_digest, payload_digest, headers, block))
                size += len(data)
            if size >= 1 << 22:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=record_schema())
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=record_schema())


def record_schema() -> pa.Schema:
    return pa.schema([(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.string()) for x in RECORD.split(", ")])


def record_name(*parts: Column) -> Column:
    """A record id that follows from its parts."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] if k else []) + [F.substring(h, a, n)]], F.lit(">"))


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """Response records of ``pages(page_id, url, html)``: doc_id, record_id, target_uri, date, headers, payload."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col("page_id").cast("long").alias("doc_id"), record_name(F.col("page_id"), F.col("url"), F.col("html")).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit(date).alias("date"), head.alias("headers"), body.alias("payload"),
    )


def derivatives(response: DataFrame) -> DataFrame:
    """Two rows, `metadata` and `conversion`, for every row of ``response(doc_id, record_id, target_uri, date, headers, payload)``.

    A null payload or null headers are empty, and an empty page gives an empty conversion. A null URI stays null and
    leaves relative links as they are. Repeated rows each give their records. Other columns are ignored.
    """
    empty = F.lit("")
    rows = response.select("doc_id", "record_id", "target_uri", "date", F.coalesce("headers", empty).alias("headers"), F.coalesce("payload", empty).alias("payload"))
    return rows.mapInArrow(_derived, RECORD)


def serialised(row: dict) -> bytes:
    """The record as it stands in a WARC file."""
    one = lambda v: " ".join(str(v).split())
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"] or NO_DATE), ("WARC-Refers-To", row["refers_to"])]
    if row["target_uri"] is not None:
        head += [("WARC-Target-URI", one(row["target_uri"])), ("WARC-Refers-To-Target-URI", one(row["target_uri"]))]
    head += [("WARC-Refers-To-Date", row["date"] or NO_DATE), ("WARC-Block-Digest", row["block_digest"]), ("Content-Type", row["content_type"]), ("Content-Length", row["content_length"])]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + row["block"].encode() + b"\r\n\r\n"


def write_files(records: DataFrame, folder: str) -> list[str]:
    """Write records to ``folder``, one file of gzip members for every partition, and name the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, draft, n = f"{root}/part-{number:06d}.warc.gz", f"{root}/_draft-{number:06d}-{uuid.uuid4().hex}", 0
        with fs.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(gzip.compress(serialised(row), mtime=0))
                    n += 1
        fs.move(draft, name)  # a repeated attempt replaces the same bytes
        yield pa.RecordBatch.from_pydict({"name": [f"{folder.rstrip('/')}/part-{number:06d}.warc.gz"], "n": pa.array([n], pa.int64())})

    return [r.name for r in records.mapInArrow(run, "name string, n long").filter("n > 0").orderBy("name").collect()]


def read_file(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of one file."""
    fs, name = filesystem(path)
    with fs.open_input_stream(name, compression=None) as raw, gzip.open(raw) as file:
        while line := file.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{path}: no record begins with {line[:40]!r}")
            head = {}
            while (line := file.readline()) not in (b"\r\n", b""):
                key, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[key] = value
            block = file.read(int(head["Content-Length"]))
            file.read(4)
            yield head, block
