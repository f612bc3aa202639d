"""References to large contents: where they are, what kind they are, and what is in them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions.text import compact

#: Contents from this size on become references.
LEAST_BYTES = 25 * 1024
#: Payloads that are walked at a time, in bytes: what Python holds besides one Arrow batch is a few times this.
PART_BYTES = 4 << 20
# MIME types by file extension, and fields of a payload that hold paths and contents.
MIME = {
    "application/json": ["json"],
    "text/csv": ["csv"],
    "text/x-typescript": ["ts", "tsx", "js", "jsx", "mjs", "cjs"],
    "text/x-code": ["py", "rb", "go", "rs", "swift", "java", "kt", "c", "cc", "cpp", "h"],
    "text/plain": ["md", "txt", "log", "yaml", "yml", "toml", "sql", "xml", "html", "css"],
}
PATHS = ["path", "file", "file_path", "filepath", "filePath", "filename", "absolute_path", "absolutePath"]
CONTENTS = ["content", "contents", "text", "body", "output", "stdout", "stderr", "tool_response", "result"]


def extension(path: Column) -> Column:
    """The last part of a path's name after a dot, lower-cased; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.]\.([^./]*)$", 1))


def mime(path: Column, content: Column) -> Column:
    """JSON if it is named or looks so, else by extension, else octets."""
    ext = extension(path)
    out = F.lit("application/octet-stream")
    for kind, names in MIME.items():
        out = F.when(ext.isin(names), kind).otherwise(out)
    looks = F.coalesce(F.regexp_replace(content, r"(?U)^\s+", "").rlike(r"^[\[{]"), F.lit(False))
    return F.when(looks, "application/json").otherwise(out)


def exploration(path: Column, kind: Column, size: Column, content: Column, cut: Column) -> Column:
    """One sentence on what a content holds: keys or items, columns and rows, names of code, or how it begins."""
    what = F.concat(F.lit(" file at "), path, F.lit(", "), size, F.lit(" bytes."))
    some = lambda names, none: F.coalesce(F.nullif(F.array_join(F.slice(names, 1, 8), ", "), F.lit("")), F.lit(none))
    array, keys = F.json_array_length(content), F.json_object_keys(content)
    lines = F.filter(F.split(content, "\r?\n"), lambda x: F.trim(x) != "")
    columns = F.filter(F.transform(F.split(F.get(lines, 0), ","), F.trim), lambda x: x != "")
    names = F.regexp_extract_all(content, F.lit(r"\b(?:function|class|interface|type|def)\s+([A-Za-z0-9_$]+)"), F.lit(1))
    beginning = F.coalesce(F.nullif(F.substring(compact(content), 1, 220), F.lit("")), F.lit("empty"))
    text = F.concat(F.lit("Text"), what, F.lit(" Preview: "), beginning, F.lit("."))
    out = (
        F.when(F.coalesce(content, F.lit("")) == "", F.concat(kind, what))
        .when((kind == "application/json") & array.isNotNull(), F.concat(F.lit("JSON array"), what, F.lit(" Items: "), array, F.lit(".")))
        .when((kind == "application/json") & keys.isNotNull(), F.concat(F.lit("JSON object"), what, F.lit(" Keys: "), some(keys, "none"), F.lit(".")))
        .when(kind == "text/csv", F.concat(F.lit("CSV"), what, F.lit(" Columns: "), some(columns, "unknown"), F.lit(". Rows sampled: "), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(".")))
        .when(F.startswith(kind, F.lit("text/x-")), F.concat(F.lit("Code"), what, F.lit(" Symbols: "), some(names, "none detected"), F.lit(".")))
        .otherwise(text)
    )
    return F.concat(out, F.when(cut, " Stored payload was already truncated; summary uses the available preview.").otherwise(""))


def contents_in(value: object, at: str = "$.payload") -> Iterator[tuple[str, str | None, int, str, str, bool]]:
    """(path, content, bytes, sha256, where, cut) of each path beside each content in a JSON value, at any depth."""
    if isinstance(value, list):
        for i, x in enumerate(value):
            yield from contents_in(x, f"{at}[{i}]")
    if isinstance(value, dict):
        paths = [v for k, v in value.items() if k in PATHS and isinstance(v, str) and _is_path(v)]
        held = [h for k, v in value.items() if paths and k in CONTENTS for h in _content(v, f"{at}.{k}")]
        yield from ((p, *h) for p in paths for h in held)
        for k, v in value.items():
            yield from contents_in(v, f"{at}.{k}")


def _content(v: object, at: str) -> Iterator[tuple[str | None, int, str, str, bool]]:
    if isinstance(v, str):
        data = v.encode("utf-8", "surrogatepass")
        yield v, len(data), hashlib.sha256(data).hexdigest(), at, False
    elif isinstance(v, dict) and v.get("truncated") is True and isinstance(v.get("sha256"), str):
        size, preview = v.get("original_bytes"), v.get("preview")
        yield preview if isinstance(preview, str) else None, size if isinstance(size, int) else 0, v["sha256"], at, True
    elif isinstance(v, dict):
        for k, x in v.items():
            if k in CONTENTS:
                yield from _content(x, f"{at}.{k}")


def _is_path(p: str) -> bool:
    ext = p.strip().rpartition(".")[2]
    return bool(p.strip()) and ("/" in p or "\\" in p or ("." in p and 1 <= len(ext) <= 12 and ext.isascii() and ext.isalnum()))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose payloads are PART_BYTES together, or one payload that is longer."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column("payload")).to_pylist()):
        if i > start and size + (n or 0) > PART_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    yield batch.slice(start)


def _find(least: int):
    names = ["session_id", "observed_event_id", "ts", "path", "content", "byte_count", "sha256", "source_path", "truncated"]
    types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                out = []
                for session, event, ts, payload in zip(*(part.column(c).to_pylist() for c in ("session_id", "event_id", "ts", "payload")), strict=True):
                    found = contents_in(json.loads(payload)) if payload else ()
                    out += [(session, event, ts, *c) for c in found if c[2] >= least]
                columns = zip(*out, strict=True) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def references(events: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """One row for each large content that a payload (session_id, event_id, ts, payload) holds beside a path.

    Payloads nest to any depth, so each is walked in Python, in parts of Arrow batches; all that is said of a content is
    column expressions. The same content at the same path of a session is one reference, its first event's.
    """
    schema = "session_id string, observed_event_id string, ts string, path string, content string, byte_count long, sha256 string, source_path string, truncated boolean"
    rows = events.select("session_id", "event_id", "ts", "payload").mapInArrow(_find(least), schema)
    kind = mime(F.col("path"), F.col("content"))
    rows = rows.withColumn("mime_type", kind).withColumn("file_ref_id", F.concat(F.lit("file:"), F.substring(F.sha2(F.concat_ws("\0", "session_id", "path", "sha256"), 256), 1, 32)))
    said = exploration(F.col("path"), F.col("mime_type"), F.col("byte_count"), F.col("content"), F.col("truncated"))
    rows = rows.withColumn("exploration_summary", said).drop("content")
    fields = [c for c in rows.columns if c != "file_ref_id"]
    return rows.groupBy("file_ref_id").agg(F.min_by(F.struct(*fields), F.struct("ts", "observed_event_id", "source_path")).alias("r")).select("file_ref_id", "r.*")
