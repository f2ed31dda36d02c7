"""Text of request bodies: inflated, unwrapped, decoded."""

from __future__ import annotations

import email.message
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leakscan.functions.base64text import decode_base64_text
from leakscan.functions.form import form_text

STEP = 256  # bodies that are held unpacked at once


def inflate(data: bytes, encoding: str) -> tuple[bytes, bool]:
    """All inflated bytes; the bytes as they are and False if that fails."""
    kind = (encoding or "").strip().lower()
    if kind in ("", "identity") or not data:
        return data, True
    if "gzip" not in kind and "deflate" not in kind:
        return data, False
    window = 31 if "gzip" in kind else -15
    parts, size, rest = [], 0, data
    try:
        while rest:
            engine = zlib.decompressobj(window)
            part = engine.decompress(rest)
            parts.append(part)
            size += len(part)
            if not engine.eof:
                return data, False
            rest = engine.unused_data if window == 31 else b""
    except zlib.error:
        return data, False
    return (b"".join(parts), True) if size else (data, False)


def _boundary(content_type: str) -> bytes:
    message = email.message.Message()
    message["content-type"] = content_type
    found = message.get_param("boundary")
    return found.encode() if isinstance(found, str) else b""


def multipart_parts(data: bytes, content_type: str) -> list[tuple[str, bytes]]:
    """(file name, raw bytes) of every complete part; [] if the body is no multipart."""
    mark = _boundary(content_type)
    if not mark:
        return []
    lines = b"\r\n" + data
    pieces = lines.split(b"\r\n--" + mark)
    parts = []
    for piece in pieces[1:]:
        if piece.startswith(b"--"):
            break
        head, gap, body = piece.partition(b"\r\n\r\n")
        if not gap:
            continue
        message = email.message_from_bytes(head.lstrip(b" \t").removeprefix(b"\r\n") + b"\r\n\r\n")
        name = message.get_filename() if message.get_content_disposition() == "form-data" else None
        parts.append(((name or "").replace("\\", "/").rsplit("/", 1)[-1], body))
    return parts


def _unpacked(batch: pa.RecordBatch) -> list[pa.Array]:
    """Raw bytes, whether the encoding was right, and names and bytes of the parts, for each body of a batch."""
    opened, ok, names, parts = [], [], [], []
    for kind, encoding, data in zip(*[batch.column(c).to_pylist() for c in ("content_type", "content_encoding", "body")]):
        raw, fine = inflate(data if data is not None else b"", encoding)
        found = multipart_parts(raw, kind) if "multipart/form-data" in (kind or "") else []
        opened.append(None if found else raw)
        ok.append(fine)
        names.append([n for n, _ in found])
        parts.append([b for _, b in found])
    types = (pa.binary(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.binary()))
    return [pa.array(v, t) for v, t in zip((opened, ok, names, parts), types)]


def extract_body_text(bodies: DataFrame, key: str = "record_id") -> DataFrame:
    """Adds ``text`` and ``encoding_ok`` to bodies (content_type, content_encoding, body BINARY).

    Only bodies that are compressed or multipart go through Python, in Arrow
    batches; their text, like that of all others, is decoded by expressions.
    """
    kind, encoding = F.coalesce(F.col("content_type"), F.lit("")), F.lower(F.trim(F.coalesce(F.col("content_encoding"), F.lit(""))))
    packed = (~encoding.isin("", "identity")) | F.contains(kind, F.lit("multipart/form-data"))
    ready = bodies.filter(~packed).select(
        *bodies.columns, F.coalesce(F.col("body"), F.lit(b"")).alias("_raw"), F.lit(True).alias("encoding_ok"),
        F.array().cast("array<string>").alias("_names"), F.array().cast("array<binary>").alias("_parts"))
    columns = [f for f in bodies.schema if f.name != "body"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in columns]
                       + ["_raw binary", "encoding_ok boolean", "_names array<string>", "_parts array<binary>"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [c for c in batch.schema.names if c != "body"]
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in others], *_unpacked(part)], names=[*others, "_raw", "encoding_ok", "_names", "_parts"])

    opened = bodies.filter(packed).mapInArrow(unpack, schema)
    both = ready.drop("body").unionByName(opened)
    text = both.withColumn("text", _body_text(kind, F.col("_raw"), F.col("_names"), F.col("_parts")))
    return text.drop("_raw", "_names", "_parts")


def _body_text(kind: Column, raw: Column, names: Column, parts: Column) -> Column:
    whole = F.make_valid_utf8(raw.cast("string"))

    def part_text(name: Column, data: Column) -> Column:
        text = F.make_valid_utf8(data.cast("string"))
        return F.array_join(F.filter(F.array(name, text, decode_base64_text(text)), lambda s: s != ""), "\n")

    pieces = F.filter(F.zip_with(names, parts, part_text), lambda s: s != "")
    inline = F.concat_ws("\n", whole, F.nullif(decode_base64_text(whole), F.lit("")))
    return (
        F.when(F.size(parts) > 0, F.array_join(pieces, "\n"))
        .when(F.contains(kind, F.lit("application/x-www-form-urlencoded")), form_text(whole))
        .otherwise(inline))
