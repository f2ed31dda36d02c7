"""TIFF as a column: one row per page, whatever the layout and compression.

Files are walked by their image directories. Strips and tiles are decoded
(none, PackBits, LZW, deflate), predictors undone, and the samples of a page put
together row by row. 8- and 16-bit samples, chunky or planar, either byte order.
The writer lays out 8-bit grey pages in strips or tiles with any of these.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leakscan.llm.bpe import _ddl
from leakscan.llm.common import arrow_schema, map_rows, whole

# Fixed values of the format: tags, field types with their sizes, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
CLEAR, END = 256, 257
MOST_PACKED = 4096  # a byte of a file never stands for so many of its image


class TiffError(ValueError):
    """The bytes are not a file that this module reads."""


# --- compression ---------------------------------------------------------------------------------


def packbits_decode(data: bytes) -> bytes:
    out, at, n = [], 0, len(data)
    while at < n:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += head + 2
        else:
            if head > 128 and at + 1 < n:
                out.append(data[at + 1 : at + 2] * (257 - head))
            at += 2 if head > 128 else 1
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    values = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, int)
    lengths = np.diff(np.r_[starts, len(values)])
    out, at = [], 0  # at: start of what is not yet written

    def literal(to: int) -> None:
        for a in range(at, to, 128):
            piece = data[a : min(a + 128, to)]
            out.append(bytes([len(piece) - 1]) + piece)

    for start, length in zip(starts[lengths >= 3].tolist(), lengths[lengths >= 3].tolist()):
        literal(start)
        for a in range(0, length, 128):
            piece = min(128, length - a)
            out.append(bytes([(257 - piece) & 255, data[start]]))  # a run of one is a literal of one
            if piece == 1:
                out[-1] = bytes([0, data[start]])
        at = start + length
    literal(len(data))
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; a width ends one code early, as the format has it."""
    first = {bytes([i]): i for i in range(256)}
    codes, widths = [CLEAR], [9]
    table, width, here = dict(first), 9, b""
    size = 258
    for i in range(len(data)):
        longer = here + data[i : i + 1]
        if longer in table:
            here = longer
            continue
        codes.append(table[here])
        widths.append(width)
        table[longer] = size
        size += 1
        if size == 4094:
            codes.append(CLEAR)
            widths.append(width)
            table, size, width = dict(first), 258, 9
        elif size >= (1 << width) - 1 and width < 12:
            width += 1
        here = data[i : i + 1]
    if here:
        codes.append(table[here])
        widths.append(width)
        size += 1
        if size >= (1 << width) - 1 and width < 12:
            width += 1
    codes.append(END)
    widths.append(width)
    bits = np.array(codes)[:, None] >> np.arange(11, -1, -1) & 1
    used = np.arange(12)[None, :] >= 12 - np.array(widths)[:, None]
    return np.packbits(bits[used].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes) -> bytes:
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last = list(first), 9, b""
    out, held, bits = [], 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, last = list(first), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise TiffError("LZW code out of turn")
        out.append(entry)
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def decompress(kind: int, data: bytes) -> bytes:
    if kind == NONE:
        return data
    if kind == PACKBITS:
        return packbits_decode(data)
    if kind == LZW:
        return lzw_decode(data)
    if kind in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompress(data)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    raise TiffError(f"compression {kind}")


def compress(kind: int, data: bytes) -> bytes:
    if kind == NONE:
        return data
    return {PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6)}[kind](data)


# --- reading -------------------------------------------------------------------------------------


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each image directory in turn; a loop of directories ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        try:
            (count,) = struct.unpack_from(order + "H", data, at)
            fields = {}
            for i in range(count):
                tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind not in TYPES:
                    continue
                code, size = TYPES[kind]
                where = at + 10 + 12 * i
                if n * size > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                fields[tag] = struct.unpack_from(f"{order}{n}{code}", data, where)
            (after,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
        except struct.error as e:
            raise TiffError("directory beyond the end") from e
        yield order, fields
        at = after


def _field(fields: dict[int, tuple], tag: int, default: int | None = None) -> int:
    if tag in fields:
        if not fields[tag]:
            raise TiffError(f"tag {tag} is empty")
        return fields[tag][0]
    if default is None:
        raise TiffError(f"tag {tag} is missing")
    return default


def read_page(data: bytes, order: str, fields: dict[int, tuple]) -> dict:
    width, height = _field(fields, WIDTH), _field(fields, HEIGHT)
    samples, bits = _field(fields, SAMPLES, 1), _field(fields, BITS, 1)
    kind, predictor, planar = _field(fields, COMPRESSION, NONE), _field(fields, PREDICTOR, 1), _field(fields, PLANAR, 1)
    if bits not in (8, 16) or predictor not in (1, 2) or len(set(fields.get(BITS, (1,)))) > 1:
        raise TiffError(f"{bits} bits with predictor {predictor}")
    dtype = np.dtype(np.uint8 if bits == 8 else order + "u2")
    tiled = TILE_OFFSETS in fields
    if tiled:
        across, down = _field(fields, TILE_WIDTH), _field(fields, TILE_HEIGHT)
        offsets, sizes = fields[TILE_OFFSETS], fields.get(TILE_BYTES, ())
    else:
        across, down = width, min(_field(fields, ROWS_PER_STRIP, height), height)
        offsets, sizes = fields.get(STRIP_OFFSETS, ()), fields.get(STRIP_BYTES, ())
    if not all(isinstance(x, int) and x > 0 for x in (width, height, samples, across, down)):
        raise TiffError("an image, strip or tile of no size")
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    columns, lines = -(-width // across), -(-height // down)
    if max(width * height, across * down) * samples * dtype.itemsize > MOST_PACKED * len(data):
        raise TiffError("larger than its file can hold")
    if len(offsets) < planes * columns * lines or len(sizes) != len(offsets):
        raise TiffError("too few strips or tiles")
    page = np.zeros((height, width, samples), dtype)
    part = iter(zip(offsets, sizes))
    for plane in range(planes):
        for top in range(0, height, down):
            for left in range(0, width, across):
                offset, size = next(part)
                rows = down if tiled else min(down, height - top)
                raw = decompress(kind, data[offset : offset + size])
                if len(raw) < rows * across * each * dtype.itemsize:
                    raise TiffError("short strip or tile")
                block = np.frombuffer(raw, dtype, rows * across * each).reshape(rows, across, each)
                if predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
                to = page[top : top + rows, left : left + across]
                if planar == 2:
                    to[:, :, plane] = block[: to.shape[0], : to.shape[1], 0]
                else:
                    to[:] = block[: to.shape[0], : to.shape[1]]
    return {
        "width": width, "height": height, "samples": samples, "bits": bits, "compression": NAMES[kind],
        "predictor": predictor, "tiled": tiled, "pixels": page.astype(dtype.newbyteorder("<")).tobytes(),
    }


def read_pages(data: bytes) -> Iterator[dict]:
    """The pages of a file in order; raises :class:`TiffError` where it cannot be read."""
    for order, fields in directories(data):
        yield read_page(data, order, fields)


# --- writing -------------------------------------------------------------------------------------


def write_tiff(pages: list[np.ndarray], kind: int = DEFLATE, predictor: int = 1, tile: int | None = None,
               strip_bytes: int = 1 << 16, order: str = "<") -> bytes:
    """A file of 8-bit grey pages, in strips of about ``strip_bytes`` or in square tiles of a multiple of 16."""
    out = [(b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)]
    size, link = 8, None  # link: the part and place that name the next directory

    def put(data: bytes) -> int:
        nonlocal size
        if size % 2:
            out.append(b"\0")
            size += 1
        out.append(data)
        size += len(data)
        return size - len(data)

    for page in pages:
        height, width = page.shape
        down, across = (tile, tile) if tile else (max(1, strip_bytes // max(1, width)), width)
        offsets, sizes = [], []
        for top in range(0, height, down):
            for left in range(0, width, across):
                block = page[top : top + down, left : left + across]
                if tile:
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0))
                data = compress(kind, np.ascontiguousarray(block).tobytes())
                offsets.append(put(data))
                sizes.append(len(data))
        fields = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8]), COMPRESSION: (3, [kind]),
                  PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PREDICTOR: (3, [predictor])}
        if tile:
            fields |= {TILE_WIDTH: (4, [tile]), TILE_HEIGHT: (4, [tile]), TILE_OFFSETS: (4, offsets), TILE_BYTES: (4, sizes)}
        else:
            fields |= {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [down]), STRIP_BYTES: (4, sizes)}
        entries = []
        for tag, (field_type, values) in sorted(fields.items()):
            data = struct.pack(f"{order}{len(values)}{TYPES[field_type][0]}", *values)
            data = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", put(data))
            entries.append(struct.pack(order + "HHI", tag, field_type, len(values)) + data)
        at = put(struct.pack(order + "H", len(entries)) + b"".join(entries) + struct.pack(order + "I", 0))
        if link is None:
            out[0] = out[0][:4] + struct.pack(order + "I", at)
        else:
            out[link] = out[link][:-4] + struct.pack(order + "I", at)
        link = len(out) - 1
    return b"".join(out)


# --- columns -------------------------------------------------------------------------------------

LINE = 64  # samples in a row of a page that holds a text
LAYOUTS = (
    {"kind": DEFLATE, "predictor": 2},
    {"kind": PACKBITS, "predictor": 1},
    {"kind": LZW, "predictor": 1},
    {"kind": DEFLATE, "predictor": 1, "tile": 64},
)


def payload(text: str) -> bytes:
    """UTF-8, filled up with bytes 0 to a positive multiple of ``LINE``."""
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % LINE or (0 if data else LINE))


def write_texts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, ``n_bytes`` (UTF-8) and ``media``: a TIFF of one page that holds the whole text.

    A checksum of the text picks one of ``LAYOUTS``, so equal texts give equal
    files and every decoder is in use. NULL is the empty text: one row of zeros.
    """

    def image(t: str) -> bytes:
        data = payload(t)
        return write_tiff([np.frombuffer(data, np.uint8).reshape(-1, LINE)], **LAYOUTS[zlib.crc32(data) % len(LAYOUTS)])

    def rows(*columns):
        return dict(zip(keep, columns)) | {
            "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in columns[-1]],
            "media": [image(t) for t in columns[-1]],
        }

    return map_rows(docs.select(*keep, whole(F.col(text)).alias("_text")), _ddl(docs, keep) + "n_bytes long, media binary", rows)


PAGE = ("page int, width long, height long, samples int, bits int, compression string, predictor int, tiled boolean, "
        "pixels binary, error string")


def pages(files: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """One row per page: ``keep`` and the columns of ``PAGE``; pixels are little-endian, row by row.

    A file that cannot be read, or no further, gives one row with the reason in
    ``error`` after its good pages; a NULL file gives no row.
    """
    schema = _ddl(files, keep) + PAGE
    arrow = arrow_schema(files.sparkSession, schema)

    def found(data: bytes) -> Iterator[dict]:
        number = -1
        try:
            for number, page in enumerate(read_pages(data)):
                yield page | {"page": number}
        except TiffError as e:
            yield {"page": number + 1, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held = [], 0
            for row in batch.to_pylist():
                if row["_media"] is None:
                    continue
                for page in found(row["_media"]):
                    made.append({k: row[k] for k in keep} | page)
                    held += len(page.get("pixels", b""))
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_pylist(made, arrow)
                        made, held = [], 0
            yield pa.RecordBatch.from_pylist(made, arrow)

    return files.select(*keep, F.col(media).alias("_media")).mapInArrow(run, schema)


def feature(pixels: Column, width: Column, height: Column, compression: Column) -> Column:
    """A few exact facts of a page in one string."""
    return F.concat_ws(";", F.concat(F.lit("size="), width, F.lit("x"), height), F.concat(F.lit("codec="), compression),
                       F.concat(F.lit("crc32="), F.crc32(pixels)))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write every text as a TIFF, read it back, and return digests of both forms for each row."""
    files = write_texts(docs, [key], text)
    kept = [key, "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media"]
    read = pages(files.select(*kept), [key, "n_bytes", "media_bytes", "media_sha256"])
    return read.select(
        key,
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -LINE, LINE)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature(F.col("pixels"), F.col("width"), F.col("height"), F.col("compression")).alias("feature"),
    )
