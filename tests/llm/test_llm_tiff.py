"""TIFF round trips, other writers' layouts, and broken files."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from samples import clashing, empty_table, odd_rows, odd_table

from leakscan.llm import tiff

DATA = st.one_of(st.binary(max_size=700), st.lists(st.sampled_from([65, 65, 65, 66, 7]), max_size=3000).map(bytes))


@settings(max_examples=150, deadline=None)
@given(DATA)
def test_compressions_are_lossless(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_widths_and_full_tables():
    rnd = random.Random(1)
    for n in (253, 254, 255, 256, 257, 509, 510, 511, 1021, 1022, 3837, 3838, 3839, 3840, 100_000):
        for letters in (range(256), b"ab", b"a"):
            data = bytes(rnd.choice(letters) for _ in range(n))
            assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_of_a_known_strip():
    # the example of the format's description: 7 7 7 8 8 7 7 6 6
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed


def test_packbits_of_a_known_strip():
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA".replace(" ", ""))
    data = bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA".replace(" ", ""))
    assert tiff.packbits_decode(packed) == data
    assert tiff.packbits_decode(b"\x80" + packed) == data  # 128 does nothing


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16, 64])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_come_back(kind, predictor, tile, order):
    rnd = np.random.default_rng(3)
    pages = [rnd.integers(0, 4, (h, w), dtype=np.uint8) for h, w in ((1, 1), (70, 33), (16, 64))]
    read = list(tiff.read_pages(tiff.write_tiff(pages, kind, predictor, tile, 100, order)))
    assert [(r["width"], r["height"], r["pixels"]) for r in read] == [(p.shape[1], p.shape[0], p.tobytes()) for p in pages]
    assert {r["predictor"] for r in read} == {predictor} and {r["tiled"] for r in read} == {tile is not None}


def build(fields, blocks, order="<"):
    """A file of one directory; ``blocks`` are its strips, and the fields name their offsets as ``None``."""
    out, places = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), []
    for b in blocks:
        places.append(len(out))
        out += b
    entries, extra = [], bytearray()
    at = len(out) + 2 + 12 * len(fields) + 4
    for tag, (kind, values) in sorted(fields.items()):
        values = places if values is None else values
        data = struct.pack(f"{order}{len(values)}{tiff.TYPES[kind][0]}", *values)
        if len(data) > 4:
            entries.append(struct.pack(order + "HHII", tag, kind, len(values), at + len(extra)))
            extra += data
        else:
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
    out[4:8] = struct.pack(order + "I", len(out))
    return bytes(out + struct.pack(order + "H", len(entries)) + b"".join(entries) + struct.pack(order + "I", 0) + extra)


def test_rgb_sixteen_bits_and_planes():
    rnd = np.random.default_rng(5)
    for order in "<>":
        image = rnd.integers(0, 60_000, (6, 5, 3)).astype(order + "u2")
        step = np.diff(image.astype("u2"), axis=1, prepend=np.zeros((6, 1, 3), "u2")).astype(order + "u2")
        chunky = build({256: (3, [5]), 257: (3, [6]), 258: (3, [16, 16, 16]), 259: (3, [8]), 273: (4, None), 277: (3, [3]), 278: (3, [6]),
                        279: (4, [len(zlib.compress(step.tobytes()))]), 317: (3, [2])}, [zlib.compress(step.tobytes())], order)
        planes = [np.ascontiguousarray(image[:, :, i]).tobytes() for i in range(3)]
        planar = build({256: (3, [5]), 257: (3, [6]), 258: (3, [16, 16, 16]), 259: (3, [1]), 273: (4, None), 277: (3, [3]), 278: (3, [6]),
                        279: (4, [60, 60, 60]), 284: (3, [2])}, planes, order)
        for data in (chunky, planar):
            (page,) = tiff.read_pages(data)
            assert page["pixels"] == image.astype("<u2").tobytes() and page["bits"] == 16 and page["samples"] == 3


STRIP = {256: (3, [4]), 257: (3, [4]), 258: (3, [8]), 259: (3, [1]), 273: (4, None), 277: (3, [1]), 278: (3, [4]), 279: (4, [16])}
TILE = {256: (3, [4]), 257: (3, [4]), 258: (3, [8]), 259: (3, [1]), 277: (3, [1]), 322: (3, [16]), 323: (3, [16]), 324: (4, None), 325: (4, [256])}


@pytest.mark.parametrize("fields,tag", [(STRIP, 256), (STRIP, 257), (STRIP, 277), (STRIP, 278), (TILE, 322), (TILE, 323)])
@pytest.mark.parametrize("values", [[0], [], [60_000]])
def test_sizes_that_cannot_be(fields, tag, values):
    size = 16 if fields is STRIP else 256
    assert len(list(tiff.read_pages(build(fields, [bytes(size)])))) == 1
    if (tag, values) != (278, [60_000]):  # a strip may be longer than its image
        with pytest.raises(tiff.TiffError):
            list(tiff.read_pages(build(fields | {tag: (3, values)}, [bytes(size)])))


def test_any_bytes_give_pages_or_an_error():
    rnd = random.Random(12)
    image = np.arange(400, dtype=np.uint8).reshape(20, 20)
    good = [tiff.write_tiff([image, image], kind, 2, tile) for kind in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE) for tile in (None, 16)]
    good += [build(STRIP, [bytes(16)]), build(TILE, [bytes(256)])]
    for _ in range(6000):
        data = bytearray(rnd.choice(good))
        (at,) = struct.unpack_from("<I", data, 4)
        for _ in range(rnd.randint(1, 6)):  # mostly in the directory
            place = rnd.randrange(at, len(data)) if rnd.random() < 0.8 else rnd.randrange(len(data))
            data[place] = rnd.choice([0, 1, 255, rnd.randrange(256)])
        try:
            list(tiff.read_pages(bytes(data)))
        except tiff.TiffError:
            pass


def test_broken_files_tell_why(spark):
    good = tiff.write_tiff([np.arange(64, dtype=np.uint8).reshape(8, 8)] * 2, tiff.DEFLATE)
    loop = bytearray(tiff.write_tiff([np.zeros((2, 2), np.uint8)]))
    (at,) = struct.unpack("<I", loop[4:8])
    loop[-4:] = struct.pack("<I", at)
    files = [b"", b"II*\0", b"not a file at all", good[:40], good[:8] + b"\xff" * 20 + good[28:], bytes(loop), good, None]
    rows = tiff.pages(spark.createDataFrame([(i, f) for i, f in enumerate(files)], "id long, media binary"), ["id"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert all(by[i][-1].error and by[i][-1].pixels is None for i in range(4))
    assert [r.page for r in by[6]] == [0, 1] and all(r.error is None for r in by[6]) and len(by[5]) == 1 and 7 not in by


def test_digests_of_odd_rows(spark):
    got = sorted((tuple(r) for r in tiff.digests(clashing(odd_table(spark)).drop("media")).collect()), key=repr)
    want = {}
    for key, text, *_ in odd_rows():
        data = (text or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        want[text or ""] = (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert sorted(r[:5] for r in got) if None not in [r[0] for r in got] else len(got) == len(odd_rows())
    assert sorted(r[1:5] for r in got) == sorted(want[r[1] or ""] for r in odd_rows())
    by_text = {}
    for r in got:
        by_text.setdefault(r[3], set()).add(r[1:])
    assert all(len(v) == 1 for v in by_text.values())
    assert len({r[7].split(";")[1] for r in got}) == 3  # every compression is in use
    assert tiff.digests(empty_table(spark)).count() == 0
