"""TIFF files whose headers promise more than they hold, and files of very many pages, in little memory."""

import struct
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import media_tiff


def directory(fields, following):
    entries = b"".join(struct.pack("<HHII", tag, 4, 1, value) for tag, value in sorted(fields.items()))
    # a single 8-bit depth is a short
    entries = entries.replace(struct.pack("<HHII", 258, 4, 1, 8), struct.pack("<HHIHH", 258, 3, 1, 8, 0))
    return struct.pack("<H", len(fields)) + entries + struct.pack("<I", following)


def file_of(strip, width, height, scheme, rows=None, pages=1, count=None):
    """``pages`` directories, all of one strip."""
    out = b"II*\0" + struct.pack("<I", 8 + len(strip)) + strip
    for k in range(pages):
        fields = {256: width, 257: height, 258: 8, 259: scheme, 262: 1, 273: 8, 277: 1, 278: rows or height, 279: len(strip) if count is None else count}
        size = 2 + 12 * len(fields) + 4
        out += directory(fields, len(out) + size if k + 1 < pages else 0)
    return out


def outcome(data):
    tracemalloc.start()
    pages, error = 0, None
    try:
        for _ in media_tiff.decode_tiff(data):
            pages += 1
    except (ValueError, struct.error, zlib.error) as e:
        error = str(e)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return pages, error, peak


def test_headers_that_promise_too_much():
    strip = b"\x80\x00" * (32 << 10)
    for width, height, scheme in ((805_306_358, 64, media_tiff.LZW), (1 << 28, 1, media_tiff.LZW), (1 << 20, 40, media_tiff.DEFLATE), (1 << 20, 4, media_tiff.PACKBITS)):
        pages, error, peak = outcome(file_of(strip, width, height, scheme))
        assert pages == 0 and error and peak < 64 << 20, (width, height, scheme, error, peak)
    pages, error, _ = outcome(file_of(b"abcd", 2, 2, media_tiff.NONE, count=1 << 31))  # a count beyond the end
    assert (pages, error) == (1, None) or error
    assert outcome(file_of(b"abc", 2, 2, media_tiff.NONE))[1]


def test_lzw_without_clear_codes_stays_small():
    """Codes that never clear the table: it stops growing at 4096 entries."""
    codes = [256, *([65] * 30_000)]
    bits = "".join(f"{c:09b}" for c in codes[:255]) + "".join(f"{c:012b}" for c in codes[255:])
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    tracemalloc.start()
    try:
        media_tiff.lzw_decode(data, 1 << 20)
    except ValueError:
        pass
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()


def test_many_pages_one_at_a_time(spark):
    image = np.arange(64 * 1000, dtype=np.uint64).astype(np.uint8).tobytes()
    data = file_of(image, 64, 1000, media_tiff.NONE, pages=3000)
    pages, error, peak = outcome(data)
    assert (pages, error) == (3000, None) and peak < 8 << 20
    bad = file_of(b"\x80\x00" * 1000, 805_306_358, 64, media_tiff.LZW)
    rows = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(bad)), (3, None), (4, bytearray(b"II"))], "id int, media binary")
    got = media_tiff.read_tiff(rows).groupBy("id").agg(F.count("page").alias("pages"), F.count("error").alias("errors"), F.count_distinct(F.sha2("samples", 256)).alias("kinds"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3000, 0, 1), (2, 0, 1, 0), (4, 0, 1, 0)]
