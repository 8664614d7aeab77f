"""Media columns: TIFF images written to and read from a binary column."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, documents, record_batch

#: Pixels of a row, rows of a page, of a strip, and rows and pixels of a tile that ``write_tiff`` uses.
WIDTH, PAGE_ROWS, STRIP_ROWS, TILE_ROWS, TILE_PIXELS = 64, 1024, 256, 64, 32

#: Texts that a task turns into files at once.
ROWS_AT_ONCE = 256

# Fixed values of the TIFF 6.0 specification: tags, compression schemes, predictors, field types.
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR = 273, 277, 278, 279, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, STOP = 256, 257
TYPE_SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}


# ---------------------------------------------------------------- codecs


def _packed_row(line: bytes) -> bytes:
    out, i, literal = bytearray(), 0, 0
    while i < len(line):
        j = i + 1
        while j < len(line) and line[j] == line[i] and j - i < 128:
            j += 1
        if j - i >= 3:
            for k in range(literal, i, 128):
                piece = line[k : min(k + 128, i)]
                out.append(len(piece) - 1)
                out += piece
            out += bytes((257 - (j - i), line[i]))
            literal = j
        i = j
    for k in range(literal, len(line), 128):
        piece = line[k : k + 128]
        out.append(len(piece) - 1)
        out += piece
    return bytes(out)


def packbits_encode(data: bytes, row: int) -> bytes:
    """Rows are packed one by one: runs of three or more equal bytes as runs, all else as literals."""
    whole = len(data) // row if row <= 128 else 0
    x = np.frombuffer(data, np.uint8, whole * row).reshape(whole, row)
    runs = ((x[:, 2:] == x[:, 1:-1]) & (x[:, 1:-1] == x[:, :-2])).any(axis=1)
    plain = np.concatenate([np.full((whole, 1), row - 1, np.uint8), x], axis=1)  # rows without runs: one literal each
    out, done = [], 0
    for k in np.flatnonzero(runs):
        out += [plain[done:k].tobytes(), _packed_row(x[k].tobytes())]
        done = k + 1
    out.append(plain[done:].tobytes())
    out += [_packed_row(data[at : at + row]) for at in range(whole * row, len(data), row)]
    return b"".join(out)


def packbits_decode(data: bytes, limit: int) -> bytes:
    """The unpacked bytes, ``limit`` or a little more at most."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < limit:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def _pack_codes(codes: list[int], widths: list[int]) -> bytes:
    """Codes of 9 to 12 bits one after the other, highest bit first."""
    width = np.array(widths)
    bits = (np.array(codes)[:, None] >> (width[:, None] - 1 - np.arange(12))) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]].astype(np.uint8)).tobytes()


def lzw_encode(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, highest bit first; the width grows one code early, as TIFF has it."""
    codes, widths, width, following = [CLEAR], [9], 9, 258
    table: dict[int, int] = {}  # code of a word << 8 | next byte -> code of the longer word
    word = -1
    for b in data:
        if word < 0:
            word = b
            continue
        longer = table.get(word << 8 | b)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        widths.append(width)
        table[word << 8 | b] = following
        following += 1
        if following == 4094:
            codes.append(CLEAR)
            widths.append(width)
            table = {}
            width, following = 9, 258
        elif following + 1 > 1 << width:
            width += 1
        word = b
    if word >= 0:
        codes.append(word)
        widths.append(width)
        if following + 2 > 1 << width and width < 12:
            width += 1
    return _pack_codes([*codes, STOP], [*widths, width])


_BYTES = [bytes((b,)) for b in range(256)] + [b"", b""]


def lzw_decode(data: bytes, limit: int) -> bytes:
    """The unpacked bytes, ``limit`` or a little more at most."""
    table: list[bytes] = []
    out, size, width, at, last = [], 0, 9, 0, b""
    end = len(data) * 8
    data += b"\0\0\0"
    while at + width <= end and size < limit:
        byte = at >> 3
        code = (data[byte] << 16 | data[byte + 1] << 8 | data[byte + 2]) >> (24 - width - (at & 7)) & ((1 << width) - 1)
        at += width
        if code == STOP:
            break
        if code == CLEAR:
            table, width, last = _BYTES.copy(), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        out.append(entry)
        size += len(entry)
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def _unpacked(data: bytes, scheme: int, size: int) -> bytes:
    """``size`` bytes of a strip or tile."""
    if scheme == NONE:
        out = data
    elif scheme == LZW:
        out = lzw_decode(data, size)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif scheme == PACKBITS:
        out = packbits_decode(data, size)
    else:
        raise ValueError(f"compression {scheme} is not supported")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


# ---------------------------------------------------------------- files


def encode_tiff(payload: bytes) -> bytes:
    """Samples of 8 bits, WIDTH a row, as a little-endian TIFF of one or more pages.

    Pages alternate between strips and tiles. Which comes first and whether LZW, PackBits or deflate packs them is
    drawn by a hash of the payload, alike at all sizes; LZW and deflate come after horizontal differencing. The
    bytes depend on the payload alone.
    """
    drawn = zlib.crc32(payload)
    scheme = (LZW, PACKBITS, DEFLATE)[drawn % 3]
    predictor = 1 if scheme == PACKBITS else 2
    rows = len(payload) // WIDTH
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4  # where the offset of the next directory goes
    for page, top in enumerate(range(0, rows, PAGE_ROWS)):
        image = np.frombuffer(payload, np.uint8, min(PAGE_ROWS, rows - top) * WIDTH, top * WIDTH).reshape(-1, WIDTH)
        height = len(image)
        tiled = (page + (drawn >> 16)) % 2 == 1
        down, across = (TILE_ROWS, TILE_PIXELS) if tiled else (STRIP_ROWS, WIDTH)
        offsets, counts = [], []
        for y in range(0, height, down):
            for x in range(0, WIDTH, across):
                piece = image[y : y + down, x : x + across]
                if tiled and len(piece) < down:
                    piece = np.pad(piece, ((0, down - len(piece)), (0, 0)))
                if predictor == 2:
                    piece = np.diff(piece, axis=1, prepend=np.uint8(0))
                raw = piece.tobytes()
                packed = lzw_encode(raw) if scheme == LZW else packbits_encode(raw, across) if scheme == PACKBITS else zlib.compress(raw, 1)
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed + b"\0" * (len(packed) % 2)
        fields = {IMAGE_WIDTH: [WIDTH], IMAGE_LENGTH: [height], BITS: [8], COMPRESSION: [scheme], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        if tiled:
            fields |= {TILE_WIDTH: [TILE_PIXELS], TILE_LENGTH: [TILE_ROWS], TILE_OFFSETS: offsets, TILE_COUNTS: counts}
        else:
            fields |= {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [STRIP_ROWS], STRIP_COUNTS: counts}
        entries = b""
        for tag, values in sorted(fields.items()):
            data = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                data, at = struct.pack("<I", len(out)), len(out)
                out += struct.pack(f"<{len(values)}I", *values)
            entries += struct.pack("<HHI", tag, 4, len(values)) + data
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: Bytes that one byte of a strip or tile can unpack to at most.
EXPANSION = {NONE: 1, PACKBITS: 64, DEFLATE: 1032, OLD_DEFLATE: 1032, LZW: 4096}
#: Bytes of a page at most; a task holds a page as a whole, so larger ones are refused in an error row.
PAGE_BYTES = 1 << 28


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for k in range(n):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if kind in TYPE_SIZES:
            code, size = TYPE_SIZES[kind]
            where = entry + 8 if count * size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            if not 0 < count * size <= len(data):
                raise ValueError(f"tag {tag} has {count} values")
            fields[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def decode_tiff(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(width, height, samples per pixel, samples) of each page: 8-bit samples, pixel by pixel, row by row.

    Walks the chain of image directories of either byte order. ValueError tells what is wrong with a malformed
    file: a chain that comes back to itself, missing or impossible values, strips or tiles that hold fewer bytes
    than their header says (EXPANSION times their packed size at most), and pages of over PAGE_BYTES. Memory goes
    to bytes that were unpacked and not to sizes in headers, and to one page at a time.
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        fields, following = _directory(data, at, order)

        def one(tag, default=None, fields=fields):
            value = fields.get(tag, (default,))[0]
            if value is None:
                raise ValueError(f"tag {tag} is missing")
            return value

        width, height, samples = one(IMAGE_WIDTH), one(IMAGE_LENGTH), one(SAMPLES, 1)
        if set(fields.get(BITS, (1,))) != {8}:
            raise ValueError("samples are not of 8 bits")
        scheme, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
        if TILE_OFFSETS in fields:
            across, down, offsets, counts = one(TILE_WIDTH), one(TILE_LENGTH), fields[TILE_OFFSETS], fields.get(TILE_COUNTS, ())
        else:
            across, down, offsets, counts = width, min(one(ROWS_PER_STRIP, height), height), fields.get(STRIP_OFFSETS, ()), fields.get(STRIP_COUNTS, ())
        if min(width, height, samples, across, down) < 1:
            raise ValueError("a size is 0")
        per_row, per_column = -(-width // across), -(-height // down)
        if len(offsets) < per_row * per_column or len(counts) < per_row * per_column:
            raise ValueError("strips or tiles are missing")
        pixels, padded = width * height * samples, per_column * down * per_row * across * samples
        places = [(o, min(c, max(0, len(data) - o))) for o, c in zip(offsets[: per_row * per_column], counts)]
        if pixels > EXPANSION.get(scheme, 1) * sum(n for _, n in places) or padded > 4 * pixels + (4 << 20):
            raise ValueError("more pixels than the file can hold")
        if padded > PAGE_BYTES:
            raise ValueError("a page is too large")
        if predictor not in (1, 2):
            raise ValueError(f"predictor {predictor} is not supported")
        bands = []
        for y in range(0, height, down):
            rows = down if TILE_OFFSETS in fields else min(down, height - y)
            pieces = []
            for offset, count in places[y // down * per_row :][:per_row]:
                raw = _unpacked(data[offset : offset + count], scheme, rows * across * samples)
                piece = np.frombuffer(raw, np.uint8).reshape(rows, across, samples)
                pieces.append(np.cumsum(piece, axis=1, dtype=np.uint8) if predictor == 2 else piece)
            band = pieces[0] if per_row == 1 else np.concatenate(pieces, axis=1)
            bands.append(band[: height - y, :width].tobytes())
        yield width, height, samples, b"".join(bands)
        at = following


# ---------------------------------------------------------------- columns


def write_tiff(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` and ``media`` added: each text's UTF-8 bytes, padded with zero bytes to a
    positive multiple of WIDTH, as a TIFF.

    Defined cases: null counts as empty, one row of zeros; equal texts give equal bytes; an empty table gives
    no rows; columns named n_bytes or media are replaced.
    """

    keep = [f for f in docs.schema.fields if f.name not in ("n_bytes", "media")]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "n_bytes long", "media binary"])
    names = [f.name for f in keep]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = [t or b"" for t in part.column(text_col).cast(pa.binary()).to_pylist()]
                files = [encode_tiff(t + b"\0" * (max(WIDTH, -(-len(t) // WIDTH) * WIDTH) - len(t))) for t in texts]
                made = pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], names=[*names, "n_bytes", "media"])

    return bounded_batches(docs).mapInArrow(run, ddl)


def read_tiff(media: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page: the other columns of ``media`` with page (from 0), width, height, samples, error.

    Pages of one file follow one another. A file that cannot be read gives a row with page null and the reason
    in ``error``, after the pages before the fault; null media give no rows. Pages are handed on as they come, so a
    file of many pages needs no more memory than some of them.
    """
    keep = [f for f in media.schema.fields if f.name not in (media_col, "page", "width", "height", "samples", "error")]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "page int", "width int", "height int", "samples binary", "error string"])
    names = [f.name for f in keep]
    limit = 2 << 20

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[int] = []
            pages: list[tuple] = []
            size = 0

            def pack(batch=batch):
                kept = batch.select(names).take(pa.array(rows, pa.int64()))  # rows and pages as they are by then
                types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                return pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(zip(*pages), types))], names=[*names, "page", "width", "height", "samples", "error"])

            for k, data in enumerate(batch.column(media_col)):
                data = data.as_py()
                if data is None:
                    continue
                try:
                    for page, (width, height, _, samples) in enumerate(decode_tiff(data)):
                        rows.append(k)
                        pages.append((page, width, height, samples, None))
                        size += len(samples)
                        if size > limit:
                            yield pack()
                            rows, pages, size = [], [], 0
                except (ValueError, struct.error, zlib.error, MemoryError) as error:
                    rows.append(k)
                    pages.append((None, None, None, None, str(error) or type(error).__name__))
            if rows:
                yield pack()

    return bounded_batches(media).mapInArrow(run, ddl)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file, from its pages in turn: size, digest, crc of the last bytes, and which columns are bright."""
    now: dict = {}

    def done() -> tuple:
        bright = now["columns"] * WIDTH > now["columns"].sum()
        feature = f"{int(''.join('01'[int(b)] for b in bright), 2):016x}"
        return (*now["head"][:2], now["size"], now["sha"].hexdigest(), zlib.crc32(now["tail"]), *now["head"][2:], feature)

    for batch in it:
        out = []
        for doc_id, n_bytes, media_bytes, media_sha, page, samples in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "samples"))):
            if page == 0 or not now:
                if now:
                    out.append(done())
                now.update(head=(doc_id, n_bytes, media_bytes, media_sha), size=0, sha=sha256(), tail=b"", columns=np.zeros(WIDTH, np.int64))
            if samples is None:  # what cannot be read adds nothing
                continue
            now["size"] += len(samples)
            now["sha"].update(samples)
            now["tail"] = samples[-64:]
            now["columns"] += np.frombuffer(samples, np.uint8).reshape(-1, WIDTH).sum(axis=0, dtype=np.int64)
        if out:
            yield record_batch(_DIGEST, *zip(*out))
    if now:
        yield record_batch(_DIGEST, *zip(done()))


def digests(media: DataFrame) -> DataFrame:
    """Size and digests of the samples that are read back from doc_id, n_bytes, media, and a feature: which of the
    WIDTH columns of all pages are brighter than the mean, as 64 bits in hex."""
    media = media.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read_tiff(media).mapInArrow(_digest, ddl)


def op6_media_tiff(spark, sf_dir: str) -> DataFrame:
    return digests(write_tiff(documents(spark, sf_dir).select("doc_id", "text")))
