"""Baseline JPEG columns: bytes stored losslessly as quantized coefficients, and thumbnails read back.

A payload is padded to blocks of 64 bytes. Each byte, less 128, is one quantized
coefficient of an 8 x 8 block in zigzag order, the unit that a baseline scan stores
without loss. Blocks fill a grid that is as square as can be; the scan has a restart
marker after a few blocks, so that decoding can go on at many places at once.

The decoder parses the markers, takes the Huffman tables of the file, and decodes the
restart intervals of many images in step with each other in numpy. The DC coefficients
give the luminance thumbnail, one pixel for each block; the payload comes from all of them.

Both directions are projections of each row: nothing is shuffled, and an image is a
binary column. Defined results: a null text counts as empty, and an empty one
becomes one block of zero bytes. Equal texts give equal values.
"""

from __future__ import annotations

import copy
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 64
#: Blocks between restart markers.
RESTART = 4
#: Bytes of payload that are encoded or decoded in step, about.
TOGETHER = 1 << 20
#: Bytes of payload in a part of a long image: whole cycles of eight restart markers.
PART = 8 * 512 * RESTART * BLOCK

#: The code counts by length and the symbols in order of code, of the two Huffman tables
#: that this writer puts into its files. DC: bit sizes 0 to 9. AC: run and size, as the nibbles of a byte.
DC_COUNTS = (0, 0, 6, 3, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = (3, 4, 5, 6, 7, 2, 8, 1, 0, 9)
AC_SIZES_FIRST = (4, 5, 7, 3, 6, 2, 1, 8)


def _ac_table() -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Short codes for sizes without a run before them, then the end of a block, runs and long runs."""
    rest = [0x00, 0xF0, *(run << 4 | size for run in range(1, 16) for size in range(1, 11)), 9, 10]
    counts = [0] * 16
    counts[1], counts[2], counts[4], counts[6], counts[7] = 2, 2, 3, 1, 0
    counts[11] = len(rest)
    return tuple(counts), (*AC_SIZES_FIRST, *rest)


AC_COUNTS, AC_SYMBOLS = _ac_table()


def _codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), by the rule of the format: codes of a length count up."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = code, length
            code += 1
        at, code = at + n, code << 1
    return out


def _lookup(counts, symbols) -> np.ndarray:
    """For each 16 bits: length << 8 | symbol of the code that they begin with; 0 if none."""
    table = np.zeros(1 << 16, np.uint16)
    for symbol, (code, length) in _codes(counts, symbols).items():
        table[code << 16 - length : (code + 1) << 16 - length] = length << 8 | symbol
    return table


_DC, _AC = _codes(DC_COUNTS, DC_SYMBOLS), _codes(AC_COUNTS, AC_SYMBOLS)


def _bits(value: int, codes: dict, run: int = 0) -> tuple[int, int]:
    """Code of a value's size and its bits, as one number, and their length."""
    size = abs(value).bit_length()
    code, length = codes[run << 4 | size]
    return code << size | (value if value >= 0 else value + (1 << size) - 1), length + size


_DC_BITS, _DC_LENGTH = map(np.array, zip(*(_bits(v, _DC) for v in range(-511, 512)), strict=True))
_AC_BITS, _AC_LENGTH = np.zeros((16, 256), np.int64), np.zeros((16, 256), np.int64)
for _run in range(16):
    for _v in range(-128, 128):
        if _v:
            _AC_BITS[_run, _v + 128], _AC_LENGTH[_run, _v + 128] = _bits(_v, _AC, _run)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(width: int, height: int, n_bytes: int) -> bytes:
    tables = bytes([0x00, *DC_COUNTS, *DC_SYMBOLS]) + bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
            _segment(0xFE, b"payload-bytes=%d" % n_bytes),
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC0, bytes([8, *height.to_bytes(2, "big"), *width.to_bytes(2, "big"), 1, 1, 0x11, 0])),
            _segment(0xC4, tables),
            _segment(0xDD, RESTART.to_bytes(2, "big")),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def _scans(blocks: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Entropy-coded data of images whose blocks (n x 64, int16) follow each other, counts[i] of image i."""
    n = len(blocks)
    first = np.zeros(n, bool)
    starts = np.cumsum(counts) - counts
    place = np.arange(n) - np.repeat(starts, counts)
    first[place % RESTART == 0] = True
    dc = blocks[:, 0].astype(np.int64)
    step = np.diff(dc, prepend=0)
    step[first] = dc[first]
    value = np.zeros((n, BLOCK + 1), np.int64)
    length = np.zeros((n, BLOCK + 1), np.int64)
    value[:, 0], length[:, 0] = _DC_BITS[step + 511], _DC_LENGTH[step + 511]
    ac = blocks[:, 1:].astype(np.int64) + 128
    value[:, 1:BLOCK], length[:, 1:BLOCK] = _AC_BITS[0][ac], _AC_LENGTH[0][ac]
    for b in np.flatnonzero((ac == 128).any(axis=1)).tolist():  # blocks with zeros have runs
        run = 0
        for k in range(1, BLOCK):
            v = int(blocks[b, k])
            if v == 0:
                run += 1
                continue
            total, bits = 0, 0
            while run > 15:
                code, size = _AC[0xF0]
                total, bits, run = total << size | code, bits + size, run - 16
            code, size = _bits(v, _AC, run)
            value[b, k], length[b, k] = total << size | code, bits + size
            run = 0
        if run:
            value[b, BLOCK], length[b, BLOCK] = _AC[0x00]
    # Pad each restart interval to whole bytes with ones.
    interval = np.cumsum(first) - 1
    block_bits = length.sum(axis=1)
    interval_bits = np.bincount(interval, weights=block_bits).astype(np.int64)
    pad = -interval_bits % 8
    last = np.append(np.flatnonzero(first)[1:], n) - 1
    code, size = value[last, BLOCK], length[last, BLOCK]
    value[last, BLOCK] = code << pad | (1 << pad) - 1
    length[last, BLOCK] = size + pad
    flat, sizes = value.ravel(), length.ravel()
    some = sizes > 0
    flat, sizes = flat[some], sizes[some]
    # Sums of disjoint bits in words of 24: a code of up to 48 bits reaches into three.
    end = np.cumsum(sizes)
    at = end - sizes
    word, shift = at // 24, at % 24
    room = 72 - shift - sizes  # places free below the code in three words
    total = int(end[-1])
    words = np.zeros(total // 24 + 4)
    high, low = flat >> 24, flat & 0xFFFFFF
    for part, up in ((low, room), (high, room + 24)):
        for k, base in enumerate((48, 24, 0)):
            by = up - base
            moved = np.where(by >= 0, part << np.clip(by, 0, 38), part >> np.clip(-by, 0, 63)) & 0xFFFFFF
            words += np.bincount(word + k, weights=moved, minlength=len(words))
    as_bytes = words.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].ravel()
    # A byte of ones is followed by a zero byte; intervals are joined by restart markers.
    interval_bytes = (interval_bits + pad) // 8
    ends = np.cumsum(interval_bytes)
    raw = as_bytes[: ends[-1]]
    image = np.repeat(np.arange(len(counts)), -(-counts // RESTART))
    of_image = np.arange(len(image)) - np.searchsorted(image, image)
    last_of_image = np.append(image[1:] != image[:-1], True)
    out = []
    stuffed = raw == 0xFF
    extra = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(stuffed, out=extra[1:])
    marked = np.zeros(len(raw) + 1, np.int64)
    inner = ends[~last_of_image]
    np.add.at(marked, inner, 2)
    shift_by = extra[:-1] + np.cumsum(marked)[:-1]
    whole = np.zeros(len(raw) + int(extra[-1]) + 2 * len(inner), np.uint8)
    whole[np.arange(len(raw)) + shift_by] = raw
    marker_at = inner + extra[inner] + 2 * np.arange(len(inner))
    whole[marker_at] = 0xFF
    whole[marker_at + 1] = 0xD0 + of_image[~last_of_image] % 8
    stop = ends[last_of_image] + extra[ends[last_of_image]] + 2 * np.cumsum(np.bincount(image, minlength=len(counts)) - 1)
    begin = 0
    for s in stop.tolist():
        out.append(whole[begin:s].tobytes())
        begin = s
    return out


def grid(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of the least square-like grid that holds n_blocks."""
    columns = math.isqrt(n_blocks - 1) + 1 if n_blocks > 1 else 1
    return columns, -(-n_blocks // columns)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload of whole blocks."""
    scans: list[list[bytes]] = [[] for _ in payloads]
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        counts = np.array([len(p) // BLOCK for _, p in group])
        blocks = np.frombuffer(b"".join(p for _, p in group), np.uint8).astype(np.int16).reshape(-1, BLOCK) - 128
        for (i, _), scan in zip(group, _scans(blocks, counts), strict=True):
            scans[i].append(scan)
        group.clear()

    for i, p in enumerate(payloads):
        columns, rows = grid(len(p) // BLOCK)
        size = columns * rows * BLOCK
        # A long image is encoded in parts of whole cycles of its restart markers, which bounds the memory.
        for at in range(0, size, PART):
            own = p[at : at + PART]
            group.append((i, own + b"\x80" * (min(PART, size - at) - len(own))))
            held += len(group[-1][1])
            if held >= TOGETHER:
                flush()
                held = 0
    if group:
        flush()
    out = []
    for p, parts in zip(payloads, scans, strict=True):
        columns, rows = grid(len(p) // BLOCK)
        out.append(_header(8 * columns, 8 * rows, len(p)) + b"\xff\xd7".join(parts) + b"\xff\xd9")
    return out


class Image:
    """What the markers of a baseline JPEG with one component say, and where its scan lies."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.restart, self.n_bytes, self.tables, at = 0, None, b"", 2
        while True:
            if data[at] != 0xFF:
                raise ValueError(f"no marker at byte {at}")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC0:
                if body[0] != 8 or body[5] != 1:
                    raise ValueError("only 8 bits and one component are read")
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == 0xC4:
                self.tables += body
            elif marker == 0xDB and not body[0] >> 4:
                self.dc_step = body[1]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xFE and body.startswith(b"payload-bytes="):
                self.n_bytes = int(body[14:])
            elif marker == 0xDA:
                break
        self.columns, self.rows = -(-self.width // 8), -(-self.height // 8)
        self.n_blocks = self.columns * self.rows
        self.scan = data[at : len(data) - 2 if data.endswith(b"\xff\xd9") else len(data)]

    def parts(self) -> list[Image]:
        """The image, or if its scan is long images of parts of it, cut at restart markers."""
        every = PART // (BLOCK * self.restart) if self.restart else 0
        if not every or self.n_blocks <= 2 * every * self.restart:
            return [self]
        data = np.frombuffer(self.scan, np.uint8)
        marks = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] >= 0xD0) & (data[1:] <= 0xD7))
        cuts = marks[every - 1 :: every].tolist()
        out, begin, left = [], 0, self.n_blocks
        for cut in [*cuts, len(data)]:
            part = copy.copy(self)
            part.scan, begin = self.scan[begin:cut], cut + 2
            part.n_blocks = min(every * self.restart, left)
            left -= part.n_blocks
            if part.n_blocks:
                out.append(part)
        return out


def _lookups(tables: bytes) -> np.ndarray:
    """Lookup of the AC table followed by that of the DC table."""
    found, at = {}, 0
    while at < len(tables):
        kind, counts = tables[at] >> 4, tables[at + 1 : at + 17]
        symbols = tables[at + 17 : at + 17 + sum(counts)]
        found[kind] = _lookup(counts, symbols)
        at += 17 + sum(counts)
    return np.concatenate([found[1], found[0]]).astype(np.int32)


_known: dict[bytes, np.ndarray] = {}


def _coefficients(images: list[Image]) -> np.ndarray:
    """All coefficients (n x 64, zigzag order) of images with equal tables, block after block."""
    tables = images[0].tables
    if tables not in _known:
        _known.clear()
        _known[tables] = _lookups(tables)
    lookup = _known[tables]
    data = np.frombuffer(b"".join(x.scan + b"\xff\xd9" for x in images) + b"\0" * 8, np.uint8)
    ones = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ones + 1]
    stuffing, marks = ones[after == 0] + 1, ones[after != 0]
    keep = np.ones(len(data), bool)
    keep[stuffing] = False
    keep[marks] = keep[marks + 1] = False
    shift = np.cumsum(~keep)
    stops = marks - shift[marks] + 1  # of the intervals, in the data without stuffing and markers
    starts = np.append(0, stops[:-1])
    raw = data[keep].astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    sizes = []
    for x in images:
        every = x.restart or x.n_blocks
        full, rest = divmod(x.n_blocks, every)
        sizes += [every] * full + [rest] * (rest > 0)
    sizes = np.array(sizes)
    if len(sizes) != len(starts):
        raise ValueError("the restart markers don't fit the size of the image")
    base = (np.cumsum(sizes) - sizes) * BLOCK
    out = np.zeros(int(sizes.sum()) * BLOCK, np.int32)
    at, pos, k = base.copy(), starts * 8, np.zeros(len(sizes), np.int64)
    end = base + sizes * BLOCK  # k: place in the block; at: start of the block in out
    while len(pos):
        bits = window[pos >> 3].astype(np.int64) << (pos & 7) & 0xFFFFFFFF
        entry = lookup[(bits >> 16) + ((k == 0) << 16)]
        length, size, run = entry >> 8, entry & 15, entry >> 4 & 15
        if not length.all():
            raise ValueError("a code that isn't in the table")
        low = bits << length & 0xFFFFFFFF
        value = low >> (32 - size)
        value = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
        k += run
        stop = (size == 0) & (run < 15) & (k > 0)  # the end of the block
        put = (size > 0) & (k < BLOCK)
        if put.all():
            out[at + k] = value
        else:
            out[(at + k)[put]] = value[put]
        k += 1
        pos += length + size
        ended = stop | (k >= BLOCK)
        if ended.any():
            at[ended] += BLOCK
            k[ended] = 0
            left = at < end
            if not left.all():
                at, pos, k, end = at[left], pos[left], k[left], end[left]
    blocks = out.reshape(-1, BLOCK)
    # DC coefficients are stored as steps within an interval.
    sums = np.cumsum(blocks[:, 0])
    before = np.append(0, sums)[base // BLOCK]
    blocks[:, 0] = sums - np.repeat(before, sizes)
    return blocks


def decode(images: list[bytes]) -> list[tuple[bytes, Image, np.ndarray]]:
    """Payload, markers and thumbnail (rows x columns, 0 to 255) of each image."""
    found = [Image(data) for data in images]
    payloads: list[list[bytes]] = [[] for _ in found]
    dc: list[list[np.ndarray]] = [[] for _ in found]
    group: list[tuple[int, Image]] = []

    def flush() -> None:
        blocks = _coefficients([x for _, x in group])
        whole = (blocks + 128).astype(np.uint8)
        at = 0
        for i, x in group:
            payloads[i].append(whole[at : at + x.n_blocks].tobytes())
            dc[i].append(blocks[at : at + x.n_blocks, 0].copy())
            at += x.n_blocks
        group.clear()

    held = 0
    for i, image in enumerate(found):
        for part in image.parts():
            if group and group[0][1].tables != part.tables:
                flush()
                held = 0
            group.append((i, part))
            held += len(part.scan)
            if held >= TOGETHER:
                flush()
                held = 0
    if group:
        flush()
    out = []
    for image, parts, own in zip(found, payloads, dc, strict=True):
        luminance = np.clip(np.concatenate(own) * image.dc_step / 8 + 128, 0, 255)
        out.append((b"".join(parts)[: image.n_bytes], image, luminance.reshape(image.rows, image.columns)))
    return out


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 8 cells is lighter than the one to its right (the row goes round)."""
    rows, columns = thumbnail.shape
    # Cell means by sums over the rectangle; a thumbnail of fewer pixels repeats them.
    sums = np.zeros((rows + 1, columns + 1))
    sums[1:, 1:] = thumbnail.cumsum(axis=0).cumsum(axis=1)
    r0, c0 = np.arange(8) * rows // 8, np.arange(8) * columns // 8
    r1 = np.maximum((np.arange(8) + 1) * rows // 8, r0 + 1)
    c1 = np.maximum((np.arange(8) + 1) * columns // 8, c0 + 1)
    total = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    cells = total / np.outer(r1 - r0, c1 - c0)
    return np.packbits(cells > np.roll(cells, -1, axis=1)).tobytes().hex()


def padded(text: str | None) -> tuple[int, bytes]:
    """Number of bytes of a text, and these bytes with zeros up to a positive multiple of a block."""
    data = (text or "").encode()
    return len(data), data + b"\0" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def _groups(values: list, most: int = 4 * TOGETHER) -> Iterator[list]:
    group, held = [], 0
    for v in values:
        group.append(v)
        held += len(v or "")
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of docs: the text as a baseline JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for group in _groups(batch.column(1).to_pylist()):
                sizes, payloads = zip(*map(padded, group), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(group)), pa.array(sizes, pa.int64()), pa.array(encode(list(payloads)), pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )
                at += len(group)

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """media (doc_id, n_bytes, media) with what its images hold: sizes, digests, dimensions and thumbnail hash."""
    schema = (
        f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, "
        "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for group in _groups(batch.column(2).to_pylist()):
                for data, (payload, image, thumbnail) in zip(group, decode(group), strict=True):
                    rows.append(
                        (
                            len(payload),
                            hashlib.sha256(payload).hexdigest(),
                            zlib.crc32(payload[-BLOCK:]),
                            len(data),
                            hashlib.sha256(data).hexdigest(),
                            f"{image.width}x{image.height}:{thumbnail_hash(thumbnail)}",
                        )
                    )
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
