"""The parts of the TIFF format that single-band rasters need: directory, tiles or strips, Deflate and LZW, both predictors.

Everything works on one tile or one header at a time; the data source in ``raster.py`` deals tiles to tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# The format's tag numbers, value types, compressions and sample kinds.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, NODATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
UNSIGNED, SIGNED, FLOATING = 1, 2, 3
CLEAR, END = 256, 257


@dataclass
class Header:
    """What a file says of its raster; blocks are tiles, or strips as wide as the raster."""

    width: int
    height: int
    dtype: np.dtype  # in the file's byte order
    compression: int
    predictor: int
    block_width: int
    block_height: int
    offsets: list[int]
    sizes: list[int]
    nodata: float | None
    scale: tuple[float, float] | None  # size of a cell
    corner: tuple[float, float] | None  # upper left corner of cell (0, 0)
    description: str
    tiled: bool

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    def window(self, block: int) -> tuple[int, int, int, int]:
        """(first row, row after the last, first column, column after the last) of a block, inside the raster."""
        r, c = block // self.across * self.block_height, block % self.across * self.block_width
        return r, min(r + self.block_height, self.height), c, min(c + self.block_width, self.width)


def header(read: Callable[[int, int], bytes]) -> Header:
    """The first image of a file; ``read`` gives bytes by (offset, size).  Files beyond 4 GB (8-byte offsets) are read as well."""
    start = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    kind = struct.unpack(f"{order}H", start[2:4])[0] if order else None
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    large = kind == 43
    at = struct.unpack(f"{order}Q", start[8:16])[0] if large else struct.unpack(f"{order}I", start[4:8])[0]
    head, entry, word = (8, 20, "Q") if large else (2, 12, "I")
    room = 8 if large else 4
    count = struct.unpack(order + ("Q" if large else "H"), read(at, head))[0]
    table, tags = read(at + head, count * entry), {}
    for i in range(count):
        own = table[i * entry : (i + 1) * entry]
        tag, type_ = struct.unpack(f"{order}HH", own[:4])
        n = struct.unpack(order + word, own[4 : 4 + room])[0]
        if type_ not in TYPES:
            continue
        size = n * struct.calcsize(f"{order}{TYPES[type_]}")
        raw = own[-room:][:size] if size <= room else read(struct.unpack(order + word, own[-room:])[0], size)
        tags[tag] = raw.rstrip(b"\0").decode("utf-8", "replace") if type_ == 2 else list(struct.unpack(f"{order}{n}{TYPES[type_]}", raw))
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    if one(SAMPLES, 1) != 1:
        raise ValueError("only rasters of one band are read")
    kind_of = {UNSIGNED: "u", SIGNED: "i", FLOATING: "f"}[one(SAMPLE_FORMAT, UNSIGNED)]
    tiled = TILES in tags
    nodata = tags.get(NODATA, "").strip()
    scale, tie = tags.get(PIXEL_SCALE), tags.get(TIE_POINT)
    return Header(
        one(WIDTH), one(HEIGHT), np.dtype(f"{order}{kind_of}{one(BITS, 8) // 8}"), one(COMPRESSION, PLAIN), one(PREDICTOR, 1),
        one(TILE_WIDTH) if tiled else one(WIDTH), one(TILE_HEIGHT) if tiled else min(one(STRIP_ROWS, one(HEIGHT)), one(HEIGHT)),
        tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], float(nodata) if nodata else None,
        (scale[0], scale[1]) if scale else None, (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]) if tie and scale else None, tags.get(DESCRIPTION, ""), tiled,
    )


def unpacked_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the width grows one code before the table needs it."""
    out, table, last = bytearray(), [], b""
    held = bits = at = 0
    width = 9
    while True:
        while bits < width:
            if at == len(data):
                return bytes(out)
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFF, bits + 8, at + 1
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == END:
            return bytes(out)
        if code == CLEAR:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        own = table[code] if code < len(table) else last + last[:1]
        out += own
        if last:
            table.append(last + own[:1])
        last = own
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def packed_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(CLEAR, 9)
    table: dict[tuple[int, int], int] = {}  # (code of a string, next byte) -> code of both
    size, own = END + 1, -1
    width = 9
    for byte in data:
        if own < 0:
            own = byte
        elif (own, byte) in table:
            own = table[own, byte]
        else:
            put(own, width)
            table[own, byte] = size
            size, own = size + 1, byte
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
            if size == 4094:
                put(CLEAR, width)
                table, size, width = {}, END + 1, 9
    if own >= 0:
        put(own, width)
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(END, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def decoded(data: bytes, compression: int, predictor: int, dtype: np.dtype, rows: int, columns: int) -> np.ndarray:
    """One block as (rows, columns) in the machine's byte order."""
    if compression == LZW:
        data = unpacked_lzw(data)
    elif compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif compression != PLAIN:
        raise ValueError(f"compression {compression} is not read")
    if predictor == 3:  # bytes of like weight together, each the difference to the one before
        wide = np.frombuffer(data, np.uint8, rows * columns * dtype.itemsize).reshape(rows, -1)
        wide = np.add.accumulate(wide, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, columns)
        return np.ascontiguousarray(wide.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, columns).astype(dtype.newbyteorder("="))
    out = np.frombuffer(data, dtype, rows * columns).reshape(rows, columns).astype(dtype.newbyteorder("="))
    return np.add.accumulate(out, axis=1, dtype=out.dtype) if predictor == 2 else out


def encoded(block: np.ndarray, compression: int, predictor: int) -> bytes:
    rows, columns = block.shape
    if predictor == 3:
        wide = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(rows, columns, -1).transpose(0, 2, 1).reshape(rows, -1)
        data = np.diff(wide, axis=1, prepend=np.zeros((rows, 1), np.uint8)).astype(np.uint8).tobytes()
    else:
        if predictor == 2:
            block = np.diff(block, axis=1, prepend=np.zeros((rows, 1), block.dtype)).astype(block.dtype)
        data = block.astype(block.dtype.newbyteorder("<")).tobytes()
    return packed_lzw(data) if compression == LZW else zlib.compress(data) if compression == DEFLATE else data


def file_bytes(raster: np.ndarray, tile: int, compression: int, predictor: int, nodata: float | None, scale: tuple[float, float], corner: tuple[float, float], description: str) -> bytes:
    """A whole tiled file of one raster (bounded by the caller: one block of a larger raster), little-endian."""
    height, width = raster.shape
    tiles = []
    for r in range(0, height, tile):
        for c in range(0, width, tile):
            own = np.zeros((tile, tile), raster.dtype)
            part = raster[r : r + tile, c : c + tile]
            own[: part.shape[0], : part.shape[1]] = part
            tiles.append(encoded(own, compression, predictor))
    kind = {"u": UNSIGNED, "i": SIGNED, "f": FLOATING}[raster.dtype.kind]
    at = 8 + np.cumsum([0, *map(len, tiles)])
    text = lambda s: (2, s.encode() + b"\0")
    number = lambda *v: (4, struct.pack(f"<{len(v)}I", *v))
    real = lambda *v: (12, struct.pack(f"<{len(v)}d", *v))
    tags = {
        WIDTH: number(width), HEIGHT: number(height), BITS: number(raster.dtype.itemsize * 8), COMPRESSION: number(compression), PHOTOMETRIC: number(1), DESCRIPTION: text(description), SAMPLES: number(1),
        PREDICTOR: number(predictor), TILE_WIDTH: number(tile), TILE_HEIGHT: number(tile), TILES: number(*at[:-1].tolist()), TILE_BYTES: number(*map(len, tiles)), SAMPLE_FORMAT: number(kind),
        PIXEL_SCALE: real(*scale, 0.0), TIE_POINT: real(0.0, 0.0, 0.0, *corner, 0.0),
    } | ({} if nodata is None else {NODATA: text(f"{nodata:g}")})
    body = b"".join(tiles)
    body += b"\0" * (len(body) % 2)
    extra_at, entries, extra = 8 + len(body), [], b""
    for tag in sorted(tags):
        type_, raw = tags[tag]
        n = len(raw) // struct.calcsize(f"<{TYPES[type_]}")
        if len(raw) > 4:
            value = struct.pack("<I", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            value = raw.ljust(4, b"\0")
        entries.append(struct.pack("<HHI", tag, type_, n) + value)
    return struct.pack("<2sHI", b"II", 42, extra_at + len(extra)) + body + extra + struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0)
