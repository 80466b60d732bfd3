"""Indexed PNG tiles: chunks, codec and recolouring, as Arrow functions over binary columns."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .feed import STRIPE

# Fixed values of the format and of the tiles.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, COLOURS = 256, 16
ALPHA = bytes([0] + [77] * 14 + [179])
ORDER = (b"IHDR", b"PLTE", b"tRNS", b"IDAT", b"IEND")


class PngError(ValueError):
    """A file that breaks the tile contract."""


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes, int, bool]]:
    """(type, data, crc, crc_ok) of each chunk; nothing may follow the last."""
    if data[:8] != SIGNATURE:
        raise PngError("signature")
    at, kind = 8, b""
    while at < len(data):
        if kind == b"IEND" or at + 12 > len(data):
            raise PngError("residue or truncation")
        n, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + n > len(data):
            raise PngError("truncated chunk")
        body = data[at + 8 : at + 8 + n]
        crc = struct.unpack_from(">I", data, at + 8 + n)[0]
        yield kind, body, crc, crc == zlib.crc32(kind + body)
        at += 12 + n
    if kind != b"IEND":
        raise PngError("no end")


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(indices: np.ndarray, palette: bytes) -> bytes:
    """SIDE x SIDE indices below COLOURS to a tile: unfiltered rows, best compression."""
    if indices.shape != (SIDE, SIDE) or indices.max() >= COLOURS or len(palette) != 3 * COLOURS:
        raise PngError("indices or palette")
    rows = np.zeros((SIDE, SIDE + 1), np.uint8)
    rows[:, 1:] = indices
    head = struct.pack(">IIBBBBB", SIDE, SIDE, 8, 3, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"PLTE", palette) + chunk(b"tRNS", ALPHA) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + chunk(b"IEND", b"")


def check(data: bytes) -> dict[bytes, bytes]:
    """The chunks of a tile that holds to the contract."""
    found = list(chunks(data))
    if tuple(k for k, _, _, _ in found) != ORDER or not all(ok for *_, ok in found):
        raise PngError("order or checksum of chunks")
    by = {k: body for k, body, _, _ in found}
    if by[b"IHDR"] != struct.pack(">IIBBBBB", SIDE, SIDE, 8, 3, 0, 0, 0) or len(by[b"PLTE"]) != 3 * COLOURS or by[b"tRNS"] != ALPHA or not by[b"IDAT"] or by[b"IEND"]:
        raise PngError("header, palette, transparency or data")
    return by


def decode(data: bytes) -> np.ndarray:
    """The indices of a tile, with any of the five row filters."""
    raw = zlib.decompress(check(data)[b"IDAT"])
    if len(raw) != SIDE * (SIDE + 1):
        raise PngError("size of data")
    rows = np.frombuffer(raw, np.uint8).reshape(SIDE, SIDE + 1)
    out = np.zeros((SIDE, SIDE), np.uint8)
    above = np.zeros(SIDE, np.uint8)
    for y in range(SIDE):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            own = line
        elif kind == 1:
            own = np.cumsum(line, dtype=np.uint8)
        elif kind == 2:
            own = line + above
        elif kind in (3, 4):
            own, left, corner = np.zeros(SIDE, np.uint8), 0, 0
            for x in range(SIDE):
                up = int(above[x])
                guess = (left + up) // 2 if kind == 3 else min((left, up, corner), key=lambda v, p=left + up - corner: abs(p - v))
                left, corner = (int(line[x]) + guess) & 255, up
                own[x] = left
        else:
            raise PngError("row filter")
        out[y] = above = own
    return out


def recolour(data: bytes, colours: list[list[int]], hatched: bool) -> bytes:
    """A tile with the zones' colours in palette entries 1-7 and, hatched, their dark stripes in 8-14, else the same there.

    Only these entries and the palette's checksum change.
    """
    if len(colours) != 7 or any(len(c) != 3 or not all(0 <= v <= 255 for v in c) for c in colours):
        raise PngError("colours")
    palette = bytearray(check(data)[b"PLTE"])
    for i, c in enumerate(colours, 1):
        palette[3 * i : 3 * i + 3] = bytes(c)
        palette[3 * i + 21 : 3 * i + 24] = bytes(int(v * STRIPE + 0.5) for v in c) if hatched else bytes(c)
    at = data.index(b"PLTE") - 4
    return data[:at] + chunk(b"PLTE", bytes(palette)) + data[at + 12 + len(palette) :]


def recoloured(tile: Column, colours: Column, style: Column) -> Column:
    """recolour over columns, in Arrow batches."""
    @F.pandas_udf("binary")
    def paint(tiles: pd.Series, rgb: pd.Series, styles: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else recolour(bytes(t), [list(map(int, c)) for c in r], s == "forecast_hatch") for t, r, s in zip(tiles, rgb, styles, strict=True)])

    return paint(tile, colours, style)


def chunk_table():
    """A table function png_chunks(binary): seq, type, length, crc, crc_ok; malformed files give no rows but one of seq -1."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="seq int, type string, length int, crc long, crc_ok boolean")
    class Chunks:
        def eval(self, data: bytes):
            try:
                for i, (kind, body, crc, ok) in enumerate(list(chunks(bytes(data)))):
                    yield i, kind.decode("latin-1"), len(body), crc, ok
            except PngError:
                yield -1, None, None, None, False

    return Chunks


def render(edges: np.ndarray, zones: np.ndarray, z: int, x: int, y: int, wide: int = 1, high: int = 1) -> np.ndarray:
    """Indices of one tile, or of a window of tiles from it on, from closed outlines in Mercator metres: zone fill 1-7, its hatch 8-14, border 15, background 0.

    edges: rows of ax, ay, bx, by; zones: each edge's index 1-7. A pixel is filled by the even-odd rule at its middle, the hatch
    and the border follow global pixels, so neighbouring tiles fit without a seam.
    """
    from .tiles import HALF_WORLD, HATCH_PERIOD, HATCH_WIDTH, WORLD

    scale = SIDE * 2**z / WORLD
    gx, gy = (edges[:, [0, 2]] + HALF_WORLD) * scale - x * SIDE, (HALF_WORLD - edges[:, [1, 3]]) * scale - y * SIDE
    width, height = wide * SIDE, high * SIDE
    across, middle = np.arange(width) + 0.5, np.arange(height) + 0.5
    out = np.zeros((height, width), np.uint8)
    for zone in np.unique(zones):
        ax, bx, ay, by = gx[zones == zone, 0], gx[zones == zone, 1], gy[zones == zone, 0], gy[zones == zone, 1]
        inside = np.zeros((height, width), bool)
        for i in np.flatnonzero((np.minimum(ay, by) < height) & (np.maximum(ay, by) > 0) & (ay != by)):
            rows = np.flatnonzero((ay[i] > middle) != (by[i] > middle))
            cut = ax[i] + (middle[rows] - ay[i]) / (by[i] - ay[i]) * (bx[i] - ax[i])
            inside[rows] ^= across[None, :] > cut[:, None]
        out[inside] = zone
    rows, cols = np.mgrid[0:height, 0:width]
    hatch = ((cols + x * SIDE + rows + y * SIDE) % HATCH_PERIOD < HATCH_WIDTH) & (out > 0)
    out[hatch] += 7
    # the border: pixels whose middle is within one pixel of an edge
    near = (np.minimum(gx[:, 0], gx[:, 1]) < width + 1) & (np.maximum(gx[:, 0], gx[:, 1]) > -1) & (np.minimum(gy[:, 0], gy[:, 1]) < height + 1) & (np.maximum(gy[:, 0], gy[:, 1]) > -1)
    for ax, bx, ay, by in zip(gx[near, 0], gx[near, 1], gy[near, 0], gy[near, 1], strict=True):
        c0, c1 = max(0, int(min(ax, bx)) - 2), min(width, int(max(ax, bx)) + 3)
        r0, r1 = max(0, int(min(ay, by)) - 2), min(height, int(max(ay, by)) + 3)
        if c0 >= c1 or r0 >= r1:
            continue
        px, py = np.meshgrid(across[c0:c1], middle[r0:r1])
        dx, dy = bx - ax, by - ay
        along = np.clip(((px - ax) * dx + (py - ay) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
        out[r0:r1, c0:c1][np.hypot(px - ax - along * dx, py - ay - along * dy) <= 1] = 15
    return out


def rgba(indices: np.ndarray, palette: bytes) -> np.ndarray:
    """Red, green, blue and alpha of each pixel of indices."""
    colours = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    alpha = np.full(len(colours), 255, np.uint8)
    alpha[: len(ALPHA)] = np.frombuffer(ALPHA, np.uint8)
    return np.concatenate([colours[indices], alpha[indices][..., None]], axis=-1)


def mosaic(tiles: dict[tuple[int, int], np.ndarray], x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """The indices of a window of tiles, both ends included; tiles that are not there are background."""
    out = np.zeros(((y1 - y0 + 1) * SIDE, (x1 - x0 + 1) * SIDE), np.uint8)
    for (x, y), own in tiles.items():
        if x0 <= x <= x1 and y0 <= y <= y1:
            out[(y - y0) * SIDE : (y - y0 + 1) * SIDE, (x - x0) * SIDE : (x - x0 + 1) * SIDE] = own
    return out


def crop(window: np.ndarray, column: int, row: int) -> np.ndarray:
    """One tile of a mosaic."""
    return window[row * SIDE : (row + 1) * SIDE, column * SIDE : (column + 1) * SIDE]


def overview(window: np.ndarray, step: int) -> np.ndarray:
    """Every step-th pixel of a mosaic: the middle of each square."""
    return window[step // 2 :: step, step // 2 :: step]


def border_near(window: np.ndarray, column: int, row: int, radius: int = 3) -> tuple[int, int] | None:
    """The first border pixel, by row and column, within so many pixels of a place; none is None."""
    a, b = max(0, row - radius), max(0, column - radius)
    hits = np.argwhere(window[a : row + radius + 1, b : column + radius + 1] == 15)
    return (int(hits[0][1]) + b, int(hits[0][0]) + a) if len(hits) else None


def fixture() -> np.ndarray:
    """A tile of two zones with their hatches, a border between them and background around."""
    rows, cols = np.mgrid[0:SIDE, 0:SIDE]
    out = np.where(cols < SIDE // 2, 1, 2)
    out = np.where((rows + cols) % 12 < 2, out + 7, out)
    out[:, SIDE // 2 - 1 : SIDE // 2 + 1] = 15
    out[:16], out[-16:], out[:, :16], out[:, -16:] = 0, 0, 0, 0
    return out.astype(np.uint8)


def uint32(content: Column, at: Column) -> Column:
    """The big-endian number of four bytes from a place (from 0) on."""
    return F.conv(F.hex(F.substring(content, at + 1, F.lit(4))), 16, 10).cast("long")
