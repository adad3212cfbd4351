"""PNG images to RGB arrays and back, with numpy and zlib alone: all colour types, depths and filters, interlaced or not."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Fixed values of the format: samples of a pixel and the depths allowed by colour type; origin and step of the seven
# passes of an interlaced image (x, y, step in x, step in y).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class DamagedImage(ValueError):
    """A file that isn't a whole, sound image."""


def chunks(content: bytes) -> list[tuple[bytes, bytes]]:
    """Type and data of each chunk; lengths, checksums and the end are checked."""
    if not content.startswith(SIGNATURE):
        raise DamagedImage("signature")
    out, at = [], len(SIGNATURE)
    while at + 12 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data, end = content[at + 8 : at + 8 + size], at + 12 + size
        if end > len(content) or zlib.crc32(kind + data) != int.from_bytes(content[end - 4 : end]):
            raise DamagedImage(f"checksum of {kind!r}")
        out.append((kind, data))
        at = end
        if kind == b"IEND":
            break
    if not out or out[0][0] != b"IHDR" or out[-1][0] != b"IEND" or at != len(content):
        raise DamagedImage("order of chunks, or bytes after the end")
    return out


def header(content: bytes) -> tuple[int, int, int, int, bool]:
    """Width, height, depth, colour type, and whether the image is interlaced, from its first chunk."""
    if len(content) < 33 or content[12:16] != b"IHDR":
        raise DamagedImage("header")
    width, height, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", content[16:29])
    if not width or not height or depth not in DEPTHS.get(colour, ()) or packing or filtering or interlace > 1:
        raise DamagedImage("header")
    return width, height, depth, colour, bool(interlace)


def _unfiltered(lines: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """Undo the filters of ``lines`` (height, bytes), whose pixels take ``step`` bytes."""
    if filters.max(initial=0) > 4:
        raise DamagedImage("filter")
    height, width = lines.shape[0], lines.shape[1] // step
    out = np.zeros((height + 1, width + 1, step), dtype=np.int16)  # a line above and a pixel to the left of zeros
    source = lines.reshape(height, width, step)
    if filters.max(initial=0) <= 2:  # a line at a time: differences to the left are a running sum
        for y in range(height):
            line = source[y].astype(np.int16)
            if filters[y] == 1:
                line = np.cumsum(line, axis=0, dtype=np.int64).astype(np.int16)
            elif filters[y] == 2:
                line = line + out[y, 1:]
            out[y + 1, 1:] = line & 255
        return out[1:, 1:].astype(np.uint8).reshape(height, -1)
    # a pixel needs those to its left, above, and above that: all pixels of a diagonal at once
    for diagonal in range(height + width - 1):
        y = np.arange(max(0, diagonal - width + 1), min(height, diagonal + 1))
        x = diagonal - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        near_left, near_up, near_corner = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        nearest = np.where((near_left <= near_up) & (near_left <= near_corner), left, np.where(near_up <= near_corner, up, corner))
        kind = filters[y][:, None]
        added = np.choose(kind, (np.zeros_like(left), left, up, (left + up) >> 1, nearest))
        out[y + 1, x + 1] = (source[y, x] + added) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, -1)


def _samples(data: np.ndarray, width: int, depth: int, samples: int) -> np.ndarray:
    """The samples (height, width, samples) of unfiltered lines; of 16 bits, the high byte."""
    if depth == 16:
        return data.reshape(len(data), width, samples, 2)[..., 0]
    if depth == 8:
        return data.reshape(len(data), width, samples)
    bits = np.unpackbits(data, axis=1).reshape(len(data), -1, depth)
    values = bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
    return values[:, :width, None]


def _parts(width: int, height: int, interlaced: bool) -> list[tuple[int, int, int, int]]:
    return list(PASSES) if interlaced else [(0, 0, 1, 1)]


def decode(content: bytes, most_pixels: int) -> np.ndarray:
    """The image as RGB (height, width, 3), without its transparency; a ``DamagedImage`` tells what isn't sound.

    No more is unpacked than the header promises, and that is at most ``most_pixels``.
    """
    told = chunks(content)
    width, height, depth, colour, interlaced = header(content)
    if width * height > most_pixels:
        raise DamagedImage("pixels")
    kinds = [kind for kind, _ in told]
    data_at = [i for i, kind in enumerate(kinds) if kind == b"IDAT"]
    if not data_at or data_at != list(range(data_at[0], data_at[-1] + 1)) or kinds.count(b"IHDR") != 1:
        raise DamagedImage("order of chunks")
    samples = SAMPLES[colour]
    step = max(1, samples * depth // 8)
    shapes = [(-(-(width - x) // dx) if width > x else 0, -(-(height - y) // dy) if height > y else 0) for x, y, dx, dy in _parts(width, height, interlaced)]
    lengths = [h * (1 + -(-w * samples * depth // 8)) if w else 0 for w, h in shapes]
    unpacker = zlib.decompressobj()
    try:
        raw = unpacker.decompress(b"".join(told[i][1] for i in data_at), sum(lengths) + 1)
    except zlib.error as problem:
        raise DamagedImage("data") from problem
    if len(raw) != sum(lengths) or not unpacker.eof:
        raise DamagedImage("length of data")
    out, at = np.zeros((height, width, samples), dtype=np.uint8), 0
    for (x, y, dx, dy), (w, h), size in zip(_parts(width, height, interlaced), shapes, lengths, strict=True):
        if size:
            lines = np.frombuffer(raw, dtype=np.uint8, count=size, offset=at).reshape(h, -1)
            out[y::dy, x::dx] = _samples(_unfiltered(lines[:, 1:], lines[:, 0], step), w, depth, samples)
        at += size
    if colour == 3:
        palette = next((data for kind, data in told[: data_at[0]] if kind == b"PLTE"), b"")
        colours = np.frombuffer(palette[: len(palette) // 3 * 3], dtype=np.uint8).reshape(-1, 3)
        if len(palette) % 3 or not len(colours) or int(out.max()) >= len(colours):
            raise DamagedImage("palette")
        return colours[out[..., 0]]
    if colour in (0, 4):
        grey = out[..., :1].astype(np.uint16) * 255 // ((1 << min(depth, 8)) - 1)
        return np.repeat(grey.astype(np.uint8), 3, axis=2)
    return out[..., :3]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I4s", len(data), kind) + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray) -> bytes:
    """An RGB array (height, width, 3) of bytes as a PNG file; equal arrays give equal files."""
    height, width, _ = pixels.shape
    lines = np.zeros((height, 1 + 3 * width), dtype=np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)
    above = np.zeros_like(lines[:, 1:])
    above[1:] = lines[:-1, 1:]
    lines[:, 1:] -= above  # what differs from the line above, which is little in drawings
    lines[:, 0] = 2
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + _chunk(b"IEND", b"")
