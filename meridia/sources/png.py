"""PNG images as NumPy arrays: 8 bits a channel or 1 bit of grey, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """(height, width) of grey images, (height, width, 3) of colour ones; alpha is left off. Anything else is a ValueError."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("a PNG image is cut off")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None:
        raise ValueError("a PNG image without a header")
    width, height, bits, colour, _, _, interlaced = head
    if interlaced or colour not in _CHANNELS or not (bits == 8 or (bits == 1 and colour == 0)):
        raise ValueError(f"PNG images of {bits} bits, colour type {colour}, interlaced {interlaced} are not read")
    step = _CHANNELS[colour]
    row = (width * step * bits + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != height * (row + 1):
        raise ValueError("a PNG image of another size than its header's")
    lines = _unfiltered(raw.reshape(height, row + 1), step)
    if bits == 1:
        return np.unpackbits(lines, axis=1)[:, :width] * np.uint8(255)
    pixels = lines.reshape(height, width, step)
    if colour == 3:
        if palette is None:
            raise ValueError("a PNG image lacks its palette")
        return palette[pixels[:, :, 0]]
    return pixels[:, :, :3] if step >= 3 else pixels[:, :, 0]


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    above = np.zeros(lines.shape[1] - 1, np.uint8)
    for y, line in enumerate(lines):
        kind, this = int(line[0]), line[1:]
        if kind == 0:
            above = this
        elif kind == 1:
            above = np.add.accumulate(this.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            above = this + above
        elif kind in (3, 4):
            above = np.array(_sequential(kind, this.tolist(), above.tolist(), step), np.uint8)
        else:
            raise ValueError("a PNG image with an unknown filter")
        out[y] = above
    return out


def _sequential(kind: int, line: list[int], above: list[int], step: int) -> list[int]:
    """The two filters in which a byte needs the one before it."""
    for i, value in enumerate(line):
        left, up = line[i - step] if i >= step else 0, above[i]
        if kind == 3:
            guess = (left + up) // 2
        else:
            corner = above[i - step] if i >= step else 0
            by_left, by_up, by_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if by_left <= by_up and by_left <= by_corner else up if by_up <= by_corner else corner
        line[i] = (value + guess) & 255
    return line


def as_rgb(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 3 else np.repeat(image[:, :, None], 3, axis=2)


def as_mask(image: np.ndarray) -> np.ndarray:
    """Whether a pixel's grey value, rounded, is over 0."""
    if image.ndim == 2:
        return image > 0
    # The weights of luma in 65,536ths.
    return (image.astype(np.int64) @ np.array([19595, 38470, 7471]) + 32768) >> 16 > 0
