"""Fingerprints of images: size, difference hash, alpha. PNG is decoded here, JPEG, GIF and BMP by the JVM's reader."""

from __future__ import annotations

import struct
import zlib

import numpy as np

RASTER = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif")


#: Adam7: first column, first row, column step, row step of each pass.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfilter(raw: np.ndarray, h: int, stride: int, step: int) -> np.ndarray:
    """The bytes of ``h`` rows, each led by its filter's number."""
    rows, out, prev = raw.reshape(h, stride + 1), np.zeros((h, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 2:
            line += prev
        elif kind == 1:
            line = line.reshape(-1, step) if stride % step == 0 else line
            line = np.cumsum(line, 0, dtype=np.uint8).ravel()
        elif kind in (3, 4):
            v, p = line.astype(int).tolist(), prev.tolist()
            for i in range(stride):
                a, b, c = v[i - step] if i >= step else 0, p[i], p[i - step] if i >= step else 0
                if kind == 3:
                    v[i] = (v[i] + (a + b) // 2) & 255
                else:
                    e = a + b - c
                    pa, pb, pc = abs(e - a), abs(e - b), abs(e - c)
                    v[i] = (v[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            line = np.array(v, np.uint8)
        out[y] = prev = line
    return out


def _samples(raw: np.ndarray, at: int, w: int, h: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    """One image or pass of it, 8 bits a sample (palette places as they are), and where it ends in ``raw``."""
    stride, step = (w * channels * depth + 7) // 8, max(1, channels * depth // 8)
    end = at + h * (stride + 1)
    out = _unfilter(raw[at:end], h, stride, step)
    if depth == 16:
        out = out.reshape(h, -1, 2)[:, :, 0]
    elif depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(h, -1, depth)
        out = bits.dot(1 << np.arange(depth)[::-1]).astype(np.uint8)[:, : w * channels]
    return out.reshape(h, w, channels), end


def decode_png(data: bytes) -> np.ndarray | None:
    """Height x width x channels, 8 bits each, interlaced or not; null for what isn't a whole PNG."""
    try:
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, idat, head, palette, trans = 8, [], None, None, None
        while at + 8 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + n]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"tRNS":
                trans = body
            elif kind == b"IDAT":
                idat.append(body)
            elif kind == b"IEND":
                break
            at += 12 + n
        w, h, depth, color, _, _, lace = head
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
        if depth != 8 and not (depth == 16 or color in (0, 3)):
            return None
        raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8)
        if lace:
            img, at = np.zeros((h, w, channels), np.uint8), 0
            for x, y, dx, dy in _PASSES:
                pw, ph = -(-(w - x) // dx), -(-(h - y) // dy)
                if pw > 0 and ph > 0:
                    img[y::dy, x::dx], at = _samples(raw, at, pw, ph, channels, depth)
        else:
            img, _ = _samples(raw, 0, w, h, channels, depth)
        if depth < 8 and color == 0:
            img = (img.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        if color == 3:
            rgb = palette[img[:, :, 0]]
            if trans is None:
                return rgb
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(trans)] = np.frombuffer(trans, np.uint8)
            return np.concatenate([rgb, alpha[img]], 2)
        return img
    except (KeyError, TypeError, ValueError, zlib.error, struct.error, IndexError):
        return None


def difference_hash(img: np.ndarray) -> int:
    """64 bits of left-exceeds-right over a 9 x 8 average of the brightness, least significant first, as a signed long."""
    f = img.astype(np.float64)
    grey = f[:, :, 0] if img.shape[2] < 3 else f[:, :, :3] @ np.array([0.299, 0.587, 0.114])

    def shrink(a: np.ndarray, n: int) -> np.ndarray:
        edges = np.arange(n + 1) * a.shape[0] / n
        total = np.concatenate([np.zeros((1, a.shape[1])), np.cumsum(a, 0)])
        lo = np.minimum(np.floor(edges).astype(int), a.shape[0])
        at = total[lo] + (edges - lo)[:, None] * np.concatenate([a, np.zeros((1, a.shape[1]))])[lo]
        return np.diff(at, axis=0) * n / a.shape[0]

    small = np.round(shrink(shrink(grey, 8).T, 9).T, 6)
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    value = int(sum(1 << i for i in range(64) if bits[i]))
    return value - (1 << 64) if value >> 63 else value


def fingerprint(img: np.ndarray | None) -> dict | None:
    if img is None:
        return None
    alpha = img.shape[2] >= 4
    return {"width": img.shape[1], "height": img.shape[0], "d_hash": difference_hash(img), "has_alpha": alpha, "uses_transparency": bool(alpha and (img[:, :, 3] < 255).any())}
