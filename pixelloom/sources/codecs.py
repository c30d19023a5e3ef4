"""Bytes of PNG images, little-endian tensors, cache records and graph files; no codec package is needed."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np

# Fixed values of the formats.
PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
COLOUR_TYPE = {1: 0, 2: 4, 3: 2, 4: 6}
RECORD, DIGEST = b"M15RAW\0", 64
PROFILES = (("sRGB", "sRGB"), ("iCCP", "ICC"), ("gAMA", "gamma-tagged (sRGB-compatible input convention)"))
UNPROFILED = "unprofiled (PNG sRGB default)"
#: Values of a record at most.
MOST_VALUES = 16_777_216


def codes(v: np.ndarray) -> np.ndarray:
    """0..1 as 0..255, halves up; what isn't finite is 0."""
    return np.floor(np.clip(np.where(np.isfinite(v), v, 0), 0, 1) * 255 + 0.5).astype(np.uint8)


# ---- PNG


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(image: np.ndarray) -> bytes:
    """An 8-bit image (h, w) or (h, w, channels): grey, grey with alpha, RGB or RGBA, colours as they are."""
    h, w = image.shape[:2]
    flat = np.ascontiguousarray(image, dtype=np.uint8).reshape(h, -1)
    rows = np.concatenate([np.zeros((h, 1), np.uint8), flat], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, COLOUR_TYPE[flat.shape[1] // w], 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_chunks(raw: bytes):
    """(kind, data) of the chunks up to the end mark."""
    if not raw.startswith(PNG):
        raise ValueError("invalid PNG signature")
    at = len(PNG)
    while at + 12 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        if at + 12 + n > len(raw):
            raise ValueError("truncated PNG chunk")
        yield kind, raw[at + 8 : at + 8 + n]
        if kind == b"IEND":
            return
        at += 12 + n


def png_metadata(raw: bytes) -> tuple[int | None, int | None, str]:
    """Bit depth, colour type, and the profile: sRGB before ICC before gamma."""
    depth = kind_of = None
    seen = set()
    for kind, data in png_chunks(raw):
        if kind == b"IHDR" and len(data) >= 13:
            depth, kind_of = data[8], data[9]
        seen.add(kind.decode("latin-1"))
    return depth, kind_of, next((name for k, name in PROFILES if k in seen), UNPROFILED)


def png_size(raw: bytes) -> tuple[int, int]:
    """Width and height from the header alone."""
    if not raw.startswith(PNG) or raw[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack_from(">II", raw, 16)


def _unfiltered(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """Rows with their filters undone: none, left, up, mean of both, or the nearest of left, up and corner."""
    data = np.frombuffer(raw, np.uint8, h * (stride + 1)).reshape(h, stride + 1)
    out, before = np.zeros((h, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = data[y, 0], data[y, 1:].astype(np.int64)
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step]) & 255
        elif kind == 2:
            line = (line + before) & 255
        elif kind in (3, 4):
            up = before.astype(np.int64)
            for x in range(stride):
                left = line[x - step] if x >= step else 0
                if kind == 3:
                    guess = (left + up[x]) >> 1
                else:
                    corner = up[x - step] if x >= step else 0
                    guess = min((left, up[x], corner), key=lambda v: abs(left + up[x] - corner - v))  # noqa: B023
                line[x] = (line[x] + guess) & 255
        elif kind:
            raise ValueError("unknown PNG filter")
        out[y] = before = line.astype(np.uint8)
    return out


def png_pixels(raw: bytes) -> np.ndarray:
    """(h, w, channels) as stored: 8 or 16 bits a sample; a palette is looked up. No interlacing, no smaller depths."""
    parts = list(png_chunks(raw))
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", dict(parts)[b"IHDR"][:13])
    if depth not in (8, 16) or interlaced or kind not in CHANNELS:
        raise ValueError("unsupported PNG form")
    n, size = CHANNELS[kind], depth // 8
    rows = _unfiltered(zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT")), h, w * n * size, n * size)
    image = rows.reshape(h, w, n) if size == 1 else rows.view(">u2").reshape(h, w, n)
    if kind == 3:
        palette = np.frombuffer(dict(parts)[b"PLTE"], np.uint8).reshape(-1, 3)
        image = palette[image[..., 0]]
    return image


def canonical(raw: bytes, most_pixels: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Colours (h, w, 3) and an alpha that is always there (h, w), both 0..1; too large an image fails before decoding."""
    w, h = png_size(raw)
    if most_pixels is not None and w * h > most_pixels:
        raise ValueError(f"{w} x {h} pixels are over the limit of {most_pixels}")
    image = png_pixels(raw)
    unit = image.astype(np.float32) / (255 if image.dtype == np.uint8 else 65535)
    rgb = unit[..., :3] if unit.shape[2] >= 3 else np.repeat(unit[..., :1], 3, axis=2)
    alpha = unit[..., -1] if unit.shape[2] in (2, 4) else np.ones(unit.shape[:2], np.float32)
    return rgb, alpha


def straight_rgba(rgb: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """8-bit RGBA; colours aren't multiplied by alpha."""
    return codes(np.concatenate([rgb, alpha[..., None]], axis=2))


# ---- tensors and cache records


def floats(raw: bytes, expected: int) -> np.ndarray:
    """Little-endian 32-bit floats of exactly that number."""
    if len(raw) != 4 * expected:
        raise ValueError(f"{len(raw)} bytes aren't {expected} values")
    return np.frombuffer(raw, "<f4")


def record(input_hash: str, manifest_hash: str, width: int, height: int, values: np.ndarray) -> bytes:
    """A cache record: magic, two strings with their lengths, sizes, values, and the digest of all before it."""
    if not np.isfinite(values).all():
        raise ValueError("a cached value isn't finite")
    text = b"".join(struct.pack("<H", len(b)) + b for b in (input_hash.encode(), manifest_hash.encode()))
    body = RECORD + text + struct.pack("<IIQ", width, height, len(values)) + values.astype("<f4").tobytes()
    return body + hashlib.sha256(body).hexdigest().encode()


def payload_range(raw: bytes) -> tuple[int, int]:
    """Where the values of a record start and end."""
    at = len(RECORD)
    for _ in range(2):
        at += 2 + struct.unpack_from("<H", raw, at)[0]
    n = struct.unpack_from("<Q", raw, at + 8)[0]
    if n > MOST_VALUES:
        raise ValueError("a cache record is unreasonably large")
    return at + 16, at + 16 + 4 * n


def read_record(raw: bytes) -> tuple[str, str, int, int, np.ndarray] | None:
    """None for what isn't a record at all; a damaged one is an error."""
    if len(raw) < len(RECORD) + 2 or not raw.startswith(RECORD):
        return None
    at, text = len(RECORD), []
    for _ in range(2):
        n = struct.unpack_from("<H", raw, at)[0]
        text.append(raw[at + 2 : at + 2 + n].decode())
        at += 2 + n
    width, height = struct.unpack_from("<II", raw, at)
    start, end = payload_range(raw)
    if len(raw) != end + DIGEST:
        raise ValueError("a cache record's length doesn't fit")
    if hashlib.sha256(raw[:end]).hexdigest() != raw[end:].decode():
        raise ValueError("a cache record's checksum doesn't fit")
    values = np.frombuffer(raw, "<f4", (end - start) // 4, start)
    if not np.isfinite(values).all():
        raise ValueError("a cached value isn't finite")
    return text[0], text[1], width, height, values


# ---- graph files


def varint(raw: bytes, at: int) -> tuple[int, int] | None:
    """(value, place after it); None past the end or 64 bits."""
    value = 0
    for shift in range(0, 64, 7):
        if at >= len(raw):
            return None
        b, at = raw[at], at + 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
    return None


def _fields(raw: bytes):
    """(number, wire type, value) of a message; a value that isn't whole is an error."""
    at = 0
    while at < len(raw):
        if (tag := varint(raw, at)) is None:
            raise ValueError("truncated field")
        (key, at), wire = tag, tag[0] & 7
        if wire in (0, 2):
            if (found := varint(raw, at)) is None:
                raise ValueError("truncated field")
            value, at = found
            if wire == 2:
                value, at = raw[at : at + value], at + value
        elif wire in (1, 5):
            value, at = None, at + (8 if wire == 1 else 4)
        else:
            raise ValueError("unknown wire type")
        if at > len(raw):
            raise ValueError("truncated field")
        yield key >> 3, wire, value


def declared_opset(raw: bytes) -> int | None:
    """The version that field 8 of a graph file imports for the default domain; the last one counts."""
    out = None
    try:
        for number, wire, value in _fields(raw):
            if wire not in (0, 2):
                return None
            if number == 8 and wire == 2:
                own = {(n, w): v for n, w, v in _fields(value)}
                if (2, 0) not in own:
                    return None
                if own.get((1, 2), b"") in (b"", b"ai.onnx"):
                    out = own[2, 0] & 0xFFFFFFFF
    except ValueError:
        return None
    return out
