"""Decoders for image and volume files from their bytes: PNG, NIfTI-1, DICOM. numpy and the standard library only.

All raise DecodeError, and nothing else, for data that they can't read.
"""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np


class DecodeError(ValueError):
    """The bytes aren't what they should be, or use a part of the format that isn't read here."""


def guarded(f):
    def run(data: bytes, *args, **kwargs):
        try:
            return f(data, *args, **kwargs)
        except DecodeError:
            raise
        except Exception as e:  # noqa: BLE001 - broken files fail in any way
            raise DecodeError(f"{f.__name__}: {type(e).__name__}: {e}") from e

    return run


# -- PNG -------------------------------------------------------------------------------------------------------------

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PNG = b"\x89PNG\r\n\x1a\n"


#: Bytes of the rows that are decoded along their diagonals at once, and the least number of rows.
_BLOCK_BYTES, _BLOCK_ROWS = 8_000_000, 64


def _unfilter(raw: bytes, height: int, row: int, step: int) -> np.ndarray:
    """The bytes of the rows, whose differences to the bytes left and above are stored."""
    lines = np.frombuffer(raw, np.uint8)[: height * (row + 1)].reshape(height, row + 1)
    kinds = lines[:, 0]
    if (kinds > 4).any():
        raise DecodeError(f"PNG filter {kinds.max()}")
    wide = -(-row // step)
    data = np.zeros((height, wide * step), np.uint8)
    data[:, :row] = lines[:, 1:]
    data = data.reshape(height, wide, step)
    above = np.zeros((wide, step), np.uint8)
    block = max(_BLOCK_ROWS, _BLOCK_BYTES // max(1, row))
    for y in range(0, height, block):
        part = kinds[y : y + block]
        if (part > 2).any():
            data[y : y + block] = _diagonals(part, data[y : y + block], above)
        else:
            for k, kind in enumerate(part, y):
                if kind == 1:
                    data[k] = np.cumsum(data[k], axis=0, dtype=np.uint64).astype(np.uint8)
                elif kind == 2:
                    data[k] += data[k - 1] if k else 0
        above = data[min(y + block, height) - 1]
    return data.reshape(height, -1)[:, :row]


def _diagonals(kinds: np.ndarray, data: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A block of rows of any filters. A byte depends on those left, above and left above, which all lie on earlier
    diagonals, so all rows advance together; cell (x, y) is kept at [x + y + 2, y + 1], the row above at y = -1."""
    h, w, step = data.shape
    yy, xx = np.indices((h, w))
    stored = np.zeros((h + w + 2, h, step), np.int16)
    stored[xx + yy + 2, yy] = data
    done = np.zeros((h + w + 2, h + 1, step), np.int16)
    done[np.arange(w) + 1, 0] = above
    one, two, three, four = (kinds[:, None] == k for k in (1, 2, 3, 4))
    for t in range(2, h + w + 1):
        lo, hi = max(0, t - 1 - w), min(h, t - 1)
        left, up, corner = done[t - 1, lo + 1 : hi + 1], done[t - 1, lo:hi], done[t - 2, lo:hi]
        over, beside = up - corner, left - corner
        da, db, dc = np.abs(over), np.abs(beside), np.abs(over + beside)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        guess = left * one[lo:hi] + up * two[lo:hi] + ((left + up) >> 1) * three[lo:hi] + paeth * four[lo:hi]
        done[t, lo + 1 : hi + 1] = (stored[t, lo:hi] + guess) & 255
    return done[xx + yy + 2, yy + 1].astype(np.uint8)


@guarded
def read_png(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, channels), bytes or 16-bit; palettes become colours, with alpha if they have any."""
    if data[:8] != _PNG:
        raise DecodeError("not a PNG file")
    at, body, palette, alpha = 8, bytearray(), None, b""
    width = height = depth = colour = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
            if interlaced:
                raise DecodeError("interlaced PNG")
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = part
        elif kind == b"IDAT":
            body += part
        elif kind == b"IEND":
            break
    n = _CHANNELS[colour]
    bits = n * depth
    plane = _unfilter(zlib.decompress(bytes(body)), height, (width * bits + 7) // 8, max(1, bits // 8))
    if depth == 16:
        image = plane.reshape(height, width, n, 2).astype(np.uint16)
        image = (image[..., 0] << 8) | image[..., 1]
    elif depth == 8:
        image = plane.reshape(height, width, n)
    else:
        unpacked = np.unpackbits(plane, axis=1)[:, : width * depth].reshape(height, width, depth)
        image = (unpacked @ (1 << np.arange(depth - 1, -1, -1)))[..., None].astype(np.uint8)
        if colour == 0:
            image = (image.astype(np.uint16) * 255 // (2**depth - 1)).astype(np.uint8)
    if colour == 3:
        if palette is None:
            raise DecodeError("PNG without its palette")
        index = image[..., 0]
        image = palette[index]
        if alpha:
            table = np.full(256, 255, np.uint8)
            table[: len(alpha)] = np.frombuffer(alpha, np.uint8)
            image = np.concatenate([image, table[index][..., None]], axis=2)
    return image[..., 0] if image.shape[2] == 1 else image


def write_png(image: np.ndarray) -> bytes:
    """(h, w), (h, w, 3) or (h, w, 4) bytes, or (h, w) 16-bit, as a PNG file."""
    colour = {1: 0, 3: 2, 4: 6}[image.shape[2] if image.ndim == 3 else 1]
    wide = image.dtype == np.uint16
    rows = np.ascontiguousarray(image.astype(">u2") if wide else image.astype(np.uint8)).view(np.uint8).reshape(image.shape[0], -1)
    body = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()

    def chunk(kind: bytes, part: bytes) -> bytes:
        return struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))

    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 16 if wide else 8, colour, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


# -- NIfTI -----------------------------------------------------------------------------------------------------------

_NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def _affine(head: bytes, order: str) -> np.ndarray:
    pixdim = struct.unpack(f"{order}8f", head[76:108])
    qform, sform = struct.unpack(f"{order}2h", head[252:256])
    if sform > 0:
        return np.array(struct.unpack(f"{order}12f", head[280:328])).reshape(3, 4)[:, :3]
    if qform > 0:
        b, c, d = struct.unpack(f"{order}3f", head[256:268])
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        return turn * np.array([pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1)])
    return np.diag([pixdim[1] or 1, pixdim[2] or 1, pixdim[3] or 1])


def canonical(volume: np.ndarray, affine: np.ndarray) -> np.ndarray:
    """volume with its axes turned and flipped to the closest right, anterior, superior."""
    size = np.linalg.norm(affine, axis=0)
    parts = np.abs(affine / np.where(size == 0, 1, size))
    target: dict[int, int] = {}
    for _ in range(3):  # the clearest pair of axes first
        world, axis = np.unravel_index(int(parts.argmax()), parts.shape)
        target[int(world)] = int(axis)
        parts[world, :] = parts[:, axis] = -1
    axes = [target[w] for w in range(3)]
    turned = np.transpose(volume, axes + list(range(3, volume.ndim)))
    flips = tuple(slice(None, None, -1) if affine[w, axes[w]] < 0 else slice(None) for w in range(3))
    return turned[flips]


@guarded
def read_nifti(data: bytes) -> np.ndarray:
    """(x, y, depth) float32 in canonical order; of a fourth axis the first entry."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(f"{order}i", data[:4])[0] != 348:
        raise DecodeError("not a NIfTI-1 file")
    dim = struct.unpack(f"{order}8h", data[40:56])
    kind = struct.unpack(f"{order}h", data[70:72])[0]
    offset, slope, inter = struct.unpack(f"{order}3f", data[108:120])
    if kind not in _NIFTI_TYPES:
        raise DecodeError(f"NIfTI data type {kind}")
    shape = [max(0, n) for n in dim[1 : 1 + dim[0]]]
    while len(shape) > 3 and shape[-1] == 1:
        shape.pop()
    if len(shape) not in (2, 3, 4):
        raise DecodeError(f"NIfTI with {len(shape)} axes")
    count = int(np.prod(shape))
    values = np.frombuffer(data, np.dtype(_NIFTI_TYPES[kind]).newbyteorder(order), count, int(offset))
    volume = values.reshape(shape, order="F").astype(np.float32)
    if slope not in (0.0, 1.0) or inter:
        volume = volume * (slope or 1.0) + inter
    if volume.ndim == 4:
        if volume.shape[3] == 0:
            raise DecodeError("NIfTI with an empty fourth axis")
        volume = volume[..., 0]
    if volume.ndim == 2:
        volume = volume[:, :, None]
    if volume.shape[2] == 0:
        raise DecodeError("NIfTI without slices")
    return canonical(volume, _affine(data[:348], order))


def write_nifti(volume: np.ndarray, affine: np.ndarray | None = None) -> bytes:
    """A plain NIfTI-1 file, for tests."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, volume.ndim, *volume.shape, *[1] * (7 - volume.ndim))
    kind = {v: k for k, v in _NIFTI_TYPES.items()}[volume.dtype.str[1:]]
    struct.pack_into("<2h", head, 70, kind, volume.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, *[1] * 7)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    if affine is not None:
        struct.pack_into("<2h", head, 252, 0, 1)
        struct.pack_into("<12f", head, 280, *np.concatenate([affine, np.zeros((3, 1))], axis=1).ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + volume.tobytes(order="F")


# -- DICOM -----------------------------------------------------------------------------------------------------------

_LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT", b"SV", b"UV"}
_PIXELS = (0x7FE0, 0x0010)
_RAW_SYNTAXES = {"1.2.840.10008.1.2", "1.2.840.10008.1.2.1"}
UNKNOWN = 0xFFFFFFFF


def is_dicom(data: bytes) -> bool:
    return data[128:132] == b"DICM"


def _elements(data: bytes) -> dict[tuple[int, int], bytes]:
    """Top-level elements of a little-endian data set; items of sequences are skipped."""
    at = 132 if is_dicom(data) else 0
    out: dict[tuple[int, int], bytes] = {}
    depth = 0
    explicit: bool | None = True if at else None
    while at + 8 <= len(data):
        tag = struct.unpack_from("<HH", data, at)
        if tag[0] == 0xFFFE:  # items of a sequence of unknown length
            size = struct.unpack_from("<I", data, at + 4)[0]
            at += 8
            if tag[1] == 0xE0DD:
                depth = max(0, depth - 1)
            elif tag[1] == 0xE000 and size != UNKNOWN:
                at += size
            continue
        if explicit is None or (tag[0] != 2 and (0x0002, 0x0010) in out):
            syntax = out.get((0x0002, 0x0010), b"").rstrip(b"\0 ").decode("ascii", "replace")
            if syntax and syntax not in _RAW_SYNTAXES:
                raise DecodeError(f"DICOM transfer syntax {syntax}")
            explicit = syntax.endswith(".1") if syntax else data[at + 4 : at + 6].isalpha() and data[at + 4 : at + 6].isupper()
        if explicit:
            kind = data[at + 4 : at + 6]
            if kind in _LONG:
                size, at = struct.unpack_from("<I", data, at + 8)[0], at + 12
            else:
                size, at = struct.unpack_from("<H", data, at + 6)[0], at + 8
        else:
            size, at = struct.unpack_from("<I", data, at + 4)[0], at + 8
        if size == UNKNOWN:
            if tag == _PIXELS:
                raise DecodeError("compressed DICOM pixels")
            depth += 1
            continue
        if depth == 0:
            out[tag] = data[at : at + size]
        if tag == _PIXELS:
            break
        at += size
    return out


@guarded
def read_dicom(data: bytes) -> dict:
    """pixels ((rows, columns), frames first if several, channels last if coloured), slope, intercept, inverse,
    coloured, number and z (None where absent)."""
    e = _elements(data)

    def text(tag: tuple[int, int], default: str = "") -> str:
        return e.get(tag, default.encode()).decode("ascii", "replace").strip(" \0")

    def short(group: int, element: int, default: int) -> int:
        return struct.unpack("<H", e[group, element][:2])[0] if (group, element) in e else default

    def number(tag: tuple[int, int], place: int = 0) -> float | None:
        try:
            return float(text(tag).split("\\")[place])
        except (ValueError, IndexError):
            return None

    if _PIXELS not in e:
        raise DecodeError("DICOM without pixels")
    rows, columns, bits = short(0x28, 0x10, 0), short(0x28, 0x11, 0), short(0x28, 0x100, 16)
    samples, planar, frames = short(0x28, 2, 1), short(0x28, 6, 0), int(number((0x28, 8)) or 1)
    kind = np.dtype({8: "u1", 16: "u2", 32: "u4"}[bits]) if not short(0x28, 0x103, 0) else np.dtype({8: "i1", 16: "i2", 32: "i4"}[bits])
    values = np.frombuffer(e[_PIXELS], kind.newbyteorder("<"), rows * columns * samples * frames)
    if samples > 1:
        shape = (frames, samples, rows, columns) if planar else (frames, rows, columns, samples)
        image = np.moveaxis(values.reshape(shape), 1, -1) if planar else values.reshape(shape)
    else:
        image = values.reshape(frames, rows, columns)
    photometric = text((0x28, 4))
    return {
        "pixels": image[0] if frames == 1 else image, "slope": number((0x28, 0x1053)), "intercept": number((0x28, 0x1052)), "inverse": photometric == "MONOCHROME1",
        "coloured": samples >= 3 or photometric.startswith(("RGB", "YBR")), "number": number((0x20, 0x13)), "z": number((0x20, 0x32), 2),
    }


def write_dicom(pixels: np.ndarray, photometric: str = "MONOCHROME2", **tags) -> bytes:
    """An explicit little-endian DICOM file, for tests. tags: number, z, slope, intercept."""

    def element(group: int, item: int, kind: bytes, value: bytes) -> bytes:
        value += (b"\0" if kind in (b"UI", b"OW") else b" ") * (len(value) % 2)
        size = b"\0\0" + struct.pack("<I", len(value)) if kind in _LONG else struct.pack("<H", len(value))
        return struct.pack("<HH", group, item) + kind + size + value

    coloured = pixels.ndim >= 3 and pixels.shape[-1] == 3
    frames = pixels.shape[0] if pixels.ndim == (4 if coloured else 3) else 1
    rows, columns = (pixels.shape[-3:-1] if coloured else pixels.shape[-2:])
    short = lambda g, i, v: element(g, i, b"US", struct.pack("<H", v))
    parts = [element(2, 0x10, b"UI", b"1.2.840.10008.1.2.1")]
    if tags.get("number") is not None:
        parts.append(element(0x20, 0x13, b"IS", str(tags["number"]).encode()))
    if tags.get("z") is not None:
        parts.append(element(0x20, 0x32, b"DS", f"0\\0\\{tags['z']}".encode()))
    parts += [short(0x28, 2, 3 if coloured else 1), element(0x28, 4, b"CS", photometric.encode()), element(0x28, 8, b"IS", str(frames).encode()), short(0x28, 0x10, rows), short(0x28, 0x11, columns), short(0x28, 0x100, pixels.dtype.itemsize * 8), short(0x28, 0x103, int(pixels.dtype.kind == "i"))]
    for name, item in (("intercept", 0x1052), ("slope", 0x1053)):
        if tags.get(name) is not None:
            parts.append(element(0x28, item, b"DS", str(tags[name]).encode()))
    parts.append(element(0x7FE0, 0x10, b"OW", pixels.astype(pixels.dtype.newbyteorder("<")).tobytes()))
    return b"\0" * 128 + b"DICM" + b"".join(parts)
