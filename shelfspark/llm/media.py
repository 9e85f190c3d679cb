"""Media columns: Netpbm and BMP images as numpy arrays, tiles and difference hashes.

Images are decoded to uint8 arrays (height, width, channels), resized by area
averaging over integral images, and written as NPY bytes in a binary column with
a 64-bit difference hash.  Spark partitions the work; the decoders see one image.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, map_batches

#: Width in samples of the images that carry text payloads.
PAYLOAD_WIDTH = 64
#: Side of the square NPY tiles.
TILE = 32


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary greymap (P5) of a (height, width) uint8 array."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit greyscale BMP, rows from bottom to top and padded to 4 bytes."""
    height, width = samples.shape
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + info + palette.tobytes() + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    need, values, at = (2 if kind in (1, 4) else 3), [], 2
    token = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])+([0-9]{1,18})")
    while len(values) < need:
        found = token.match(data, at)
        if not found:
            raise ValueError("broken Netpbm header")
        values.append(int(found[1]))
        at = found.end()
    width, height, most = (values + [1])[:3]
    channels = 3 if kind in (3, 6) else 1
    count = width * height * channels
    if not (0 < most < 65536 and 0 < count <= 8 * len(data)):  # P4 packs 8 samples in a byte
        raise ValueError("broken Netpbm header")
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-width // 8) * height, at + 1).reshape(height, -1), axis=1)
        return (255 * (1 - bits[:, :width]))[:, :, None].astype(np.uint8)
    if kind == 1:
        bits = np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:])[:count], np.uint8) - 48
        if bits.max(initial=0) > 1:
            raise ValueError("broken Netpbm samples")
        return (255 * (1 - bits)).reshape(height, width, 1).astype(np.uint8)
    if kind in (2, 3):
        raw = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:count], np.int64)
    else:
        raw = np.frombuffer(data, ">u2" if most > 255 else "u1", count, at + 1)
    if len(raw) < count or raw.min() < 0 or raw.max() > most:
        raise ValueError("broken Netpbm samples")
    out = raw if most == 255 else (raw.astype(np.int64) * 255 + most // 2) // most
    return out.reshape(height, width, channels).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, size, width, height, _, depth, packing = struct.unpack("<10xIIiiHHI", data[:34])
    if packing or depth not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP with {depth} bits and compression {packing} is not supported")
    if width <= 0 or not height:
        raise ValueError("BMP without samples")
    stride, lines = -(-width * depth // 32) * 4, abs(height)
    rows = np.frombuffer(data, np.uint8, stride * lines, start).reshape(lines, stride)
    rows = rows[::-1] if height > 0 else rows
    if depth >= 24:
        return np.ascontiguousarray(rows[:, : width * depth // 8].reshape(lines, width, depth // 8)[:, :, 2::-1])
    colours = struct.unpack("<I", data[46:50])[0] or 1 << depth
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(lines, -1, depth)
        rows = bits @ (1 << np.arange(depth)[::-1])
    out = palette[rows[:, :width]]
    return out[:, :, :1] if (palette == palette[:, :1]).all() else out


def decode(data: bytes) -> np.ndarray:
    """A Netpbm (P1 to P6) or uncompressed BMP image as (height, width, 1 or 3) uint8."""
    if data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


#: Samples of an image that are summed at once.
STRIP = 1 << 18


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area-averaged resize of a (height, width) array by its integral image, as float64.

    Box edges may lie between samples; the integral image is interpolated there, which is exact for area means.  The
    integral image is built strip by strip, and only the rows at box edges are kept, so the memory beyond the image
    itself does not grow with it.
    """
    rows, cols = image.shape
    y, x = np.linspace(0, rows, height + 1), np.linspace(0, cols, width + 1)
    y0, x0 = np.minimum(y.astype(int), rows - 1), np.minimum(x.astype(int), cols - 1)
    fy, fx = (y - y0)[:, None], x - x0
    wanted = np.unique(np.concatenate((y0, y0 + 1)))
    kept, above, step = np.zeros((len(wanted), cols + 1)), np.zeros(cols), max(1, STRIP // cols)
    for at in range(0, rows, step):
        sums = np.cumsum(image[at : at + step], axis=0, dtype=np.float64) + above
        inside = np.nonzero((wanted > at) & (wanted <= at + len(sums)))[0]
        kept[inside, 1:] = np.cumsum(sums[wanted[inside] - at - 1], axis=1)
        above = sums[-1]
    strips = kept[np.searchsorted(wanted, y0)] * (1 - fy) + kept[np.searchsorted(wanted, y0 + 1)] * fy
    corners = strips[:, x0] * (1 - fx) + strips[:, x0 + 1] * fx
    return np.diff(np.diff(corners, axis=0), axis=1) / (rows / height * cols / width)


def difference_hash(grey: np.ndarray) -> str:
    """64 bits, as hex: whether each of 8 x 9 area means exceeds its right neighbour."""
    means = area_resize(grey, 8, 9)
    return np.packbits(np.round(means[:, :-1], 6) > np.round(means[:, 1:], 6)).tobytes().hex()


def npy_tile(grey: np.ndarray, side: int = TILE) -> bytes:
    """An area-resized square tile in NPY format."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(grey, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a decoded image."""
    return image[:, :, 0] if image.shape[2] == 1 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def text_payload(text: bytes | None) -> bytes:
    """A text's bytes with zeros up to a positive multiple of PAYLOAD_WIDTH."""
    data = text or b""
    return data + bytes(-len(data) % PAYLOAD_WIDTH if data else PAYLOAD_WIDTH)


def images_of_texts(df: DataFrame, text_col: str = "text", kind: str = "pgm") -> DataFrame:
    """Add ``media``: each text's payload as an 8-bit grey image, PAYLOAD_WIDTH samples wide.

    ``kind`` is ``pgm`` or ``bmp``; both keep every byte of texts of any length.  A null text is an empty one, equal
    texts give equal images, an empty table stays empty.  An input column ``media`` is replaced, others stay.
    """
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[kind]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = as_bytes(batch, text_col)
            arrays = (np.frombuffer(text_payload(t), np.uint8).reshape(-1, PAYLOAD_WIDTH) for t in texts)
            yield batch, [pa.array([encode(a) for a in arrays], pa.binary())]

    return map_batches(df, run, [T.StructField("media", T.BinaryType())])


FEATURES = [
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("tile_npy", T.BinaryType()),
]


def media_features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Decode stored images; add size, checksums, difference hash (``feature``) and NPY tile.

    ``payload_*`` describe the decoded samples, ``tail_crc32`` the last PAYLOAD_WIDTH of them.  Null or
    undecodable media, those without samples and those with fewer than their header says give nulls; equal media give equal values.  Images are whole whatever their size, an empty
    table stays empty.  Added columns replace input columns of their names, others stay.
    """

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(FEATURES)
        try:
            image = decode(data)
        except (ValueError, IndexError, OverflowError, struct.error):
            return (None,) * 5 + (len(data), hashlib.sha256(data).hexdigest(), None, None)
        image = np.ascontiguousarray(image)
        payload, luma = memoryview(image).cast("B") if image.size else b"", grey(image)
        return (
            image.shape[0], image.shape[1], len(payload), hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-PAYLOAD_WIDTH:]), len(data), hashlib.sha256(data).hexdigest(),
            difference_hash(luma), npy_tile(luma),
        )

    kinds = ["int32", "int32", "int64", "string", "int64", "int64", "string", "string", "binary"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(media_col))
            found = [one(x.as_py()) for x in column]
            yield batch, [pa.array([f[i] for f in found], getattr(pa, k)()) for i, k in enumerate(kinds)]

    return map_batches(df, run, FEATURES)
