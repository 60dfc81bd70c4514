"""Media columns: Netpbm and BMP images as binary columns, decoded to numpy arrays.

``store_texts`` stores any text losslessly, as a grey Netpbm image or as a colour BMP, by the
checksum of its bytes;
``decode`` turns stored images back into samples, an NPY tile (the image resized
by area with integral images) and a difference hash.

Defined results: a null image gives null results.  Bytes that are no image of the known
formats, or whose samples lie outside their range, give null results and say why in ``problem``.  A
null text is stored like an empty one.  A very long text is one image, a few times its size in the task that has it.  Repeated rows give repeated results; an empty table gives an empty result; extra
columns pass through ``decode`` unless they have the name of a result, which then wins.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm import common

#: Fixed value: payloads are padded to a multiple of this many bytes.
BLOCK = 576
WIDTH = 24
TILE = (8, 9)


class MediaError(ValueError):
    """The bytes are no image that can be decoded."""


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The numbers of a header, and where the samples start; comments are skipped."""
    numbers, at = [], 2
    while len(numbers) < fields:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at)
            if at < 0:
                raise MediaError("header ends in a comment")
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise MediaError("header lacks a number")
        numbers.append(int(data[at:end]))
        at = end
    return numbers, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """PBM, PGM and PPM, plain and raw, as height x width x channels of 8 bits."""
    kind = data[1] - 48
    (width, height, *rest), at = _netpbm_header(data, 2 if kind in (1, 4) else 3)
    top = rest[0] if rest else 1
    if not 0 < top < 65536:
        raise MediaError("largest sample out of range")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind == 1:
        digits = b"".join(line.split(b"#")[0] for line in data[at - 1 :].splitlines())
        samples = np.frombuffer(digits.translate(None, b" \t\n\r\x0b\x0c"), np.uint8).astype(np.int64) - 48
    elif kind in (2, 3):
        samples = np.array(b" ".join(line.split(b"#")[0] for line in data[at - 1 :].splitlines()).split(), np.int64)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, offset=at)
        stride = (width + 7) // 8
        if len(rows) < stride * height:
            raise MediaError("samples are missing")
        samples = np.unpackbits(rows[: stride * height].reshape(height, stride), axis=1)[:, :width].ravel()
    else:
        samples = np.frombuffer(data[at:][: n * (2 if top > 255 else 1)], np.uint8 if top < 256 else ">u2")
    if len(samples) < n:
        raise MediaError("samples are missing")
    samples = samples[:n].reshape(height, width, channels)
    if n and (samples.min() < 0 or samples.max() > top):
        raise MediaError("a sample is out of range")
    if kind in (1, 4):
        return ((1 - samples) * 255).astype(np.uint8)
    return samples.astype(np.uint8) if top == 255 else (samples.astype(np.int64) * 255 // top).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as height x width x 3 of 8 bits."""
    if len(data) < 54:
        raise MediaError("header is missing")
    start, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise MediaError("kind of BMP isn't known")
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    raw = np.frombuffer(data, np.uint8, offset=min(start, len(data)))
    if len(raw) < stride * rows:
        raise MediaError("samples are missing")
    raw = raw[: stride * rows].reshape(rows, stride)
    if bits >= 24:
        pixels = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        if bits < 8:
            unpacked = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
            raw = (unpacked * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8)
        palette = np.frombuffer(data, np.uint8, offset=14 + head)[: (1 << bits) * 4]
        palette = palette[: len(palette) // 4 * 4].reshape(-1, 4)[:, 2::-1]
        index = raw[:, :width]
        if not len(palette) or index.max() >= len(palette):
            raise MediaError("palette is too short")
        pixels = palette[index]
    return np.ascontiguousarray(pixels[::-1] if height > 0 else pixels)


def decode_image(data: bytes) -> np.ndarray:
    """An image as height x width x channels, by its first bytes."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise MediaError("neither Netpbm nor BMP")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A raw grey image of height x width samples of 8 bits."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A 24-bit BMP of height x width x 3 samples."""
    height, width, _ = samples.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each pixel of the result covers, as floats.

    The integral image holds the sum of all samples above and left of every corner; at
    fractional corners it is linear in between, so any area's sum takes four looks.
    """
    table = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    table[1:, 1:] = grey.astype(np.float64).cumsum(axis=0).cumsum(axis=1)
    sums = _at_edges(_at_edges(table, height, 0), width, 1)
    area = (grey.shape[0] / height) * (grey.shape[1] / width)
    return (sums[1:, 1:] - sums[1:, :-1] - sums[:-1, 1:] + sums[:-1, :-1]) / area


def _at_edges(table: np.ndarray, parts: int, axis: int) -> np.ndarray:
    size = table.shape[axis] - 1
    edges = np.arange(parts + 1) * size / parts
    low = np.minimum(np.floor(edges).astype(int), size - 1)
    part = (edges - low).reshape((-1, 1) if axis == 0 else (1, -1))
    return np.take(table, low, axis) * (1 - part) + np.take(table, low + 1, axis) * part


def difference_hash(tile: np.ndarray) -> str:
    """Whether each pixel is darker than its right neighbour, as hexadecimal digits."""
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, tile, version=(1, 0), allow_pickle=False)
    return out.getvalue()


RESULTS = "height int, width int, channels int, samples binary, tile_npy binary, dhash string, problem string"
_NAMES = ["height", "width", "channels", "samples", "tile_npy", "dhash", "problem"]


def _decoded(data: bytes | None) -> tuple:
    if data is None:
        return (None,) * 7
    try:
        image = decode_image(data)
        if not image.size:
            raise MediaError("the image has no samples")
    except (ValueError, OverflowError, struct.error) as error:
        return (None,) * 6 + (str(error),)
    grey = image[:, :, 0] if image.shape[2] == 1 else image.astype(np.int64) @ np.array([299, 587, 114]) // 1000
    tile = np.floor(area_resize(grey, *TILE) + 0.5).clip(0, 255).astype(np.uint8)
    return *image.shape, image.tobytes(), npy(tile), difference_hash(tile), None


def _decode(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]
        for whole in batches:
            for batch in common.slices(whole, "media"):
                rows = [_decoded(v.as_buffer().to_pybytes() if v.is_valid else None) for v in batch.column("media")]
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *made], names=[*names, *_NAMES])

    return run


def decode(images: DataFrame) -> DataFrame:
    """Decode the binary column ``media``: its other columns but ``media``, and height, width,
    channels, samples (row by row), tile_npy (8 x 9), dhash and problem."""
    common.ship_package(images.sparkSession)
    kept = [f for f in images.schema.fields if f.name not in {*_NAMES, "media"}]
    schema = T.StructType([*kept, *T.StructType.fromDDL(RESULTS).fields])
    names = [f.name for f in kept]
    return images.select(*[F.col(f"`{n}`") for n in names], F.col("media").cast("binary").alias("media")).mapInArrow(_decode(names), schema)


def payload_image(text: bytes) -> bytes:
    """The text's UTF-8 bytes, padded with 255, as an image 24 samples wide: a raw grey one where
    their checksum is even, else a BMP of 24 bits."""
    payload = np.frombuffer(text + b"\xff" * (-len(text) % BLOCK if text else BLOCK), np.uint8)
    if zlib.crc32(text) % 2:
        return encode_bmp(payload.reshape(-1, WIDTH, 3))
    return encode_pgm(payload.reshape(-1, WIDTH))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole, "text"):
            texts = common.utf8_column(batch.column("text"))
            made = [pa.array([len(t) for t in texts], pa.int64()), pa.array([payload_image(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_bytes", "media"])


def store_texts(documents: DataFrame) -> DataFrame:
    """Write one image for each document as a table in the shared folder, and read it:
    doc_id, n_bytes, media."""
    common.ship_package(documents.sparkSession)
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.materialize(slim.mapInArrow(_stored, "doc_id long, n_bytes long, media binary"), "media")
