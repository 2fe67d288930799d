"""Media columns: Netpbm and BMP images to numpy arrays, resized, written as NPY tiles with difference hashes.

Decoders take P1 to P6 Netpbm files and uncompressed BMP files of 1, 4, 8, 24 or 32 bits. Resizing is by area: an integral image
gives the sum over any rectangle from four corners, with linear interpolation between whole pixels, so every pixel counts by the
share of it that lies in the target's pixel. An image is stored as a row of tiles, each an NPY file, one behind the other, and is
put together again from those bytes. The difference hash compares neighbours in a 9 by 8 thumbnail.

`digest` carries any text losslessly: its bytes become an 8-bit grey image of ROW pixels a row, in a Netpbm file or, if its number
of rows is odd, in a BMP file. That is decoded, cut into NPY tiles and written to a table of tiles; what `digest` reports is read
back from that table.

Defined cases: a null text is an empty one, and an empty text is one row of zeros; a very long text is one image, held whole by one
task with its tiles, while resizing works on bands of its rows; equal texts give equal values; repeated rows give repeated rows; an
empty table gives an empty result; in `store` a null image, an undecodable one, or one with samples above its maximum or beyond its
palette gives nulls and its error, and other columns are ignored.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtable.llm.common import map_arrow, stage, work_dir
from streamtable.llm.tokens import slices

ROW = 64
#: Rows and columns of a tile.
TILE = (1024, 1024)
THUMB = (8, 9)
TAIL = 64
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """A P1 to P6 file as rows x columns (x 3) of uint8 or uint16. P1 and P4 give 0 for black and 255 for white."""
    kind, at, head = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm file")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("the header ends early")
        head.append(int(m[1]))
        at = m.end()
    width, height, most = head[0], head[1], head[2] if len(head) > 2 else 1
    if width <= 0 or height <= 0 or not 0 < most < 65536:
        raise ValueError("the header's numbers are out of range")
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    n = int(np.prod(shape))
    if kind == b"P1":
        bits = np.frombuffer(re.sub(rb"#[^\n]*\n|\s", b"", data[at:])[:n], np.uint8) - 48
        return _sized(bits == 0, shape).astype(np.uint8) * 255
    if kind in (b"P2", b"P3"):
        values = np.array(re.sub(rb"#[^\n]*\n", b" ", data[at:]).split()[:n], np.int64)
        if values.size and not 0 <= values.min() <= values.max() <= most:
            raise ValueError("a sample is above the maximum")
        return _sized(values, shape).astype(np.uint8 if most < 256 else np.uint16)
    at += 1
    if kind == b"P4":
        stride = -(-width // 8)
        rows = _sized(np.frombuffer(data, np.uint8, min(stride * height, len(data) - at), at), (height, stride))
        return (1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255)
    sample = np.dtype("u1" if most < 256 else ">u2")
    values = np.frombuffer(data, sample, min(n, (len(data) - at) // sample.itemsize), at)
    if most not in (255, 65535) and values.size and values.max() > most:
        raise ValueError("a sample is above the maximum")
    return _sized(values, shape).astype(sample.newbyteorder("="), copy=False)


def _sized(values: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    if values.size != np.prod(shape):
        raise ValueError("the samples end early")
    return values.reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP file as rows x columns x 3 of uint8, red first."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP file")
    start, size, width, height, _, bits, packed, _, _, _, used = struct.unpack_from("<IIiiHHIIiiI", data, 10)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or packed == 3 and bits != 32 or width <= 0 or not height:
        raise ValueError("a kind of BMP that isn't known")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if len(data) < start + rows * stride:
        raise ValueError("the samples end early")
    raw = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    raw = raw if height < 0 else raw[::-1]
    if bits >= 24:
        return np.ascontiguousarray(raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    colours = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + size).reshape(-1, 4)[:, 2::-1]
    if bits == 8:
        codes = raw[:, :width]
    else:
        codes = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)[:, :width] @ (1 << np.arange(bits - 1, -1, -1))
    if codes.max() >= len(colours):
        raise ValueError("a pixel lies beyond the palette")
    return colours[codes]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    """An 8-bit grey image as a P5 file."""
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit grey image as a BMP file with a palette of greys. Rows are a multiple of four pixels wide."""
    height, width = samples.shape
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4)
    palette[:, 3] = 0
    start = 54 + palette.size
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + samples.size, 0, 0, start, 40, width, height, 1, 8, 0, samples.size, 0, 0, 256, 0)
    return head + palette.tobytes() + samples[::-1].tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int, band: int = 4096) -> np.ndarray:
    """A grey image's means over a grid of height x width equal rectangles. The integral image is made for a band of rows at a time."""
    rows, columns = image.shape

    def places(n: int, of: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges between the n parts of `of` pixels: whole pixels before, and the share of the next one."""
        edges = np.arange(n + 1) * of / n
        whole = np.minimum(edges.astype(np.int64), of - 1)
        return whole, edges - whole

    down, down_part = places(height, rows)
    across, part = places(width, columns)
    corners, above = np.zeros((height + 1, width + 1)), np.zeros(width + 1)
    for top in range(0, rows, band):
        strip = image[top : top + band]
        sums = np.zeros((len(strip), columns + 1))
        np.cumsum(strip, axis=1, dtype=np.float64, out=sums[:, 1:])
        table = np.zeros((len(strip) + 1, width + 1))
        np.cumsum(sums[:, across] * (1 - part) + sums[:, across + 1] * part, axis=0, out=table[1:])
        table += above
        here = (down >= top) & (down < top + len(strip))
        k, share = down[here] - top, down_part[here, None]
        corners[here] = table[k] * (1 - share) + table[k + 1] * share
        above = table[-1]
    return np.diff(np.diff(corners, axis=0), axis=1) / (rows * columns / (height * width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether a pixel of the thumbnail is darker than the one to its right."""
    small = area_resize(grey(image), *THUMB)
    # Rounded, so that no last bit of a sum decides.
    return np.packbits(np.diff(np.round(small, 6), axis=1) > 0).tobytes().hex()


def to_tiles(image: np.ndarray, tile: tuple[int, int] = TILE) -> list[bytes]:
    """NPY files of the image's tiles, row by row."""
    out = []
    for y in range(0, image.shape[0], tile[0]):
        for x in range(0, image.shape[1], tile[1]):
            np.lib.format.write_array(f := io.BytesIO(), np.ascontiguousarray(image[y : y + tile[0], x : x + tile[1]]), version=(1, 0))
            out.append(f.getvalue())
    return out


def from_tiles(data: bytes, width: int) -> np.ndarray:
    """The image from its tiles' files, one behind the other, given its width."""
    view, at, rows, row, have = memoryview(data), 0, [], [], 0
    while at < len(data):
        if bytes(view[at : at + 6]) != b"\x93NUMPY":
            raise ValueError("not an NPY file")
        (size,) = struct.unpack_from("<H", data, at + 8)
        head = ast.literal_eval(bytes(view[at + 10 : at + 10 + size]).decode("latin-1"))
        n = int(np.prod(head["shape"]))
        kind = np.dtype(head["descr"])
        row.append(np.frombuffer(data, kind, n, at + 10 + size).reshape(head["shape"]))
        at += 10 + size + n * kind.itemsize
        have += head["shape"][1]
        if have == width:
            rows.append(np.concatenate(row, axis=1) if len(row) > 1 else row[0])
            row, have = [], 0
    if row or not rows:
        raise ValueError("tiles are missing")
    return np.concatenate(rows) if len(rows) > 1 else rows[0]


def store(images: DataFrame, id_col: str, data_col: str, size: tuple[int, int] | None = None) -> DataFrame:
    """For each row: id, height, width, tiles (an array of NPY files), hash and error. size: rows and columns to resize grey images to."""
    kind = dict(images.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one image at a time in memory
                one = batch.slice(k, 1)
                try:
                    image = decode(one.column("data")[0].as_py() or b"")
                    print_ = difference_hash(image)
                    image = area_resize(grey(image), *size) if size else image
                    row = [image.shape[0], image.shape[1], to_tiles(image), print_, None]
                except Exception as e:  # whatever a broken file leads to, it costs no other row
                    row = [None, None, None, None, f"{type(e).__name__}: {e}"]
                kinds = [pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([one.column("id"), *(pa.array([x], t) for x, t in zip(row, kinds))], names=["id", "height", "width", "tiles", "hash", "error"])

    rows = map_arrow(images.select(F.col(id_col).alias("id"), F.col(data_col).cast("binary").alias("data")), run, f"id {kind}, height int, width int, tiles array<binary>, hash string, error string")
    return rows.withColumnRenamed("id", id_col)


def written(docs: DataFrame, root: str) -> DataFrame:
    """The store of the texts' images: doc_id, n_bytes, source_bytes and tiles (an array of NPY files), as a table below root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_bytes, sizes, tiles = [], [], []
                for x in part.column("text"):
                    text = (x.as_py() or "").encode()
                    samples = np.frombuffer(text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b"\0"), np.uint8).reshape(-1, ROW)
                    source = encode_bmp(samples) if len(samples) % 2 else encode_pgm(samples)
                    image = decode(source)
                    n_bytes.append(len(text))
                    sizes.append(len(source))
                    tiles.append(to_tiles(image if image.ndim == 2 else image[:, :, 0]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tiles, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "source_bytes", "tiles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(map_arrow(rows, run, "doc_id bigint, n_bytes bigint, source_bytes bigint, tiles array<binary>"), f"{root}/tiles")


def digest(docs: DataFrame, root: str | None = None) -> DataFrame:
    """The contract's columns, read back from the stored tiles; their number and the source file's length besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tiles"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            rows = [_read(x.as_py()) for x in batch.column("tiles")]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_bytes", "source_bytes")), *columns], names=["doc_id", "n_bytes", "source_bytes", *names])

    kind = "doc_id bigint, n_bytes bigint, source_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_tiles bigint"
    return map_arrow(written(docs, root or work_dir(docs.sparkSession, "media")), run, kind)


def _read(tiles: list[bytes]) -> tuple:
    stored = b"".join(tiles)
    back = from_tiles(stored, ROW)
    data = back.tobytes()
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(back), len(tiles)
