"""Media columns: Netpbm and BMP images as numpy arrays, area-resized and hashed.

Images are decoded to arrays of height, width and channels; bit, grey and colour, plain and raw Netpbm (P1 to P6, 8 and
16 bits) and uncompressed BMP of 8, 24 and 32 bits are read. An area resize reads each target pixel's exact mean, fractions of
border pixels included, from an integral image. The integral image is never built whole: rows are summed in runs, and of its rows
only those at target borders stay, so memory follows the width and not the height. Tiles are NPY bytes; their difference hash
has a bit for each pair of neighbours in a row.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm._common import in_arrow, read, slices

#: Bytes in a row of a stored payload, rows summed at once, and height and width of a tile for difference hashes.
ROW_BYTES, RUN_ROWS, TILE = 64, 4_096, (8, 9)

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_pgm(pixels: np.ndarray) -> bytes:
    """Raw 8-bit grey Netpbm (P5) of a two-dimensional array."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, dtype=np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit BMP with a grey palette of a two-dimensional array, bottom row first, rows padded to four bytes."""
    h, w = pixels.shape
    rows = np.zeros((h, (w + 3) // 4 * 4), dtype=np.uint8)
    rows[:, :w] = pixels[::-1]
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    grey[:, 3] = 0
    at = 14 + 40 + 1024
    head = b"BM" + np.array([at + rows.size, 0, at, 40, w, h], "<u4").tobytes() + np.array([1, 8], "<u2").tobytes() + np.array([0, rows.size, 2835, 2835, 256, 0], "<u4").tobytes()
    return head + grey.tobytes() + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        found = _TOKEN.match(data, at)
        if not found:
            raise ValueError("its head is cut off")
        fields.append(int(found[1]))
        at = found.end()
    w, h, top = [*fields, 1][:3]
    depth = 3 if kind in (3, 6) else 1
    if w < 1 or h < 1 or not 0 < top < 65_536 or w * h > 8 * len(data):
        raise ValueError(f"its head says {w} by {h}, at most {top}, in {len(data)} bytes")
    if kind == 1:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.frombuffer(bytes(c for c in body if c in b"01"), np.uint8)[: w * h] == 48
        return values.reshape(h, w, 1).astype(np.uint8) * 255
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1), axis=1)[:, :w]
        return (1 - bits)[:, :, None] * np.uint8(255)
    if kind in (2, 3):
        values = np.array(list(map(int, re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h * depth])), dtype=np.int64)
    else:
        values = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * depth, at + 1)
    values = values.reshape(h, w, depth)
    if values.min() < 0 or values.max() > top:
        raise ValueError(f"samples are beyond {top}")
    return values.astype(np.uint8) if top == 255 else np.rint(values.astype(np.float64) * (255 / top)).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    at, size = int.from_bytes(data[10:14], "little"), int.from_bytes(data[14:18], "little")
    w, h = int.from_bytes(data[18:22], "little", signed=True), int.from_bytes(data[22:26], "little", signed=True)
    bits, packing = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if packing or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packing}, is not read")
    if w < 1 or h == 0:
        raise ValueError(f"its head says {w} by {h}")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, at).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits > 8:
        return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    colours = int.from_bytes(data[46:50], "little") or 256
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all() and colours == 256 and (palette[:, 0] == np.arange(256)).all():
        return rows[:, :, None]
    return palette[rows]


def decode(data: bytes) -> np.ndarray:
    """An image as an array of height, width and 1 or 3 channels, 8 bits each. Whatever is wrong with it is a ValueError."""
    read = _netpbm if len(data) > 2 and data[:1] == b"P" and 49 <= data[1] <= 54 else _bmp if data[:2] == b"BM" else None
    if read is None:
        raise ValueError("neither Netpbm nor BMP")
    try:
        return read(data)
    except (ArithmeticError, LookupError, TypeError) as e:
        raise ValueError(f"it can't be read: {e}") from e


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area means of a grid of ``height`` by ``width`` cells over a two-dimensional image."""
    h, w = pixels.shape
    if not h or not w:
        return np.zeros((height, width))
    ys, xs = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width
    rows, cols = np.minimum(ys.astype(np.int64), h - 1), np.minimum(xs.astype(np.int64), w - 1)
    # the integral image at whole rows just before and after each border; a border inside a row lies between them
    above, below, total, done = np.zeros((height + 1, w)), np.zeros((height + 1, w)), np.zeros(w), 0
    while done < h:
        run = pixels[done : done + RUN_ROWS].astype(np.int64).cumsum(axis=0)
        for k in np.flatnonzero((rows >= done) & (rows < done + len(run))):
            i = int(rows[k]) - done
            above[k] = total + (run[i - 1] if i else 0)
            below[k] = total + run[i]
        total = total + run[-1]
        done += len(run)
    at_rows = above + (below - above) * (ys - rows)[:, None]
    flat = np.concatenate([np.zeros((height + 1, 1)), at_rows.cumsum(axis=1)], axis=1)
    corners = flat[:, cols] + (flat[:, cols + 1] - flat[:, cols]) * (xs - cols)
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / ((h / height) * (w / width))


def npy_tile(pixels: np.ndarray, height: int = TILE[0], width: int = TILE[1]) -> bytes:
    """The area-resized grey image as NPY bytes of 8-bit samples."""
    grey = pixels if pixels.ndim == 2 else pixels[:, :, 0] if pixels.shape[2] == 1 else pixels @ np.array([0.299, 0.587, 0.114])
    tile = np.clip(np.rint(area_resize(grey, height, width) - 1e-9), 0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def difference_hash(tile: bytes) -> str:
    """Hex of a bit for each cell that is darker than its right neighbour, row by row."""
    cells = np.load(io.BytesIO(tile), allow_pickle=False)
    return np.packbits((cells[:, :-1] < cells[:, 1:]).ravel()).tobytes().hex()


def image_features(images: DataFrame, id_col: str, media_col: str, height: int = TILE[0], width: int = TILE[1]) -> DataFrame:
    """Decode images and add ``height``, ``width``, ``channels``, ``tile`` (NPY) and ``dhash``.

    What can't be decoded, null included, has nulls and a reason in ``error``. Rows are kept one for one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            rows = []
            for data in part.column(1).to_pylist():
                try:
                    pixels = decode(data or b"")
                    tile = npy_tile(pixels, height, width)
                    rows.append((*pixels.shape, tile, difference_hash(tile), None))
                except ValueError as e:
                    rows.append((None, None, None, None, None, str(e)[:200]))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], ["id", "height", "width", "channels", "tile", "dhash", "error"])

    slim = images.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    return in_arrow(slim, run, "id long, height int, width int, channels int, tile binary, dhash string, error string").withColumnRenamed("id", id_col)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str = "pgm", with_media: bool = False, with_tile: bool = False, also: str | None = None) -> DataFrame:
    """Store every whole text losslessly as a grey image of 64 columns and describe what is read back.

    The payload is the text in UTF-8 and zeros up to a positive multiple of 64. Returns ``id_col``, ``n_bytes``,
    ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (of the last 64 bytes read back), ``media_bytes``, ``media_sha256`` and
    ``feature`` (difference hash, a colon, and the tile's samples in hex); with ``with_tile`` also ``tile`` (NPY), with ``with_media`` also ``media``. ``form`` is
    ``pgm`` or ``bmp``. With ``also`` the payload is stored and read back in that form too: ``<also>_bytes``, ``<also>_sha256`` and ``<also>_intact`` (it gives the same pixels).
    Null texts count as empty; null ids and repeated rows are kept; other columns are not read.
    """
    forms = {"pgm": encode_pgm, "bmp": encode_bmp}
    encode, second = forms[form], forms[also] if also else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in part.column(1):
                data = text.as_buffer()
                n = len(data) if data is not None else 0
                payload = np.zeros(max(1, -(-n // ROW_BYTES)) * ROW_BYTES, np.uint8)
                payload[:n] = np.frombuffer(data, np.uint8) if n else 0
                media = encode(payload.reshape(-1, ROW_BYTES))
                pixels = decode(media)
                back = np.ascontiguousarray(pixels[:, :, 0]).reshape(-1)
                tile = npy_tile(pixels)
                feature = f"{difference_hash(tile)}:{np.load(io.BytesIO(tile)).tobytes().hex()}"
                other = second(pixels[:, :, 0]) if second else None
                beside = (len(other), hashlib.sha256(other).hexdigest(), bool(np.array_equal(decode(other), pixels))) if second else (None, None, None)
                rows.append((n, back.size, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW_BYTES:]), len(media), hashlib.sha256(media).hexdigest(), feature, media if with_media else None, tile if with_tile else None, *beside))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
            names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "tile", "also_bytes", "also_sha256", "also_intact"]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, tile binary, also_bytes long, also_sha256 string, also_intact boolean"
    out = in_arrow(slim, run, schema)
    return out.select(F.col("id").alias(id_col), *out.columns[1:8], *["media"] * with_media, *["tile"] * with_tile, *[F.col(f"also_{c}").alias(f"{also}_{c}") for c in ("bytes", "sha256", "intact") if also])


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read(spark, sf_dir, "documents"), with_tile=True, also="bmp")
