"""Image sinks: PNG bytes without any imaging library, files, and HTML."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame


def to_array(image: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """A dense (height, width, 4) array of an image on a canvas; the canvas bounds what is collected."""
    out = np.zeros((*shape, 4), np.uint8)
    rows = image.select("py", "px", "rgba").toPandas()
    packed = rows["rgba"].to_numpy(np.int64)
    for n in range(4):
        out[rows["py"], rows["px"], n] = packed >> (8 * n) & 255
    return out


def png(pixels: np.ndarray) -> bytes:
    """RGBA pixels, first row on top, as a PNG file."""
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * 4)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def to_png(image: DataFrame, shape: tuple[int, int], origin: str = "lower") -> bytes:
    """A PNG of an image; with origin `lower`, row 0 is at the bottom."""
    dense = to_array(image, shape)
    return png(dense[::-1] if origin == "lower" else dense)


def export(image: DataFrame, shape: tuple[int, int], path: str, background: str | None = "black") -> str:
    """Write a PNG through Spark's file systems, so that any store works; gives the path."""
    from tessera.operators.shade import set_background

    if background is not None:
        image = set_background(image, background)
    write_bytes(image, path, to_png(image, shape))
    return path


def write_bytes(df: DataFrame, path: str, data: bytes) -> None:
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()


def html(*images: bytes, columns: int = 3) -> str:
    """A table of PNGs for notebooks."""
    cells = [f'<td><img src="data:image/png;base64,{base64.b64encode(i).decode()}"></td>' for i in images]
    return "<table>" + "".join(f"<tr>{''.join(cells[i : i + columns])}</tr>" for i in range(0, len(cells), columns)) + "</table>"
