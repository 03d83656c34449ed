"""TIFF rasters (strips or tiles, one sample type) as tables of pixels, and back.

Scanning goes over binaryFile rows, so any file system that Spark reads will do; each file is read by one task. Deflate,
LZW and PackBits are unpacked, as are differences along the rows; large grids are written as one file for each tile.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: tags, and numpy types by (sample format, bits).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS = 317, 322, 323, 324, 325
PIXEL_SCALE, TIE_POINT, GDAL_NODATA = 33550, 33922, 42113
CLEAR, END = 256, 257  # codes of LZW
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 12: "d"}
DTYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; a width ends one code early."""
    table: list[bytes] = []
    out, before, width, held, bits = [], b"", 9, 0, 0
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == END:
            break
        if code == CLEAR:
            table, before, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        now = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + now[:1])
        out.append(now)
        before, width = now, min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def pack_bits(raw: bytes) -> bytes:
    """Runs: a count below 128 is followed by one more bytes than it says, one above by a byte that stands 257 - count times."""
    out, at = [], 0
    while at < len(raw):
        n, at = raw[at], at + 1
        if n < 128:
            out.append(raw[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(raw[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


#: By the number in the file.
UNPACK: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: pack_bits}


def _block(raw: bytes, tags: dict[int, tuple], kind: np.dtype, width: int, samples: int) -> np.ndarray:
    """(row, col, sample) values of one strip or tile."""
    flat = np.frombuffer(UNPACK[tags.get(COMPRESSION, (1,))[0]](raw), kind)
    block = flat[: len(flat) // (width * samples) * width * samples].reshape(-1, width, samples)
    how = tags.get(PREDICTOR, (1,))[0]
    if how not in (1, 2):
        raise ValueError("differences of floats can't be read")
    return np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")) if how == 2 else block


def decode(raw: bytes) -> tuple[np.ndarray, tuple[float, float, float] | None]:
    """(band, row, col) values, and (min x, max y, cell size) if the file has them."""
    order = {b"II": "<", b"MM": ">"}[raw[:2]]
    magic, at = struct.unpack_from(order + "HI", raw, 2)
    if magic != 42:
        raise ValueError("not a TIFF file")
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        if kind in TYPES:
            size = n * struct.calcsize(TYPES[kind])
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * i)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{TYPES[kind]}", raw, place)
    if tags.get(COMPRESSION, (1,))[0] not in UNPACK:
        raise ValueError(f"compression {tags[COMPRESSION][0]} can't be read")
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    kind = np.dtype(order + DTYPES[tags.get(FORMAT, (1,))[0], tags.get(BITS, (8,))[0]])
    apart = tags.get(PLANAR, (1,))[0] == 2  # each sample has blocks of its own
    wide, high = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if TILES in tags else (width, min(height, tags.get(ROWS, (height,))[0]))
    cube = np.zeros((samples, height, width), kind.newbyteorder("="))
    across, down = -(-width // wide), -(-height // high)
    for i, (a, n) in enumerate(zip(tags[TILES if TILES in tags else STRIPS], tags[TILE_COUNTS if TILES in tags else COUNTS], strict=True)):
        band, place_in = divmod(i, across * down)
        r, c = place_in // across * high, place_in % across * wide
        block = _block(raw[a : a + n], tags, kind, wide, 1 if apart else samples)[: height - r, : width - c]
        cube[band if apart else slice(None), r : r + len(block), c : c + block.shape[1]] = block[:, :, 0] if apart else block.transpose(2, 0, 1)
    place = None
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        cell, (i, j, _, x, y, _) = tags[PIXEL_SCALE][0], tags[TIE_POINT][:6]
        place = (x - i * cell, y + j * cell, cell)
    return cube, place


def encode(grid: np.ndarray, min_x: float = 0.0, max_y: float = 0.0, cell: float = 10.0, nodata: int | None = -9999, pack: bool = False) -> bytes:
    """A file of one band with one strip, deflated if it is to be packed."""
    grid = np.ascontiguousarray(grid)
    body = grid.astype(grid.dtype.newbyteorder("<")).tobytes()
    body = zlib.compress(body) if pack else body
    form, bits = next(k for k, v in DTYPES.items() if np.dtype(v) == grid.dtype.newbyteorder("="))
    entries: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (grid.shape[1],)), (HEIGHT, 4, (grid.shape[0],)), (BITS, 3, (bits,)), (COMPRESSION, 3, (8 if pack else 1,)), (PHOTOMETRIC, 3, (1,)), (STRIPS, 4, (0,)), (SAMPLES, 3, (1,)),
        (ROWS, 4, (grid.shape[0],)), (COUNTS, 4, (len(body),)), (PLANAR, 3, (1,)), (FORMAT, 3, (form,)), (PIXEL_SCALE, 12, (cell, cell, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, min_x, max_y, 0.0)),
    ]
    if nodata is not None:
        entries.append((GDAL_NODATA, 2, tuple(bytes([c]) for c in f"{nodata}\0".encode())))
    head = 8 + 2 + 12 * len(entries) + 4
    extra = b""
    table = struct.pack("<H", len(entries))
    blobs = [struct.pack(f"<{len(v)}{TYPES[k]}", *v) for _, k, v in entries]
    total = sum(len(b) + len(b) % 2 for b in blobs if len(b) > 4)
    for (tag, kind, values), blob in zip(entries, blobs, strict=True):
        if tag == STRIPS:
            blob = struct.pack("<I", head + total)
        if len(blob) > 4:
            field = struct.pack("<I", head + len(extra))
            extra += blob + b"\0" * (len(blob) % 2)
        else:
            field = blob.ljust(4, b"\0")
        table += struct.pack("<HHI", tag, kind, len(values)) + field
    return b"II*\0" + struct.pack("<I", 8) + table + struct.pack("<I", 0) + extra + body


def read_pixels(spark: SparkSession, folder: str, bands: list[str], pattern: str = "*.tif") -> DataFrame:
    """(path, x, y, band columns...): the pixel centres of all files of a folder."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder), bands)


def decoded(files: DataFrame, bands: list[str]) -> DataFrame:
    """The same of a table of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                cube, place = decode(raw.as_py())
                min_x, max_y, cell = place or (0.0, float(cube.shape[1]), 1.0)
                row, col = np.divmod(np.arange(cube.shape[1] * cube.shape[2]), cube.shape[2])
                arrays = [pa.array([path] * len(row)), pa.array(min_x + (col + 0.5) * cell), pa.array(max_y - (row + 0.5) * cell)]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(cube[i].ravel().astype(float)) for i in range(len(bands))], names=["path", "x", "y", *bands])

    return files.select("path", "content").mapInArrow(run, "path string, x double, y double, " + ", ".join(f"{b} double" for b in bands))


def grid_bytes(grid: DataFrame, rows: int, cols: int, min_x: float, max_y: float, cell: float = 10.0, nodata: int = -9999) -> bytes:
    """A table (row, col, value) as a file; the grid must fit in the driver's memory, which its size tells before."""
    if rows * cols > 50_000_000:
        raise ValueError("write large grids by tile")
    out = np.full((rows, cols), nodata, np.int32)
    found = grid.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).select("row", "col", F.col("value").cast("int")).toArrow()
    out[found.column(0).to_numpy(), found.column(1).to_numpy()] = found.column(2).to_numpy()
    return encode(out, min_x, max_y, cell, nodata)


def tile_files(grid: DataFrame, side: int, min_x: float, max_y: float, cell: float = 10.0, nodata: int = -9999) -> DataFrame:
    """(tile_row, tile_col, content): a file for each tile of a grid (row, col, value) that has any cell.

    A task holds one tile of side * side cells at a time, whatever the size of the grid.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        out = np.full((side, side), nodata, np.int32)
        row, col, value = (table.column(c).to_numpy() for c in ("row", "col", "value"))
        out[row - i * side, col - j * side] = value
        raw = encode(out, min_x + j * side * cell, max_y - i * side * cell, cell, nodata, pack=True)
        return pa.table({"tile_row": pa.array([i], pa.int32()), "tile_col": pa.array([j], pa.int32()), "content": pa.array([raw], pa.binary())})

    placed = grid.select(F.floor(F.col("row") / side).cast("int").alias("tile_row"), F.floor(F.col("col") / side).cast("int").alias("tile_col"), F.col("row").cast("int"), F.col("col").cast("int"), F.col("value").cast("int"))
    return placed.groupBy("tile_row", "tile_col").applyInArrow(run, "tile_row int, tile_col int, content binary")


def write_files(tiles: DataFrame, folder: str) -> DataFrame:
    """Writes each tile's file below a folder that all executors share; gives (path, bytes) when its rows are read.

    A file gets its name when it is whole, so that a task may run twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = pafs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        for b in batches:
            paths = [f"tile_{i}_{j}.tif" for i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            for path, raw in zip(paths, b.column(2), strict=True):
                unfinished = f"{top}/.{path}-{uuid.uuid4().hex}"
                with system.open_output_stream(unfinished) as out:
                    out.write(raw.as_py())
                system.move(unfinished, f"{top}/{path}")
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([len(raw.as_py()) for raw in b.column(2)], pa.int64())], names=["path", "bytes"])

    return tiles.select("tile_row", "tile_col", "content").mapInArrow(run, "path string, bytes long")
