"""Block gzip: gzip members of at most 64 KiB that carry their own length, so that readers can seek by (block, offset)."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from allelake.sources.files import locate

BLOCK = 65_280
MODES = ("w", "a", "wu", "au")


def block(data: bytes) -> bytes:
    """One member of up to ``BLOCK`` bytes; the member of no bytes marks the end of a file."""
    for level in (6, 0):  # bytes that don't shrink are stored
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
        if len(body) + 26 <= 1 << 16:
            break
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data), len(data))


class BlockWriter:
    """Writes a file in modes w and a (block gzip) or wu and au (plain bytes); ``a`` appends."""

    def __init__(self, path: str, mode: str = "w"):
        if mode not in MODES:
            raise ValueError(f"invalid write mode {mode}")
        self.path, self.plain, self.pending, self.closed = path, "u" in mode, bytearray(), False
        fs, name = locate(path)
        self.at = fs.get_file_info(name).size or 0 if mode[0] == "a" else 0
        self.out = fs.open_append_stream(name, compression=None) if mode[0] == "a" else fs.open_output_stream(name, compression=None)

    def _put(self, data: bytes) -> None:
        if self.out.write(data) not in (None, len(data)):
            raise OSError(f"failed to write {self.path}")
        self.at += len(data)

    def write(self, data: str | bytes) -> None:
        if self.closed:
            raise ValueError(f"attempted to write to closed file {self.path}")
        data = data.encode() if isinstance(data, str) else data
        if self.plain:
            return self._put(data)
        self.pending += data
        while len(self.pending) >= BLOCK:
            self._put(block(bytes(self.pending[:BLOCK])))
            del self.pending[:BLOCK]

    def pack(self, layout: str, *values) -> None:
        """Write numbers, little-endian, by a ``struct`` layout."""
        self.write(struct.pack("<" + layout, *values))

    def tell(self) -> int:
        """Where the next byte goes: its block's address times 65536 plus its place there (plain: its place)."""
        return self.at if self.plain else self.at << 16 | len(self.pending)

    def close(self) -> None:
        if not self.closed:
            if not self.plain:
                if self.pending:
                    self._put(block(bytes(self.pending)))
                self._put(block(b""))
            self.out.close()
            self.closed = True

    def __enter__(self) -> BlockWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def read_from(path: str, place: int) -> Iterator[bytes]:
    """Contents of the blocks from a place that ``tell`` gave."""
    fs, name = locate(path)
    with fs.open_input_file(name) as f:
        f.seek(place >> 16)
        skip = place & 0xFFFF
        while head := f.read(18):
            size = struct.unpack_from("<H", head, 16)[0] + 1
            data = zlib.decompress(f.read(size - 18)[:-8], -15)
            yield data[skip:]
            skip = 0


def write_lines(lines: DataFrame, folder: str) -> DataFrame:
    """Write the one text column of ``lines`` as a block gzip file for each partition: (path, lines, bytes) of those that
    count, once evaluated (a task that runs again writes another file). Null lines are empty lines."""

    def run(batches):
        fs, root = locate(folder)
        fs.create_dir(root, recursive=True)
        path, n = os.path.join(folder, f"{uuid.uuid4().hex}.gz"), 0
        with BlockWriter(path) as out:
            for batch in batches:
                for line in batch.column(0):
                    out.write((line.as_py() or "") + "\n")
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([out.at], pa.int64())], ["path", "lines", "bytes"])

    return lines.mapInArrow(run, "path string, lines long, bytes long")
