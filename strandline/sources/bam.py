"""BAM files as a Spark data source, read in byte ranges.

A BAM file is a row of small gzip blocks (BGZF) that hold records one after another, without regard to the blocks' ends. A partition is a byte range: it takes the records that begin in the blocks
that begin in its range. The first block after the range's begin is found by its header and that of the block which follows it; the first record by what all its fields must be, and by records that
follow it without a gap. Only the file's head, with the names of the chromosomes, is read on the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: letters of the 16 codes of a base, letters of cigar operations, the empty block that ends a file.
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SCHEMA = "file string, place long, chrom string, pos int, cigar array<struct<op:string,len:int>>, read string"
PAIRS = np.array([[ord(BASES[k >> 4]), ord(BASES[k & 15])] for k in range(256)], np.uint8)
#: Records in a row that must fit before a place is taken for the begin of one.
RUN = 4


def block_size(head: bytes) -> int | None:
    """The whole size of the block that begins with head, or None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, min(12 + extra, len(head))
    while at + 4 <= end:
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= end:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


class Blocks:
    """The blocks of a file from a place on, one after another."""

    def __init__(self, file, size: int, at: int, ahead: int = 1 << 20):
        self.file, self.size, self.ahead = file, size, ahead
        self.at, self.held, self.begin = at, b"", at

    def head(self, n: int) -> bytes:
        """The n bytes from `at` on, fewer at the end of the file."""
        k = self.at - self.begin
        if k + n > len(self.held) and self.begin + len(self.held) < self.size:
            self.file.seek(self.at)
            self.begin, self.held, k = self.at, self.file.read(max(n, self.ahead)), 0
        return self.held[k : k + n]

    def seek_block(self) -> bool:
        """Goes on to the next block's begin, which another block or the file's end must follow."""
        while self.at < self.size:
            window = self.head(1 << 17)
            k = window.find(b"\x1f\x8b\x08\x04")
            if k < 0:
                self.at += max(1, len(window) - 3)
                continue
            self.at += k
            size = block_size(self.head(64))
            if size:
                after, here = self.at + size, self.at
                self.at = after
                fits = after == self.size or block_size(self.head(64)) is not None
                self.at = here
                if fits:
                    return True
            self.at += 1
        return False

    def next(self, name: str) -> bytes | None:
        """The data of the block at `at`, or None at the file's end."""
        if self.at >= self.size:
            return None
        size = block_size(self.head(64))
        raw = self.head(size) if size else b""
        if not size or len(raw) < size:
            raise ValueError(f"{name}: no whole block at {self.at}; the file is damaged or cut off")
        extra = struct.unpack_from("<H", raw, 10)[0]
        data = zlib.decompress(raw[12 + extra : -8], -15)
        if struct.unpack_from("<II", raw, size - 8) != (zlib.crc32(data), len(data)):
            raise ValueError(f"{name}: the block at {self.at} is damaged")
        self.at += size
        return data


@dataclass
class Range(InputPartition):
    path: str
    size: int
    begin: int
    end: int
    #: Data bytes of the first block before its first record, in the range that has the file's first record.
    skip: int | None
    chroms: list[str]


def opened(path: str):
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at), system.get_file_info(at).size


def header(path: str) -> tuple[list[str], int, int, int]:
    """Names of the chromosomes, the file's size, and where the first record begins: its block, and its place in that."""
    file, size = opened(path)
    with file:
        file.seek(max(0, size - len(LAST_BLOCK)))
        if file.read(len(LAST_BLOCK)) != LAST_BLOCK:
            raise ValueError(f"{path}: no last block; this is no BAM file, or one that is cut off")
        blocks, data, starts = Blocks(file, size, 0), bytearray(), []

        def need(n: int) -> None:
            while len(data) < n:
                starts.append((len(data), blocks.at))
                more = blocks.next(path)
                if more is None:
                    raise ValueError(f"{path}: the header is cut off")
                data.extend(more)

        need(8)
        if data[:4] != b"BAM\1":
            raise ValueError(f"{path}: no BAM file")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        need(at + 4)
        names, n = [], struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n):
            need(at + 4)
            length = struct.unpack_from("<i", data, at)[0]
            need(at + 8 + length)
            names.append(bytes(data[at + 4 : at + 3 + length]).decode())
            at += 8 + length
        begin, block = next(((b, p) for b, p in reversed(starts) if b <= at), (0, 0))
        return names, size, block, at - begin


def plausible(data: memoryview, at: int, chroms: int) -> int | None:
    """Where the record at `at` ends, if there may be one; None if there can't; -1 if the data ends before that is known."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, name, _, _, operations, _, bases, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < chroms and -1 <= next_ref < chroms and pos >= -1 and next_pos >= -1 and name >= 1 and bases >= 0) or size < 32 + name + 4 * operations + (bases + 1) // 2 + bases:
        return None
    if at + 36 + name > len(data):
        return -1
    label = bytes(data[at + 36 : at + 36 + name])
    if label[-1] or any(not 33 <= c <= 126 for c in label[:-1]):
        return None
    first = at + 36 + name
    if any(v & 15 >= len(OPERATIONS) for v in struct.unpack_from(f"<{min(operations, max(0, (len(data) - first) // 4))}I", data, first)):
        return None
    return at + 4 + size


def first_record(data: bytes, chroms: int, whole: bool) -> int | None:
    """The first place from which records follow each other without a gap, RUN of them or to the end of data; whole says that the file ends there."""
    view = memoryview(data)
    for at in range(len(data)):
        k, n = at, 0
        while n < RUN:
            if k == len(data) and n:
                break
            end = plausible(view, k, chroms)
            if end is None or end > len(data) and whole or end == -1 and (whole or not n):
                n = -1
                break
            if end == -1 or end > len(data):
                break
            k, n = end, n + 1
        if n > 0:
            return at
    return None


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["paths"].split("\n")
        self.bytes = int(options.get("partition_bytes", 8 << 20))

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            chroms, size, block, skip = header(path)
            for k in range(-(-size // self.bytes)):
                begin, end = k * self.bytes, min(size, (k + 1) * self.bytes)
                if end > block:
                    out.append(Range(path, size, max(begin, block), end, skip if begin <= block else None, chroms))
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        file, size = opened(part.path)
        if size != part.size:
            raise ValueError(f"{part.path} has changed")
        with file:
            blocks = Blocks(file, size, part.begin)
            if part.skip is None and not blocks.seek_block() or blocks.at >= part.end:
                return
            data, starts = bytearray(), []  # starts: where each block's data begins, and the block
            while blocks.at < part.end and blocks.at < size:
                starts.append((len(data), blocks.at))
                data += blocks.next(part.path)
            own = len(data)
            at = part.skip
            while at is None:
                at = first_record(bytes(data), len(part.chroms), blocks.at >= size)
                if at is None or at >= own:
                    if at is not None or blocks.at >= size or not self.more(blocks, data, part.path):
                        return
                    at = None
            held: list[tuple] = []
            order = 0
            while at < own:
                while len(data) < at + 4 or len(data) < at + 4 + struct.unpack_from("<i", data, at)[0]:
                    if not self.more(blocks, data, part.path):
                        raise ValueError(f"{part.path}: the last record is cut off")
                while order + 1 < len(starts) and starts[order + 1][0] <= at:
                    order += 1
                length = struct.unpack_from("<i", data, at)[0]
                if length < 32:
                    raise ValueError(f"{part.path}: no record where one should be, in the block at {starts[order][1]}")
                held.append((part.path, starts[order][1] << 16 | at - starts[order][0], *self.row(data, at, part.chroms)))
                at += 4 + length
                if len(held) == 4096:
                    yield self.batch(held)
                    held = []
            if held:
                yield self.batch(held)

    @staticmethod
    def more(blocks: Blocks, data: bytearray, path: str) -> bool:
        block = blocks.next(path)
        if block is not None:
            data += block
        return block is not None

    @staticmethod
    def row(data: bytearray, at: int, chroms: list[str]) -> tuple:
        _, ref, pos, name, _, _, operations, _, bases = struct.unpack_from("<iiiBBHHHi", data, at)
        first = at + 36 + name
        cigar = [{"op": OPERATIONS[v & 15], "len": v >> 4} for v in struct.unpack_from(f"<{operations}I", data, first)]
        codes = np.frombuffer(data, np.uint8, (bases + 1) // 2, first + 4 * operations)
        return chroms[ref] if ref >= 0 else "*", pos, cigar, PAIRS[codes].tobytes()[:bases].decode("ascii")

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())])), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "place", "chrom", "pos", "cigar", "read"])


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandline_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, *paths: str, sample: str = "", partition_bytes: int = 8 << 20) -> DataFrame:
    """sample, read_id, chrom, pos (from 0), cigar, read of BAM files, all records of them; paths may be URIs that pyarrow's file systems know. A file that is cut off or damaged ends the run."""
    spark.dataSource.register(BamSource)
    rows = spark.read.format("strandline_bam").option("paths", "\n".join(paths)).option("partition_bytes", partition_bytes).load()
    return rows.select(F.lit(sample).alias("sample"), F.xxhash64("file", "place").alias("read_id"), "chrom", "pos", "cigar", F.col("read"))
