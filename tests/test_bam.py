"""BAM files against the same records as SAM text."""

import random
import struct
import zlib

import pytest

from strandline.sources import bam, files

CHROMS = ["chr1", "chr2", "chrX"]


def bgzf(data, size, last=True):
    out = b""
    for at in range(0, len(data), size):
        part = data[at : at + size]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out + (bam.LAST_BLOCK if last else b"")


def records(n, seed, longest=180):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        length = rng.randrange(0, longest)
        seq = "".join(rng.choice("ACGTN") for _ in range(length))
        ops = [(rng.choice("MIDS"), rng.randrange(1, 90)) for _ in range(rng.randrange(0, 4))]
        ref = rng.randrange(-1, 3)
        out.append((f"read{k}", ref, rng.randrange(0, 10_000) if ref >= 0 else -1, ops, seq))
    return out


def encoded(rows):
    text = b"@HD\tVN:1.6\n" + b"@CO\tBAM\1 not a header\n" * 40
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(CHROMS))
    for c in CHROMS:
        head += struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", 10**6)
    out = b""
    for name, ref, pos, ops, seq in rows:
        codes = [bam.BASES.index(c) for c in seq] + [0]
        packed = bytes(codes[k] << 4 | codes[k + 1] for k in range(0, len(seq), 2))
        cigar = b"".join(struct.pack("<I", n << 4 | bam.OPERATIONS.index(o)) for o, n in ops)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 30, 4680, len(ops), 0, len(seq), -1, -1, 0) + name.encode() + b"\0" + cigar + packed + b"\xff" * len(seq) + b"NMC\x01"
        out += struct.pack("<i", len(body)) + body
    return head + out


def sam(rows):
    lines = ["@HD\tVN:1.6"]
    for name, ref, pos, ops, seq in rows:
        lines.append("\t".join([name, "0", CHROMS[ref] if ref >= 0 else "*", str(pos + 1), "30", "".join(f"{n}{o}" for o, n in ops) or "*", "*", "0", "0", seq, "*"]))
    return "\n".join(lines) + "\n"


def told(df):
    return sorted((r.sample, r.chrom, r.pos, tuple((c["op"], c["len"]) for c in r.cigar), r.read) for r in df.collect())


@pytest.mark.parametrize("block", [333, 20_000])
@pytest.mark.parametrize("parts", [1, 3, 17])
def test_bam_equals_sam(spark, tmp_path, parts, block):
    rows = records(3000, parts)
    data = bgzf(encoded(rows), block)
    (tmp_path / "a.bam").write_bytes(data)
    (tmp_path / "a.sam").write_text(sam(rows))
    df = bam.read_bam(spark, str(tmp_path / "a.bam"), sample="s", partition_bytes=-(-len(data) // parts))
    assert df.rdd.getNumPartitions() == parts
    got, want = told(df), told(files.read_sam(spark, str(tmp_path / "a.sam"), sample="s"))
    assert got == want and df.select("read_id").distinct().count() == len(rows)


def test_records_longer_than_ranges(spark, tmp_path):
    """Records that reach over several blocks and ranges: some ranges have no record of their own."""
    rows = [*records(20, 1), ("long", 0, 5, [("M", 70_000)], "ACGT" * 17_500), *records(20, 2)]
    data = bgzf(encoded(rows), 1000)
    (tmp_path / "a.bam").write_bytes(data)
    (tmp_path / "a.sam").write_text(sam(rows))
    assert told(bam.read_bam(spark, str(tmp_path / "a.bam"), partition_bytes=1500)) == told(files.read_sam(spark, str(tmp_path / "a.sam")))


def test_no_records(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(bgzf(encoded([]), 100))
    assert files.read_reads(spark, str(tmp_path / "a.bam")).count() == 0


def test_cut_off_and_damaged_files_end_the_run(spark, tmp_path):
    data = bgzf(encoded(records(500, 3)), 500)
    for name, bad in (("end", data[:-28]), ("half", data[: len(data) // 2]), ("record", bgzf(encoded(records(500, 3))[:-20], 500)), ("text", b"@HD\tVN:1.6\n" * 100)):
        (tmp_path / f"{name}.bam").write_bytes(bad)
        with pytest.raises(Exception, match="(cut off|no BAM file|damaged)"):
            bam.read_bam(spark, str(tmp_path / f"{name}.bam")).count()
    flipped = bytearray(data)
    flipped[len(data) // 2] ^= 255
    (tmp_path / "flipped.bam").write_bytes(bytes(flipped))
    with pytest.raises(Exception, match="(cut off|damaged|no record|rror)"):
        bam.read_bam(spark, str(tmp_path / "flipped.bam")).count()
    with pytest.raises(ValueError, match="CRAM"):
        files.read_reads(spark, "x.cram")


def test_suffixes(spark, tmp_path):
    rows = records(50, 4)
    (tmp_path / "a.bam").write_bytes(bgzf(encoded(rows), 700))
    (tmp_path / "a.sam").write_text(sam(rows))
    want = sorted(r[4] for r in rows)
    assert sorted(r.seq for r in files.read_reads(spark, str(tmp_path / "a.bam")).collect()) == want == sorted(r.seq for r in files.read_reads(spark, str(tmp_path / "a.sam")).collect())
    files.read_reads(spark, str(tmp_path / "a.sam")).write.parquet(str(tmp_path / "a.parquet"))
    assert files.read_reads(spark, str(tmp_path / "a.parquet")).count() == 50
