"""k-mers inside variants: of deleted sequence, and of inserted sequence and its breakpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..session import written
from .windows import CHUNK, K, chunks, packed_windows, windows


def around(tracks: DataFrame, reference: DataFrame, svtype: str, begin: Column, length: Column, seq=lambda bases: bases) -> DataFrame:
    """Tracks of a type with `window`, made by seq of `length` bases from `begin` on; without those whose window has an unknown base.

    The bases come from the chunks of the reference that they touch, by an equal join; what is gathered for a track is as long as its window.
    """
    rows = tracks.where(F.col("svtype") == svtype).withColumns({"low": begin.cast("long"), "high": (begin + length).cast("long")})
    touched = F.explode(F.sequence(F.greatest(F.floor(F.col("low") / CHUNK), F.lit(0)), F.floor((F.col("high") - 1) / CHUNK)))
    parts = chunks(reference).select("chrom", (F.col("offset") / CHUNK).cast("long").alias("nth"), "offset", F.substring(F.col("piece"), (F.col("offset") - F.col("base") + 1).cast("int"), F.lit(CHUNK)).alias("own"))
    from_, to = F.greatest(F.col("low"), F.col("offset")), F.least(F.col("high"), F.col("offset") + CHUNK)
    cut = rows.select("track", "chrom", "low", "high", touched.alias("nth")).join(parts, ["chrom", "nth"])
    cut = cut.select("track", F.struct("nth", F.substring(F.col("own"), (from_ - F.col("offset") + 1).cast("int"), (to - from_).cast("int")).alias("bases")).alias("part"))
    whole = cut.groupBy("track").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["bases"]), "").alias("window"))
    return rows.drop("low", "high").join(whole, "track").withColumn("window", seq(F.col("window"))).where(~F.contains("window", F.lit("N")))


def counted(windows: DataFrame, text: bool = True, carried: tuple = ()) -> DataFrame:
    """track, the carried columns, kmer (packed, as code, without text), mult of windows (track, window), one row a track: each is counted in the task that has it."""
    rows = packed_windows(windows, "track", *carried, seq="window", summed=True)
    return rows.select("track", *carried, dna.decode(F.col("code")).alias("kmer"), "mult") if text else rows


def deletions(tracks: DataFrame, reference: DataFrame, text: bool = True, carried: tuple = ()) -> DataFrame:
    """track, the carried columns of tracks, kmer, mult: every 32-mer from 32 before a deletion to 32 past its length."""
    return counted(around(tracks, reference, "DEL", F.col("begin") - 32, F.col("svlen") + 64), text, carried)


def breakpoints(tracks: DataFrame, reference: DataFrame, text: bool = True) -> DataFrame:
    """track, kmer (packed, as code, without text), mult: the 33 k-mers across an insertion's place in the reference."""
    return counted(around(tracks, reference, "INS", F.col("begin") - 32, F.lit(64)), text)


def body_windows(tracks: DataFrame, reference: DataFrame) -> DataFrame:
    """Insertions with window: the inserted sequence with 250 bases of the reference on either side."""
    gap = F.col("end") - F.col("begin")
    with_ends = lambda bases: F.upper(F.concat(F.substring(bases, F.lit(1), F.lit(250)), F.col("seq"), F.substring(bases, gap + 251, F.lit(250))))
    return around(tracks, reference, "INS", F.col("begin") - 250, gap + 500, with_ends)


#: The first start of a body's k-mers in its window.
BODY = 250 + K


def body_stop() -> Column:
    """Where the starts of a body's k-mers stop."""
    return F.length("window") - 250 - 2 * K + 1


def bodies(tracks: DataFrame, reference: DataFrame) -> DataFrame:
    """track, chrom, begin, start, kmer, left, right, gc: k-mers of inserted sequence whose flanks lie in the insert, 250 bases around it read too."""
    rows = windows(body_windows(tracks, reference), BODY, body_stop(), seq="window")
    w, s = F.col("window"), F.col("start")
    return rows.select("track", "chrom", "begin", "start", dna.canonical(dna.kmer_at(w, s)).alias("kmer"), dna.left_of(w, s).alias("left"), dna.right_of(w, s).alias("right"), dna.gc_percent(w, s).alias("gc"))


def spans(tracks: DataFrame, reference: DataFrame) -> DataFrame:
    """Insertions with window, and first and last: the starts of a body's k-mers in it."""
    return body_windows(tracks, reference).withColumns({"first": F.lit(BODY), "last": F.greatest(body_stop() - 1, F.lit(BODY))}).where(body_stop() >= BODY)


def packed_bodies(tracks: DataFrame, reference: DataFrame) -> DataFrame:
    """bodies, with k-mers and flanks packed. They are written: insertions reads them three times."""
    rows = packed_windows(spans(tracks, reference), "track", "chrom", "begin", seq="window", flanks=True, gc=True, first="first", last="last")
    return written(rows.drop("same").withColumnRenamed("code", "kmer"), "bodies")


def insertions(tracks: DataFrame, reference: DataFrame, text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(track, kmer, mult) and the loci (track, kmer, chrom, pos, left, right, gc) of insertions; without text k-mers and flanks are packed.

    A breakpoint k-mer that the body has leaves the breakpoint's, and the first such place in the body is left out; later ones count.
    """
    body = bodies(tracks, reference) if text else packed_bodies(tracks, reference)
    breaks = breakpoints(tracks, reference) if text else breakpoints(tracks, reference, text=False).withColumnRenamed("code", "kmer")
    order = Window.partitionBy("track", "kmer").orderBy("start")
    seen = body.withColumn("nth", F.row_number().over(order)).join(breaks.select("track", "kmer", F.lit(True).alias("crossed")), ["track", "kmer"], "left")
    loci = seen.where((F.col("nth") > 1) | F.col("crossed").isNull()).select("track", "kmer", "chrom", F.col("begin").alias("pos"), "left", "right", "gc", "start")
    left = breaks.join(body.select("track", "kmer").distinct(), ["track", "kmer"], "left_anti")
    counted = loci.groupBy("track", "kmer").agg(F.count("*").alias("mult"))
    return counted.unionByName(left), loci


def inserted(tracks: DataFrame, reference: DataFrame) -> DataFrame:
    """track, code, mult of insertions, packed: what insertions counts, from sums for each track and k-mer, made where its window is. No place is listed and none is put in order."""
    inside = packed_windows(spans(tracks, reference), "track", seq="window", first="first", last="last", summed=True).withColumnRenamed("mult", "inside")
    across = breakpoints(tracks, reference, text=False).withColumnRenamed("mult", "across")
    rows = inside.join(across, ["track", "code"], "full")
    # Of a k-mer that the body has too, the first place in the body is left out, and the breakpoint's.
    mult = F.when(F.col("inside").isNull(), F.col("across")).otherwise(F.col("inside") - F.when(F.col("across").isNull(), 0).otherwise(1))
    return rows.select("track", "code", mult.alias("mult")).where("mult > 0")


def merge(tracks: DataFrame, reference: DataFrame) -> DataFrame:
    """kmer, tracks (how many), mult (summed over them): all inner k-mers. They are packed until they are summed."""
    rows = deletions(tracks, reference, text=False).unionByName(inserted(tracks, reference))
    return rows.groupBy("code").agg(F.count("*").alias("tracks"), F.sum("mult").alias("mult")).select(dna.decode(F.col("code")).alias("kmer"), "tracks", "mult")
