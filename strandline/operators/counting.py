"""Counting k-mers of a panel in reads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.masks import judged
from ..session import cleaned, dealt, written
from .superkmers import count_codes
from .windows import Members, Sieve, packed_windows

#: k-mers of a panel that are sent to all tasks at most: 8 MB. Of a larger panel a filter of bounded size is sent, and what passes is joined.
SENT = 1_000_000


def count_all(reads: DataFrame) -> DataFrame:
    """kmer, total: every canonical k-mer of the reads; an unknown base counts as G."""
    return count_codes(reads, text=True)


def members(codes: DataFrame, most: int = SENT) -> Members | Sieve:
    """What tells in a task which codes may be among these (code, distinct): the codes themselves, or a filter where they are more than `most`. Either is of bounded size, and so is what comes to the driver."""
    with cleaned(codes.sparkSession):
        n = codes.count()
    return Sieve.of(codes, n) if n > most else Members(np.sort(codes.toArrow()["code"].to_numpy()))


def panel_windows(reads: DataFrame, codes: DataFrame, flanks: bool = False, most: int = SENT) -> DataFrame:
    """The reads' windows that have one of codes, told in the tasks that pack them; with more than `most` codes some windows of others too, which a join with the codes takes out."""
    return packed_windows(reads, flanks=flanks, only=reads.sparkSession.sparkContext.broadcast(members(codes, most)))


def count_panel(reads: DataFrame, panel: DataFrame, most: int = SENT, text: bool = True) -> DataFrame:
    """kmer, total for every k-mer of panel (kmer; packed without text), 0 where unseen. Reads are filtered by the packed panel before anything is summed."""
    if text:
        keys = written(dealt(panel.select("kmer").distinct().withColumn("code", dna.encode(F.col("kmer"))), "code"), "panel")
    else:
        keys = written(dealt(panel.select(F.col("kmer").alias("code")).distinct(), "code"), "panel")
    seen = panel_windows(reads, keys.select("code"), most=most).groupBy("code").agg(F.count("*").alias("total"))
    return keys.join(seen, "code", "left").select("kmer" if text else F.col("code").alias("kmer"), F.coalesce("total", F.lit(0)).alias("total"))


def count_masked(reads: DataFrame, masks: DataFrame, most: int = SENT, text: bool = True) -> DataFrame:
    """kmer, count, total for masks (kmer, mask: null for a k-mer without masks; packed without text). An occurrence counts if the k-mer has no masks, or if some mask
    is a gapped subsequence of a flank that the read has whole. k-mers are met as the read has them or as its complement; masks are the k-mer's.
    Occurrences with equal flanks are judged once."""
    known = masks.groupBy("kmer").agg(F.collect_set("mask").alias("masks"))
    if text:
        known = known.withColumns({"code": dna.encode(F.col("kmer")), "masks": F.transform("masks", dna.encode)})
    else:
        known = known.withColumnRenamed("kmer", "code")
    known = written(dealt(known, "code"), "masks")
    # Joined before they are summed, so that windows are shuffled once, by code.
    rows = panel_windows(reads, known.select("code"), flanks=True, most=most).select("code", "left", "right").join(known.select("code"), "code", "left_semi").groupBy("code", "left", "right").agg(F.count("*").alias("n"))
    seen = judged(rows.join(known.select("code", "masks"), "code")).groupBy("code").agg(F.sum(F.when(F.col("passes"), F.col("n")).otherwise(0)).alias("count"), F.sum("n").alias("total"))
    return known.drop("masks").join(seen, "code", "left").select("kmer" if text else F.col("code").alias("kmer"), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("total", F.lit(0)).alias("total"))
