"""Line limits go with the host's size, and short lines count."""

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import lines


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def own(k, n=25):
    return " ".join(f"w{x}" for x in np.random.default_rng(k).integers(0, 10**9, n)).translate(str.maketrans("0123456789", "abcdefghij"))


def test_verdicts_do_not_change_as_the_host_grows(spark):
    """A line of 30 of 1,000 texts is an ordinary one; of 100 texts it is not."""
    ordinary, everywhere = own(10**6, 30), "all rights reserved by the house"
    rows = [(k, "hot", f"{own(k)}\n{everywhere}" + (f"\n{ordinary}" if k < 30 else "")) for k in range(1000)]
    rows += [(2000 + k, "cold", f"{own(k)}\n{everywhere}" + (f"\n{ordinary}" if k < 30 else "")) for k in range(100)]
    got = {r.doc_id: r for r in lines.judge(corpus(spark, rows)).collect()}
    assert {got[k].removed_words for k in range(1000)} == {6}
    assert {got[2000 + k].removed_words for k in range(30)} == {36} and {got[2000 + k].removed_words for k in range(30, 100)} == {6}
    texts = {r.doc_id: r.text for r in lines.clean(corpus(spark, rows)).collect()}
    assert ordinary in texts[3] and everywhere not in texts[3]


def test_near_copies_of_a_large_host_stay(spark):
    near = [(k, "hot", f"{own(1)}\n{own(2)}\ncopy {own(100 + k, 2)}") for k in range(40)]
    rows = near + [(1000 + k, "hot", own(1000 + k)) for k in range(1000)]
    assert {r.kept for r in lines.judge(corpus(spark, rows)).where(F.col("doc_id") < 40).collect()} == {True}


def test_short_lines_count(spark):
    rows = [(k, "h", f"Home\nContact us\n{own(k)}") for k in range(30)]
    menu = "\n".join(f"{a}{b}" for a in "abcde" for b in "vwxyz")
    rows += [(100 + k, "menus", menu + "\nx" + own(k, 1)) for k in range(30)]
    got = {r.doc_id: r for r in lines.judge(corpus(spark, rows)).collect()}
    assert {got[k].removed_words for k in range(30)} == {3} and all(got[k].kept for k in range(30))
    assert not any(got[100 + k].kept for k in range(30))
    assert {r.text for r in lines.clean(corpus(spark, rows)).collect()} == {own(k) for k in range(30)}
