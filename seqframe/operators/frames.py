"""Six-frame translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import reverse_complement
from ..functions.sequences import FRAME_MARK, translate_codons


def _frame_locked(s: Column) -> Column:
    """Place (from 1) of the first ATG that lies on a codon border; 0 without one."""
    marked = F.regexp_replace(s, "(...)", "$1 ")
    inside = F.regexp_instr(F.concat(F.lit(" "), marked), F.lit("(?<= )ATG "))
    return F.when(inside > 0, F.floor((inside - 2) / 4).cast("int") * 3 + 1).otherwise(F.lit(0))


def six_frames(seqs: DataFrame, *, seq_col: str = "seq", frame_locked: bool = False, ambiguous: str = "strict") -> DataFrame:
    """All columns of ``seqs`` with frame ('+1' ... '-3'), orf, orf_forward and protein, one row for each frame with a protein.

    The first ATG is searched at any place behind the frame's offset, as several frames may share a
    start; ``frame_locked`` takes only starts on the frame's own codon borders. orf counts on the
    frame's strand, orf_forward gives the place of the start's first base on the forward strand.
    """
    seq = F.col(seq_col)
    strands = F.array(F.struct(F.lit("+").alias("strand"), seq.alias("s")), F.struct(F.lit("-").alias("strand"), reverse_complement(seq).alias("s")))
    both = seqs.withColumn("__x", F.explode(strands)).withColumn("__o", F.explode(F.array(*(F.lit(i) for i in range(3)))))
    part = F.substr(F.col("__x.s"), F.col("__o") + 1, F.length("__x.s"))
    at = both.withColumn("__p", part)
    at = at.withColumn("__at", _frame_locked(F.col("__p")) if frame_locked else F.locate("ATG", F.col("__p"))).where("__at > 0")
    protein = translate_codons(F.substr(F.col("__p"), F.col("__at"), F.length("__p")), ambiguous, to_stop=True)
    orf = F.col("__at") - 1 + F.col("__o")
    forward = F.when(F.col("__x.strand") == "+", orf).otherwise(F.length("__x.s") - 1 - orf)
    out = at.select(*seqs.columns, F.concat("__x.strand", (F.col("__o") + 1).cast("string")).alias("frame"), orf.cast("int").alias("orf"), forward.cast("int").alias("orf_forward"), protein.alias("protein"))
    return out.where(F.length("protein") > 0)


def frame_header(header: Column, frame: Column, orf: Column) -> Column:
    return F.concat(F.lit(FRAME_MARK), frame, F.lit(" | ORF@"), orf.cast("string"), F.lit("] "), header)
