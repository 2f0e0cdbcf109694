"""Mutation tables and the pair pipeline: align DNA, translate, align proteins, classify."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SeqValueError
from ..functions.alphabet import detect_type
from ..functions.sequences import change_impact, translate_orf
from .alignment import align


def explode_mutations(aligned: DataFrame, *keep: str, column: str = "alignment") -> DataFrame:
    """One row per mutation, in order (ordinal from 0)."""
    return aligned.select(*keep, F.posexplode(f"{column}.mutations").alias("ordinal", "m")).select(*keep, "ordinal", "m.*")


def mutations_from_strings(aligned: DataFrame, key: str, a_col: str = "aligned_a", b_col: str = "aligned_b") -> DataFrame:
    """The same table from aligned strings alone: running counts of the symbols before each column give the places."""
    letters = lambda c: F.filter(F.split(F.col(c), ""), lambda x: x != "")
    each = aligned.select(key, F.posexplode(F.arrays_zip(letters(a_col).alias("x"), letters(b_col).alias("y"))).alias("col", "z")).select(key, "col", F.col("z.x").alias("x"), F.col("z.y").alias("y"))
    before = Window.partitionBy(key).orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    place = lambda c: F.coalesce(F.sum((F.col(c) != "-").cast("int")).over(before), F.lit(0)).cast("int")
    kind = F.when(F.col("y") == "-", "deletion").when(F.col("x") == "-", "insertion").otherwise("substitution")
    return each.withColumns({"pos_a": place("x"), "pos_b": place("y")}).where("x <> y").select(key, kind.alias("kind"), "pos_a", "pos_b", F.col("x").alias("sym_a"), F.col("y").alias("sym_b"))


def with_impact(mutations: DataFrame) -> DataFrame:
    """Adds impact: of substitutions conservative or radical, else null."""
    return mutations.withColumn("impact", F.when(F.col("kind") == "substitution", change_impact(F.col("sym_a"), F.col("sym_b"))))


def rollup_mutations(mutations: DataFrame, *keys: str) -> DataFrame:
    """Counts by the keys, with all subtotals and the total."""
    return mutations.rollup(*keys).agg(F.count(F.lit(1)).alias("n"))


def first_of_each_file(records: DataFrame, file_col: str = "file", order_col: str = "seq_id") -> DataFrame:
    """Each task finds the first of its records, so no task has all of a file's; select the columns that are needed before."""
    first = F.min_by(F.struct(*(F.col(c) for c in records.columns)), F.struct(order_col)).alias("__first")  # a struct, so that nulls come first
    return records.groupBy(F.col(file_col).alias("__file")).agg(first).select("__first.*")


def mutation_pipeline(pairs: DataFrame, mode: str = "both", *, a_col: str = "a", b_col: str = "b", strict: bool = False) -> DataFrame:
    """All columns of ``pairs`` with effective_mode, dna and protein alignments (null where the mode leaves them out), proteins and silent.

    mode: dna, protein or both; pairs of proteins are aligned as proteins in any mode. Pairs of unlike
    types get no alignment, or an error if strict.
    """
    if mode not in ("dna", "protein", "both"):
        raise SeqValueError("mode must be 'dna', 'protein' or 'both'")
    a, b = F.col(a_col), F.col(b_col)
    type_a, type_b = detect_type(a), detect_type(b)
    unlike = F.raise_error(F.lit("sequences of unlike types")).cast("string") if strict else F.lit(None).cast("string")
    found = pairs.withColumn("effective_mode", F.when(type_a != type_b, unlike).when(type_a == "protein", "protein").otherwise(mode))
    is_dna = F.col("effective_mode").isin("dna", "both") & (type_a == "nucleotide")
    wants = F.col("effective_mode").isin("protein", "both")
    residues = lambda s, kind: F.when(wants, F.when(kind == "protein", s).otherwise(translate_orf(s)))
    found = found.withColumns({"protein_a": residues(a, type_a), "protein_b": residues(b, type_b)})
    found = found.withColumns({"dna": align(F.when(is_dna, a), F.when(is_dna, b)), "protein": align(F.col("protein_a"), F.col("protein_b"))})
    found = found.withColumns({c: F.when(F.col(f"{c}.score").isNotNull(), F.col(c)) for c in ("dna", "protein")})
    return found.withColumn("silent", (F.size("dna.mutations") > 0) & (F.size("protein.mutations") == 0))
