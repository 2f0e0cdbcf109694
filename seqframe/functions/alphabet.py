"""The symbol alphabet: 5-bit codes, canonical letters, types and complements, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes 0-3 nucleotides, 4-23 amino acids in letter order, then stop, gap and unknown.
NUCLEOTIDES = "ACGT"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
STOP, GAP, UNKNOWN = 24, 25, 31
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NUCLEOTIDE_CODES = {c: i for i, c in enumerate(NUCLEOTIDES)} | {"-": GAP, "N": UNKNOWN}
PROTEIN_CODES = {c: i + 4 for i, c in enumerate(AMINO_ACIDS)} | {"*": STOP, "-": GAP, "X": UNKNOWN}


def canonical_nucleotides(seq: Column) -> Column:
    """Upper-case ACGT; U reads as T, a dot as a gap, anything else as N. Length is kept."""
    return F.regexp_replace(F.translate(seq, "acgtuU.", "ACGTTT-"), "[^ACGT-]", "N")


def canonical_protein(seq: Column) -> Column:
    """Upper-case residues, stop and gap; anything else as X. Length is kept."""
    return F.regexp_replace(F.translate(seq, _LOWER, _UPPER), f"[^{AMINO_ACIDS}*-]", "X")


def detect_type(seq: Column) -> Column:
    """'protein' if a letter occurs that only proteins have, else 'nucleotide'."""
    return F.when(seq.rlike("[EFILPQefilpq*]"), "protein").otherwise("nucleotide")


def nucleotides_only(seq: Column, seq_type: Column | None = None, strict: bool = True) -> Column:
    """``seq`` where it is a nucleotide sequence; a protein is an error or, if not strict, null. Without ``seq_type`` the letters decide."""
    protein = (detect_type(seq) if seq_type is None else seq_type) == "protein"
    refused = F.raise_error(F.lit("a protein where only nucleotide sequences are defined")) if strict else F.lit(None)
    return F.when(protein, refused.cast("string")).otherwise(seq)


def canonical(seq: Column, seq_type: Column | None = None) -> Column:
    seq_type = detect_type(seq) if seq_type is None else seq_type
    return F.when(seq_type == "protein", canonical_protein(seq)).otherwise(canonical_nucleotides(seq))


def codes(seq: Column, protein: bool = False) -> Column:
    """The 5-bit codes of a canonical sequence, as an array."""
    table = PROTEIN_CODES if protein else NUCLEOTIDE_CODES
    letters = "".join(table)
    values = F.array(*(F.lit(v) for v in table.values()))
    each = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.transform(each, lambda c: F.get(values, F.position(c, F.lit(letters)) - 1))


def letters(code_array: Column, protein: bool = False) -> Column:
    """A sequence from its codes; codes outside the family read as '?'."""
    table = PROTEIN_CODES if protein else NUCLEOTIDE_CODES
    by_code = {v: k for k, v in table.items()}
    signs = F.lit("".join(by_code.get(i, "?") for i in range(32)))
    return F.array_join(F.transform(code_array, lambda c: F.substr(signs, c + 1, F.lit(1))), "")


def reverse_complement(seq: Column) -> Column:
    """A and T, C and G change places, N and gaps stay, and the order is reversed."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))
