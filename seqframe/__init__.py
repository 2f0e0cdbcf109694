"""seqframe: a PySpark-native analytics engine for biological sequence data.

The public names are loaded when they are first used, so that workers import only what a task needs.
"""

from importlib import import_module

__version__ = "0.1.0"

_PLACES = {
    "errors": "AlignmentError EngineError SeqError SeqIOError SeqTypeError SeqValueError TranslationError",
    "functions.alphabet": "canonical codes detect_type letters reverse_complement",
    "functions.sequences": "composition find_orf gc_content mean_quality quality_scores sequence_stats translate_orf",
    "operators.alignment": "align align_pairs format_alignment",
    "operators.frames": "six_frames",
    "operators.kmers": "dense_spectrum spectrum",
    "operators.mutations": "explode_mutations mutation_pipeline",
    "operators.quality_control": "filter_reads scalars",
    "sources.bgzf": "compress_bytes compress_file",
    "sources.fasta": "parse_fasta read_fasta write_fasta",
    "sources.fastq": "read_any read_fastq write_fastq",
}
_WHERE = {name: place for place, names in _PLACES.items() for name in names.split()}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
