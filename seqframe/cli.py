"""python -m seqframe.cli {mutations,qc,bgzip}: reports on files. Any error ends with status 1."""

from __future__ import annotations

import argparse
import sys

from .errors import SeqError, SeqIOError, SeqValueError


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("seqframe").getOrCreate()


def _write(text: str, path: str | None) -> None:
    print(text)
    if path:
        with open(path, "w") as f:
            f.write(text + "\n")


def mutation_report(reference: str, query: str, mode: str = "both") -> str:
    """Compares the first records of two FASTA files."""
    from pyspark.sql import functions as F

    from .operators.mutations import mutation_pipeline
    from .report import mutation_text
    from .sources.fasta import read_fasta

    spark = _session()
    first = lambda path: read_fasta(spark, path).orderBy("seq_id").limit(1)
    pair = first(reference).select(F.col("seq").alias("a"), F.col("header").alias("name_a")).crossJoin(first(query).select(F.col("seq").alias("b"), F.col("header").alias("name_b")))  # one row each
    row = mutation_pipeline(pair, mode, strict=True).first()
    if row is None:
        raise SeqValueError("a file has no record")
    row = row.asDict(recursive=True)
    return f"{row['name_a']} and {row['name_b']}\n{mutation_text(row)}"


def quality_report(path: str) -> str:
    from .operators.quality_control import report
    from .report import quality_text
    from .sources.fastq import read_fastq

    return quality_text(report(read_fastq(_session(), path).select("read_id", "seq", "qual")), path)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="seqframe", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("mutations")
    p.add_argument("reference")
    p.add_argument("query")
    p.add_argument("--mode", default="both", choices=("dna", "protein", "both"))
    p.add_argument("--out")
    p = commands.add_parser("qc")
    p.add_argument("path")
    p.add_argument("--out")
    p = commands.add_parser("bgzip")
    p.add_argument("path")
    p.add_argument("--out")
    p.add_argument("--level", type=int, default=6)
    a = parser.parse_args(args)
    try:
        if a.command == "mutations":
            _write(mutation_report(a.reference, a.query, a.mode), a.out)
        elif a.command == "qc":
            _write(quality_report(a.path), a.out)
        else:
            from .sources.bgzf import compress_file

            print(compress_file(a.path, a.out, a.level))
    except (SeqError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # noqa: BLE001  Spark's own errors
        print(f"error: {SeqIOError(str(e).splitlines()[0])}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
