"""Text reports, rendered on the driver from small collected tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import SeqValueError
from .functions.sequences import BASE_NAMES, RESIDUE_NAMES
from .operators.quality_control import QCReport

#: Ten levels of the sparkline, least first.
_RAMP = "_,;!ixoXO8"
#: From this least mean quality on, a whole run is good.
GOOD_QUALITY = 28


def sparkline(values: list[float], width: int = 60) -> str:
    """Ten levels from the least to the greatest value, of evenly spaced values if there are more than ``width``."""
    if not values:
        return ""
    if len(values) > width:
        values = [values[round(i * (len(values) - 1) / (width - 1))] for i in range(width)]
    low, high = min(values), max(values)
    return "".join(_RAMP[-1] if high == low else _RAMP[min(9, int(10 * (v - low) / (high - low)))] for v in values)


def bars(histogram: dict[int, int], low: int, high: int, step: int, width: int = 40) -> list[str]:
    """A line per bucket; the last one is open to the right."""
    if step < 1:
        raise SeqValueError("step must be at least 1")
    counts = {lo: 0 for lo in range(low, high + 1, step)}
    for b, n in histogram.items():
        if b >= low:
            counts[min((b - low) // step * step + low, max(counts))] += n
    peak = max(counts.values(), default=0) or 1
    return [f"{lo:>4}{'+' if lo == max(counts) else ' '} {'#' * int(width * n / peak + 0.5)} {n}" for lo, n in counts.items()]


def diagnosis(means: list[float]) -> str:
    if not means:
        return "no positions"
    if min(means) >= GOOD_QUALITY:
        return "good quality over the whole length"
    return "quality drops towards the end" if means[-1] < means[0] else "irregular quality"


def quality_text(r: QCReport, title: str = "reads") -> str:
    s = r.scalars
    means = [p["mean_q"] for p in r.positions]
    total = {b: sum(p[f"{b}_share"] for p in r.bases) for b in ("a", "c", "g", "t", "other")}
    whole = sum(total.values()) or 1
    lines = [
        f"Quality of {title}",
        f"reads {s['n_reads']}, bases {s['total_bases']}, length {s['min_len']} to {s['max_len']} (mean {s['mean_len']:.1f})",
        f"GC {100 * s['gc']:.2f} %, mean quality {s['mean_q']:.2f}, Q20 {s['pct_q20']:.1f} %, Q30 {s['pct_q30']:.1f} %",
        "",
        "Mean quality of reads",
        *bars(r.quality_histogram, 0, 45, 5),
        "",
        "GC of reads, per cent",
        *bars(r.gc_histogram, 0, 100, 10),
        "",
        f"Quality by position: {sparkline(means)}",
        diagnosis(means),
        "Bases: " + ", ".join(f"{'N' if b == 'other' else b.upper()} {100 * v / whole:.1f} %" for b, v in total.items()),
    ]
    return "\n".join(lines)


def _listed(mutations: list, names: dict[str, str], most: int) -> list[str]:
    out = []
    for m in mutations[:most]:
        if m["kind"] == "substitution":
            out.append(f"  {m['pos_a'] + 1}: {names.get(m['sym_a'], m['sym_a'])} to {names.get(m['sym_b'], m['sym_b'])}")
        elif m["kind"] == "deletion":
            out.append(f"  {m['pos_a'] + 1}: {names.get(m['sym_a'], m['sym_a'])} lost")
        else:
            out.append(f"  {m['pos_b'] + 1} of the query: {names.get(m['sym_b'], m['sym_b'])} gained")
    if len(mutations) > most:
        out.append(f"  and {len(mutations) - most} more")
    return out


def mutation_text(row: dict) -> str:
    """Report on one row of the mutation pipeline; positions count from 1."""
    from .functions.sequences import LIKE_RESIDUES

    lines = []
    for part, names, most in (("dna", BASE_NAMES, 60), ("protein", RESIDUE_NAMES, 55)):
        found = row.get(part)
        if found is None:
            continue
        kinds = [m["kind"] for m in found["mutations"]]
        lines += [f"{part}: score {found['score']}, identity {100 * found['identity']:.2f} %, substitutions {kinds.count('substitution')}, deletions {kinds.count('deletion')}, insertions {kinds.count('insertion')}"]
        lines += _listed(found["mutations"], names, most)
    if row.get("silent"):
        lines.append("the DNA changes leave the protein as it is")
    elif row.get("protein") is not None:
        changes = [m for m in row["protein"]["mutations"] if m["kind"] == "substitution"]
        radical = sum(not any(m["sym_a"] in g and m["sym_b"] in g for g in LIKE_RESIDUES) for m in changes)
        lines.append(f"residues exchanged: {len(changes)}, of these radical {radical}")
    return "\n".join(lines)


def mutation_reports(pipeline: DataFrame, key: str) -> DataFrame:
    """(key, text): the report on each row of a mutation pipeline, made in the tasks."""

    @F.pandas_udf("string")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([mutation_text(r) for r in rows.to_dict("records")], dtype=object)

    return pipeline.select(key, run(F.struct("dna", "protein", "silent")).alias("text"))
