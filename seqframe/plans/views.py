"""Sequence views derived from the driver's tables, in SQL that Spark and DuckDB both read.

{T} is the text type, {G} the regexp option for 'all', and {events} ... the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_R = """select event_id as read_id,
 translate(md5(cast(event_id as {T})), '0123456789abcdef', 'ACGTACGTACGTACGN') as seq,
 translate(md5(concat(cast(event_id as {T}), 'q')), '0123456789abcdef', '!+05:?ADFGHIIIII') as qual from {events}"""
_GENE = """translate(lower(regexp_replace(text, '[^A-Za-z]', ''{G})),
 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"""
_PROTEIN = """translate(upper(regexp_replace(text, '[^A-Za-z]', ''{G})),
 'BJOUXZ', 'DLKCGE')"""
_CODONS = ("GCT", "TGT", "GAT", "GAA", "TTT", "GGT", "CAT", "ATT", "AAA", "CTT", "AAT", "CCT", "CAA", "CGT", "TCT", "GTT")


def _coded(digits: str) -> str:
    out = f"translate({digits}, '0123456789abcdef', 'ghijklmnopqrstuv')"
    for letter, codon in zip("ghijklmnopqrstuv", _CODONS, strict=True):
        out = f"replace({out}, '{letter}', '{codon}')"
    return out


VIEWS = {
    "reads": _R,
    "ragged": f"""select read_id, substr(concat(seq, seq), 1, cast(8 + read_id % 49 as int)) as seq,
 substr(concat(qual, qual), 1, cast(8 + read_id % 49 as int)) as qual from ({_R}) r""",
    "genes": f"select doc_id as gene_id, lang, {_GENE} as seq from {{documents}}",
    "proteins": f"select doc_id as prot_id, {_PROTEIN} as seq from {{documents}}",
    "both": f"select doc_id as id, {_GENE} as g, {_PROTEIN} as p from {{documents}}",
    "alleles": """select o_orderkey as pair_id, a, p,
 case o_orderkey % 4 when 0 then a
  when 1 then concat(substr(a, 1, p), translate(substr(a, p + 1, 1), 'ACGT', 'CGTA'), substr(a, p + 2))
  when 2 then concat(substr(a, 1, p), substr(a, p + 2))
  else concat(substr(a, 1, p), translate(substr(a, p + 1, 1), 'ACGT', 'CGTA'), substr(a, p + 1)) end as b,
 case o_orderkey % 4 when 0 then 'identical' when 1 then 'substitution' when 2 then 'deletion' else 'insertion' end as kind
 from (select o_orderkey, translate(md5(cast(o_orderkey as {T})), '0123456789abcdef', 'ACGTACGTACGTACGT') as a,
  cast(4 + o_orderkey % 24 as int) as p from {orders}) t""",
    "wild": """select pair_id, substr(x, 1, cast(7 + pair_id % 6 as int)) as a,
 concat(substr(x, cast(1 + pair_id % 3 as int), 5), substr(y, 1, cast(2 + pair_id % 5 as int)), substr(x, 9, 2)) as b
 from (select o_orderkey as pair_id, translate(md5(cast(o_orderkey as {T})), '0123456789abcdef', 'ACGTACGTACGTACGT') as x,
  translate(md5(concat(cast(o_orderkey as {T}), 'x')), '0123456789abcdef', 'ACGTACGTACGTACGT') as y from {orders}) t""",
    "coding": f"""select pair_id, p, kind, h, concat('ATG', {_coded("h")}, 'TAA') as a,
 case kind when 'identical' then concat('ATG', {_coded("h")}, 'TAA')
  when 'synonymous' then concat('ATG', substr({_coded("h")}, 1, 3 * p + 2), translate(substr({_coded("h")}, 3 * p + 3, 1), 'TA', 'CG'), substr({_coded("h")}, 3 * p + 4), 'TAA')
  else concat('ATG', {_coded("concat(substr(h, 1, p), translate(substr(h, p + 1, 1), '0123456789abcdef', '123456789abcdef0'), substr(h, p + 2))")}, 'TAA') end as b
 from (select o_orderkey as pair_id, md5(cast(o_orderkey as {{T}})) as h, cast(2 + o_orderkey % 28 as int) as p,
  case o_orderkey % 3 when 0 then 'identical' when 1 then 'synonymous' else 'missense' end as kind from {{orders}}) t""",
}


def spread(df: DataFrame) -> DataFrame:
    """Deals rows over all cores where a table has few file splits (which a single row group may leave all but one empty); for work that costs far more than moving the rows.

    The layout alone depends on the number of splits, never the rows: there are never fewer parts than splits, so a part's size is bounded.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(max(cores, splits)) if splits < 8 * cores else df


#: The columns that the views of costly operators read.
_COSTLY = {"documents": ("doc_id", "lang", "text"), "orders": ("o_orderkey",), "events": ("event_id",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("events", "documents", "orders")}
    for table, columns in _COSTLY.items():
        if "{" + table + "}" in VIEWS[name]:
            tables[table] = f"spread_{uuid.uuid4().hex}"
            spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)).createOrReplaceTempView(tables[table])
    return spark.sql(VIEWS[name].format(T="string", G="", **tables))


def duck(name: str) -> str:
    """The view as a DuckDB subquery."""
    return "(" + VIEWS[name].format(T="varchar", G=", 'g'", events="events", documents="documents", orders="orders") + ")"
