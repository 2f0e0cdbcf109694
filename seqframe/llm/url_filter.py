"""URL filters: rules by host and path, and a classifier on segmented host names for what no rule decides.

The words of all page texts, of any length, make a unigram model. A Viterbi pass splits each letter run
of a host or path into its most probable words: letters that are no word cost more the more there are of
them. Multinomial naive Bayes on the words of hosts and paths, learned from the pages that a rule decides,
judges the rest. The words that a rule names itself are left out: they would only repeat the rule. Rules
say nothing of how common either class is, so the classes count as equally likely beforehand, and
``least_odds`` says how much evidence it takes to block.

Words, runs and urls are tables throughout. A run's words are found by joining its substrings with the
word counts: those of up to SHORT letters as they are, longer words by their first SHORT letters. Each
distinct run is split once, each distinct url is judged once, and joins on words, runs and urls are dealt
by salt. The driver gets a few totals.

Edge cases: a url that is null or has no ``://`` has an empty host and path, fits no rule and has no words;
without words, or if no page of one of the classes is decided by a rule, the odds are 0 and the verdict is
allow, as it is for odds up to ``least_odds``; of several rules for one host and path the one given first
holds; repeated rows and null ids get results of their own; an empty table gives an empty result; extra
columns are ignored; long urls and words are taken whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, pick, salted, work_path

#: Words of up to so many letters are looked up by all substrings of a run; longer ones by their beginning.
SHORT = 24
#: What an unknown stretch costs beyond a word seen once, and what each of its letters costs.
UNKNOWN, LETTER = 2.0, 2.3
#: What a word adds to the counts of each class.
SMOOTH = 0.5
_TAGS = r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>"
_RUNS = r"\p{L}+|\p{Nd}+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- urls and rules


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the rules (verdict, host/path) that fits, the first given of equal ones; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(reversed(rules), key=lambda r: len(r[1])):  # what is tried last wins
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _url_id() -> Column:
    return F.unhex(F.sha2(F.concat("host", "path"), 256))  # a path that is not empty begins with a slash, a host has none


def runs_of(text: Column) -> Column:
    """The letter runs and digit runs of a text, in order, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_RUNS})"), F.lit(1))


# --- the unigram model


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): the letter runs, in lower case, of all rows (html) without tags, scripts and styles."""
    plain = F.lower(F.regexp_replace("html", _TAGS, " "))
    return texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def words_within(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words, counts): of each run those counted words that occur in it."""
    named = runs.select(F.unhex(F.sha2("run", 256)).alias("id"), "run")
    starts = named.select("id", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"))
    sizes = starts.select("id", "run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(SHORT), F.length("run") - F.col("start") + 1))).alias("size"))
    parts = sizes.select("id", F.substr("run", F.col("start"), F.col("size")).alias("word"), (F.col("size") == SHORT).alias("long"))
    found = salted(parts.distinct(), words.where(F.length("word") <= SHORT), "word", "id").select("id", "word", "n")

    begin = F.substr("word", F.lit(1), F.lit(SHORT))
    far = words.where(F.length("word") > SHORT).select(begin.alias("begin"), F.col("word").alias("longer"), "n")
    begins = parts.where("long").select("id", F.col("word").alias("begin")).distinct()
    more = salted(begins, far, "begin", "id").join(named, "id").where(F.contains("run", "longer")).select("id", F.col("longer").alias("word"), "n")
    sets = found.unionByName(more).groupBy("id").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("counts"))
    return named.join(sets, "id", "left").select("run", "words", "counts")


def best_split(run: str, counts: dict[str, int], total: int) -> tuple[str, ...]:
    """The split of least cost. A word costs minus the logarithm of its share; a stretch of no words what a word seen once costs, UNKNOWN more and LETTER for each letter."""
    first = math.log(max(total, 1)) + UNKNOWN
    cost = {w: math.log(total / n) for w, n in counts.items()}
    sizes = sorted({len(w) for w in cost})
    n = len(run)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    open_cost, open_at = [math.inf] * (n + 1), [0] * (n + 1)  # of splits that end in a stretch of no words
    for end in range(1, n + 1):
        begun, longer = best[end - 1] + first + LETTER, open_cost[end - 1] + LETTER
        open_cost[end], open_at[end] = (longer, open_at[end - 1]) if longer < begun else (begun, end - 1)
        best[end], back[end] = open_cost[end], open_at[end]
        for size in sizes:
            if size > end:
                break
            price = cost.get(run[end - size : end])
            if price is not None and best[end - size] + price < best[end]:
                best[end], back[end] = best[end - size] + price, end - size
    out, at = [], n
    while at:
        out.append(run[back[at] : at])
        at = back[at]
    return tuple(reversed(out))


def split_runs(runs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(run, split) of distinct letter runs (run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            splits = [best_split(r, dict(zip(w or (), n or (), strict=True)), total) for r, w, n in zip(names, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(splits, pa.list_(pa.string()))], names=["run", "split"])

    return words_within(runs, words).mapInArrow(lean(run), "run string, split array<string>")


# --- the classifier


def word_odds(counts: DataFrame) -> DataFrame:
    """(token, odds): log odds of block of each token, from its counts (token, block, allow) with SMOOTH added; none if a class has no tokens."""
    sums = counts.agg(F.sum("block"), F.sum("allow"), F.count(F.lit(1))).first()
    block, allow, distinct = (int(x or 0) for x in sums)
    if not block or not allow:
        return counts.where("false").select("token", F.lit(0.0).alias("odds"))
    share = math.log((allow + SMOOTH * distinct) / (block + SMOOTH * distinct))
    return counts.select("token", (F.log((F.col("block") + SMOOTH) / (F.col("allow") + SMOOTH)) + F.lit(share)).alias("odds"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_odds: float = 3.0) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, the host's words, and the log odds of block (blocked above ``least_odds`` where no rule fits)."""
    base = work_path(pages.sparkSession, "urls")
    rows = pick(pages, page_id=id_col, url=url_col)
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # stored with the task that read them: equal rows of many tasks are dealt apart by it later on
    rows = materialize(rows.withColumn("url", _url_id()).withColumn("task", F.spark_partition_id()), f"{base}/rows")
    name, said = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages")).withColumns({"rule": name, "said": said}).withColumn("url", _url_id())
    urls = materialize(urls, f"{base}/urls", 8)

    # what each url consists of: digit runs count as one token for their number of places
    def marked(column: str) -> Column:
        return F.transform(runs_of(F.col(column)), lambda x: F.struct(F.lit(column[0]).alias("kind"), x.alias("run")))

    parts = F.concat(marked("host"), marked("path"))
    each = urls.select("url", "said", "pages", F.posexplode(parts).alias("place", "x")).select("url", "said", "pages", "place", "x.*")
    sizes = each.groupBy("kind", "run").agg(*(F.sum(F.when(F.col("said") == s, F.col("pages")).otherwise(0)).alias(s) for s in ("block", "allow")))
    sizes = materialize(sizes, f"{base}/runs", 8)
    words = materialize(count_words(pick(pages, html=text_col)), f"{base}/words", 2)
    total = words.agg(F.sum("n")).first()[0] or 0
    split = split_runs(sizes.where("run rlike '^\\\\p{L}'").select("run").distinct(), words, total)
    known = sizes.join(split, "run", "left").withColumn("split", F.coalesce("split", F.array("run")))
    known = materialize(known, f"{base}/split", 8)

    # tokens, but for the words of a rule
    named = sorted({w for _, rule in rules for w in re.findall(r"[^\W\d_]+|\d+", rule.lower())})
    token = F.when(F.col("word").rlike(r"^\p{Nd}"), F.concat("kind", F.lit("#"), F.length("word").cast("string"))).otherwise(F.concat("kind", F.lit(":"), "word"))
    tokens = known.select("kind", "run", "block", "allow", F.explode("split").alias("word")).where(~F.col("word").isin(named) if named else F.lit(True)).withColumn("token", token)
    counts = tokens.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).where("block + allow > 0")
    counts = materialize(counts, f"{base}/counts", 8)
    run_odds = salted(tokens.select("kind", "run", "token"), word_odds(counts), "token", "run").groupBy("kind", "run").agg(F.sum("odds").alias("odds"))
    known = known.select("kind", "run", "split").join(run_odds, ["kind", "run"], "left").withColumn("key", F.concat("kind", "run")).select("key", "split", "odds")

    scored = salted(each.select("url", "place", "kind", F.concat("kind", "run").alias("key")), known, "key", "url").groupBy("url").agg(
        F.sum("odds").alias("odds"), F.array_sort(F.collect_list(F.when(F.col("kind") == "h", F.struct("place", "split")))).alias("host_parts")
    )
    judged = urls.join(scored, "url", "left").select("url", "rule", "said", F.coalesce("odds", F.lit(0.0)).alias("odds"), F.coalesce(F.flatten(F.col("host_parts.split")), F.array().cast("array<string>")).alias("host_words"))
    judged = materialize(judged, f"{base}/judged", 8)
    verdict = F.coalesce("said", F.when(F.col("odds") > least_odds, "block").otherwise("allow"))
    out = salted(rows, judged, "url", "page_id", "task")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "host_words", F.round("odds", 9).alias("block_odds"))
