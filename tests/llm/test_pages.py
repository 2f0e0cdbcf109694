from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqframe.llm import url_filter as uf
from seqframe.llm import warc
from seqframe.llm.queries import URL_RULES
from tests.llm.conftest import SF


@pytest.fixture
def pages(spark):
    def build(rows):
        return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, strong string, keeper string, Host string")

    return build


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


URLS = ["http://A.Example.NET/en/x", "http://example.net/en/", "http://example.net/fr/", "http://net/", "http://notexample.net/en/y", "https://x.example.com/de/1?q#f", "https://example.com.de/de/", "ftp://q.org/fr/", "http://q.org/fr", "http://q.org?x://y/fr/", "http://net", "no scheme", "", None, "http:///path", "x://a.net/en/#z", "http://ÄB.net/EN/", "a\nb://h.net/p\nq"]


def test_hosts_paths_and_rules(pages):
    rows = {r["page_id"]: r for r in uf.judge_urls(pages([(i, u, "<p>some words") for i, u in enumerate(URLS)]), URL_RULES).collect()}
    for i, url in enumerate(URLS):
        host, path = parsed(url)
        fitting = []
        for verdict, rule in URL_RULES:
            h, p = rule[: rule.index("/")], rule[rule.index("/") :]
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fitting.append((len(rule), rule, verdict))
        best = max(fitting, default=(0, None, None))
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, best[1]), url
        assert rows[i]["verdict"] in ("allow", "block") and best[2] in (None, rows[i]["verdict"])


def every_split(run):
    if not run:
        yield ()
    for i in range(1, len(run) + 1):
        for rest in every_split(run[i:]):
            yield (run[:i], *rest)


def cost_of(split, counts, total):
    return sum(math.log(total / counts[w]) if w in counts else math.log(total) + uf.UNKNOWN + uf.LETTER * len(w) for w in split)


def test_viterbi_against_all_splits():
    rng = random.Random(3)
    for _ in range(150):
        counts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.randint(1, 60) for _ in range(rng.randint(0, 8))}
        total = sum(counts.values()) + rng.randint(0, 5)
        run = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        split = uf.best_split(run, counts, total or 1)
        assert "".join(split) == run
        assert cost_of(split, counts, total or 1) == pytest.approx(min(cost_of(s, counts, total or 1) for s in every_split(run)))


def test_words_within_runs(spark):
    """All counted words that a run holds, however long; many words that begin alike; a long run."""
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    words = {long[i : i + n]: i + 1 for i, n in ((0, 1), (5, 24), (5, 25), (5, 26), (9, 700), (2000, 1000), (40, 3))} | {long[5:29] + "zz": 3, "größe": 7, "ö": 2}
    runs = [long, "größe", "x", long[5:31], long[:2]]
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = uf.words_within(spark.createDataFrame([(r,) for r in runs], "run string"), table).collect()
    assert {r["run"]: dict(zip(r["words"] or [], r["counts"] or [], strict=True)) for r in got} == {r: {w: n for w, n in words.items() if w in r} for r in runs}


def test_words_are_counted_whole(spark):
    html = [("<b>One</b> one<script>two</script> É é Größe INTERNATIONALIZATIONFORALLOFUSINTHEWORLD x1y",), (None,), ("one<style>\nx</style>",)]
    words = {r["word"]: r["n"] for r in uf.count_words(spark.createDataFrame(html, "html string")).collect()}
    assert words == {"one": 3, "é": 2, "größe": 1, "internationalizationforallofusintheworld": 1, "x": 1, "y": 1}


def plain_verdicts(rows, rules, least):
    """The operator in plain Python: word counts, splits by all words, naive Bayes."""
    import regex

    words = Counter(w for _, _, html in rows if html for w in regex.findall(r"\p{L}+", regex.sub(r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>", " ", html).lower()))
    total = sum(words.values())
    named = {w for _, rule in rules for w in regex.findall(r"\p{L}+|\p{Nd}+", rule)}

    def tokens(url):
        out = []
        for kind, text in zip("hp", parsed(url), strict=True):
            for run in regex.findall(r"\p{L}+|\p{Nd}+", text.lower()):
                out += [f"{kind}#{len(run)}"] if run.isdigit() and run not in named else [f"{kind}:{w}" for w in uf.best_split(run, words, total) if w not in named and not run.isdigit()]
        return out

    def rule_of(url):
        host, path = parsed(url)
        fitting = [(len(rule), -k, said) for k, (said, rule) in enumerate(rules) if (host == rule[: rule.index("/")] or host.endswith("." + rule[: rule.index("/")])) and path.startswith(rule[rule.index("/") :])]
        return max(fitting)[2] if fitting else None

    sides = {"block": Counter(), "allow": Counter()}
    for _, url, _ in rows:
        if said := rule_of(url):
            sides[said].update(tokens(url))
    block, allow = sides["block"], sides["allow"]
    distinct = len(block | allow)
    odds = {}
    if block and allow:
        odds = {t: math.log((block[t] + 0.5) / (block.total() + 0.5 * distinct)) - math.log((allow[t] + 0.5) / (allow.total() + 0.5 * distinct)) for t in block | allow}
    out = []
    for page, url, _ in rows:
        score = sum(odds.get(t, 0.0) for t in tokens(url))
        out.append((page, rule_of(url) or ("block" if score > least else "allow"), score))
    return out


RULES = [("block", "bad.org/"), ("allow", "good.org/")]


def mixed(n, seed):
    rng = random.Random(seed)
    parts = ["casino", "bet", "win", "garden", "news", "essex", "sussex", "42", "größe", "co", "shop"]
    rows = []
    for i in range(n):
        side = rng.choice(["bad.org", "good.org", "other.example"])
        lean_ = parts[:5] if side == "bad.org" else parts[3:] if side == "good.org" else parts
        rows.append((rng.choice([i, i, 7, None]), f"http://{rng.choice(lean_)}{rng.choice(lean_)}.{side}/{rng.choice(lean_)}/{rng.randint(0, 2000)}", rng.choice(["<p>casino bet win garden news", "essex sussex shop and größe co", None, "win the bet"])))
    return rows


def test_verdicts_against_plain_python(pages):
    rows = mixed(300, 9) + [(900 + i, u, "<p>word") for i, u in enumerate(URLS)] + [(7, "http://casinobet.other.example/win/1", "x")] * 5
    got = sorted(((r["page_id"], r["verdict"], round(r["block_odds"], 6)) for r in uf.judge_urls(pages(rows), RULES).collect()), key=str)
    want = sorted(((p, v, round(s, 6)) for p, v, s in plain_verdicts(rows, RULES, 3.0)), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-6)
    assert {v for _, v, _ in want} == {"allow", "block"}


def test_harmless_hosts_are_allowed(pages):
    hosts = ["essex.edu", "sussex.ac.uk", "winwin.com", "middlesex.gov", "expertsexchange.com"]
    rows = mixed(200, 2) + [(1000 + i, f"http://www.{h}/", "<p>sex win casino") for i, h in enumerate(hosts)]
    got = {r["page_id"]: r["verdict"] for r in uf.judge_urls(pages(rows), RULES).where("page_id >= 1000").collect()}
    assert len(got) == len(hosts) and "block" not in [v for k, v in got.items() if k != 1002]


def test_without_rules_words_or_rows(pages):
    assert uf.judge_urls(pages([]), URL_RULES).count() == 0
    one_class = [(i, f"http://casino{i}.net/x", "<p>casino") for i in range(5)] + [(9, "http://casino.example/x", None), (10, None, None)]
    got = {r["page_id"]: (r["verdict"], r["block_odds"]) for r in uf.judge_urls(pages(one_class), URL_RULES).collect()}
    assert got[9] == got[10] == ("allow", 0.0) and got[0][0] == "block"
    assert {r["verdict"] for r in uf.judge_urls(pages(one_class), []).collect()} == {"allow"}


def test_ties_of_rules_and_words_of_equal_count(pages):
    rules = [("allow", "a.com/x"), ("block", "b.a.com"[2:] + "/x")]  # the same rule twice: the first one holds
    assert [r["verdict"] for r in uf.judge_urls(pages([(1, "http://q.a.com/xy", "<p>w")]), rules).collect()] == ["allow"]
    text = " ".join("".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(3000))
    split = uf.judge_urls(pages([(1, "http://aaabaacaa.com/", text)]), []).first()["host_words"]
    assert split == ["aaa", "baa", "caa", "com"]


def test_long_urls(pages):
    long = "http://" + "ab" * 2000 + ".com/" + "x/" * 2000
    row = uf.judge_urls(pages([(1, long, "<p>" + "ab" * 30 + " ab"), (1, long, None), (None, long, None)]), URL_RULES).collect()
    assert len(row) == 3 and all("".join(r["host_words"]) == "ab" * 2000 + "com" for r in row)


PAGES = [(1, "http://a/", "same"), (5, "http://b/\r\nX: y", "same"), (3, None, "same"), (2, "http://c/", None), (9, "http://d/", ""), (7, "http://e/", "é" * 5000), (7, "http://e/", "é" * 5000), (7, "http://e/", "é" * 5000), (7, "http://f/%41 🙂", "other"), (None, "http://g/", "none"), (None, None, "none"), (-4, "", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n")]


def archive_bytes(folder):
    import glob
    import gzip

    return b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{folder}/warc/part-*")))


def digest32(raw):
    import base64

    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def expected(rows, least=0):
    """By the contract's words: of equal payloads one record of the largest page_id is a response."""
    out = []
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    for raw, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            response = len(raw) < least
            if not response and i == top and left:
                response, left = True, 0
            out.append((i, len(raw), digest32(raw), "response" if response else "revisit", None if response else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5, 1 << 40])
def test_archive_round_trip(pages, spark, tmp_path, least):
    where = f"file://{tmp_path}/w"
    warc.write_archive(pages(PAGES), where, min_bytes=least)
    rows = warc.archive_report(spark, where, f"{where}/store").collect()
    assert sorted((tuple(r) for r in rows), key=str) == expected(PAGES, least)
    payloads, headers = warc.split_archive(spark, where, f"{where}/again")
    assert sorted(bytes(r["payload"]) for r in payloads.collect()) == sorted({(h or "").encode() for _, _, h in PAGES})
    rebuilt = warc.rebuild_records(payloads, headers).collect()
    whole = archive_bytes(f"{tmp_path}/w")
    assert sum(len(r["record"]) for r in rebuilt) == len(whole) and all(bytes(r["record"]) in whole for r in rebuilt)
    assert len({bytes(r["record"]) for r in rebuilt}) == len(PAGES)  # each record has a name of its own
    pages_back = warc.rebuild_pages(payloads, headers).collect()
    assert sorted((str(r["page_id"]), str(r["url"]), bytes(r["payload"])) for r in pages_back) == sorted((str(i), str(u), (h or "").encode()) for i, u, h in PAGES)
    assert b"\r\nX: y" not in whole and b"http://b/%0D%0AX:%20y" in whole


def test_archive_files_parse_by_the_format(pages, tmp_path):
    """A reader of its own: header lines up to a blank one, then Content-Length bytes and two line ends."""
    warc.write_archive(pages(PAGES), f"file://{tmp_path}/w")
    raw, n = archive_bytes(f"{tmp_path}/w"), 0
    while raw:
        head, _, raw = raw.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        block, raw, n = raw[:size], raw[size:], n + 1
        http, _, payload = block.partition(b"\r\n\r\n")
        if b"WARC-Type: response" in head:
            assert int(re.search(rb"Content-Length: (\d+)", http)[1]) == len(payload) and hashlib.sha256(payload).hexdigest().encode() in head
        else:
            assert payload == b""
        assert raw.startswith(b"\r\n\r\n")
        raw = raw[4:]
    assert n == len(PAGES)


def test_an_archive_replaces_the_one_before(pages, spark, tmp_path):
    where = f"file://{tmp_path}/w"
    warc.write_archive(pages([(i, f"http://a/{i}", f"page {i % 7}") for i in range(40)]), where)
    assert warc.archive_report(spark, where, f"{where}/store").count() == 40
    warc.write_archive(pages(PAGES[:3]), where)
    assert warc.archive_report(spark, where, f"{where}/store").count() == 3
    warc.write_archive(pages([]), where)
    assert warc.archive_report(spark, where, f"{where}/store").count() == 0


def test_large_payloads_take_more_files(pages, spark, tmp_path, monkeypatch):
    import glob

    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    monkeypatch.setattr(warc, "HELD_BYTES", 500)
    rows = [(i, f"http://a/{i}", f"{i} " * 400) for i in range(60)]
    warc.write_archive(pages(rows), f"file://{tmp_path}/w")
    assert len(glob.glob(f"{tmp_path}/w/warc/part-*")) > 20
    got = warc.archive_report(spark, f"file://{tmp_path}/w", f"file://{tmp_path}/s").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_a_shared_payload_is_dealt_over_the_tasks(pages, spark):
    from seqframe.llm.common import salted

    rows = spark.range(4000).selectExpr("id", "'hot' as strong")
    one = spark.createDataFrame([("hot", 1)], "strong string, x long")
    dealt = salted(rows, one, "strong", "id")
    assert dealt.count() == 4000 and dealt.where("x = 1").count() == 4000


def test_a_changed_payload_is_found(pages, spark, tmp_path):
    import glob
    import gzip
    import os

    warc.write_archive(pages([(1, "http://a/", "payload one")]), f"file://{tmp_path}/w")
    (name,) = [f for f in glob.glob(f"{tmp_path}/w/warc/part-*") if gzip.open(f).read()]
    broken = gzip.open(name).read().replace(b"payload one", b"payload two")
    crc = f"{os.path.dirname(name)}/.{os.path.basename(name)}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    with open(name, "wb") as f:
        f.write(gzip.compress(broken))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.archive_report(spark, f"file://{tmp_path}/w", f"file://{tmp_path}/s").collect()


def test_a_missing_payload_is_found(pages, spark, tmp_path):
    warc.write_archive(pages(PAGES), f"file://{tmp_path}/w")
    payloads, headers = warc.split_archive(spark, f"file://{tmp_path}/w", f"file://{tmp_path}/s")
    with pytest.raises(Exception, match="payload is missing"):
        warc.rebuild_records(payloads.where("payload_bytes <> 4"), headers).select("payload_digest").collect()


def test_on_the_tables(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_archive(table, f"file://{tmp_path}/w")
    got = warc.rebuild_pages(*warc.split_archive(spark, f"file://{tmp_path}/w", f"file://{tmp_path}/s")).select("page_id", "url", F.sha1("payload").alias("s"))
    assert sorted((r["page_id"], r["url"], r["s"]) for r in got.collect()) == sorted((r["page_id"], r["url"], hashlib.sha1(r["html"].encode()).hexdigest()) for r in table.collect())
