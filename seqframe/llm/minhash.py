"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its word shingles, each hashed into a circle of D places. One permutation
scatters the places; a second one, shifted by k places, gives the k-th coordinate: its least value
over the set. So two permutations stand for any number of hash functions. Coordinates are cut into
bands; documents that agree on a band are candidates. The number of bands follows from the
threshold, so that two documents at the threshold share no band with a chance of at most ``miss``.

No bucket is expanded into its pairs. Documents with equal sets, by a digest of 128 bits, form classes;
each bucket's classes are compared, on the full sets, with its most central class (a star): the one that
shares the most buckets with others, as the original of a group of copies does. Where a bucket still holds
several components after that, the classes of its largest component are dealt into blocks, and those of all
others into blocks of their own; the others are compared with both inside tasks, the largest component
never with itself. Classes of one component, or of sizes that cannot reach the threshold, are passed over, and
a pair is looked at only in the first bucket that it shares. Thus every candidate pair ends verified or
inside one component, and rows grow with the size of a bucket times the blocks of classes outside its
largest component: linearly, while few stay outside. Components are found by joins.

Edge cases: a null or empty text, or one without words, has an empty set and links with nothing;
fewer words than a shingle has make one shingle; rows of one doc_id are one document, except in
``deduplicate``, which drops single rows; repeated rows get equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ROW, U64, blocks, keyed, lean, materialize, mix, pick, remove, salted, shingle_hashes, shuffle_partitions, text_views, without, word_table, work_path
from .components import connected_components

#: Places of the circle; a power of two.
PLACES = 1 << 20
ROWS_PER_BAND = 4
#: Star edges of one hub that are compared in one group; sets of one hub are sent once per group.
PER_HUB = 64
#: Classes of one block of a bucket that is not settled by its star.
BLOCK = 512


def bands_needed(threshold: float, rows: int = ROWS_PER_BAND, miss: float = 1e-7) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


@functools.lru_cache(maxsize=2)
def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    scatter = rng.permutation(PLACES).astype(np.int32)
    circle = rng.permutation(PLACES).astype(np.int32)
    return scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate([circle, circle[:coordinates]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The circulant MinHash coordinates of a non-empty set of 64-bit hashes."""
    scatter, shifted = _permutations(coordinates)
    places = scatter[(shingles >> U64(44)).astype(np.int64)]
    least = shifted[places[:4096]].min(axis=0)
    for i in range(4096, len(places), 4096):
        np.minimum(least, shifted[places[i : i + 4096]].min(axis=0), out=least)
    return least


def band_keys(signed: np.ndarray, bands: int, rows: int = ROWS_PER_BAND) -> np.ndarray:
    parts = signed[: bands * rows].reshape(bands, rows).astype(np.uint64)
    total = np.arange(1, bands + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
    for r in range(rows):
        total = mix(total + parts[:, r])
    return total.view(np.int64)


def shingle_sets(flat: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes, of 64 bits, of each row: what sets are counted and compared on."""
    starts, _, words = word_table(LOWER[flat], bounds)
    first = np.searchsorted(starts, bounds)
    return [np.unique(shingle_hashes(words[first[i] : first[i + 1]], width)) for i in range(len(bounds) - 1)]


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def sign(docs: DataFrame, width: int, threshold: tuple[int, int], bands: int) -> DataFrame:
    """doc_id, n, digest (null without words) and band keys. A set too small to reach the threshold with any other set has none."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", 1 << 20):
                sizes, digests, keys = [], [], []
                for s in shingle_sets(*text_views(block.column(1)), width):
                    n = len(s)
                    sizes.append(n)
                    digests.append(digest_of(s) if n else None)
                    reach = max(den * (n - 1) - num * n, den * n - num * (n + 1))  # with one shingle less or more
                    keys.append(band_keys(signature(s, bands * ROWS_PER_BAND), bands).tolist() if n and reach >= 0 else None)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "bands"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, digest binary, bands array<long>")


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, shingles) of the classes in ``wanted`` (cls, digest, rep): their texts are fetched by id and cut anew."""
    chosen = docs.join(wanted.select("rep").distinct().hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col("rep")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", 1 << 20):
                sets = [s for s in shingle_sets(*text_views(block.column(0)), width) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([digest_of(s) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["digest", "shingles"])

    found = chosen.select("text").mapInArrow(lean(run), "digest binary, shingles binary")
    return found.join(wanted.select("digest", "cls"), "digest").select("cls", "shingles").dropDuplicates(["cls"])


def _reaches(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> bool:
    num, den = threshold
    place = np.minimum(np.searchsorted(a, b), len(a) - 1)
    common = int((a[place] == b).sum())
    return den * common >= num * (len(a) + len(b) - common)


def _verified(edges: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of edges (a, b, size): those whose sets reach the threshold. size: that of a bucket that they share.

    A hub's edges are cut into groups of about PER_HUB, each of which gets the hub's set once, so
    that no task holds all edges of a hub; rows stream through in sorted order, one hub set in memory.
    """
    dealt = edges.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / PER_HUB)).alias("part"))
    hubs = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("cls", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "shingles")
    spokes = dealt.join(sets.withColumnRenamed("cls", "b"), "b").select("a", "part", "b", "shingles")
    rows = hubs.unionByName(spokes).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, part, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                s = _unpacked(raw.as_py())
                if b is None:
                    at, hub = (a, part), s
                    continue
                if at != (a, part):
                    raise ValueError("a hub's set is missing")
                if _reaches(hub, s, threshold):
                    out.append((a, b))
            yield _pairs(out)

    return rows.mapInArrow(lean(run), "a long, b long")


def _block_links(rows: DataFrame, tops: DataFrame, bands: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links between components in buckets: rows (key, cls, label, n) and each bucket's largest component, tops (key, top, n_top, size) -> (a, b).

    Groups are dealt on the narrow rows; the classes' ``bands`` and ``sets`` join them last. A group holds a block of the largest component and one of the others (kind 0), or two blocks of the
    others (kind 1): 2 * BLOCK classes or so, whatever the bucket's size.
    """
    num, den = threshold
    dealt = salted(rows, tops, "key", "cls").withColumn("inner", F.col("label") == F.col("top"))
    blocks_in, blocks_out = (F.ceil(n / BLOCK).cast("int") for n in (F.col("n_top"), F.col("size") - F.col("n_top")))
    place = F.struct(F.lit(0).alias("kind"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side"))

    def at(kind: int, lo: Column, hi: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), side.cast("int").alias("side"))

    def each(many: Column, f) -> Column:
        return F.when(many > 0, F.transform(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), f)).otherwise(F.array_remove(F.array(place), place))

    own_in, own_out = (F.pmod(F.xxhash64("cls"), F.greatest(b, F.lit(1))).cast("int") for b in (blocks_in, blocks_out))
    inner = each(blocks_out, lambda k: at(0, own_in, k, F.lit(0)))
    with_inner = each(blocks_in, lambda k: at(0, k, own_out, F.lit(1)))
    with_others = each(blocks_out, lambda k: at(1, F.least(own_out, k), F.greatest(own_out, k), own_out > k))
    dealt = dealt.withColumn("g", F.explode(F.when(F.col("inner"), inner).otherwise(F.concat(with_inner, with_others))))
    dealt = dealt.select("key", "g.kind", "g.lo", "g.hi", "g.side", "cls", "label", "n")
    dealt = dealt.join(bands.join(sets, "cls"), "cls").select(*dealt.columns, "bands", "shingles")
    dealt = dealt.repartition("key", "kind", "lo", "hi").sortWithinPartitions("key", "kind", "lo", "hi")

    def compare(key: int, kind: int, lo: int, hi: int, held: list[tuple]) -> list[tuple[int, int]]:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        out = []
        side, cls, label, n = (np.array([x[i] for x in held]) for i in range(4))
        bands = np.array([x[4] for x in held])
        alone = kind == 1 and lo == hi
        for i in range(len(held)) if alone else np.flatnonzero(side == 1):
            like = (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])) & (label != label[i])
            if alone:
                like[: i + 1] = False
            else:
                like &= side == 0
            others = np.flatnonzero(like)
            if len(others) == 0:
                continue
            first = (bands[others] == bands[i]).argmax(axis=1)
            for j in others[bands[i][first] == key]:
                x, y = find(label[i]), find(label[j])
                if x != y and _reaches(_unpacked(held[i][5]), _unpacked(held[j][5]), threshold):
                    top[x] = y
                    out.append((int(cls[i]), int(cls[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(i).to_pylist() for i in range(9)]
            for key, kind, lo, hi, *rest, raw in zip(*columns, batch.column(9), strict=True):
                if at != (key, kind, lo, hi):
                    if held:
                        out += compare(*at, held)
                    at, held = (key, kind, lo, hi), []
                held.append((*rest, raw.as_py()))
            yield _pairs(out)
        if held:
            yield _pairs(compare(*at, held))

    return dealt.mapInArrow(lean(run), "a long, b long")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])


def near_duplicates(docs: DataFrame, *, width: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked doc_id), kept (it is that document).

    ``threshold``: (80, 100) links sets with 100 * intersection >= 80 * union.
    """
    num, den = threshold
    if not 0 < num <= den:
        raise ValueError("threshold must lie in (0, 1]")
    spark = docs.sparkSession
    base = work_path(spark, "minhash")
    texts = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    bands = bands_needed(num / den) if num < den else 1
    signed = materialize(sign(texts, width, threshold, bands), f"{base}/signed")

    # classes of equal sets, numbered as they are stored; their first document stands for them, and bands depend on the set alone
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), f"{base}/classes")
    first = classes.where("bands is not null").select("cls", "n", "bands")
    spread = first.select("cls", "n", F.explode("bands").alias("key")).withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(shuffle_partitions(spark))))

    # buckets of two or more classes; hot ones are gathered by salt first, and joined back by salt
    def per_bucket(rows: DataFrame, **sums) -> DataFrame:
        """Aggregates per key in two steps, one row per (key, salt) that occurs."""
        some = rows.groupBy("key", "salt").agg(*(f(c).alias(name) for name, (f, c) in sums.items()))
        whole = some.groupBy("key").agg(*((F.sum if f is F.count else f)(name).alias(name) for name, (f, _) in sums.items()), F.collect_list("salt").alias("salts"))
        return whole.select("key", *sums, F.explode("salts").alias("salt"))

    buckets = per_bucket(spread, size=(F.count, "cls")).where("size > 1")
    members = materialize(spread.join(buckets, ["key", "salt"]), f"{base}/members", 8)
    central = members.groupBy("cls").agg(F.sum("size").alias("degree"))
    members = materialize(members.join(central, "cls"), f"{base}/central", 8)
    hubs = per_bucket(members, hub=(F.max, F.struct("degree", "cls", "n")))
    like = den * F.least("n", "hub.n") >= num * F.greatest("n", "hub.n")
    stars = members.join(hubs, ["key", "salt"]).where((F.col("cls") != F.col("hub.cls")) & like)
    stars = materialize(stars.groupBy(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).agg(F.max("size").alias("size")), f"{base}/stars", 8)
    involved = members.select("cls").distinct().join(classes.select("cls", "digest", "rep"), "cls")
    sets = materialize(_sets_of(texts, involved, width), f"{base}/sets")
    links = materialize(_verified(stars, sets, threshold), f"{base}/links")
    labels = connected_components(links)

    # buckets that still hold several components
    named = members.select("key", "salt", "cls", "n", "size").join(labels.select(F.col("id").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = materialize(named, f"{base}/named", 8)
    open_ = per_bucket(named, lo=(F.min, "label"), hi=(F.max, "label")).where("lo <> hi").select("key", "salt")
    rest = materialize(named.join(open_, ["key", "salt"]).select("key", "cls", "label", "n"), f"{base}/open", 8)
    if not rest.isEmpty():
        tops = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("many")).groupBy("key").agg(F.max(F.struct("many", "label")).alias("most"), F.sum("many").alias("size"))
        tops = tops.select("key", F.col("most.label").alias("top"), F.col("most.many").alias("n_top"), "size")
        more = materialize(_block_links(rest, tops, first.select("cls", "bands"), sets, threshold), f"{base}/more")
        if not more.isEmpty():
            labels = connected_components(more, labels)

    smallest = classes.select("digest", "rep", "cls").join(labels, classes["cls"] == labels["id"], "left").select("digest", "rep", F.coalesce("label", "cls").alias("label"))
    tops = smallest.groupBy("label").agg(F.min("rep").alias("component"))
    found = materialize(smallest.join(tops, "label").select("digest", "component"), f"{base}/found", 8)
    for part in ("members", "central", "stars", "sets", "links", "named", "open", "more", "classes"):
        remove(spark, f"{base}/{part}")
    out = salted(signed.select("doc_id", "n", "digest"), found, "digest", "doc_id", how="left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows that stay, with all their columns: of each component the one of smallest id (null ids come last), and all that link with nothing.

    Rows are told apart by a key of their own, so rows of one id, or of none, are documents of their own here.
    """
    rows = keyed(docs)
    ids = pick(rows, row=ROW, id=id_col).select("row", F.col("id").cast("long").alias("id"))
    found = near_duplicates(rows, id_col=ROW, **options).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    several = found.where("row <> component").select("component").distinct()
    linked = found.join(several, "component").join(ids, "row")
    linked = materialize(linked, work_path(docs.sparkSession, "linked"), 8)
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("first"))
    gone = linked.join(first, "component").where("row <> first")
    return without(rows, ROW, gone.select("row")).drop(ROW)
