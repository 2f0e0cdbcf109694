"""Shards by jump consistent hashing, in DataFrame functions only.

A key's shard comes from the published jump recurrence: a 64-bit linear congruential sequence
seeded by the key names ever later jump targets until one lies beyond the shard count. There is no
ring table; going from n to n + 1 shards moves about 1/(n + 1) of the rows, all into the new shard.

Edge cases: a null key counts as key 0; a null text has size 1 and a null checksum; repeated rows
get slots of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense_numbers, pick

#: Fixed value: the multiplier of the published recurrence.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW1, _LOW0 = MULTIPLIER >> 32, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER & 0xFFFF
_MASK = 0xFFFFFFFF
#: So many jumps are tried at first; the chance that a key needs more is below 1e-9 for any count in use.
_USUAL = 64


def _advance(high: Column, low: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64, in 32-bit limbs: no product overflows a long, so ANSI mode holds."""
    part = low * F.lit(_LOW1)
    small = low * F.lit(_LOW0) + F.shiftleft(part.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    upper = high * F.lit(_LOW0) + F.shiftleft((high * F.lit(_LOW1)).bitwiseAND(F.lit(0xFFFF)), 16)
    carried = F.shiftright(small, 32) + F.shiftright(part, 16) + low * F.lit(_HIGH) + upper
    return carried.bitwiseAND(F.lit(_MASK)), small.bitwiseAND(F.lit(_MASK))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, from 0 to ``shards`` - 1, of a long key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    high, low = _advance(F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_MASK)))

    def state(at: Column, to: Column, high: Column, low: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), to.cast("long").alias("to"), high.cast("long").alias("high"), low.cast("long").alias("low"))

    def step(s: Column, _: Column) -> Column:
        ratio = F.lit(2147483648.0) / (F.shiftright(s["high"], 1) + F.lit(1)).cast("double")
        target = F.floor((s["to"] + F.lit(1)).cast("double") * ratio)
        return F.when(s["to"] < F.lit(shards), state(s["to"], target, *_advance(s["high"], s["low"]))).otherwise(s)

    def walk(begin: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, step)

    found = walk(state(F.lit(0), F.lit(0), high, low), min(shards, _USUAL))
    if shards > _USUAL:
        found = F.when(found["to"] < F.lit(shards), walk(found, shards)).otherwise(found)
    return found["at"].cast("int")


def assign_shards(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", chunks: int = 512) -> DataFrame:
    """One row per document: its shard and a slot, gapless from 0 in the shard.

    Only ids, sizes and checksums are shuffled, never texts. Slots are numbered in ``chunks``
    hashed parts of each shard, so that a shard may be far larger than a task.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    placed = rows.withColumn("shard", jump_shard(F.col("doc_id"), shards)).withColumn("grown_shard", jump_shard(F.col("doc_id"), shards + 1))
    numbered = dense_numbers(placed, "slot", ["shard"], ["doc_id"], ["doc_id", "text_crc32", "size"], chunks)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
