"""Sharding by a permutation-filled lookup table of prime size."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame, functions as F

MOST_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = 65537) -> list[int]:
    """Index of the shard that owns each slot.

    Each shard has its own order of preference over the slots, an arithmetic progression modulo the prime table size,
    and the shards take turns to claim their first free slot. Slot counts differ by one at most, and when a shard goes
    most slots keep their owner.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime between the number of shards and {MOST_SLOTS}")
    offsets, skips = [], []
    for name in shards:
        digest = md5(name.encode()).hexdigest()
        offsets.append(int(digest[:8], 16) % slots)
        skips.append(int(digest[8:16], 16) % (slots - 1) + 1)
    owner, spot, left = [-1] * slots, offsets[:], slots
    while left:
        for shard, skip in enumerate(skips):
            while owner[spot[shard]] >= 0:
                spot[shard] = (spot[shard] + skip) % slots
            owner[spot[shard]] = shard
            left -= 1
            if not left:
                break
    return owner


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a document; without an id its text stands in."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text), F.lit(""))))


def place(df: DataFrame, key: Column, shards: Sequence[str], slots: int = 65537) -> DataFrame:
    """Add ``slot`` and ``shard`` (or replace columns of these names); one lookup a row, no shuffle.

    The table has a bounded size (``slots``) and travels to the tasks as a folded literal array. Equal keys share a
    shard, so a null key (taken as empty) and repeated rows do as well; keys should identify documents, not sources.
    """
    names = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    slot = F.pmod(F.conv(F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 12), 16, 10).cast("long"), F.lit(slots)).cast("int")
    shard_names = F.array(*[F.lit(s) for s in shards])
    placed = df.withColumn("slot", slot)
    return placed.withColumn("shard", F.element_at(shard_names, F.element_at(names, F.col("slot") + 1).cast("int") + 1))


def write_shards(placed: DataFrame, path: str, format: str = "parquet") -> None:
    """One folder for each shard. Every task writes its own files, so no shard is gathered in one task."""
    placed.write.partitionBy("shard").format(format).mode("errorifexists").save(path)
