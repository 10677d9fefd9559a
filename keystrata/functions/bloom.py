"""Bloom filters with a fixed hash: ten bits a key, six probes, the probe count in the last byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filters must answer alike wherever they were built.
SEED, FACTOR, BITS_PER_KEY, LEAST_BITS, PROBES, MASK = 0xBC9F1D34, 0x5BD1E995, 10, 64, 6, 0xFFFFFFFF


def bloom_hash(key: Column) -> Column:
    """32-bit hash of a key's bytes; bytes from 0x80 on count sign-extended, as in a signed char."""
    raw = F.hex(key.cast("binary"))
    size = F.octet_length(key.cast("binary")).cast("long")
    byte = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.conv(F.substring(raw, (2 * i - 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    signed = F.transform(F.filter(byte, lambda b: b.isNotNull()), lambda b: F.when(b >= 128, b + (MASK - 255)).otherwise(b))

    def step(h: Column, b: Column) -> Column:
        mixed = (h.bitwiseXOR(b) * F.lit(FACTOR).cast("long")).bitwiseAND(F.lit(MASK).cast("long"))
        return mixed.bitwiseXOR(F.shiftrightunsigned(mixed, 15))

    start = F.lit(SEED).cast("long").bitwiseXOR(size.bitwiseAND(F.lit(MASK).cast("long")))
    return F.when(size == 0, start).otherwise(F.aggregate(signed, start, step))


def probe_bits(h: Column, bits: Column) -> Column:
    """The bit places of a hash in a filter of ``bits`` bits: steps of the hash turned right by 17."""
    delta = F.shiftrightunsigned(h, 17).bitwiseOR(F.shiftleft(h, 15)).bitwiseAND(F.lit(MASK).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda j: (h + j * delta).bitwiseAND(F.lit(MASK).cast("long")) % bits)


def filter_bits(n: Column) -> Column:
    return F.floor((F.greatest(n * BITS_PER_KEY, F.lit(LEAST_BITS)) + 7) / 8) * 8


def create_filters(runs: DataFrame) -> DataFrame:
    """Set bits of each run's filter: ``run``, ``bits``, ``bit``; one row for each set bit, so no run is gathered."""
    sizes = runs.groupBy("run").agg(filter_bits(F.count("*")).alias("bits"))
    return runs.select("run", bloom_hash(F.col("key")).alias("h")).join(sizes, "run").select("run", "bits", F.explode(probe_bits(F.col("h"), F.col("bits"))).alias("bit")).distinct()


def filter_bytes(runs: DataFrame) -> DataFrame:
    """Size of each run's filter in bytes, with the last byte for the probe count."""
    return runs.groupBy("run").agg((filter_bits(F.count("*")) / 8 + 1).cast("long").alias("filter_bytes"))


def may_match(filters: DataFrame, probes: DataFrame) -> DataFrame:
    """``run``, ``key``, ``maybe`` for each probe (``run``, ``key``): false means that the run does not hold the key.

    A key is hashed once, whatever the number of runs it is asked of.
    """
    sizes = filters.select("run", "bits").distinct()
    hashes = probes.select("key").distinct().select("key", bloom_hash(F.col("key")).alias("h"))
    places = probes.join(hashes, "key").join(sizes, "run").select("run", "key", F.explode(F.array_distinct(probe_bits(F.col("h"), F.col("bits")))).alias("bit"))
    hits = places.join(filters.select("run", "bit", F.lit(True).alias("hit")), ["run", "bit"], "left")
    return hits.groupBy("run", "key").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("maybe"))


def packed_filters(filters: DataFrame) -> DataFrame:
    """``run`` and ``data``: each run's filter as a file holds it, eight bits a byte from the lowest, the probe count last."""
    held = filters.groupBy("run", F.floor(F.col("bit") / 8).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("byte"))
    every = filters.select("run", "bits").distinct().select("run", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("bits") / 8 - 1).cast("long"))).alias("at"))
    full = every.join(held, ["run", "at"], "left").select("run", "at", F.lpad(F.hex(F.coalesce("byte", F.lit(0))), 2, "0").alias("two"))
    joined = full.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("at", "two"))).alias("bytes"))  # a filter is one value
    return joined.select("run", F.unhex(F.concat(F.array_join(F.transform("bytes", lambda x: x["two"]), ""), F.lit(f"{PROBES:02X}"))).alias("data"))


def pack(bits: int, set_bits: list[int]) -> bytes:
    """A filter's bytes from its set bits, for files."""
    out = bytearray(int(bits) // 8)
    for b in set_bits:
        out[b // 8] |= 1 << (b % 8)
    return bytes(out) + bytes([PROBES])


def hash_bytes(key: bytes) -> int:
    """``bloom_hash`` of one key, for readers and writers of files."""
    h = SEED ^ (len(key) & MASK)
    for b in key:
        h = ((h ^ (b if b < 128 else b + (MASK - 255))) * FACTOR) & MASK
        h ^= h >> 15
    return h


def _places(h: int, bits: int) -> list[int]:
    delta = ((h >> 17) | (h << 15)) & MASK
    return [((h + j * delta) & MASK) % bits for j in range(PROBES)]


def pack_hashes(hashes: list[int]) -> bytes:
    """A filter's bytes for the keys of these hashes."""
    bits = (max(len(hashes) * BITS_PER_KEY, LEAST_BITS) + 7) // 8 * 8
    out = bytearray(bits // 8)
    for h in hashes:
        for b in _places(h, bits):
            out[b // 8] |= 1 << (b % 8)
    return bytes(out) + bytes([PROBES])


def may_hold(data: bytes, key: bytes) -> bool:
    """Whether a packed filter may hold ``key``; one of fewer than two bytes holds nothing."""
    if len(data) < 2:
        return False
    bits = (len(data) - 1) * 8
    return all(data[b // 8] >> (b % 8) & 1 for b in _places(hash_bytes(key), bits)[: data[-1]])
