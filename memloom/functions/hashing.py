"""Hashes, shards and hashed n-gram features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_HASH = "0" * 64


def atom_hash(atom: Column) -> Column:
    return F.sha2(atom.cast("binary"), 256)


def jump_shard(atom: Column, shards: int) -> Column:
    """Jump consistent hash of the first eight bytes of the SHA-256, in exact decimals."""
    if shards == 1:
        return F.lit(0)
    seed = F.conv(F.substring(atom_hash(atom), 1, 16), 16, 10).cast("decimal(20,0)")
    zero = F.struct(seed.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(s: Column, _: Column) -> Column:
        k = ((s["k"].cast("decimal(38,0)") * F.lit("2862933555777941757").cast("decimal(19,0)") + 1) % F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")
        high = F.floor(k.cast("decimal(38,0)") / F.lit("8589934592").cast("decimal(10,0)")).cast("double") + 1
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / high)).cast("bigint")
        more = s["j"] < shards
        return F.struct(F.when(more, k).otherwise(s["k"]).alias("k"), F.when(more, s["j"]).otherwise(s["b"]).alias("b"), F.when(more, j).otherwise(s["j"]).alias("j"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), zero, step, lambda s: s["b"]).cast("int")


def rounded_fnv(text: Column) -> Column:
    """A 32-bit hash whose product is rounded as a double before it is cut, as a long."""

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(F.ascii(c).cast("bigint"))
        signed = F.when(x >= 2147483648, x - 4294967296).otherwise(x)
        return (signed.cast("double") * F.lit(16777619.0)).cast("bigint").bitwiseAND(F.lit(4294967295))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("bigint"), step)


def word_features(word: Column) -> Column:
    """The word itself and its 3- to 5-grams, prefixed by their kind; two letters are a gram too."""
    n = F.length(word)

    def grams(k: int) -> Column:
        at = F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.lit("n:"), F.substr(word, i, F.lit(k))))

    short = F.when(n == 2, F.array(F.concat(F.lit("n:"), word))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.concat(F.lit("w:"), word)), short, grams(3), grams(4), grams(5))


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
