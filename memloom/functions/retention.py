"""Decay, half-lives, tiers and write rules as column expressions. Time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000
#: Fixed values of the half-life model: weights of accesses, training passes, type and provenance.
THETA = {"access": 0.1, "training": 0.15, "type": 0.3, "provenance": 0.4}
TYPE_BIAS = {"procedure": 1.0, "fact": 0.0, "relation": 0.0, "state": -1.0, "event": -1.0, "other": -0.5}
PROVENANCE_BIAS = {"human": 1.0, "test": 0.0, "research": -0.5}
BASE_HALF_LIFE, MAX_HALF_LIFE = 7 * DAY, 90 * DAY


def provenance(atom: Column) -> Column:
    out = None
    for name in PROVENANCE_BIAS:
        test = atom.endswith(f"_src_{name}")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("default")


def type_bias(kind: Column) -> Column:
    out = None
    for name, bias in TYPE_BIAS.items():
        out = F.when(kind == name, bias) if out is None else out.when(kind == name, bias)
    return out.otherwise(0.0)


def provenance_bias(source: Column) -> Column:
    out = None
    for name, bias in PROVENANCE_BIAS.items():
        out = F.when(source == name, bias) if out is None else out.when(source == name, bias)
    return out.otherwise(-1.0)


def half_life(accesses: Column, passes: Column, kind: Column, source: Column, base: float = BASE_HALF_LIFE, theta: dict = THETA) -> Column:
    """Milliseconds: base * 2^(theta . features), at most 90 days."""
    x = F.lit(theta["access"]) * accesses + F.lit(theta["training"]) * passes + F.lit(theta["type"]) * type_bias(kind) + F.lit(theta["provenance"]) * provenance_bias(source)
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(x, F.lit(1000.0))), F.lit(float(MAX_HALF_LIFE)))


def simple_half_life(accesses: Column) -> Column:
    """Without the model: a day, and a tenth of one an access, at most 90 days."""
    return F.least(F.lit(1.0) + accesses / 10, F.lit(90.0)) * DAY


def decayed(weight: Column, elapsed: Column, half: Column) -> Column:
    """weight halved each half-life; unchanged where the half-life or the time is missing or not positive."""
    gone = F.greatest(elapsed, F.lit(0))
    return F.when(half.isNull() | (half <= 0) | elapsed.isNull(), weight.cast("double")).otherwise(weight * F.pow(F.lit(0.5), gone / half))


def spike_increment(dt: Column, tau: float) -> Column:
    """max(1, round(1000 e^(-dt / tau))); 1 where tau is not positive."""
    return F.greatest(F.lit(1), F.round(F.exp(-F.greatest(dt, F.lit(0)) / tau) * 1000)).cast("long") if tau > 0 else F.lit(1).cast("long")


def tier(half: Column, since: Column) -> Column:
    """hot, warm or cold from half-life and milliseconds since the last access (null: never)."""
    never = since.isNull()
    return (
        F.when(never | (since > 30 * DAY), "cold")
        .when((half > 14 * DAY) & (since > DAY), "cold")
        .when((half < 3 * DAY) & (since <= DAY), "hot")
        .otherwise("warm")
    )


def write_tier(kind: Column, by_type: dict[str, str], default: str = "auto-write") -> Column:
    out = F.lit(None).cast("string")
    for name, value in by_type.items():
        out = F.when(F.coalesce(kind, F.lit("other")) == name, value).otherwise(out)
    return F.coalesce(out, F.lit(default))


def write_decision(write: Column, review_approved: bool = False) -> Column:
    return F.when(write == "never-store", "deny").when((write == "review-required") & F.lit(not review_approved), "review-required").otherwise("allow")


def encode_tier(name: Column) -> Column:
    """The stored letter of a tier."""
    return F.when(name.isin("hot", "warm", "cold"), F.substring(name, 1, 1))


def decode_tier(letter: Column) -> Column:
    return F.when(letter == "h", "hot").when(letter == "w", "warm").when(letter == "c", "cold")


def tier_key(index: Column) -> Column:
    """The stored key of an atom's tier: its index in ten digits."""
    return F.concat(F.lit("tier:"), F.lpad(index.cast("string"), 10, "0"))


def parse_theta(text: Column) -> Column:
    """A struct of weights from ``name:number,name:number``; null where a name is missing or its number is none."""
    pairs = F.filter(F.split(text, ","), lambda p: F.size(F.split(p, ":")) >= 2)

    def of(name: str) -> Column:
        values = F.transform(F.filter(pairs, lambda p: F.split(p, ":")[0] == name), lambda p: F.split(p, ":")[1].try_cast("double"))
        return F.try_element_at(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(-1)).alias(name)

    return F.struct(*[of(n) for n in THETA])
