"""Column expressions over atoms, the typed strings ``v1.<type>.<value>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
TYPES = ("fact", "event", "relation", "state", "procedure", "other")
ATOM_PATTERN = r"^v1\.(fact|event|relation|state|procedure|other)\.([^\n\r\x{2028}\x{2029}]+)\z"
METADATA_MARKERS = ("_src_", "_conf_", "_scope_", "_dt_", "_ns_", "_namespace_")
NAMESPACE_PATTERN = r"(?:^|_)(?:ns|namespace)_(user|project|task)_([a-z0-9_-]+?)(?=_(?:ns|namespace)_(?:user|project|task)_|$)"
SECRET_KEYWORDS = ("password", "passwd", "apikey", "privatekey", "secret", "credential", "accesstoken", "authtoken", "bearertoken")
INJECTION_WORDS = r"(?i)\b(ignore|override|bypass|disregard|instead)\b"
INJECTION_PHRASES = ("system_prompt", "pre_approved", "approved_all", "forget_previous")
CATEGORY_MARKERS = (
    ("preference", ("prefers_", "preference_")),
    ("constraint", ("requires_", "must_", "constraint_", "policy_")),
    ("goal", ("objective_", "current_focus_", "next_step_", "sprint.")),
)


def _part(atom: Column, group: int) -> Column:
    found = F.regexp_extract(atom, ATOM_PATTERN, group)
    return F.when(F.trim(F.regexp_extract(atom, ATOM_PATTERN, 2)) != "", found)


def atom_type(atom: Column) -> Column:
    """The type, or null where the string is not an atom."""
    return _part(atom, 1)


def atom_value(atom: Column) -> Column:
    """The trimmed value, or null where the string is not an atom."""
    return F.trim(_part(atom, 2))


def encode_atom(kind: Column, value: Column) -> Column:
    """The atom of a type and a value; null for an unknown type, an empty value or line ends in it."""
    v = F.trim(value)
    good = kind.isin(*TYPES) & (v != "") & ~v.rlike(r"[\r\n]")
    return F.when(good, F.concat(F.lit("v1."), kind, F.lit("."), v))


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def semantic_text(atom: Column) -> Column:
    """What indices hold of an atom: type, value and the atom itself."""
    return F.when(atom_type(atom).isNull(), atom).otherwise(F.concat_ws(" ", atom_type(atom), atom_value(atom), atom))


def strip_metadata(value: Column) -> Column:
    """value up to its first metadata marker, without underscores at its ends."""
    low, none = F.lower(value), F.length(value) + 1
    cuts = [F.when(F.instr(low, m) > 0, F.instr(low, m)).otherwise(none) for m in METADATA_MARKERS]
    return F.regexp_replace(F.substring(value, F.lit(1), F.least(*cuts) - 1), "^_+|_+$", "")


def compact_summary(atom: Column) -> Column:
    kind, short = atom_type(atom), strip_metadata(atom_value(atom))
    return F.when(kind.isNull(), atom).when(short == "", kind).otherwise(F.concat_ws(":", kind, short))


def namespace(atom: Column, dimension: str) -> Column:
    """The first value of a dimension (user, project or task) named in the atom."""
    text = F.lower(F.coalesce(atom_value(atom), atom))
    pattern = NAMESPACE_PATTERN.replace("(user|project|task)", "(user|project|task)", 1)
    keys = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.when(F.array_contains(keys, dimension), F.try_element_at(values, F.array_position(keys, dimension).cast("int")))


def in_scope(atom: Column, scope: dict[str, str], include_global: bool = True) -> Column:
    """Whether an atom's namespaces fit a scope; atoms without a dimension are global in it."""
    good = F.lit(True)
    for dimension, wanted in scope.items():
        actual = namespace(atom, dimension)
        good = good & F.coalesce(actual == wanted, F.lit(include_global))
    return good


def fact_claim(atom: Column) -> Column:
    """Struct (key, claim, source, confidence) of a fact; null for other atoms or fewer than two tokens."""
    value = F.lower(atom_value(atom))
    parts = F.filter(F.split(strip_metadata(value), "_"), lambda t: t != "")
    n = F.size(parts)
    source, confidence = F.regexp_extract(value, r"(?:^|_)src_([a-z0-9_-]+)", 1), F.regexp_extract(value, r"(?:^|_)conf_([a-z0-9_-]+)", 1)
    found = F.struct(
        F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), "_").alias("key"),
        F.try_element_at(parts, F.lit(-1)).alias("claim"),
        F.when(source != "", source).alias("source"),
        F.when(confidence != "", confidence).alias("confidence"),
    )
    return F.when((atom_type(atom) == "fact") & (n >= 2), found)


def memory_category(atom: Column) -> Column:
    """preference, constraint, goal or memory; the first that fits."""
    value = F.lower(F.coalesce(atom_value(atom), F.lit("")))
    out = None
    for name, markers in CATEGORY_MARKERS:
        test = F.lit(False)
        for m in markers:
            test = test | F.contains(value, F.lit(m))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("memory")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def has_secret(atom: Column) -> Column:
    flat = F.regexp_replace(F.lower(F.coalesce(atom_value(atom), atom)), r"[\s_-]+", "")
    return flat.rlike("|".join(SECRET_KEYWORDS))


def has_injection(atom: Column) -> Column:
    value = F.coalesce(atom_value(atom), atom)
    return F.translate(value, "_", " ").rlike(INJECTION_WORDS) | F.lower(value).rlike("|".join(INJECTION_PHRASES))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)
