"""Personal data: patterns propose, checksums confirm, nearby words adjust the score. Built-in functions only.

Spark has no function for the places of all matches, so a text is cut by the pattern: the pieces
between matches and the matches themselves give every place as a running sum of lengths. A cheap
test of the whole text comes first, so that the patterns run only where they can match. Patterns
are written without backtracking into what they have taken (possessive), and start only where a
run starts, so their time is linear in the text. So is what follows, but for a logarithm: running
sums double their reach from pass to pass, parts of a text are taken from blocks of it, and no
array grows by one item at a time.

The base kinds are email, ip (parts up to 255), card (13 to 19 digits, Luhn) and phone (9 to 15
digits). The method adds iban and national ids of the form 3-2-4 digits, which have no checksum and
therefore need a context word. An IBAN may be followed by more capitals or digits, so every end of
15 to 34 characters that no letter or digit follows is tried with mod-97: the country's own length
comes first, then the longest that passes. A span's score starts from its kind and validator and
gains where one of the kind's words stands within 48 code points before it.

Defined cases: a null text counts as empty and stays null when masked; an empty text has no
spans; equal rows give equal results; an empty table gives no rows; other columns are kept by
``mask`` and not read by ``find_pii``. Places are in code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table

_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
#: The head alone is taken, and group 1 looks at what may follow it, with one more character: heads inside it are candidates, too.
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    **dict.fromkeys(("NO",), 15), **dict.fromkeys(("BE",), 16), **dict.fromkeys(("DK", "FI", "FK", "FO", "GL", "NL", "SD"), 18), **dict.fromkeys(("MK", "SI"), 19),
    **dict.fromkeys(("AT", "BA", "EE", "KZ", "LT", "LU", "MN", "XK"), 20), **dict.fromkeys(("CH", "HR", "LI", "LV"), 21), **dict.fromkeys(("BG", "BH", "CR", "DE", "GB", "GE", "IE", "ME", "RS", "VA"), 22),
    **dict.fromkeys(("AE", "GI", "IL", "IQ", "OM", "SO", "TL"), 23), **dict.fromkeys(("AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"), 24), **dict.fromkeys(("LY", "PT", "ST"), 25),
    **dict.fromkeys(("IS", "TR"), 26), **dict.fromkeys(("BI", "DJ", "FR", "GR", "IT", "MC", "MR", "SM"), 27), **dict.fromkeys(("AL", "AZ", "BY", "CY", "DO", "GT", "HN", "HU", "LB", "NI", "PL", "SV"), 28),
    **dict.fromkeys(("BR", "EG", "PS", "QA", "UA"), 29), **dict.fromkeys(("JO", "KW", "MU", "YE"), 30), **dict.fromkeys(("MT", "SC"), 31), "LC": 32, "RU": 33,
}
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CONTEXT, LEAST_SCORE, BLOCK = 48, 0.5, 1024


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip_parts(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda d: (F.length(d) < 3) | ((F.length(d) == 3) & (d <= "255"))))


def _card(m: Column) -> Column:
    return let(_digits(m), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))


def _iban_end(head: Column, tail: Column) -> Column:
    """Characters of tail that end an IBAN, 0 if none do: at the country's length, else the most that mod-97 confirms.

    ISO 7064 is over the tail with the head moved behind it, letters counting 10 to 35.
    """

    def value(c: Column) -> Column:
        return F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)

    h = ((value(F.substring(head, 1, 1)) * 100 + value(F.substring(head, 2, 1))) * 100 + F.substring(head, 3, 2).cast("int")) % 97
    size = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair]), F.substring(head, 1, 2)), F.lit(0))

    def of(fixed: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            c, n = F.substr(tail, i, F.lit(1)), s["n"] + 1
            r = F.when(c <= "9", s["r"] * 10 + value(c)).otherwise(s["r"] * 100 + value(c)) % 97
            good = (n >= 15) & ((r * 1_000_000 + fixed["h"]) % 97 == 1) & ~F.substr(tail, i + 1, F.lit(1)).rlike("[A-Za-z0-9]")
            most = F.when(good, i).otherwise(s["most"])
            own = F.when(good & (n == fixed["size"]), i).otherwise(s["own"])
            return F.when(c.rlike("[A-Z0-9]") & (n <= 34), F.struct(n.alias("n"), r.alias("r"), own.alias("own"), most.alias("most"))).otherwise(s)

        zero = F.struct(F.lit(4).alias("n"), F.lit(0).alias("r"), F.lit(0).alias("own"), F.lit(0).alias("most"))
        return F.aggregate(F.sequence(F.lit(1), F.length(tail)), zero, step, lambda s: F.when(s["own"] > 0, s["own"]).otherwise(s["most"]))

    return let(F.struct(h.alias("h"), size.alias("size")), of)


def _running(values: Column, combine) -> Column:
    """Running totals of an array of ints: each pass reaches twice as far back."""

    def doubled(a: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(a, lambda x, i: F.when(i >= back, combine(x, F.get(a, i - back))).otherwise(x))

    passes = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), passes - 1), values, doubled)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _between(blocks: Column, a: Column, b: Column) -> Column:
    """The text of the blocks from place a to before place b."""
    first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
    head, tail = F.get(blocks, first), F.coalesce(F.get(blocks, last), F.lit(""))
    inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(F.substr(head, a % BLOCK + 1), inner, F.substr(tail, F.lit(1), b % BLOCK))
    return F.when(a >= b, F.lit("")).when(first == last, F.substr(head, a % BLOCK + 1, b - a)).otherwise(across)


_PLACES = "array<struct<start:int,end:int,k:int>>"


def _ibans(places: Column, heads: Column, tails: Column) -> Column:
    """places of heads to those of the numbers that begin there, without any that begin inside an earlier one."""
    long = F.transform(places, lambda p: F.struct(p["start"].alias("start"), (p["end"] + _iban_end(F.element_at(heads, p["k"]), F.element_at(tails, p["k"]))).alias("end"), p["k"].alias("k")))
    found = F.filter(long, lambda p: p["end"] - p["start"] > 4)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PLACES}>").alias("done"), F.array().cast(_PLACES).alias("now"))

    def add(s: Column, p: Column) -> Column:  # what is taken is gathered by the hundred, so that no long array is copied for one item
        more = F.struct(p["end"].alias("at"), s["done"].alias("done"), F.concat(s["now"], F.array(p)).alias("now"))
        full = F.struct(p["end"].alias("at"), F.concat(s["done"], F.array(s["now"])).alias("done"), F.array(p).alias("now"))
        return F.when(p["start"] < s["at"], s).when(F.size(s["now"]) >= 256, full).otherwise(more)

    return F.aggregate(found, zero, add, lambda s: F.flatten(F.concat(s["done"], F.array(s["now"]))))


#: kind: pattern, test of the whole text, validator (an IBAN's is in _ibans), score without context, words that add 0.3.
KINDS: dict[str, tuple] = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.7, "mail|contact|e-mail|correo|courriel"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]"), _ip_parts, 0.6, r"\bip\b|address|host|server"),
    "card": (_CARD, lambda t: t.rlike("[0-9](?:[\\x20-]?[0-9]){12}"), _card, 0.6, "card|visa|master|credit|karte|carte|tarjeta"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(9, 15), 0.6, "phone|tel|call|mobile|fax"),
    "iban": (_IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){4}"), None, 0.6, "iban|account|bank|konto|compte|cuenta"),
    "ssn": (_SSN, lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda m: ~m.substr(1, 3).isin("000", "666") & (m.substr(1, 1) != "9") & (m.substr(5, 2) != "00") & (m.substr(8, 4) != "0000"), 0.3, r"\bssn\b|social|security|tax"),
}
BASE = ("email", "ip", "card", "phone")
_SPAN = "array<struct<kind:string,rank:int,start:int,end:int,score:double>>"


def _places(pieces: Column, hits: Column) -> Column:
    """Starts and ends of the matches, from the pieces around them."""
    ends = _running(F.transform(hits, lambda h, i: (F.length(h) + F.length(F.get(pieces, i))).cast("int")), lambda x, y: x + y)
    return let(ends, lambda e: F.transform(hits, lambda h, i: F.struct((F.get(e, i) - F.length(h)).alias("start"), F.get(e, i).alias("end"), (i + 1).alias("k"))))


def _spans(text: Column, kind: str, rank: int) -> Column:
    pattern, gate, valid, score, words = KINDS[kind]
    none = F.array().cast(_SPAN)

    def of_hits(hits: Column) -> Column:
        def of_pieces(pieces: Column) -> Column:
            if kind == "iban":
                good = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda tails: _ibans(_places(pieces, hits), hits, tails))
            else:
                good = F.filter(_places(pieces, hits), lambda p: valid(F.element_at(hits, p["k"])))

            def of_blocks(places: Column, blocks: Column) -> Column:
                def scored(p: Column) -> Column:
                    near = F.lower(_between(blocks, F.greatest(p["start"] - CONTEXT, F.lit(0)), p["start"]))
                    return F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), p["start"].alias("start"), p["end"].alias("end"), (F.lit(score) + F.when(near.rlike(words), 0.3).otherwise(0.0)).alias("score"))

                out = F.transform(places, scored)
                return out if kind in BASE else F.filter(out, lambda s: s["score"] >= LEAST_SCORE)

            return let(good, lambda places: F.when(F.size(places) > 0, let(_blocks(text), lambda blocks: of_blocks(places, blocks))).otherwise(none))

        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), of_pieces)).otherwise(none)

    return F.when(gate(text), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of_hits)).otherwise(none)


def pii_spans(text: Column) -> Column:
    """All spans of a text: an array of (kind, rank, start, end, score), by kind as listed, then start."""
    return F.concat(*[_spans(F.coalesce(text, F.lit("")), kind, k) for k, kind in enumerate(KINDS)])


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return docs.select(key, pii_spans(F.col(text)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


#: The same in SQL. Its patterns know no look-around: a match may hold the character before it, and what follows is tested after.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT * FROM (VALUES
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 0),
  ('ip', 1, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', 0),
  ('card', 2, '[0-9](?:[ -]?[0-9])+', 0),
  ('phone', 3, '\+[0-9][ ().0-9-]+[0-9]', 0),
  ('iban', 4, '(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}', 1),
  ('ssn', 5, '(?:^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}', 1)) AS v(kind, rank, pat, edge)),
m AS (SELECT doc_id, t, kind, rank, edge, regexp_extract_all(t, pat) AS hits, string_split_regex(t, pat) AS pieces FROM t, k WHERE regexp_matches(t, pat)),
i AS (SELECT *, unnest(range(1, len(hits) + 1)) AS n FROM m),
p AS (SELECT doc_id, t, kind, rank, hits[n] AS raw, edge,
  list_sum(list_transform(pieces[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:n - 1], lambda x: length(x))), 0) AS pos FROM i),
s AS (SELECT doc_id, t, kind, rank, (pos + skip)::BIGINT AS a, (pos + length(raw))::BIGINT AS b, substr(raw, (skip + 1)::BIGINT) AS hit, regexp_replace(substr(raw, (skip + 1)::BIGINT), '[^0-9]', '', 'g') AS d
  FROM (SELECT *, CASE WHEN edge = 1 AND NOT regexp_matches(raw, CASE kind WHEN 'iban' THEN '^[A-Z]' ELSE '^[0-9]' END) THEN 1 ELSE 0 END AS skip FROM p)),
good AS (SELECT *, lower(substr(t, (greatest(a - 48, 0) + 1)::BIGINT, (a - greatest(a - 48, 0))::BIGINT)) AS near, substr(t, b + 1, 1) AS next, replace(hit, ' ', '') AS c FROM s),
kept AS (SELECT doc_id, kind, rank, a, b FROM good WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(x, '0'), '') AS INT), 0) > 255)) = 0
  WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN (length(d) - j) % 2 = 0 THEN substr(d, j, 1)::INT WHEN substr(d, j, 1)::INT > 4 THEN 2 * substr(d, j, 1)::INT - 9 ELSE 2 * substr(d, j, 1)::INT END)) % 10 = 0
  WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
  WHEN 'iban' THEN NOT regexp_matches(next, '[A-Za-z0-9]') AND length(c) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END), lambda r, x: CASE WHEN x < 10 THEN (r * 10 + x) % 97 ELSE (r * 100 + x) % 97 END, 0) = 1
  ELSE NOT regexp_matches(next, '[0-9-]') AND substr(hit, 1, 3) NOT IN ('000', '666') AND hit[1] <> '9' AND substr(hit, 5, 2) <> '00' AND substr(hit, 8, 4) <> '0000' AND regexp_matches(near, '\bssn\b|social|security|tax') END)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY rank, a) FILTER (WHERE rank < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY rank, a), '') AS spans
FROM t LEFT JOIN kept USING (doc_id) GROUP BY t.doc_id
"""


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; spans that overlap become one."""
    by_start = F.array_sort(F.transform(pii_spans(F.col(text)), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))


    def masked(spans: Column, upto: Column, blocks: Column) -> Column:
        """upto: the furthest end of each span and those before it; a span that begins there or later is apart."""
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(upto, i - 1))
        apart = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), before(i).alias("after"), s["kind"].alias("kind"), i.alias("i"))), lambda s: (s["i"] == 0) | (s["start"] >= s["after"]))
        parts = F.transform(apart, lambda s: F.concat(_between(blocks, s["after"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), _between(blocks, F.element_at(upto, -1), F.length(F.col(text))))

    furthest = _running(F.transform("__spans", lambda s: s["end"]), F.greatest)
    new = F.when(F.size("__spans") > 0, let(furthest, lambda upto: let(_blocks(F.col(text)), lambda blocks: masked(F.col("__spans"), upto, blocks)))).otherwise(F.col(text))
    marked = docs.withColumn("__spans", by_start)
    return marked.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns])


__all__ = ["KINDS", "ORACLE_SQL", "find_pii", "mask", "op6_pii", "pii_spans"]
