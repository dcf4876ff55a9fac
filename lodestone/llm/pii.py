"""Personal data: patterns propose, checksums confirm, context words weigh in.

DataFrame functions only.  For each kind a regular expression proposes spans
(leftmost, non-overlapping); a validator drops those that cannot be real (ranges
of IP parts, Luhn for cards, mod 97 for IBANs); words just before or behind a
span move its score.  A span is reported if its score reaches the threshold; email, ip,
card and phone start high enough to be reported whatever the context.

Offsets come from the gaps between the matches: the same expression that finds
the matches splits the text, and the lengths of both add up to code points.
Running sums over a text's matches go through blocks of about the root of their
number, so no accumulator grows with the text; masking cuts the text into pieces
of fixed length once and takes each gap from the pieces it touches.
The expressions are written so that no text makes them backtrack over long
runs or recurse: possessive groups, and starts tied to the beginning of a run.

Cases: null and empty texts have no spans; very long texts are scanned whole;
an empty table gives an empty result; repeated rows and extra columns are left
as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import fresh, let, table

#: Spans below this score are not reported.
THRESHOLD = 0.6
#: Code points on either side of a span in which context words count; they end at the kind's previous and next match.
CONTEXT = 40
#: Code points of the pieces that masking cuts a text into.
PIECE = 4096


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of ``s`` pass the Luhn checksum."""

    def total(d: Column) -> Column:
        n = F.length(d)
        digit = lambda i: F.substring(d, n - i + 1, F.lit(1)).cast("int")
        twice = lambda i: F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(i)).otherwise(digit(i)))

    return let(_digits(s), total) % 10 == 0


def mod97(s: Column) -> Column:
    """Whether ``s``, an IBAN, leaves 1 modulo 97."""

    def rest(x: Column) -> Column:
        turned = F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))

        def step(acc: Column, i: Column) -> Column:
            code = F.ascii(F.substring(turned, i, F.lit(1)))
            return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), step)

    return let(F.replace(s, F.lit(" "), F.lit("")), rest) == 1


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


#: The edges of a word of ASCII letters, digits and underscores.
_BEHIND, _AHEAD = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_IBAN = "[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})"
_SSN = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
_SSN_WORDS = "(?:ssn|social security)"
_SECRET_WORDS = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("token", "secret", "password", "passwd")) + "|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy]"
_SECRET = rf'(?:{_SECRET_WORDS})[ \t]{{0,3}}[=:][ \t]{{0,3}}"[^" \t\r\n]{{8,}}"'
_IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    ``likely`` is a cheap test that is true for every text with a match;
    ``score`` is what a valid match starts with, ``boost`` what a context word adds.
    """

    name: str
    pattern: str
    likely: object
    valid: object
    score: float
    context: str = ""
    boost: float = 0.0


#: Kinds in the order in which spans with equal starts are listed.  The first four are the base.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.8, r"(?:e-?mail|contact|correo|courriel)", 0.2),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), lambda m: F.rlike(m, F.lit(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")), 0.7, r"(?:\bip\b|host|server|address)", 0.2),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", lambda t: F.rlike(t, F.lit(r"[0-9](?:[ -]?[0-9]){11}")), lambda m: let(F.length(_digits(m)), lambda n: F.when(_between(n, 12, 19), luhn(m)).otherwise(F.lit(False))), 0.8, r"(?:card|visa|karte|carte|tarjeta)", 0.2),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: _between(F.length(_digits(m)), 9, 15), 0.7, r"(?:phone|\btel|mobile|call|telefon)", 0.2),
    Kind("iban", rf"{_BEHIND}{_IBAN}{_AHEAD}", lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")), mod97, 0.8, r"(?:iban|konto|account|cuenta|compte)", 0.2),
    Kind("ssn", rf"{_BEHIND}{_SSN}{_AHEAD}", lambda t: F.rlike(t, F.lit(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")), lambda m: ~F.rlike(m, F.lit(r"^(?:000|666|9..)-|-00-|-0000$")), 0.4, _SSN_WORDS, 0.4),
    Kind("secret", rf"{_BEHIND}{_SECRET}", lambda t: F.rlike(t, F.lit(r'[=:][ \t]{0,3}"')), lambda m: F.lit(True), 0.7),
)
BASE = ("email", "ip", "card", "phone")


def running(values: Column, op) -> Column:
    """For each of some integers, ``op`` over those before it, from 0 on; ``op`` is associative and keeps 0 as it is.

    An accumulator that grows by one value is copied for each, so the values are
    cut into blocks of about the root of their number.
    """

    def fold(part: Column) -> Column:
        zero = F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(part, zero, lambda acc, x: F.struct(op(acc["all"], x).alias("all"), F.concat(acc["before"], F.array(acc["all"])).alias("before")))

    def joined(blocks: Column) -> Column:
        totals = fold(F.transform(blocks, lambda b: b["all"]))["before"]
        return F.flatten(F.zip_with(blocks, totals, lambda b, total: F.transform(b["before"], lambda x: op(total, x))))

    def scanned(a: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(a))).cast("int")
        return let(F.transform(F.sequence(F.lit(1), F.size(a), step), lambda i: fold(F.slice(a, i, step))), joined)

    return let(values, lambda a: F.when(F.size(a) > 0, scanned(a)).otherwise(F.array().cast("array<int>")))


def _spans(text: Column, kind: Kind, order: int, threshold: float) -> Column:
    """Valid spans of one kind: array of (start, ord, end, kind, score), in order of start."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,score:double>>")

    def span(x: Column) -> Column:
        start = x["before"] + F.length(x["gap"])
        near = F.lower(F.concat_ws("\n", F.substring(x["gap"], -CONTEXT, CONTEXT), F.substring(x["behind"], 1, CONTEXT)))
        score = F.lit(kind.score) + F.when(F.rlike(near, F.lit(kind.context)), kind.boost).otherwise(0.0) if kind.context else F.lit(kind.score)
        made = F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + F.length(x["hit"])).alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))
        return F.when(F.coalesce(kind.valid(x["hit"]), F.lit(False)), made)

    def placed(hits: Column, parts: Column) -> Column:
        sizes = F.zip_with(hits, F.slice(parts, F.lit(1), F.size(hits)), lambda h, g: F.length(h) + F.length(g))
        rows = F.arrays_zip(hits.alias("hit"), F.slice(parts, F.lit(1), F.size(hits)).alias("gap"), F.slice(parts, F.lit(2), F.size(hits)).alias("behind"), running(sizes, lambda a, b: a + b).alias("before"))
        good = F.filter(F.transform(rows, span), lambda s: s.isNotNull())
        return good if kind.score >= threshold else F.filter(good, lambda s: s["score"] >= threshold)

    return F.when(F.coalesce(kind.likely(text), F.lit(False)), let(found, lambda h: F.when(F.size(h) > 0, let(gaps, lambda g: placed(h, g))).otherwise(empty))).otherwise(empty)


def find_pii(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, kinds: tuple[Kind, ...] = KINDS, out: str = "pii") -> DataFrame:
    """``df`` with ``out``: its spans by start, then kind: array of (start, ord, end, kind, score)."""
    spans = F.array_sort(F.concat(*[_spans(F.col(text), k, i, threshold) for i, k in enumerate(kinds)]))
    (out,) = fresh(df, out)
    return df.withColumn(out, spans)


def mask_pii(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``df`` with every span in ``text`` replaced by its kind in brackets; spans that overlap become one."""
    (pii,) = fresh(df, "pii")

    def masked(t: Column, spans: Column) -> Column:
        def cut(pieces: Column, start: Column, end: Column) -> Column:
            first, last = (F.floor(x / PIECE).cast("int") for x in (start, end))
            head, tail = F.get(pieces, first), F.coalesce(F.get(pieces, last), F.lit(""))
            inside = F.substring(head, start % PIECE + 1, end - start)
            across = F.concat(F.substring(head, start % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), F.substring(tail, F.lit(1), end % PIECE))
            return F.when(start >= end, F.lit("")).when(first == last, inside).otherwise(across)

        def build(pieces: Column, rows: Column) -> Column:
            apart = F.filter(rows, lambda x: x["s"]["start"] >= x["before"])
            parts = F.transform(apart, lambda x: F.concat(cut(pieces, x["before"], x["s"]["start"]), F.lit("["), F.upper(x["s"]["kind"]), F.lit("]")))
            return F.concat(F.array_join(parts, ""), cut(pieces, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(t)))

        # each span with the furthest end of those before it: a span that starts beyond is apart from all of them
        rows = F.arrays_zip(spans.alias("s"), running(F.transform(spans, lambda s: s["end"]), F.greatest).alias("before"))
        return let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: let(rows, lambda r: build(pieces, r)))

    found = find_pii(df, text, threshold, kinds, pii)
    return found.withColumn(text, F.when(F.size(pii) > 0, masked(F.col(text), F.col(pii))).otherwise(F.col(text))).drop(pii)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(name: str) -> Column:
    return F.filter("pii", lambda s: s["kind"] == name)


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["ord"] < len(BASE))
    return found.select(
        "doc_id",
        *[F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("pii")).alias("spans"),
    )


#: DuckDB SQL for the rows of op9_pii_spans.
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'),
  (1, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
  (2, 'card', '[0-9](?:[\x20-]?[0-9])+'),
  (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
  (4, 'iban', '\b{_IBAN}\b'),
  (5, 'ssn', '\b{_SSN}\b'),
  (6, 'secret', '\b{_SECRET}')) v(ord, kind, re)),
m AS (SELECT rid, ord, kind, hits, string_split_regex(t, re) AS gaps FROM (SELECT rid, ord, kind, re, t, regexp_extract_all(t, re) AS hits FROM d, p) WHERE len(hits) > 0),
u AS (SELECT rid, ord, kind, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(gaps[2:len(hits) + 1]) AS behind, generate_subscripts(hits, 1) AS i FROM m),
s AS (SELECT *, (sum(length(hit) + length(gap)) OVER (PARTITION BY rid, ord ORDER BY i))::BIGINT AS e, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, replace(hit, ' ', '') AS iban FROM u),
ok AS (SELECT rid, ord, kind, e - length(hit) AS b, e FROM s WHERE CASE kind
  WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(right(x, 3) AS INT), 0) > 255)) = 0
  WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(digits)), lambda j: CASE WHEN j % 2 = 0 THEN digits[-1 - j]::INT WHEN digits[-1 - j]::INT > 4 THEN digits[-1 - j]::INT * 2 - 9 ELSE digits[-1 - j]::INT * 2 END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  WHEN 'iban' THEN list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(iban[5:] || iban[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), ''), ''), lambda c: c::INT), lambda a, c: (a * 10 + c) % 97) = 1
  WHEN 'ssn' THEN NOT regexp_matches(hit, '^(?:000|666|9..)-|-00-|-0000$') AND regexp_matches(lower(right(gap, {CONTEXT}) || chr(10) || left(behind, {CONTEXT})), '{_SSN_WORDS}')
  ELSE true END),
a AS (SELECT rid, count(*) FILTER (ord = 0) AS n_email, count(*) FILTER (ord = 1) AS n_ip, count(*) FILTER (ord = 2) AS n_card, count(*) FILTER (ord = 3) AS n_phone,
  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) FILTER (ord < 4), '') AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) AS spans FROM ok GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""
