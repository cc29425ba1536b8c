"""Personal data by patterns, checksums and context. DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for IBANs, ranges
for addresses and numbers), words near a span raise or lower its score. Base kinds (email, ip, card, phone)
are kept whatever their score; added kinds (iban, ssn, tel) are kept from `THRESHOLD` on, where they
overlap no base span. A kind's expressions run only on texts that a plain search lets through.

Offsets are code points, end exclusive: the text is split by the same pattern that extracts the
matches, and lengths of gaps and matches add up. The patterns are possessive where that changes no
match, so that long runs neither recurse nor backtrack, and start only where a run starts (or the
match before ended), so that runs that match nothing are passed once.

Edge cases: null text is empty; empty text has no spans and the hash of nothing; repeated rows get
equal results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import table

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "tel")
THRESHOLD = 0.5
#: Code points on either side of a span in which context words count.
REACH = 40

# The length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

#: One alternative per length: the countries with it, two check digits, the rest with single spaces at will.
IBAN_PATTERN = "(?<![A-Za-z0-9])(?:%s)(?![A-Za-z0-9])" % "|".join(
    "(?:%s)[0-9]{2}(?:\\x20?[A-Z0-9]){%d}" % ("|".join(c for c, k in IBAN_LENGTHS.items() if k == n), n - 4) for n in sorted(set(IBAN_LENGTHS.values()))
)

# A search that lets a text through, the pattern, the score without context.
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9),
    "ip": (r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", 0.6),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11}", r"[0-9](?:[\x20-]?[0-9])++", 0.6),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7),
    "iban": ("[A-Z]{2}[0-9]{2}", IBAN_PATTERN, 0.8),
    "ssn": ("[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.5),
    "tel": (r"[0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", 0.3),
}
# Context words, by kind.
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "address|host|server|ip",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|insurance",
    "tel": "phone|tel|call|mobile|fax|anruf|mobil",
}
# Words that speak against a kind.
AGAINST = {
    "email": "example\\.|noreply",
    "ip": "version|release|chapter|section",
    "card": "isbn|order|invoice|serial|tracking",
    "phone": "serial|version",
    "iban": "example|sample",
    "ssn": "isbn|serial|version|part no",
    "tel": "isbn|serial|version|order|part no",
}
BOOST, LESS = 0.35, 0.3


def _sub(text: Column, start: Column | int, length: Column | int) -> Column:
    """`length` code points of a text from place `start`, counted from 1."""
    return F.substr(text, *(x if isinstance(x, Column) else F.lit(x) for x in (start, length)))


def _digit(c: Column) -> Column:
    return F.ascii(c) - 48


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(c == "", F.lit(0)).when(i % 2 == 0, _digit(c)).when(_digit(c) > 4, 2 * _digit(c) - 9).otherwise(2 * _digit(c)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97, its first four characters last."""
    turned = F.concat(_sub(iban, 5, 64), _sub(iban, 1, 4))
    step = lambda a, c: F.when(c == "", a).when(_digit(c) < 10, (a * 10 + _digit(c)) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


#: Matches whose places are summed one by one; places of whole blocks of them are summed first.
BLOCK = 128


def _bound(value: Column, use) -> Column:
    """use(value) with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _starts(sizes: Column) -> Column:
    """Where each of pieces of these sizes starts: sums within blocks of `BLOCK`, so the work grows by a block's length a piece, not by all before it."""
    total = lambda some: F.aggregate(some, F.lit(0), lambda a, x: a + x)

    def within(sizes):
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: total(F.slice(sizes, at + 1, F.lit(BLOCK))))
        base = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
        return _bound(base, lambda base: F.transform(sizes, lambda x, i: F.get(base, F.floor(i / BLOCK).cast("int")) + total(F.slice(sizes, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))

    return _bound(sizes, within)


def _clipped(gap: Column) -> Column:
    """A gap without what is out of reach from both of its ends."""
    return F.when(F.length(gap) <= 2 * REACH, gap).otherwise(F.concat(F.left(gap, F.lit(REACH)), F.right(gap, F.lit(REACH))))


def _matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches with their offsets and place among the pieces, and the pieces: each gap, clipped, with its match.

    What stands around a match is put together from pieces: looked up by its offset, it would be searched for from the text's beginning."""
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, match: F.struct(F.length(gap).alias("size"), _clipped(gap).alias("gap"), F.coalesce(match, F.lit("")).alias("match"), match.isNotNull().alias("there")),
    )

    def placed(pairs):
        starts = _starts(F.transform(pairs, lambda p: p["size"] + F.length(p.match)))
        spans = F.zip_with(
            F.transform(pairs, lambda p, i: p.withField("i", i)), starts,
            lambda p, at: F.struct((at + p["size"]).alias("start"), (at + p["size"] + F.length(p.match)).alias("end"), p.match.alias("match"), p.gap.alias("gap"), p["i"].alias("i"), p.there.alias("there")),
        )
        return F.struct(F.filter(spans, lambda x: x.there).alias("spans"), F.transform(pairs, lambda p: F.concat(p.gap, p.match)).alias("pieces"))

    return _bound(pairs, placed)


def _around(x: Column, pieces: Column) -> Column:
    """`REACH` characters on either side of a match with it, in lower case: a piece has two characters at least, so half as many pieces do."""
    n = REACH // 2
    first = F.greatest(x["i"] - n, F.lit(0))
    before = F.concat(F.array_join(F.slice(pieces, first + 1, x["i"] - first), ""), x["gap"])
    after = F.array_join(F.slice(pieces, x["i"] + 2, F.lit(n + 1)), "")
    return F.lower(F.concat(F.right(before, F.lit(REACH)), x["match"], F.left(after, F.lit(REACH))))


def _only_digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _confirmed(kind: str, x: Column) -> Column:
    match = x.match
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = _only_digits(match)
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_only_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(kind: str, order: int, text: Column) -> Column:
    """Confirmed spans of a kind: array<struct<start, order, end, kind, score>>."""
    search, pattern, score = PATTERNS[kind]
    total = lambda c: F.lit(score) + F.when(c.rlike(CONTEXT[kind]), BOOST).otherwise(0.0) - F.when(c.rlike(AGAINST[kind]), LESS).otherwise(0.0)

    def scored_of(found):
        kept = F.filter(found["spans"], lambda x: _confirmed(kind, x))
        rounded = lambda x: F.round(F.greatest(F.least(_bound(_around(x, found["pieces"]), total), F.lit(1.0)), F.lit(0.0)), 2)
        return F.transform(kept, lambda x: F.struct(x.start.alias("start"), F.lit(order).alias("order"), x.end.alias("end"), F.lit(kind).alias("kind"), rounded(x).alias("score")))

    scored = _bound(_matches(text, pattern), scored_of)
    none = F.expr("cast(array() as array<struct<start:int,order:int,end:int,kind:string,score:double>>)")
    passes = F.instr(text, "@") > 0 if kind == "email" else text.rlike(search)
    return F.when(passes, scored).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, base, added): arrays of spans (start, order, end, kind, score) by start, then kind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.array_sort(F.concat(*[_spans(k, i, text) for i, k in enumerate(BASE)]))
    added = F.concat(*[_spans(k, len(BASE) + i, text) for i, k in enumerate(ADDED)])
    rows = rows.select("doc_id", base.alias("base"), added.alias("added"))
    free = lambda x: ~F.exists("base", lambda b: (b.start < x.end) & (x.start < b.end))
    kept = F.array_sort(F.filter("added", lambda x: (x.score >= THRESHOLD) & free(x)))
    return rows.select("doc_id", "base", kept.alias("added"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with `redacted`: the text with every found span replaced by its kind in brackets.

    Overlapping spans are replaced from the first one on; other columns stay as they are.
    """
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    found = F.array_sort(F.concat(*[_spans(k, i, text) for i, k in enumerate(BASE + ADDED)]))
    found = F.filter(found, lambda x: (x.order < len(BASE)) | (x.score >= THRESHOLD))
    out = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x.start < acc.at, acc).otherwise(
            F.struct(x.end.alias("at"), F.concat(acc.out, _sub(text, acc.at + 1, x.start - acc.at), F.lit("["), F.upper(x.kind), F.lit("]")).alias("out"))
        ),
        lambda acc: F.concat(acc.out, _sub(text, acc.at + 1, F.length(text))),
    )
    return docs.withColumn("redacted", out)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    every = F.array_sort(F.concat("base", "added"))
    scores = F.array_join(F.transform(every, lambda x: F.format_number(x.score, 2)), ",")
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"), scores.alias("scores"))


def _is(kind: str):
    return lambda x: x.kind == kind


QUERIES = {"op1_pii": op1_pii}
