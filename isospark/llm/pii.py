"""Personal data: regular expressions propose, checksums confirm, context adjusts.

Every kind has an expression; a proposal must pass its check (Luhn for cards,
mod-97 for bank accounts, ranges and digit counts for others), and words near it
raise its score. Base kinds are kept whatever their score; the method's own
kinds (iban, id_number, secret) need MIN_SCORE, so a bare id number counts only
beside a word that speaks of one. Secrets are runs of 20 characters or more with
letters, digits and VARIETY different characters at least (words and numbers
have fewer), beside a word such as token, password or key; the common forms of
access keys count without one.

Everything is DataFrame functions of one column, evaluated row by row: nothing
is shuffled. Places come from splitting the text at the same expression: lengths
of the gaps and of the matches add up to code-point offsets, by sums over groups of
matches, then within groups, so that n matches cost n^1.5 steps. The expressions are
possessive and start only where a run of their characters starts, or where the
match before ended, so long runs cost linear time; the matches are the leftmost
non-overlapping ones of the plain expressions.

Defined cases: null and empty texts have no spans; masking keeps null as null.
Spans of different kinds may overlap; masking covers their union. Input columns
are chosen by name, others are not looked at; ids may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MIN_SCORE, NEAR = 0.5, 40
#: Different characters of a secret.
VARIETY = 9
#: How access keys of well-known services begin.
ACCESS_KEY = "^(?:AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|sk-|sk_live_|glpat-|eyJ)"

#: Characters of an account number by country (IBAN registry); other codes may have any length.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: An account number ends where its country's size says, whatever word follows.
SIZED = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, codes in IBAN_SIZES.items())

#: kind: plain expression (as in SQL), the same for Java without backtracking, score alone, words nearby.
KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.7, "mail|e-mail|contact|write"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.5, "ip|host|server|address"),
    "card": (r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9]){12,}+", 0.7, "card|visa|credit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile"),
    "iban": (r"", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{SIZED}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}+(?:\x20?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])", 0.8, "iban|bank|account"),
    "secret": (r"", r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]{20})[A-Za-z0-9_+/-]++", 0.3, "token|secret|password|passwd|pwd|key|apikey|api_key|access_key|secret_key|auth|credential|credentials|bearer"),
    "id_number": (r"(?:^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?:[^0-9-]|$)", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.2, "ssn|social security|id number|tax id"),
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold before an expression is tried.
NEEDS = {"email": "@", "phone": "+"}
#: The same as a short expression.
NEEDS_LIKE = {"iban": "[A-Z]{2}[0-9]{2}", "id_number": "[0-9]-[0-9]{2}-[0-9]"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SPAN = "array<struct<kind:string,start:bigint,stop:bigint,score:double>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod97(match: Column) -> Column:
    """Whether an account number's digits, first four characters moved behind and letters as 10 to 35, leave 1 when divided by 97."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def confirmed(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: match.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
        "card": lambda: n.between(13, 19) & F.call_function("luhn_check", _digits(match)),
        "phone": lambda: n.between(9, 15),
        "iban": lambda: mod97(match),
        "secret": lambda: match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) >= VARIETY),
        "id_number": lambda: ~match.rlike("^(?:000|666|9)|-00-|-0000$"),
    }[kind]()


def once(value: Column, of) -> Column:
    """of(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), of), 1)


def in_groups(items: Column, amount, emit, kind: str) -> Column:
    """emit(item, sum of amounts up to and with it) of each item of an array; sums run over groups of its square root."""
    zero, none = F.lit(0).cast("bigint"), lambda of: F.array().cast(f"array<{of}>")

    def within(pair: Column) -> Column:
        first = F.struct(pair.start.alias("at"), none(kind).alias("out"))
        return F.aggregate(pair.g, first, lambda s, x: F.struct((s.at + amount(x)).alias("at"), F.concat(s.out, F.array(emit(x, s.at + amount(x)))).alias("out")), lambda s: s.out)

    def started(groups: Column) -> Column:
        totals = F.transform(groups, lambda g: F.aggregate(g, zero, lambda s, x: s + amount(x)))
        starts = F.aggregate(totals, F.struct(zero.alias("at"), none("bigint").alias("out")), lambda s, t: F.struct((s.at + t).alias("at"), F.concat(s.out, F.array(s.at)).alias("out")), lambda s: s.out)
        return F.flatten(F.transform(F.arrays_zip(groups.alias("g"), starts.alias("start")), within))

    def grouped(all_of: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_of))).cast("int"))
        groups = F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_of) - 1, F.lit(0)), width), lambda at: F.slice(all_of, at + 1, width))
        return once(groups, started)

    return once(items, grouped)


def _spans(kind: str, text: Column, matches: Column) -> Column:
    """The confirmed matches of one kind with places and scores; matches is the column of what the expression found."""
    _, pattern, alone, words = KINDS[kind]
    gaps = F.split(text, pattern, -1)
    sized = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("m")), lambda p: F.struct(p.m.alias("m"), F.length(p.gap).cast("bigint").alias("gap"), F.length(p.m).cast("bigint").alias("size")))
    placed = in_groups(sized, lambda p: p.gap + p.size, lambda p, end: F.struct(p.m.alias("m"), (end - p.size).alias("start"), end.alias("stop")), "struct<m:string,start:bigint,stop:bigint>")

    def scored(s: Column) -> Column:
        near = F.lower(F.concat_ws(" ", F.substring(text, F.greatest(s.start - NEAR + 1, F.lit(1)).cast("int"), F.least(s.start, F.lit(NEAR)).cast("int")), F.substring(text, (s.stop + 1).cast("int"), F.lit(NEAR))))
        beside = near.rlike(rf"\b(?:{words})\b") | (s.m.rlike(ACCESS_KEY) if kind == "secret" else F.lit(False))
        return F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.stop.alias("stop"), F.when(beside, alone + 0.3).otherwise(alone).cast("double").alias("score"))

    found = F.transform(F.filter(placed, lambda s: confirmed(kind, s.m)), scored)
    if kind not in BASE:
        found = F.filter(found, lambda s: s.score >= MIN_SCORE)
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(SPAN))


def with_spans(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """docs with a column of all spans (kind, start, stop exclusive, score), by kind as listed, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = {kind: f"{out}_{kind}" for kind in KINDS}
    matches = {kind: F.regexp_extract_all(text, F.lit(KINDS[kind][1]), F.lit(0)) for kind in KINDS}
    matches |= {kind: F.when(F.contains(text, F.lit(held)), matches[kind]).otherwise(F.array().cast("array<string>")) for kind, held in NEEDS.items()}
    matches |= {kind: F.when(text.rlike(held), matches[kind]).otherwise(F.array().cast("array<string>")) for kind, held in NEEDS_LIKE.items()}
    found = docs.select("*", *[m.alias(names[kind]) for kind, m in matches.items()])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.concat(*[_spans(kind, text, F.col(names[kind])) for kind in KINDS]).alias(out))


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans by the first one's."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.stop.alias("stop"), s.kind.alias("kind"))))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        kept = F.substring(text, (state.at + 1).cast("int"), (s.start - state.at).cast("int"))
        masked = F.concat(state.out, F.array(kept, F.concat(F.lit("["), F.upper(s.kind), F.lit("]"))))
        return F.struct(F.greatest(state.at, s.stop).alias("at"), F.when(s.start >= state.at, masked).otherwise(state.out).alias("out"))

    # Pieces are joined once at the end, so the text isn't copied for each span.
    covered = F.aggregate(ordered, start, step, lambda s: F.concat(F.array_join(s.out, ""), F.substr(text, (s.at + 1).cast("int"))))
    return F.when(F.size(spans) > 0, covered).otherwise(text)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans of each row."""
    return with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "spans").select("doc_id", "spans")


def mask_pii(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with masked texts, and their new lengths; columns as before."""
    names = docs.columns
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).alias("text"))
    found = with_spans(plain, "text", "spans").withColumn("masked", mask(F.col("text"), F.col("spans")))
    new = {text_col: F.col("masked"), size_col: F.when(F.size("spans") > 0, F.length("masked").cast(dict(docs.dtypes).get(size_col, "bigint"))).otherwise(F.col(f"row.{size_col}") if size_col in names else F.lit(None))}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in names])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select("doc_id", *[of(kind) for kind in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES = {"op8_pii": op8_pii}
ORACLE = {}
