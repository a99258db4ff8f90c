"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust a score. SQL functions only.

Java's matcher has no positions in Spark SQL, so a kind's spans come from two views of the same scan: the matches
(regexp_extract_all) and the gaps between them (split). Their lengths, summed alternately, are the offsets. Patterns
are possessive, and start at a run's first character or at the previous match's end, so that long runs of digits or
letters are read once instead of once per starting point, and never recurse.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Span patterns by kind, in the order in which kinds are listed; iban is the kind this method adds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9_])",
}
#: A text without this character holds no match of the kind.
NEEDS = {"email": "@", "phone": "+", "ip": "."}
BASE = ["email", "ip", "card", "phone"]
# Score of a confirmed span, and words that raise it when they stand within CONTEXT characters.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8}
CONTEXT_WORDS = {
    "email": r"(?i)(?<![A-Za-z0-9_])(?:e-?mail|mail|contact|write)(?![A-Za-z0-9_])",
    "ip": r"(?i)(?<![A-Za-z0-9_])(?:ip|host|server|address|addr)(?![A-Za-z0-9_])",
    "card": r"(?i)(?<![A-Za-z0-9_])(?:card|visa|mastercard|credit|debit|payment)(?![A-Za-z0-9_])",
    "phone": r"(?i)(?<![A-Za-z0-9_])(?:phone|tel|call|mobile|fax|contact)(?![A-Za-z0-9_])",
    "iban": r"(?i)(?<![A-Za-z0-9_])(?:iban|account|bank|konto|transfer)(?![A-Za-z0-9_])",
}
CONTEXT = 40
BONUS = 0.2
#: Numbers per block of a running sum; code points per chunk of a long text.
BLOCK, CHUNK = 128, 1_000


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of ASCII digits passes the Luhn check."""
    chars = F.split(F.reverse(digits), "")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an IBAN (spaces removed) leaves remainder 1 modulo 97, letters counting 10 to 35."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.pmod(a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c), F.lit(97))
    return F.aggregate(chars, F.lit(0), step) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(m)
        n = F.when(F.char_length(m) >= 13, F.char_length(digits)).otherwise(0)
        return F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    if kind == "iban":
        plain = F.replace(m, F.lit(" "), F.lit(""))
        return F.char_length(plain).between(15, 34) & mod97(plain)
    return F.lit(True)


def _running(steps: Column) -> Column:
    """Running sums of an array of numbers as blocks of BLOCK: block sums first, then sums inside each block, so that
    the arrays copied on the way stay short however many steps there are."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda k: F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))
    add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + x)).alias("all"))
    inner = F.transform(blocks, lambda b: F.aggregate(b, start, add))
    before = F.aggregate(inner, start, lambda acc, b: F.struct((acc["sum"] + b["sum"]).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all")))
    return F.struct(before["all"].alias("before"), F.transform(inner, lambda b: b["all"]).alias("inside"))


def find_spans(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """The input with an array column `out` of (kind, start, end, score), by kind as in PATTERNS, then by start.

    Offsets count code points, the end is exclusive. Null texts count as empty and have no spans. Matches of one kind
    never overlap; kinds may. A match that fails its check is dropped without a second try. Time grows in proportion to
    the text and its matches. All columns of the input pass through, whatever their names; one named `out` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    found = docs.select(F.struct(*[docs[c] for c in kept]).alias("_row"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    text = F.col("_text")
    has_digit = text.rlike("[0-9]")
    scan, sure, gaps, ends, spans = {}, {}, {}, {}, {}
    for kind, pattern in PATTERNS.items():
        may = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else has_digit
        scan[f"_m_{kind}"] = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        m = F.col(f"_m_{kind}")
        # Checks come first: texts whose matches all fail need no offsets.
        sure[f"_s_{kind}"] = F.filter(F.transform(m, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: _confirmed(kind, x["s"]))  # noqa: B023
        gaps[f"_g_{kind}"] = F.when(F.size(f"_s_{kind}") > 0, F.split(text, pattern, -1))
        g = F.col(f"_g_{kind}")
        steps = F.transform(m, lambda s, i: (F.char_length(F.get(g, i)) + F.char_length(s)).cast("long"))  # noqa: B023
        ends[f"_e_{kind}"] = F.when(g.isNotNull(), steps)
        spans[f"_r_{kind}"] = F.when(g.isNotNull(), _running(F.col(f"_e_{kind}")))
    found = found.withColumns(scan).withColumns(sure).withColumns(gaps).withColumns(ends).withColumns(spans)
    # Finding a place in a text takes time in proportion to the place, so long texts are cut into chunks for context.
    any_span = reduce(lambda x, y: x | y, [F.col(f"_g_{k}").isNotNull() for k in PATTERNS])
    found = found.withColumn("_chunks", F.when(any_span & (F.char_length(text) > 2 * CHUNK), F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    placed = found.withColumn("_found", F.concat(*[F.coalesce(_scored(kind), NONE()) for kind in PATTERNS]))
    return placed.select("_row.*", F.col("_found").alias(out))


def NONE() -> Column:  # noqa: N802
    return F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")


def _part(a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of the text in hand."""
    text, chunks = F.col("_text"), F.col("_chunks")
    k = F.floor(a / CHUNK).cast("int")
    some = F.array_join(F.slice(chunks, k + 1, F.floor((b - 1) / CHUNK).cast("int") - k + 1), "")
    return F.when(chunks.isNull(), F.substring(text, a + 1, b - a)).otherwise(F.substring(some, a - k * CHUNK + 1, b - a))


def _scored(kind: str) -> Column:
    """The confirmed spans of a kind as (kind, start, end, score)."""
    at = F.col(f"_r_{kind}")

    def scored(x: Column) -> Column:
        k = F.floor(x["i"] / BLOCK).cast("int")
        end = (F.get(at["before"], k) + F.get(F.get(at["inside"], k), x["i"] - k * BLOCK)).cast("int")
        start = end - F.char_length(x["s"])
        near = _part(F.greatest(start - CONTEXT, F.lit(0)), end + CONTEXT)
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(CONTEXT_WORDS[kind]), BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))

    return F.transform(F.col(f"_s_{kind}"), scored)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts by base kind, digest of the base spans, all spans, n_iban and max_score (null without spans)."""
    found = find_spans(docs.select(F.col(id_col), F.col(text_col)), text_col, "_pii")
    count = lambda k: F.size(F.filter("_pii", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("_pii", lambda x: x["kind"] != "iban")
    return found.select(
        F.col(id_col),
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("_pii")).alias("spans"),
        count("iban").alias("n_iban"),
        F.array_max(F.transform("_pii", lambda x: x["score"])).alias("max_score"),
    )


def redact(docs: DataFrame, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The input with every confirmed span of at least `min_score` replaced by its kind in angle brackets, the earliest
    and then the longest of overlapping ones first. Null texts stay null; all columns stay, whatever their names."""
    name = "_pii"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    found = find_spans(docs, text_col, name)
    spans = F.array_sort(F.filter(name, lambda x: x["score"] >= min_score), lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(y["end"] - x["end"]))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(text_col)

    def step(a, x):
        piece = F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("<"), x["kind"], F.lit(">"))
        return F.when(x["start"] >= a["at"], F.struct(x["end"].alias("at"), piece.alias("out"))).otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out")))

    walk = F.aggregate(spans, start, step)
    done = F.concat(walk["out"], F.substring(text, walk["at"] + 1, F.char_length(text)))
    return found.select(*[F.when(F.size(name) > 0, done).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns])
