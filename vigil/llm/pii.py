"""Personal data in whole texts: patterns propose, validators confirm, context words adjust the score.

Per kind, a pattern proposes leftmost non-overlapping spans; a validator (Luhn for cards, mod-97 for account
numbers, part and digit ranges for the others) confirms them; the words just before and after a span raise
its score. The four base kinds stay whenever their pattern and validator hold; their score is reported beside
them. The added kinds need a score of at least ACCEPT: an account number reaches it by its mod-97 checksum,
a short card number, a local phone number or a social security number only with a context word near.

Everything is a column expression on one row, so there is no shuffle and a text of any length is one row's work.
Positions come from the text between matches: ``split`` gives the gaps, ``regexp_extract_all`` the matches, and a
running sum of their lengths in code points gives start and end. The patterns equal the plain ones in what
they match; possessive repeats and a look-behind keep them linear on long runs, where the plain forms would
retry from every character (a match can start inside a run only where the last one ended, hence ``\\G``).

Defined cases: null is the empty text (no spans; redaction leaves it null); ties cannot arise (spans of a kind do
not overlap); repeated rows are each reported; empty tables work; extra columns pass unchanged (one named ``pii`` is
replaced).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import shielded

ACCEPT = 0.6
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20

# Total length of an international bank account number by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "XK": 20,
}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Sum of the digits from the right, every second one doubled and folded, divisible by ten."""
    terms = F.transform(F.split(F.reverse(digits(value)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(terms, F.lit(0), lambda a, t: a + t) % 10 == 0


def mod97(compact: Column) -> Column:
    """First four characters moved to the end, letters as 10 to 35, remainder one."""
    moved = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda v: F.length(digits(v)).between(low, high)


def iban_part(value: Column) -> Column:
    """The leading part of a proposal that has its country's length, else null."""
    lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTH.items() for x in kv])
    n = F.element_at(lengths, F.substring(value, 1, 2))
    part = F.regexp_substr(value, F.concat(F.lit("^(?:[A-Z0-9] ?){"), n.cast("string"), F.lit("}")))
    return F.when(n.isNotNull(), F.rtrim(part))


@dataclass(frozen=True)
class Kind:
    name: str
    needs: str                                   # a cheap necessary pattern of the whole text
    pattern: str
    valid: Callable[[Column], Column]
    score: float                                 # of a confirmed span without context
    context: str                                 # words near that raise it by CONTEXT_BONUS
    base: bool = True
    part: Callable[[Column], Column] | None = None


CONTEXT_BONUS = 0.3
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda v: F.lit(True), 0.7, r"e-?mail|contact|kontakt|write to|correo|courriel"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
         lambda v: v.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"), 0.6, r"\bip\b|address|server|host|client|from"),
    Kind("card", r"[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9])++",
         lambda v: F.when(F.length(digits(v)).between(16, 19), luhn(v)).otherwise(False), 0.7,
         r"card|visa|master|credit|payment|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", digit_count(8, 15), 0.6,
         r"phone|tel|call|fax|mobile|mobil|cell|whatsapp"),
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
         lambda v: F.when(F.length(v) > 0, mod97(F.replace(v, F.lit(" "), F.lit("")))).otherwise(False), 0.7,
         r"iban|account|konto|bank|cuenta|compte", False, iban_part),
    Kind("card_short", r"[0-9][ -]?[0-9]", r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,14}(?![0-9A-Za-z]|[ -][0-9])", luhn, 0.4,
         r"\bcard|visa|master|credit|amex|karte|tarjeta|\bcarte", False),
    Kind("phone_local", r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
         lambda v: F.lit(True), 0.4, r"\bphone|\btel\b|\btel[.:]|telefon|\bcall|\bfax|\bmobile|whatsapp", False),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
         lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), 0.4, r"\bssn\b|social security", False),
)
BASE = tuple(k.name for k in KINDS if k.base)
SPAN = "struct<kind:string,start:int,end:int,value:string,score:double>"


CHUNK = 256      # spans that are appended one by one; chunks of them are appended whole, so long lists stay linear
BLOCK = 4096     # code points of a block of a text: a place is looked up in its block, not from the start of the text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def appended(items: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Struct of ``at`` (a place carried over the items, from 0) and ``out`` (array of ``kind``): ``step(at, item)`` gives the next place
    and the array to append."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        at, more = step(acc["at"], x)
        return F.struct(at.cast("int").alias("at"), F.concat(acc["out"], more).alias("out"))

    def many(acc: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda a: F.slice(items, a, F.lit(CHUNK)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(chunks, begin, many, lambda a: F.struct(a["at"].alias("at"), F.flatten(a["out"]).alias("out")))


def spans_of(text: Column, kind: Kind) -> Column:
    """The kind's spans in order of start; positions in code points, end exclusive."""
    gaps = F.split(text, kind.pattern, -1)
    found = F.arrays_zip(
        F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("match"),
        F.slice(gaps, 2, F.size(gaps)).alias("rest"))
    no_spans = F.array().cast(f"array<{SPAN}>")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        value = kind.part(x["match"]) if kind.part else x["match"]
        near = F.lower(F.concat(F.right(x["gap"], F.lit(CONTEXT_BEFORE)), F.lit(" "), F.left(x["rest"], F.lit(CONTEXT_AFTER))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        stays = F.coalesce(kind.valid(value), F.lit(False))
        if not kind.base:
            stays = stays & (score >= ACCEPT)
        span = F.struct(F.lit(kind.name).alias("kind"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"),
                        value.alias("value"), score.alias("score")).cast(SPAN)
        return start + F.length(x["match"]), F.when(stays, F.array(span)).otherwise(no_spans)

    spans = let(found, lambda items: appended(items, step, SPAN)["out"])
    return F.when(text.rlike(kind.needs), spans).otherwise(no_spans)


def find_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``pii``: all spans, by kind as listed in KINDS, then by start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_kind = df.withColumns({f"__{k.name}": spans_of(text, k) for k in KINDS})
    return by_kind.withColumn("pii", F.concat(*[F.col(f"__{k.name}") for k in KINDS])).drop(*[f"__{k.name}" for k in KINDS])


def cut(blocks: Column, a: Column, z: Column) -> Column:
    """Code points a to z of the text that was cut into ``blocks``."""
    first, last = F.floor(a / BLOCK).cast("int"), F.floor(z / BLOCK).cast("int")
    rest = F.concat(F.substring(F.get(blocks, first), a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""),
                    F.coalesce(F.substring(F.get(blocks, last), F.lit(1), z % BLOCK), F.lit("")))
    return F.when(z <= a, F.lit("")).when(first == last, F.substring(F.get(blocks, first), a % BLOCK + 1, z - a)).otherwise(rest)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span (overlapping ones as one) replaced by its kind in angle brackets."""
    spans = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    text = F.col(text_col)
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK)))

    def whole(blocks: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            piece = F.array(cut(blocks, at, s["start"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, piece).otherwise(F.array().cast("array<string>"))

        pieces = let(spans, lambda items: appended(items, step, "string"))
        return let(pieces, lambda p: F.concat(F.array_join(p["out"], ""), cut(blocks, p["at"], n)))

    out = find_pii(df, text_col)
    return out.withColumn(text_col, F.when(F.size("pii") > 0, let(blocks, whole)).otherwise(text)).drop("pii")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with redacted texts and their ``n_chars`` set anew where a text changed; other columns stay as they are."""
    def run(d: DataFrame) -> DataFrame:
        out = redact(d.withColumn("__before", F.col("text")))
        if "n_chars" in d.columns:
            changed = ~F.col("text").eqNullSafe(F.col("__before"))
            out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(d.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
        return out

    return shielded(documents, ["doc_id", "text", "n_chars"], run)


def of_kinds(*kinds: str) -> Column:
    return F.filter("pii", lambda s: s["kind"].isin(*kinds))


def op10(documents: DataFrame) -> DataFrame:
    """The contract's rows."""
    found = find_pii(documents.select("doc_id", "text"))
    count = {f"n_{k}": F.size(of_kinds(k)).cast("long") for k in BASE}
    base = of_kinds(*BASE)
    return found.select("doc_id", *[c.alias(n) for n, c in count.items()],
                        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
