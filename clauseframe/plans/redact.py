"""Redaction by an ordered rule table, with counts taken between the rules, and a gate for what remains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern`` is replaced by ``mark``; a ``$1`` in it keeps the first group. A text without ``holds`` has no match."""

    name: str
    pattern: str
    mark: str
    holds: str = ""


_EDGE, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: General identifiers, in order. Fixed patterns.
LATIN = (
    Rule("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL_ADDRESS]", "@"),
    Rule("card", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "[CARD_NUMBER]"),
    Rule("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP_ADDRESS]"),
    Rule("phone", r"\+?[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}", "[PHONE_NUMBER]"),
)
_NAME = r"[\p{IsHebrew}'-]{2,}(?:\s+[\p{IsHebrew}'-]{2,}){1,2}?(?=\s*(?:,|ת[.\"״]|נושא|שמספר))"
_TITLE = r"(?:\s*:)?\s+(?:מר\s+|גב['׳]\s+)?"


def named(role: str, words: str, mark: str) -> Rule:
    """The name behind a party's role, up to what identifies it."""
    return Rule(role, f"((?:{words}){_TITLE}){_NAME}", f"$1{mark}")


def labelled(name: str, words: str, value: str, mark: str) -> Rule:
    """A value that its label tells from other numbers."""
    return Rule(name, rf"((?:{words})\s*(?:מספר|מס['׳])?\s*[:#]?\s*){value}{_END}", f"$1{mark}")


#: Rental agreements in Hebrew, in order: what a label or a role tells apart comes before bare numbers. The marks are fixed values.
HEBREW = (
    labelled("labelled_id", "ת[.\"״]ז\\.?|תעודת\\s+זהות|מספר\\s+זהות", r"\d{7,8}-?\d", "[ID_NUMBER]"),
    labelled("passport", "דרכון", "[A-Za-z]{0,2}[0-9]{6,9}", "[PASSPORT_NUMBER]"),
    Rule("phone", _EDGE + r"(?:\+?972[ -]?|0)(?:5[0-9]|7[2-9]|[2-4]|[89])[ -]?[0-9]{3}[ -]?[0-9]{4}" + _END, "[PHONE_NUMBER]"),
    Rule("email", LATIN[0].pattern, LATIN[0].mark, LATIN[0].holds),
    Rule("address", r"(?<!\p{L})((?:ב|מ|ל)?(?:רחוב|רח['׳]|שדרות|שד['׳]|סמטת)\s+)(?:[\p{IsHebrew}'\"״-]+\s+){1,4}\d{1,4}(?:\s*/\s*\d{1,3})?(?!\d)", "$1[ADDRESS]"),
    named("landlord", "המשכיר|המשכירה|בעל הדירה|בעלת הדירה", "[LANDLORD_NAME]"),
    named("tenant", "השוכר|השוכרת|הדייר|הדיירת", "[TENANT_NAME]"),
    labelled("account", r"חשבון(?:\s+(?:ה)?בנק)?", r"\d[\d-]{3,13}", "[BANK_ACCOUNT]"),
    Rule("iban", _EDGE + r"(?i:IL)(?: ?\d){21}" + _END, "[IBAN]"),
    Rule("id", _EDGE + r"\d{9}" + _END, "[ID_NUMBER]"),
)
RESIDUAL = ("id", "phone", "email", "iban")


def redact(df: DataFrame, rules: tuple[Rule, ...], text: str = "text", counts: str = "redactions") -> DataFrame:
    """``df`` with the rules applied in order, and ``counts``: a map from rule to how often it held when its turn came."""
    out, entries = df, []
    for i, r in enumerate(rules):
        step = f"_n{i}"
        times = F.regexp_count(text, F.lit(r.pattern))
        # what holds nothing is neither counted nor written anew
        out = out.withColumn(step, F.coalesce(F.when(F.contains(F.col(text), F.lit(r.holds)), times) if r.holds else times, F.lit(0)))
        out = out.withColumn(text, F.when(F.col(step) > 0, F.regexp_replace(text, r.pattern, r.mark)).otherwise(F.col(text)))
        entries += [F.lit(r.name), F.col(step)]
    return out.withColumn(counts, F.create_map(*entries)).drop(*(f"_n{i}" for i in range(len(rules))))


def residual(text: Column | str, rules: tuple[Rule, ...], names: tuple[str, ...]) -> Column:
    """Whether any of the named rules would still hold."""
    c = F.col(text) if isinstance(text, str) else text
    out = F.lit(False)
    for r in rules:
        if r.name in names:
            out = out | F.rlike(c, F.lit(r.pattern))
    return F.coalesce(out, F.lit(False))


def gate(df: DataFrame, rules: tuple[Rule, ...] = HEBREW, names: tuple[str, ...] = RESIDUAL, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined): a document goes to the second as a whole if an identifier remains in any of its parts."""
    bad = F.col(key).isNotNull() & F.bool_or("_left").over(Window.partitionBy(key))
    told = (df if "_left" in df.columns else df.withColumn("_left", residual(text, rules, names))).withColumn("_bad", bad)
    return told.where("NOT _bad").drop("_left", "_bad"), told.where("_bad").drop("_left", "_bad")


def resolved_spans(spans: Column, text: Column, least: float) -> Column:
    """The spans (start, end, mark, score; code points, end exclusive) that count: those with a mark and ``least`` certainty that lie
    in the text, in order, and of overlapping ones the first, or the longer of two that begin together."""
    size = F.length(F.coalesce(text, F.lit("")))
    usable = F.filter(spans, lambda s: s["mark"].isNotNull() & (s["score"] >= least) & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= size))
    ordered = F.array_sort(F.transform(usable, lambda s: F.struct(s["start"].cast("int").alias("start"), (s["start"] - s["end"]).cast("int").alias("size"), s["end"].cast("int").alias("end"), s["mark"].alias("mark"))))
    none = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<start:int,end:int,mark:string>>").alias("kept"))
    step = lambda a, s: F.when(s["start"] < a["upto"], a).otherwise(F.struct(s["end"].alias("upto"), F.concat(a["kept"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["mark"].alias("mark")))).alias("kept")))
    return F.aggregate(F.coalesce(ordered, F.array().cast("array<struct<start:int,size:int,end:int,mark:string>>")), none, step)["kept"]


def mask_spans(df: DataFrame, spans: str, least: float, text: str = "text", count: str = "masked") -> DataFrame:
    """``df`` with each span of ``spans`` that counts replaced by its mark, and how many there were; see ``resolved_spans``. What names
    the spans is the caller's: they come as a column."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), s["mark"]).alias("out"))
    kept = df.withColumn("_kept", resolved_spans(F.col(spans), F.col(text), least))
    told = F.aggregate("_kept", start, step)
    masked = F.when(F.size("_kept") > 0, F.concat(told["out"], F.substring(F.col(text), told["at"] + 1, F.length(text)))).otherwise(F.col(text))
    return kept.withColumn(count, F.size("_kept")).withColumn(text, masked).drop("_kept")
