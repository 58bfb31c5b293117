"""Clause profiles: sentences, concepts, number facts and cross-references of agreements.

Input is a frame of clauses (contract_id, ord, clause_id, text, section_label, heading). Everything is equi-joins on a sentence
or a contract, so agreements are independent and any number of them is spread by contract_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicon import hebrew as H
from ..session import dealt, settled
from . import facts as X
from . import mentions

KEY = ["contract_id", "clause_id"]
SENTENCE = [*KEY, "ord", "s_ord"]


def with_sentences(clauses: DataFrame) -> DataFrame:
    """(contract_id, clause_id, ord, s_ord, sentence). A clause's heading line is a sentence of its own. Of clauses that are read (see ``read``)
    also what their sentences say."""
    if "said" in clauses.columns:
        return clauses.select(*KEY, "ord", F.inline("said"))
    lines = F.filter(F.transform(F.split("text", "\n"), T.trimmed), lambda x: x != "")
    headed = F.col("heading").isNotNull() & (F.size(lines) > 1)
    body = F.when(headed, F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(1))), "\n")).otherwise(F.col("text"))
    parts = F.concat(F.when(headed, F.slice(lines, 1, 1)).otherwise(F.array().cast("array<string>")), T.sentences(body))
    return clauses.select(*KEY, "ord", F.posexplode(parts).alias("s_ord", "sentence"))


def profiled(clauses: DataFrame, concepts: dict[str, tuple[str, ...]] = H.NAMES) -> DataFrame:
    """``clauses`` with ``counts`` (how often each concept occurs in the text, array<struct<name, n>>), ``heads`` (the concepts that its heading
    names) and ``primary`` (what it is about: named in its heading, met twice, or met most often, if it alone is or the heading names
    none). Texts and headings are scanned once for all phrases, and no clause leaves its task."""
    if "primary" in clauses.columns:
        return clauses
    noted = mentions.tallied(clauses, ("text", "heading"), list(concepts.items())).withColumn("heads", F.transform("heading_n", lambda x: x["name"])).drop("heading_n").withColumnRenamed("text_n", "counts")
    most = F.array_max(F.transform("counts", lambda x: x["n"]))
    alone = F.size(F.filter("counts", lambda x: x["n"] == most)) == 1
    headed = F.exists("counts", lambda x: F.array_contains("heads", x["name"]))
    primary = F.transform(F.filter("counts", lambda x: F.array_contains("heads", x["name"]) | (x["n"] >= 2) | ((x["n"] == most) & (alone | ~headed))), lambda x: x["name"])
    noted = noted.withColumn("primary", primary)
    urgent = F.when(F.array_contains("primary", "URGENT_REPAIR"), F.array_union("primary", F.array(F.lit("REPAIRS")))).otherwise(F.col("primary"))
    return noted.withColumn("primary", urgent)


def profile_concepts(clauses: DataFrame, concepts: dict[str, tuple[str, ...]] = H.NAMES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, heading, primary): what ``profiled`` finds, a row for each concept; it is kept."""
    found = settled(profiled(clauses, concepts).select(*KEY, "ord", "counts", "heads", "primary"))
    each = lambda c: found.select(*KEY, F.explode(c).alias("concept"))
    return found.select(*KEY, "ord", F.inline("counts").alias("concept", "n")), each("heads"), each("primary")


def number_word_value(phrase: Column) -> Column:
    """The value of a run of number words, or null if any word is none."""
    known = F.create_map(*(F.lit(x) for pair in H.NUMBER_WORDS.items() for x in pair))
    words = F.transform(F.split(F.trim(phrase), r"\s+"), lambda w: F.regexp_replace(w, "^ו(?=.{2,})", ""))
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.try_element_at(known, w))


def _numeric(hit: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(hit, f"({H.NUMBER})", 1), ",", "").cast("double")


#: What a sentence must hold for one of the longer patterns to be worth trying.
DIGIT = r"\d"
SPAN = rf"(?iu)(?:{'|'.join(s.split()[0].removesuffix('s?') for s in H.SPANS)})"


def with_numbers(sentences: DataFrame) -> DataFrame:
    """``sentences`` with ``numbers``, array<struct<scan, at, kind, value, unit>>: money, durations and percents as they are read. Each
    pattern sees the sentence once, and only one that may hold it."""
    if "numbers" in sentences.columns:
        return sentences
    s = F.col("sentence")

    def found(pattern: str, needs: str, scan: int, read) -> Column:  # noqa: ANN001
        none = F.array().cast("array<struct<scan:int,at:int,kind:string,value:double,unit:string>>")
        row = lambda x: F.struct(F.lit(scan).alias("scan"), x["at"].alias("at"), *(c.alias(n) for n, c in zip(("kind", "value", "unit"), read(x["hit"]), strict=True)))
        return F.when(F.rlike(s, F.lit(needs)), F.transform(X.occurrences(s, pattern), row)).otherwise(none)

    def duration(hit: Column) -> tuple[Column, Column, Column]:
        part = lambda i: F.regexp_extract(hit, H.DURATION, i)
        amount = F.when(part(1) != "", F.regexp_replace(part(1), ",", "").cast("double")).otherwise(number_word_value(part(2)).cast("double"))
        unit = F.lower(part(3))
        days = F.when(unit.rlike("^(?:שעות|שעה|hours?)$"), amount / 24).when(unit.rlike("^(?:שבועות|weeks?)$"), amount * 7)
        months = F.when(unit.rlike("^(?:חודשים|חודש|months?)$"), amount).when(unit.rlike("^(?:שנים|שנה|years?)$"), amount * 12)
        kind = F.when(months.isNotNull(), "months").otherwise("days")
        return kind, F.coalesce(months, days, amount), kind

    told = lambda kind, unit: lambda hit: (F.lit(kind), _numeric(hit), F.lit(unit))
    fixed = lambda value, unit: lambda _: (F.lit(unit), F.lit(float(value)), F.lit(unit))
    parts = [found(H.MONEY, DIGIT, 0, told("money", "ILS")), found(H.DURATION, SPAN, 1, duration)]
    parts += [found(pattern, "|".join(stems), 2 + i, fixed(value, unit)) for i, (pattern, value, unit, stems) in enumerate(H.IMPLICIT)]
    parts.append(found(H.PERCENT, DIGIT, 9, told("percent", "percent")))
    return sentences.withColumn("numbers", F.filter(F.concat(*parts), lambda x: x["value"] > 0))


def sentence_numbers(sentences: DataFrame) -> DataFrame:
    """Every number of a sentence: (…, scan, at, kind, value, unit); ``scan`` orders money, durations and percents as they are read."""
    return with_numbers(sentences).select(*SENTENCE, "sentence", F.inline("numbers"))


Owners = tuple[tuple[tuple[str, ...], dict[str, str]], ...]


def with_facts(sentences: DataFrame, owners: Owners = H.OWNERS) -> DataFrame:
    """``sentences`` with ``numbers`` and ``facts``, array<struct<scan, at, fact, value, unit>>: each number under the subject named closest
    before it, or else after it. All subjects are found in one scan, and no sentence leaves its task."""
    if "facts" in sentences.columns:
        return sentences
    noted = with_numbers(mentions.noted(sentences, "sentence", [(i, phrases) for i, (phrases, _) in enumerate(owners)]))
    stated = F.array(*(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("target")) for k, t in targets.items())) for _, targets in owners))
    s = F.col("sentence")
    says = lambda c, p: F.rlike(c, F.lit(p))

    def order(n: Column, h: Column, m: Column) -> Column:
        return F.struct((h["at"] > n["at"]).alias("after"), F.abs(n["at"] - h["at"]).alias("d"), (-h["end"]).alias("e"), h["name"].alias("s"), m["target"].alias("target"), h["at"].alias("s_at"))

    def owner(n: Column) -> Column:
        of = lambda h: F.transform(F.filter(F.get(stated, h["name"]), lambda m: m["kind"] == n["kind"]), lambda m: order(n, h, m))
        return F.array_min(F.flatten(F.transform(F.filter("hits", lambda h: h["at"] != n["at"]), of)))

    def fact(n: Column, o: Column) -> Column:
        before = F.substring(s, F.lit(1), n["at"] - 1)
        between = F.when(o["s_at"] < n["at"], F.substring(s, o["s_at"], n["at"] - o["s_at"])).otherwise("")
        rent = (
            F.when(says(before, H.OPTION_MARKER), "OPTION_RENT")
            .when(~says(between, H.MONTHLY_MARKER) & says(s, H.PREPAYMENT_MARKER) & ~says(s, H.MONTHLY_MARKER), "PREPAID_RENT")
            .when(says(between, H.PREPAYMENT_MARKER), "PREPAID_RENT")
            .otherwise("MONTHLY_RENT")
        )
        returned = F.when(says(s, H.RETURN_VERB), "SECURITY_RETURN_DAYS")
        return F.when(o["target"] == "RENT_BY_CONTEXT", rent).when(o["target"] == "SECURITY_RETURN_IF_STATED", returned).when(o["target"] != "", o["target"])

    owned = F.transform("numbers", lambda n: F.struct(n.alias("n"), owner(n).alias("o")))
    named = F.transform(owned, lambda x: F.struct(x["n"]["scan"].alias("scan"), x["n"]["at"].alias("at"), fact(x["n"], x["o"]).alias("fact"), x["n"]["value"].alias("value"), x["n"]["unit"].alias("unit")))
    return noted.withColumn("facts", F.filter(named, lambda x: x["fact"].isNotNull())).drop("hits")


def sentence_facts(sentences: DataFrame, owners: Owners = H.OWNERS) -> DataFrame:
    """(…, scan, at, fact, value, unit, sentence): the facts that ``with_facts`` reads, a row each."""
    return with_facts(sentences, owners).select(*SENTENCE, "sentence", F.inline("facts")).select(*SENTENCE, "scan", "at", "fact", "value", "unit", "sentence")


def contract_facts(facts: DataFrame) -> DataFrame:
    """(contract_id, fact, clause_id, value, unit, sentence): the first of each kind in document order."""
    order = F.struct("ord", "s_ord", "scan", "at")
    first = facts.groupBy("contract_id", "fact").agg(F.min_by(F.struct("clause_id", "value", "unit", "sentence"), order).alias("x"))
    return first.select("contract_id", "fact", "x.*")


def with_references(sentences: DataFrame) -> DataFrame:
    """``sentences`` with ``refs``, array<struct<at, kind, labels>>: the sections that it points at; kind is REFERENCE, SUBJECT_TO or NOTWITHSTANDING."""
    if "refs" in sentences.columns:
        return sentences

    def read(x: Column) -> Column:
        prefix = F.substring(F.col("sentence"), F.greatest(F.lit(1), x["at"] - 25), F.least(F.lit(25), x["at"] - 1))
        kind = F.when(F.rlike(prefix, F.lit(H.NOTWITHSTANDING)), "NOTWITHSTANDING").when(F.rlike(prefix, F.lit(H.SUBJECT_TO)), "SUBJECT_TO").otherwise("REFERENCE")
        return F.struct(x["at"].alias("at"), kind.alias("kind"), F.regexp_extract_all(x["hit"], F.lit(r"(\d+(?:\.\d+)*)"), F.lit(1)).alias("labels"))

    return sentences.withColumn("refs", F.transform(X.occurrences(F.col("sentence"), H.REFERENCE), read))


def references(sentences: DataFrame, clauses: DataFrame) -> DataFrame:
    """(…, at, label, kind, sentence) of each section a sentence points at, but for its own."""
    hits = with_references(sentences).select(*SENTENCE, "sentence", F.inline("refs"))
    rows = hits.select(*SENTENCE, "sentence", "at", "kind", F.posexplode("labels").alias("l_ord", "label"))
    own = clauses.select(*KEY, "section_label")
    return rows.join(own.hint("merge"), KEY).where(~F.col("label").eqNullSafe(F.col("section_label"))).drop("section_label")


def resolved(references_: DataFrame, clauses: DataFrame) -> DataFrame:
    """References with ``target``: every clause of that label, or of its parent label where no clause has it."""
    targets = clauses.select("contract_id", F.col("section_label").alias("label"), F.col("clause_id").alias("target"), F.col("ord").alias("target_ord"))
    exact = references_.join(targets.hint("merge"), ["contract_id", "label"])
    rest = references_.join(targets.hint("merge"), ["contract_id", "label"], "left_anti").withColumn("parent", F.substring_index("label", ".", 1)).where("parent <> label")
    general = rest.join(targets.withColumnRenamed("label", "parent").hint("merge"), ["contract_id", "parent"]).drop("parent")
    return exact.unionByName(general).where("target <> clause_id")


Step = Callable[[DataFrame], DataFrame]


def worded(clauses: DataFrame, before: Step | None = None, after: Step | None = None) -> tuple[DataFrame, DataFrame]:
    """(clauses, wordings): ``clauses`` with ``wording``, a number, and what is read of each distinct pair of text and heading under it.

    Agreements are written from templates, so most of their clauses are worded alike; whatever follows from the words alone is read once a
    wording. ``wordings`` stand as clauses of agreements of their own (contract_id is the wording's number, clause_id empty) with ``counts``,
    ``heads``, ``primary`` (see ``profiled``), ``stems`` and ``said``, array<struct<s_ord, sentence, numbers, facts, refs>>. ``before`` changes
    or adds to the columns of wordings before they are read, ``after`` adds to what is read. ``clauses`` take over what ``before`` does.
    """
    own = ["text", "heading"]
    # the digest only sorts and deals; wordings are told apart by their words
    digest = F.xxhash64(*own).alias("_digest")
    words = dealt(clauses.select(*own).distinct(), *own).select(F.monotonically_increasing_id().alias("contract_id"), F.lit("").alias("clause_id"), F.lit(0).alias("ord"), *own, digest, *(F.col(c).alias(f"_{c}") for c in own))
    first = settled(words)
    changed = before(first) if before else first
    more = [c for c in changed.columns if c not in first.columns]
    words = settled(profiled(changed).withColumn("stems", T.stems("text", stop=H.STOP)))
    sentences = with_references(with_facts(with_sentences(words)))
    told = F.array_sort(F.collect_list(F.struct("s_ord", "sentence", "numbers", "facts", "refs")))
    known = words.join(sentences.groupBy("contract_id").agg(told.alias("said")).hint("merge"), "contract_id", "left")
    known = settled(after(settled(known)) if after else known)
    named = words.select("_digest", *(f"_{c}" for c in own), F.col("contract_id").alias("wording"), F.col("text").alias("_now"), *more)
    mine = clauses.withColumn("_d", digest)
    same = (F.col("_d") == F.col("_digest")) & F.col("text").eqNullSafe(F.col("_text")) & F.col("heading").eqNullSafe(F.col("_heading"))
    found = mine.join(named.hint("merge"), same).withColumn("text", F.col("_now")).select(*clauses.columns, "wording", *more)
    return found, known.drop("_digest", *(f"_{c}" for c in own), *more)


def with_readings(clauses: DataFrame, wordings: DataFrame) -> DataFrame:
    """``clauses`` of ``worded`` beside what is read of their wordings."""
    read = wordings.drop("clause_id", "ord", *(c for c in clauses.columns if c in ("text", "heading"))).withColumnRenamed("contract_id", "wording")
    return clauses.join(read.hint("merge"), "wording")


def read(clauses: DataFrame, after: Step | None = None) -> DataFrame:
    """``clauses`` with all that is read of their wordings; those that are read already only get what ``after`` adds."""
    if "said" in clauses.columns:
        return after(clauses) if after else clauses
    return with_readings(*worded(clauses, after=after))
