"""Money terms of agreements, as a long table (contract_id, term, kind, value, other, note, clause_id, quote).

A term is read from the first sentence that states it. ``other`` is a second number (a multiple of the daily rent, a monthly interest),
``note`` a word (who pays, when, how often). Two readings are merged term by term, and a projection takes its inputs from here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicon import hebrew as H
from ..lexicon import money as M
from ..lexicon import verdicts as V
from ..session import settled
from . import clauses as C
from . import facts as X
from .verdicts import agreement_exit, exit_terms, says

COLUMNS = ("contract_id", "term", "kind", "value", "other", "note", "clause_id", "quote")


def start_date(sentence: Column) -> Column:
    """'YYYY-MM-DD' after a start marker, or anywhere; the parts are checked for range only."""
    marked = F.regexp_extract(sentence, f"({M.START}.*)", 1)
    tail = F.when(marked != "", marked).otherwise(sentence)
    names = F.create_map(*(F.lit(x) for pair in M.MONTHS.items() for x in pair))
    part = lambda p, i: F.nullif(F.regexp_extract(tail, p, i), F.lit(""))
    named = part(M.NAMED_DATE, 1).isNotNull()
    day = F.when(named, part(M.NAMED_DATE, 1)).otherwise(part(M.NUMERIC_DATE, 1)).cast("int")
    month = F.when(named, F.try_element_at(names, part(M.NAMED_DATE, 2))).otherwise(part(M.NUMERIC_DATE, 2).cast("int"))
    year = F.when(named, part(M.NAMED_DATE, 3)).otherwise(part(M.NUMERIC_DATE, 3)).cast("int")
    full = F.when(year < 100, year + 2000).otherwise(year)
    return F.when(month.between(1, 12) & day.between(1, 31), F.format_string("%d-%02d-%02d", full, month, day))


def stated(clauses: DataFrame, sentences: DataFrame) -> DataFrame:
    """(contract_id, clause_id, ord, s_ord, quote, term, kind, value, other, note): every sentence of ``clauses`` that states a term."""
    of = lambda kind: F.filter("numbers", lambda n: n["kind"] == kind)
    first = lambda kind, *order: F.array_min(F.transform(of(kind), lambda n: F.struct(*(n[c].alias(c) for c in (*order, "value")))))["value"]
    read = {
        "money": first("money", "scan", "at"), "n_money": F.size(of("money")), "percent": first("percent", "scan", "at"), "months": first("months", "at", "scan"),
        "amounts": F.array_sort(F.transform(of("money"), lambda n: F.struct(n["at"].alias("at"), n["value"].alias("value")))),
    }
    option = C.profiled(clauses).where(F.array_contains("primary", "OPTION")).select(*C.KEY, F.lit(True).alias("of_option"))
    df = sentences.withColumns(read).join(option.hint("merge"), C.KEY, "left")
    s = F.col("sentence")
    about = lambda c: says(s, H.CONCEPTS[c])
    null = F.lit(None)

    def item(name: str, holds: Column, value: Column = null, other: Column = null, note: Column = null, kind: str = "") -> Column:
        fields = F.struct(F.lit(name).alias("term"), F.lit(kind).alias("kind"), value.cast("double").alias("value"), other.cast("double").alias("other"), note.cast("string").alias("note"))
        return F.when(F.coalesce(holds, F.lit(False)), fields)

    in_option = about("OPTION") | (F.coalesce("of_option", F.lit(False)) & F.col("percent").isNotNull())
    frequency = F.when(says(s, M.MONTHLY), "MONTHLY").when(says(s, M.YEARLY), "ANNUAL").when(says(s, M.RENEWAL), "AT_RENEWAL").otherwise("UNKNOWN")
    mentioned = F.size(F.filter(F.array(*(F.when(says(s, p), F.lit(1)) for p in M.CHARGES.values())), lambda x: x.isNotNull()))
    payer = F.when(says(s, M.LANDLORD_PAYS) & ~says(s, V.TENANT_PAYS), "LANDLORD").otherwise("TENANT")
    late = says(s, M.LATE_VACATING)
    raw = F.regexp_extract(s, M.MULTIPLE, 1)
    multiple = F.when(raw.rlike(r"^\d+(\.\d+)?$"), raw.try_cast("double")).when(raw != "", C.number_word_value(raw).cast("double"))
    vacating, paying = F.when(says(s, M.DAILY), F.col("money")), F.when(says(s, M.PER_DAY), F.col("money"))
    interest = F.when(says(s, M.BY_YEAR), F.col("percent") / 12).otherwise(F.col("percent"))
    after = lambda p: F.coalesce(F.get(F.filter("amounts", lambda a: a["at"] > F.get(X.occurrences(s, p), F.lit(0))["at"]), F.lit(0))["value"], F.col("money"))
    items = [
        item("start", (about("TERM") | says(s, M.START)) & start_date(s).isNotNull(), note=start_date(s)),
        item("indexation", about("INDEXATION"), value=says(s, M.FLOOR).cast("int"), note=frequency, kind=""),
        item("option_months", in_option & F.col("months").isNotNull(), F.col("months")),
        item("option_percent", in_option & F.col("percent").isNotNull() & (about("RENT_INCREASE") | about("RENT")), F.col("percent")),
        item("increase_percent", ~in_option & about("RENT_INCREASE") & F.col("percent").isNotNull(), F.col("percent")),
        *(item("charge", says(s, p), F.when((mentioned == 1) & (F.col("n_money") == 1), F.col("money")), note=payer, kind=k) for k, p in M.CHARGES.items()),
        *(item("one_time", says(s, p) & F.col("money").isNotNull(), after(p), note=F.lit(when), kind=k) for k, (p, when) in M.ONE_TIME.items()),
        item("late_vacating", late & (vacating.isNotNull() | multiple.isNotNull()), vacating, multiple),
        item("late_payment", says(s, M.LATE_PAYMENT) & ~late & (paying.isNotNull() | interest.isNotNull()), paying, interest),
    ]
    return df.select("contract_id", "clause_id", "ord", "s_ord", s.alias("quote"), F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x")).select("contract_id", "clause_id", "ord", "s_ord", "quote", "x.*")


def with_terms(wordings: DataFrame) -> DataFrame:
    """What is read of wordings (see ``clauses.worded``) with ``terms`` and ``exits``: what their sentences state, and how they let a tenant leave."""
    sentences = C.with_facts(C.with_sentences(wordings))
    listed = lambda rows, name: rows.groupBy("contract_id").agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in (*C.KEY, "ord")))).alias(name)).hint("merge")
    return wordings.join(listed(stated(wordings, sentences), "terms"), "contract_id", "left").join(listed(exit_terms(sentences), "exits"), "contract_id", "left")


def extract(clauses: DataFrame) -> DataFrame:
    """The terms of each agreement in ``clauses`` (see ``clauses``); what ``with_terms`` has read is not read again."""
    if "terms" in clauses.columns:
        sentences = C.with_sentences(clauses)
        rows, exits = (clauses.select(*C.KEY, "ord", F.inline(c)) for c in ("terms", "exits"))
    else:
        sentences = settled(C.with_facts(C.with_sentences(clauses)))
        rows, exits = stated(clauses, sentences), exit_terms(sentences)
    facts = C.contract_facts(C.sentence_facts(sentences))
    once = rows.groupBy("contract_id", "term", "kind").agg(F.min_by(F.struct("value", "other", "note", "clause_id", "quote"), F.struct("ord", "s_ord")).alias("x")).select("contract_id", "term", "kind", "x.*")

    names = {"MONTHLY_RENT": "rent", "LEASE_TERM_MONTHS": "term", "OPTION_RENT": "option_rent", "SECURITY_RETURN_DAYS": "security_return_days"}
    named = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    null = F.lit(None)
    whole = facts.where(F.col("fact").isin(*names)).select("contract_id", named[F.col("fact")].alias("term"), F.lit("").alias("kind"), "value", null.cast("double").alias("other"), null.cast("string").alias("note"), "clause_id", F.col("sentence").alias("quote"))
    leaving = agreement_exit(exits)
    gone = leaving.select("contract_id", F.lit("exit").alias("term"), F.lit("").alias("kind"), F.coalesce(F.col("amount"), F.col("months").cast("double")).alias("value"), F.col("notice_days").alias("other"), F.col("kind").alias("note"), "clause_id", null.cast("string").alias("quote"))
    return once.select(*COLUMNS).unionByName(whole.select(*COLUMNS)).unionByName(gone.select(*COLUMNS))


def verified(terms: DataFrame, clauses: DataFrame) -> DataFrame:
    """``terms`` with ``verified``: the quote stands in its clause but for white space, and holds the value if there is one."""
    joined = terms.join(clauses.select("contract_id", "clause_id", "text").hint("merge"), ["contract_id", "clause_id"], "left")
    span = T.verbatim("text", "quote")
    plain = F.transform(F.regexp_extract_all(span, F.lit(f"({H.NUMBER})"), F.lit(1)), lambda n: F.regexp_replace(n, ",", "").cast("double"))
    holds = F.col("value").isNull() | F.exists(plain, lambda n: F.abs(n - F.col("value")) < 0.005)
    return joined.withColumn("verified", F.coalesce(span.isNotNull() & holds, F.lit(False))).drop("text")


def merged(rule: DataFrame, model: DataFrame) -> DataFrame:
    """Both readings, term by term: a verified model value wins, and is in ``conflict`` if the rules read another; an unverified one only
    fills a gap. ``model`` has ``verified``."""
    keys = ["contract_id", "term", "kind"]
    rest = [c for c in COLUMNS if c not in keys]
    r = rule.select(*keys, F.struct(*rest).alias("r"))
    m = model.select(*keys, "verified", F.struct(*rest).alias("m"))
    both = r.join(m.hint("merge"), keys, "full_outer")
    wins = F.coalesce("verified", F.lit(False)) | F.col("r").isNull()
    conflict = F.coalesce(F.col("verified") & (F.abs(F.col("r.value") - F.col("m.value")) > 0.005), F.lit(False))
    return both.withColumn("x", F.when(wins, F.col("m")).otherwise(F.col("r"))).select(*keys, "x.*", conflict.alias("conflict"), F.when(wins & F.col("m").isNotNull(), "MODEL").otherwise("RULE").alias("origin"))


def unknowns(terms: DataFrame, agreements: DataFrame) -> DataFrame:
    """(contract_id, notes): what an agreement does not say."""
    has = lambda t: F.bool_or(F.col("term") == t)
    told = terms.groupBy("contract_id").agg(has("rent").alias("rent"), has("term").alias("length"), has("exit").alias("exit"), F.bool_or((F.col("term") == "indexation") & (F.col("note") == "UNKNOWN")).alias("how_often"), F.sort_array(F.collect_set(F.when((F.col("term") == "charge") & (F.col("note") == "TENANT") & F.col("value").isNull(), F.concat(F.lit("UNPRICED_"), "kind")))).alias("unpriced"))
    rows = agreements.select("contract_id").distinct().join(told.hint("merge"), "contract_id", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    notes = F.array_compact(F.array(F.when(no("rent"), "NO_RENT"), F.when(no("length"), "NO_TERM"), F.when(~no("how_often"), "INDEXATION_UNCLEAR"), F.when(no("exit"), "NO_EXIT_TERMS")))
    return rows.select("contract_id", F.concat(notes, F.coalesce("unpriced", F.array().cast("array<string>"))).alias("notes"))


def schedule_inputs(terms: DataFrame) -> DataFrame:
    """One row an agreement, in the columns of ``schedule.INPUTS``. An index without a stated frequency counts as monthly."""
    get = lambda t, c="value", more=None: F.max(F.when((F.col("term") == t) & (more if more is not None else F.lit(True)), F.col(c)))
    total = lambda t, note: F.sum(F.when((F.col("term") == t) & (F.col("note") == note), F.col("value")))
    exit_kind = F.col("note")
    return terms.groupBy("contract_id").agg(
        F.substring(get("start", "note"), 1, 7).alias("start"), get("rent").alias("rent"), get("term").cast("int").alias("term"), get("increase_percent").alias("increase_percent"), get("option_months").cast("int").alias("option_months"),
        get("option_rent").alias("option_rent"), get("option_percent").alias("option_percent"), F.regexp_replace(get("indexation", "note"), "UNKNOWN", "MONTHLY").alias("indexation"), (get("indexation") > 0).alias("floor_at_base"),
        total("charge", "TENANT").alias("charges"), total("one_time", "START").alias("one_time_start"), total("one_time", "END").alias("one_time_end"), get("exit", "note").alias("exit_kind"), get("exit", "other").cast("int").alias("exit_notice_days"),
        get("exit", "value", exit_kind == "FIXED_MONTHS").cast("int").alias("exit_months"), get("exit", "value", exit_kind == "FIXED_AMOUNT").alias("exit_amount"), get("late_vacating").alias("vacating_per_day"),
        get("late_vacating", "other").alias("vacating_multiple"), get("late_payment").alias("payment_per_day"), get("late_payment", "other").alias("payment_interest"),
    )
