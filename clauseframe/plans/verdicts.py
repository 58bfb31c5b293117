"""Verdicts by rule: numeric limits, the tenant's preferences, and wording that carries a risk.

Each clause becomes one wide row (its text, sentences, facts, the agreement's facts, its links), and the rules are one table over
that row; see ``rules.evaluate`` for how they combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicon import hebrew as H
from ..lexicon import verdicts as V
from ..session import settled
from . import clauses as C
from . import rules

#: A tenant who asks for nothing.
INDIFFERENT = {
    "pets": False, "max_rent": float("inf"), "furnished": False, "accepted_securities": tuple(V.SECURITY_KINDS), "max_increase": float("inf"), "term": None, "accepts_indexation": True,
    "accepts_broker_fee": True, "early_exit": False, "renewal": False, "roommates": False, "min_notice_hours": None, "repair_hours": float("inf"),
}
#: rule -> (flag, topic, confidence). Fixed table; the order is the order of evaluation.
RULES = {
    "SECURITY_CAP": ("violates", "guarantee_security", "high"), "URGENT_REPAIR": ("violates", "repairs_maintenance", "high"), "PETS": ("preference", "pets_and_use", "high"), "BUDGET": ("preference", "rent_and_term", "high"),
    "FURNITURE": ("preference", "handover_condition", "high"), "SECURITY_KIND": ("preference", "guarantee_security", "high"), "INCREASE": ("preference", "rent_and_term", "high"), "LENGTH": ("preference", "rent_and_term", "high"),
    "INDEXATION": ("preference", "rent_and_term", "high"), "BROKER_FEE": ("preference", "charges_payments", "high"), "EARLY_EXIT": ("preference", "termination_renewal", "high"), "RENEWAL": ("preference", "termination_renewal", "high"),
    "ROOMMATES": ("preference", "pets_and_use", "high"), "ENTRY_NOTICE": ("preference", "entry_privacy", "high"), "REPAIR_TIME": ("preference", "repairs_maintenance", "high"), "WAIVER": ("risk", "waiver_liability", "medium"),
    "REALIZATION": ("risk", "guarantee_security", "medium"), "ENTRY": ("risk", "entry_privacy", "medium"), "OWNER_CHARGES": ("risk", "charges_payments", "medium"), "SECURITY_RETURN": ("risk", "guarantee_security", "medium"),
    "NO_REFUND": ("risk", "repairs_maintenance", "medium"), "OVERRIDES": ("risk", "other", "medium"), "OVERRIDDEN": ("risk", None, "medium"),
}
MOST_RETURN_DAYS, MOST_REPAIR_DAYS = 60, 3
#: Facts that are judged where they stand, and those that count for the whole agreement.
OWN = ("SECURITY_AMOUNT", "SECURITY_RETURN_DAYS", "URGENT_REPAIR_DAYS", "RENT_INCREASE_PERCENT")
WHOLE = ("MONTHLY_RENT", "LEASE_TERM_MONTHS")


def says(text: Column, pattern: str) -> Column:
    return F.coalesce(T.holds(text, pattern), F.lit(False))


def exit_terms(sentences: DataFrame) -> DataFrame:
    """(…, kind, months, amount, notice_days) of sentences about leaving early, by the first reading that holds.

    The notice is the duration after the tenant is named, else the first one.
    """
    tenant = F.locate("השוכר", F.col("sentence"))
    of = lambda kind: F.filter("numbers", lambda n: n["kind"] == kind)
    days = F.array_min(F.transform(of("days"), lambda n: F.struct((~((tenant > 0) & (n["at"] > tenant))).alias("late"), n["at"].alias("at"), n["value"].alias("value"))))["value"]
    money = F.array_min(F.transform(of("money"), lambda n: F.struct(n["at"].alias("at"), n["value"].alias("value"))))["value"]
    s = F.col("sentence")
    about = says(s, H.CONCEPTS["EARLY_TERMINATION"]) | says(s, H.CONCEPTS["REPLACEMENT_TENANT"]) | says(s, V.NO_TENANT_RIGHT)
    df = C.with_numbers(sentences.where(about)).withColumn("money", money).withColumn("notice", F.when(says(s, "הודעה|התראה"), days))
    replacement = says(s, V.REPLACEMENT) & ~says(s, V.NO_REPLACEMENT)
    raw = F.concat(F.regexp_extract(s, V.FIXED_MONTHS, 1), F.regexp_extract(s, V.FIXED_MONTHS, 2))
    months = F.when(raw.rlike(r"^\d"), F.try_to_number(raw, F.lit("999")).cast("int")).otherwise(C.number_word_value(raw))
    fixed = says(s, V.FIXED_MONTHS) & says(s, "פיצוי|ישלם|תשלם") & (months > 0)
    needs = says(s, V.REPLACEMENT_REQUIRED)
    kind = (
        F.when(says(s, V.PAYS_TO_END), "UNTIL_END")
        .when(fixed, "FIXED_MONTHS")
        .when(F.col("money").isNotNull() & says(s, "פיצוי|קנס"), "FIXED_AMOUNT")
        .when(says(s, V.TENANT_MAY_END) & replacement & needs, "UNTIL_REPLACEMENT")
        .when(says(s, V.TENANT_MAY_END) & (F.col("notice").isNotNull() | ~replacement), "ALLOWED_WITH_NOTICE")
        .when(replacement & (needs | says(s, V.MAY_PROPOSE)), "UNTIL_REPLACEMENT")
        .when(says(s, V.NO_TENANT_RIGHT), "NOT_ALLOWED")
    )
    found = df.withColumn("kind", kind).where("kind IS NOT NULL")
    return found.select(*C.SENTENCE, "sentence", "kind", F.when(F.col("kind") == "FIXED_MONTHS", months).alias("months"), F.when(F.col("kind") == "FIXED_AMOUNT", F.col("money")).alias("amount"), F.when(~F.col("kind").isin("UNTIL_END", "NOT_ALLOWED"), F.col("notice")).alias("notice_days"))


def agreement_exit(exits: DataFrame) -> DataFrame:
    """(contract_id, clause_id, kind, months, amount, notice_days, conflict): the most specific reading, the first of equals; a conflict
    if one clause denies what another grants."""
    rank = F.create_map(*(F.lit(x) for pair in V.SPECIFICITY.items() for x in pair))[F.col("kind")]
    of = Window.partitionBy("contract_id")
    denies = F.col("kind") == "NOT_ALLOWED"
    rows = exits.withColumn("k", F.row_number().over(of.orderBy(F.desc(rank), "ord", "s_ord")))
    rows = rows.withColumn("conflict", (F.max(denies.cast("int")).over(of) == 1) & (F.min(denies.cast("int")).over(of) == 0) & (F.min("clause_id").over(of) != F.max("clause_id").over(of)))
    return rows.where("k = 1").select("contract_id", "clause_id", "kind", "months", "amount", "notice_days", "conflict")


def marked(clauses: DataFrame, preferences: dict) -> DataFrame:
    """``clauses`` that are read, with ``marks``: what the rules ask of a clause's own words - the facts that it states first, and a flag for each
    rule that looks at its wording only."""
    p, text = INDIFFERENT | preferences, F.col("text")
    any_sentence = lambda f: F.coalesce(F.exists("said", lambda x: f(x["sentence"])), F.lit(False))
    # facts stand in the order of their sentences and scans, so the first of a kind is the clause's
    first = lambda k: F.get(F.filter(F.flatten(F.transform("said", lambda x: x["facts"])), lambda x: x["fact"] == k), F.lit(0))["value"]
    days = lambda x: F.array_min(F.transform(F.filter(x["numbers"], lambda n: n["kind"] == "days"), lambda n: F.struct(n["at"].alias("at"), n["value"].alias("value"))))["value"]
    entry = F.transform("said", lambda x: F.when(says(x["sentence"], H.CONCEPTS["ENTRY"]) & says(x["sentence"], V.NOTICE), days(x)))
    demanded = lambda s: F.filter(F.array(*(F.when(says(s, pattern), F.lit(kind)) for kind, pattern in V.SECURITY_KINDS.items())), lambda k: k.isNotNull())
    refused = lambda s: F.array_except(demanded(s), F.array(*map(F.lit, p["accepted_securities"])).cast("array<string>"))
    refuses = any_sentence(lambda s: says(s, V.DEMANDS_SECURITY) & (F.size(refused(s)) > 0) & (~says(s, V.OFFERS_CHOICE) | (F.size(refused(s)) == F.size(demanded(s)))))
    yes = lambda flag, c: c if flag else F.lit(False)
    flags = {
        "PETS": yes(p["pets"], says(text, V.PETS_BARRED)),
        "FURNITURE": yes(p["furnished"], says(text, V.UNFURNISHED)),
        "SECURITY_KIND": refuses,
        "INDEXATION": yes(not p["accepts_indexation"], any_sentence(lambda s: says(s, V.RENT_INDEXED) & ~says(s, V.NOT_INDEXED))),
        "BROKER_FEE": yes(not p["accepts_broker_fee"], any_sentence(lambda s: says(s, V.BROKER_FEE) & says(s, V.TENANT_PAYS))),
        "RENEWAL": yes(p["renewal"], says(text, V.NO_RENEWAL)),
        "ROOMMATES": yes(p["roommates"], any_sentence(lambda s: says(s, V.SUBLET_BARRED))),
        "WAIVER": says(text, V.WAIVES_ALL),
        "REALIZATION": says(text, V.REALIZES) & says(text, V.NO_NOTICE),
        "ENTRY": says(text, V.ENTERS) & says(text, V.NO_COORDINATION),
        "OWNER_CHARGES": says(text, V.OWNER_CHARGES),
        "NO_REFUND": says(text, V.NO_REFUND) & says(text, V.SELF_REPAIR),
        "shifts": says(text, V.SHIFTS_BURDEN),
    }
    facts = {k: first(k) for k in (*OWN, *WHOLE)} | {"entry_days": F.get(F.filter(entry, lambda d: d.isNotNull()), F.lit(0))}
    return clauses.withColumn("marks", F.struct(*(c.alias(n) for n, c in (flags | facts).items())))


def verdicts(clauses: DataFrame, links: DataFrame, preferences: dict) -> DataFrame:
    """(contract_id, clause_id, violates, risk, preference, rule, topic, confidence, severity, category) of each clause.

    ``links`` are ``links.link_clauses`` of the clauses; ``preferences`` overrides ``INDIFFERENT``, also for ``marked``, if that was called before.
    """
    p = INDIFFERENT | preferences
    if "marks" not in clauses.columns:
        clauses = C.read(clauses, after=lambda read: marked(read, preferences))
    df = clauses.select(*C.KEY, "ord", "marks.*")
    if p["early_exit"]:
        leaving = exit_terms(C.with_facts(C.with_sentences(clauses))).where("kind IN ('NOT_ALLOWED', 'UNTIL_END')").select(*C.KEY, F.lit(True).alias("stuck")).distinct()
        df = df.join(leaving.hint("merge"), C.KEY, "left")
    of_kind = lambda relation: links.where(F.col("relation") == relation)
    # what overrides a clause is read once for each wording; kept, as a pattern would be pushed below the distinct and to both sides of the join
    shifting = settled(settled(of_kind("OVERRIDDEN_BY").select("excerpt").distinct()).withColumn("shifting", says(F.col("excerpt"), V.SHIFTS_BURDEN))).where("shifting").drop("shifting")
    over = of_kind("OVERRIDES").select(*C.KEY, F.lit(True).alias("overrides"), F.lit(False).alias("overridden"))
    under = of_kind("OVERRIDDEN_BY").join(shifting.hint("merge"), "excerpt", "left_semi").select(*C.KEY, F.lit(False).alias("overrides"), F.lit(True).alias("overridden"))
    pointed = over.unionByName(under).groupBy(*C.KEY).agg(F.bool_or("overrides").alias("overrides"), F.bool_or("overridden").alias("overridden"))
    df = df.join(pointed.hint("merge"), C.KEY, "left")
    of = Window.partitionBy("contract_id")
    df = df.withColumns({f"of_{k}": F.min_by(F.struct(F.col(k).alias("value"), "clause_id"), F.when(F.col(k).isNotNull(), F.struct("ord", "clause_id"))).over(of) for k in WHOLE})

    fact = F.col
    of_all = lambda k: F.col(f"of_{k}")
    defined_here = lambda k: of_all(k)["clause_id"] == F.col("clause_id")
    cap = rules.security_cap(of_all("MONTHLY_RENT")["value"], of_all("LEASE_TERM_MONTHS")["value"], fact("SECURITY_AMOUNT"))
    yes = lambda flag, c: c if flag else F.lit(False)
    overrides = F.coalesce("overrides", F.lit(False)) & F.col("shifts")
    holds = {rule: F.col(rule) for rule in RULES if rule in df.columns} | {
        "SECURITY_CAP": ~cap["passed"],
        "URGENT_REPAIR": ~rules.urgent_repair(fact("URGENT_REPAIR_DAYS"), MOST_REPAIR_DAYS),
        "BUDGET": defined_here("MONTHLY_RENT") & (of_all("MONTHLY_RENT")["value"] > p["max_rent"]),
        "INCREASE": fact("RENT_INCREASE_PERCENT") > p["max_increase"],
        "LENGTH": yes(p["term"] is not None, defined_here("LEASE_TERM_MONTHS") & (of_all("LEASE_TERM_MONTHS")["value"] != (p["term"] or 0))),
        "EARLY_EXIT": yes(p["early_exit"], F.coalesce(F.col("stuck"), F.lit(False)) if p["early_exit"] else None),
        "ENTRY_NOTICE": yes(p["min_notice_hours"] is not None, F.col("entry_days") * 24 < (p["min_notice_hours"] or 0)),
        "REPAIR_TIME": fact("URGENT_REPAIR_DAYS") * 24 > p["repair_hours"],
        "SECURITY_RETURN": fact("SECURITY_RETURN_DAYS") > MOST_RETURN_DAYS,
        "OVERRIDES": overrides,
        "OVERRIDDEN": ~overrides & F.coalesce("overridden", F.lit(False)),
    }
    table = [rules.Rule(name, holds[name], flag) for name, (flag, _, _) in RULES.items()]
    # the topic of an overridden clause is that of the rule before it
    before = rules.evaluate(df, [r for r in table if r.reason != "OVERRIDDEN"], ("violates",), reason="rule_before").drop("violates")
    done = rules.evaluate(before, table, ("violates", "risk", "preference"), reason="rule")
    topics = F.create_map(*(F.lit(x) for name, (_, topic, _) in RULES.items() if topic for x in (name, topic)))
    sure = F.create_map(*(F.lit(x) for name, (_, _, confidence) in RULES.items() for x in (name, confidence)))
    topic = F.coalesce(topics[F.when(F.col("rule") == "OVERRIDDEN", F.col("rule_before")).otherwise(F.col("rule"))], F.lit("other"))
    flags = [F.col(f) for f in ("violates", "risk", "preference")]
    return done.select(*C.KEY, "violates", "risk", "preference", "rule", topic.alias("topic"), F.coalesce(sure[F.col("rule")], F.lit("medium")).alias("confidence"), rules.severity(*flags).alias("severity"), rules.category(*flags).alias("category"))
