"""Text, similarity and document-plan queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import similarity as S
from ..functions import text as T
from ..lexicon.latin import CONCEPTS, SUBJECTS
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ranking as R
from ..plans import facts, redact, rules, segment
from ..registry import query, table

WORDS_SQL = r"[w FOR w IN string_split_regex(coalesce({}, ''), '\s+') IF w <> '']"
LINES_SQL = r"""l AS (SELECT doc_id, unnest(range(len(ls))) AS ord, unnest(ls) AS line FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM documents)),
lines AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, line FROM l WHERE trim(regexp_replace(line, '\s', ' ', 'g')) <> '')"""
NORMAL_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '^\s*\d+(?:\.\d+)*\s*[.):\-]?\s*', ''), '[“”„״]', '"', 'g'), '[‘’‚׳]', '''', 'g'), '\s+', ' ', 'g'))"""


@query(f"WITH {LINES_SQL} SELECT doc_id, ord, line FROM lines")
def doc_line_explode(spark, sf_dir):
    return segment.explode_lines(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, CAST(len({WORDS_SQL.format('text')}) AS INTEGER) AS words FROM documents")
def doc_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count("text").alias("words"))


@query(f"""WITH {LINES_SQL}, s AS (SELECT *, len({WORDS_SQL.format('line')}) AS n FROM lines),
g AS (SELECT *, sum(CASE WHEN ord0 = 1 OR n <= 7 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS clause FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS ord0 FROM s))
SELECT doc_id, CAST(clause AS BIGINT) AS clause, count(*) AS lines, CAST(sum(n) AS BIGINT) AS words, min(ord) AS first_line FROM g GROUP BY doc_id, clause""")
def clause_group_runs(spark, sf_dir):
    lines = segment.explode_lines(table(spark, sf_dir, "documents")).withColumn("n", T.word_count("line"))
    grouped = segment.clause_groups(lines, F.col("n") <= 7)
    return grouped.groupBy("doc_id", "clause").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("words"), F.min("ord").alias("first_line"))


@query(r"""WITH j AS (SELECT doc_id, array_to_string([trim(x) FOR x IN string_split(coalesce(text, ''), chr(10)) IF trim(x) <> ''], ' ') AS t FROM documents),
s AS (SELECT doc_id, [trim(x) FOR x IN string_split(regexp_replace(t, '([^\d\s][.!?;])\s+', '\1' || chr(1), 'g'), chr(1)) IF length(trim(x)) > 1] AS ss FROM j)
SELECT doc_id, CAST(unnest(range(len(ss))) AS INTEGER) AS ord, unnest(ss) AS sentence FROM s""")
def sentence_split(spark, sf_dir):
    return segment.explode_sentences(table(spark, sf_dir, "documents"))


@query()
def chunk_pack_300(spark, sf_dir):
    return segment.pack_chunks(table(spark, sf_dir, "documents"))


@query(f"""WITH {LINES_SQL} SELECT doc_id, ord, line FROM lines WHERE NOT (
  regexp_matches(lower(line), '^\\s*(?:page|עמוד|seite|página)\\s+\\d+(?:\\s*(?:of|/|מתוך|von|de)\\s*\\d+)?\\s*$') OR regexp_matches(line, '^[\\s\\d./:,\\-]{{1,80}}$') OR regexp_matches(line, '^[\\s_=*~.\\-]{{1,80}}$'))""")
def junk_line_filter(spark, sf_dir):
    return segment.explode_lines(table(spark, sf_dir, "documents")).where(~segment.is_junk("line"))


@query(f"""WITH {LINES_SQL}, n AS (SELECT *, {NORMAL_SQL.format('line')} AS norm FROM lines),
r AS (SELECT norm FROM n GROUP BY norm HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, ord, line FROM n WHERE norm NOT IN (SELECT norm FROM r)""")
def repeated_line_furniture(spark, sf_dir):
    return segment.without_furniture(segment.explode_lines(table(spark, sf_dir, "documents")))


def _steps() -> str:
    sql = "SELECT doc_id, text AS t0 FROM documents"
    for i, r in enumerate(redact.LATIN):
        sql = f"SELECT *, len(regexp_extract_all(t{i}, '{r.pattern}')) AS n{i}, regexp_replace(t{i}, '{r.pattern}', '{r.mark}', 'g') AS t{i + 1} FROM ({sql})"
    return sql


_LAST = len(redact.LATIN)


@query(f"SELECT doc_id, t{_LAST} AS text, CAST({' + '.join(f'n{i}' for i in range(_LAST))} AS INTEGER) AS redactions FROM ({_steps()})")
def pii_redact_chain(spark, sf_dir):
    done = redact.redact(table(spark, sf_dir, "documents").select("doc_id", "text"), redact.LATIN)
    return done.select("doc_id", "text", F.aggregate(F.map_values("redactions"), F.lit(0), lambda a, x: a + x).alias("redactions"))


@query(f"SELECT r.rule, CAST(sum(n) AS BIGINT) AS entities, count(*) FILTER (n > 0) AS documents FROM (SELECT unnest([{', '.join(repr(r.name) for r in redact.LATIN)}]) AS rule, unnest([{', '.join(f'n{i}' for i in range(_LAST))}]) AS n FROM ({_steps()})) r GROUP BY r.rule")
def pii_entity_counts(spark, sf_dir):
    done = redact.redact(table(spark, sf_dir, "documents").select("doc_id", "text"), redact.LATIN)
    rows = done.select(F.explode("redactions").alias("rule", "n"))
    return rows.groupBy("rule").agg(F.sum("n").alias("entities"), F.count_if(F.col("n") > 0).alias("documents"))


@query(f"SELECT doc_id, regexp_matches(text, '{redact.LATIN[0].pattern}') OR regexp_matches(text, '{redact.LATIN[1].pattern}') AS blocked FROM documents")
def pii_residual_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", redact.residual("text", redact.LATIN, ("email", "card")).alias("blocked"))


NUMBERS_SQL = r"[replace(x, ',', '') FOR x IN regexp_extract_all(regexp_replace({}, '(?m)^[ \t]*\d{{1,3}}[.)][ \t]', '', 'g'), '(?:\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?)')]"


@query(f"SELECT doc_id, CAST(len(n) AS INTEGER) AS count, array_to_string(n, ' ') AS numbers FROM (SELECT doc_id, {NUMBERS_SQL.format('text')} AS n FROM documents)")
def number_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.numbers_in("text").alias("n")).select("doc_id", F.size("n").alias("count"), F.array_join("n", " ").alias("numbers"))


@query(f"""SELECT DISTINCT doc_id, number FROM (SELECT doc_id, unnest({NUMBERS_SQL.format('text')}) AS number FROM documents)
WHERE number NOT IN (SELECT unnest({NUMBERS_SQL.format('text')}) FROM benchmark)""")
def ungrounded_numbers(spark, sf_dir):
    said = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(N.numbers_in("text"))).alias("number"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(N.numbers_in("text")).alias("number")).distinct()
    return said.join(known, "number", "left_anti").select("doc_id", "number")


CONCEPT_SQL = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS concept, CAST(len(regexp_extract_all(lower(text), '{p}')) AS INTEGER) AS n FROM documents" for c, p in CONCEPTS.items())


@query(f"SELECT doc_id, concept, n FROM ({CONCEPT_SQL}) WHERE n > 0")
def concept_counts(spark, sf_dir):
    return facts.concept_counts(table(spark, sf_dir, "documents"), CONCEPTS)


@query(f"""WITH c AS (SELECT * FROM ({CONCEPT_SQL}) WHERE n > 0), m AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS most FROM c)
SELECT doc_id, concept, n FROM m WHERE n >= 2 OR n = most""")
def primary_concepts(spark, sf_dir):
    return facts.primary_concepts(facts.concept_counts(table(spark, sf_dir, "documents"), CONCEPTS))


@query(f"""WITH {LINES_SQL}, f AS (SELECT doc_id, ord, CASE WHEN contains(line, '@') THEN 'EMAIL' WHEN regexp_matches(line, '\\d') THEN 'NUMBER' END AS kind, line FROM lines)
SELECT doc_id, kind, min(ord) AS ord, arg_min(line, ord) AS line FROM f WHERE kind IS NOT NULL GROUP BY doc_id, kind""")
def first_fact_per_doc(spark, sf_dir):
    lines = segment.explode_lines(table(spark, sf_dir, "documents"))
    kind = F.when(F.contains("line", F.lit("@")), "EMAIL").when(F.rlike("line", F.lit(r"\d")), "NUMBER")
    return A.earliest_fact(lines.withColumn("kind", kind).where("kind IS NOT NULL"), ["doc_id", "kind"], "ord").select("doc_id", "kind", "ord", "line")


@query(rf"""WITH {LINES_SQL},
num AS (SELECT doc_id, ord, unnest(range(1, length(line) + 1)) AS pos, line FROM lines WHERE regexp_matches(line, '\d')),
n AS (SELECT doc_id, ord, pos AS number_at, regexp_extract(substr(line, pos), '^\d+') AS number FROM num WHERE regexp_matches(substr(line, pos, 1), '\d') AND (pos = 1 OR NOT regexp_matches(substr(line, pos - 1, 1), '\d'))),
s AS ({' UNION ALL '.join(f"SELECT doc_id, ord, pos AS subject_at, '{c}' AS subject, length(regexp_extract(substr(lower(line), pos), '^(?:{p})')) AS size FROM num WHERE regexp_matches(substr(lower(line), pos), '^(?:{p})')" for c, p in SUBJECTS.items())}),
j AS (SELECT n.*, s.subject, row_number() OVER (PARTITION BY n.doc_id, n.ord, n.number_at ORDER BY s.subject_at > n.number_at, abs(n.number_at - s.subject_at), -s.size, s.subject) AS k
  FROM n JOIN s ON n.doc_id = s.doc_id AND n.ord = s.ord AND s.subject_at <> n.number_at)
SELECT doc_id, ord, CAST(number_at AS INTEGER) AS number_at, number, subject FROM j WHERE k = 1""")
def nearest_subject(spark, sf_dir):
    lines = segment.explode_lines(table(spark, sf_dir, "documents")).where(F.rlike("line", F.lit(r"\d")))
    spread = lambda name, c: lines.select("doc_id", "ord", F.explode(c).alias("x")).select("doc_id", "ord", "x.at", "x.hit", *([F.lit(name).alias("subject")] if name else []))
    numbers = spread("", facts.occurrences(F.col("line"), r"\d+"))
    subjects = [spread(name, facts.occurrences(F.lower("line"), pattern)) for name, pattern in SUBJECTS.items()]
    all_ = subjects[0].unionByName(subjects[1]).unionByName(subjects[2])
    return facts.nearest_subject(numbers, all_, ["doc_id", "ord"])


@query(rf"""WITH {LINES_SQL}, t AS (SELECT doc_id, ord, unnest([w FOR w IN regexp_extract_all(lower(line), '\pL+') IF length(w) >= 3]) AS term FROM lines),
tf AS (SELECT doc_id, ord, term, count(*) AS tf FROM t GROUP BY ALL), p AS (SELECT doc_id, count(DISTINCT ord) AS parts FROM t GROUP BY 1),
w AS (SELECT *, tf * ln((1 + parts) / CAST(1 + count(*) OVER (PARTITION BY doc_id, term) AS DOUBLE)) AS w FROM tf JOIN p USING (doc_id)),
u AS (SELECT doc_id, ord, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, ord)) AS w FROM w WHERE w > 0)
SELECT a.doc_id, a.ord AS part_a, b.ord AS part_b, round(sum(a.w * b.w), 6) AS score FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.term = b.term AND a.ord < b.ord
GROUP BY ALL HAVING sum(a.w * b.w) >= 0.3""")
def tfidf_pairs(spark, sf_dir):
    lines = segment.explode_lines(table(spark, sf_dir, "documents"))
    terms = F.filter(F.regexp_extract_all(F.lower("line"), F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: F.length(w) >= 3)
    return S.part_pairs(lines, "doc_id", "ord", terms, F.length("line"), 0.3).withColumn("score", F.round("score", 6))


@query(r"""WITH g AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS t FROM benchmark), e AS (SELECT item_id, length(t) - 2 AS n, substr(t, unnest(range(1, length(t) - 1)), 3) AS gram FROM g WHERE length(t) >= 3),
c AS (SELECT item_id, n, gram, count(*) AS c FROM e GROUP BY ALL)
SELECT a.item_id AS item_a, b.item_id AS item_b, round(2.0 * sum(least(a.c, b.c)) / (a.n + b.n), 6) AS dice FROM c a JOIN c b ON a.gram = b.gram AND a.item_id < b.item_id GROUP BY a.item_id, b.item_id, a.n, b.n""")
def trigram_dice(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", T.trigrams("text").alias("grams"))
    a, b = items.withColumnRenamed("item_id", "item_a"), items.withColumnRenamed("item_id", "item_b")
    found = S.multiset_overlap(a, b, "item_a", "item_b", "grams").where("item_a < item_b")
    return found.select("item_a", "item_b", F.round(2.0 * F.col("shared") / (F.col("n_left") + F.col("n_right")), 6).alias("dice"))


@query(r"""WITH g AS (SELECT 'd' AS side, doc_id AS id, regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', '', 'g') AS t FROM documents UNION ALL SELECT 'b', item_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', '', 'g') FROM benchmark),
e AS (SELECT side, id, length(t) - 2 AS n, substr(t, unnest(range(1, length(t) - 1)), 3) AS gram FROM g WHERE length(t) >= 3), c AS (SELECT side, id, n, gram, count(*) AS c FROM e GROUP BY ALL)
SELECT a.id AS doc_id, b.id AS item_id, round(2.0 * sum(least(a.c, b.c)) / (a.n + b.n), 6) AS dice FROM c a JOIN c b ON a.gram = b.gram AND a.side = 'd' AND b.side = 'b' GROUP BY a.id, b.id, a.n, b.n""")
def trigram_dice_documents(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = S.bag_overlap(docs, items, "doc_id", "item_id", "text", S.trigram_bag)
    return found.select("doc_id", "item_id", F.round(2.0 * F.col("shared") / (F.col("n_left") + F.col("n_right")), 6).alias("dice"))


GRAMS_SQL = "list_distinct([array_to_string(w[i:i + 7], ' ') FOR i IN range(1, len(w) - 6)])"


@query(f"""WITH b AS (SELECT item_id, {GRAMS_SQL} AS g FROM (SELECT item_id, {WORDS_SQL.format('lower(text)')} AS w FROM benchmark)),
d AS (SELECT doc_id, unnest({GRAMS_SQL}) AS gram FROM (SELECT doc_id, {WORDS_SQL.format('lower(text)')} AS w FROM documents)),
i AS (SELECT item_id, len(g) AS n, unnest(g) AS gram FROM b)
SELECT doc_id, item_id, round(count(*) / CAST(n AS DOUBLE), 6) AS containment FROM d JOIN i USING (gram) GROUP BY doc_id, item_id, n HAVING count(*) / CAST(n AS DOUBLE) >= 0.7""")
def containment_pairs(spark, sf_dir):
    # runs of words are told apart by 96 bits of two unlike hashes, so that no text is shuffled
    grams = F.transform(T.shingles(F.lower("text"), 8), lambda g: F.struct(F.xxhash64(g).alias("x"), F.hash(g).alias("y")))
    items = table(spark, sf_dir, "benchmark").select("item_id", grams.alias("g")).select("item_id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(grams).alias("gram"))
    shared = docs.join(items, "gram").groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    return shared.withColumn("containment", F.col("shared") / F.col("n")).where("containment >= 0.7").select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


@query(f"""WITH w AS (SELECT conv_id, turn, list_distinct([x FOR x IN {WORDS_SQL.format('lower(text)')} IF length(x) > 1]) AS w FROM conversations),
p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
SELECT conv_id, turn, round(len(list_intersect(w, b)) / CAST(greatest(1, len(list_distinct(list_concat(w, b)))) AS DOUBLE), 6) AS jaccard FROM p WHERE b IS NOT NULL""")
def jaccard_words(spark, sf_dir):
    own = F.array_distinct(F.filter(T.words(F.lower("text")), lambda w: F.length(w) > 1))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", own.alias("w"))
    rows = rows.withColumn("b", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(S.jaccard(F.col("w"), F.col("b")), 6).alias("jaccard"))


WORD_SET_SQL = "list_distinct([x FOR x IN string_split_regex(coalesce(lower(text), ''), '[ \\t\\n\\x0b\\f\\r]+') IF length(x) > 1])"


@query(f"""WITH d AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM (SELECT doc_id, {WORD_SET_SQL} AS w FROM documents)),
b AS (SELECT item_id, len(w) AS n, unnest(w) AS word FROM (SELECT item_id, {WORD_SET_SQL} AS w FROM benchmark))
SELECT doc_id, item_id, round(count(*) / CAST(d.n + b.n - count(*) AS DOUBLE), 6) AS jaccard FROM d JOIN b ON d.word = b.word GROUP BY doc_id, item_id, d.n, b.n""")
def jaccard_words_documents(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text")), table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("text"))
    found = S.bag_overlap(docs, items, "doc_id", "item_id", "text", S.word_bag)
    return found.select("doc_id", "item_id", F.round(F.col("shared") / (F.col("n_left") + F.col("n_right") - F.col("shared")), 6).alias("jaccard"))


@query(f"""WITH n AS (SELECT doc_id, {NORMAL_SQL.format('text')} AS norm, doc_id % 2 AS side FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY side, norm ORDER BY doc_id) AS k FROM n)
SELECT a.doc_id AS before_id, b.doc_id AS after_id FROM k a JOIN k b ON a.norm = b.norm AND a.k = b.k AND a.side = 0 AND b.side = 1""")
def exact_text_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode(T.normalized("text"), "UTF-8"), 256).alias("norm"))
    left, right = docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "before_id"), docs.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "after_id")
    return J.occurrence_pairs(left, right, "norm", F.col("before_id"), F.col("after_id")).select("before_id", "after_id")


@query("""WITH s AS (SELECT q.vec_id AS query, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))), 9) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return S.nearest(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 5).withColumn("score", F.round("score", 6))


@query("""WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS score
FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.4""")
def vector_threshold_links(spark, sf_dir):
    pairs = S.linked(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.4)
    return pairs.select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"), F.round("score", 6).alias("score"))


@query("""WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.4)
SELECT vec_id, label, count(p.vec_id) AS n_links FROM u LEFT JOIN p USING (vec_id) GROUP BY vec_id, label""")
def vector_link_counts(spark, sf_dir):
    """The links of ``vector_threshold_links`` as one row a vector: its class and how many links it has."""
    vectors = table(spark, sf_dir, "embeddings")
    counted = S.linked(vectors, "label", "vec_id", "embedding", 0.4, counts=True)
    return vectors.select("vec_id", "label").join(counted, "vec_id", "left").fillna(0, ["n_links"])


@query("""WITH e AS (SELECT source, doc_id, left(text, 600) AS excerpt, n_chars FROM documents), u AS (SELECT *, coalesce(sum(length(excerpt)) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM e)
SELECT source, doc_id, left(excerpt, CAST(2500 - used AS INTEGER)) AS excerpt FROM u WHERE used < 2500""")
def budgeted_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.substring("text", 1, 600).alias("excerpt"), "n_chars")
    return R.within_budget(docs, ["source"], "excerpt", 2500, F.desc("n_chars"), F.col("doc_id")).select("source", "doc_id", "excerpt")


@query("""SELECT conv_id, turn, text, next_text FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations) WHERE role = 'user'""")
def context_lead_sentences(spark, sf_dir):
    led = table(spark, sf_dir, "conversations").withColumn("next_text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return led.where("role = 'user'").select("conv_id", "turn", "text", "next_text")


ITEMS = [
    rules.Item("contact", r"(?i)contact|[a-z0-9.]+@[a-z]", r"(?i)phone|call", r"(?i)secret"),
    rules.Item("license", r"(?i)licensed under|released under", r"(?i)licen[sc]e"),
    rules.Item("security", r"(?i)password|api_?key", r"(?i)token|secret"),
]


@query(f"""WITH {LINES_SQL}, i(item, covered, partial, excluded) AS (VALUES {', '.join(f"('{i.item}', '{i.covered}', '{i.partial}', '{i.excluded or ''}')" for i in ITEMS)}),
h AS (SELECT doc_id, item, bool_or(regexp_matches(line, covered) AND (excluded = '' OR NOT regexp_matches(line, excluded))) AS c, bool_or(regexp_matches(line, partial)) AS p,
  count(*) FILTER (regexp_matches(line, covered) AND (excluded = '' OR NOT regexp_matches(line, excluded))) AS nc, count(*) FILTER (regexp_matches(line, partial)) AS np FROM lines, i GROUP BY ALL)
SELECT doc_id, item, CASE WHEN c THEN 'COVERED' WHEN p THEN 'PARTIAL' ELSE 'MISSING' END AS status, CAST(CASE WHEN c THEN nc ELSE np END AS INTEGER) AS parts FROM h""")
def checklist_status(spark, sf_dir):
    found = rules.checklist(segment.explode_lines(table(spark, sf_dir, "documents")), ITEMS, "doc_id", "line")
    return found.withColumn("parts", F.size("parts"))
