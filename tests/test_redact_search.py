"""A rule is searched for only where it may hold."""

import random
import time

from pyspark.sql import functions as F

from clauseframe.plans import redact


def test_the_same_is_found_and_replaced(spark):
    r = random.Random(5)
    texts = ["".join(r.choices(["a", "b1", ".", "_", "@", "@x.co", ".com", " ", "1.2.3.4", "1234 1234 1234 1234", "é"], k=r.randint(0, 20))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in [*texts, "a@b.co_x@y.com", "", None]], "text string")
    done, text = redact.redact(df.select("text", F.col("text").alias("own")), redact.LATIN).collect(), F.col("own")
    plain = df.select(F.col("text").alias("own"))
    counts = []
    for rule in redact.LATIN:
        counts.append(F.coalesce(F.regexp_count(text, F.lit(rule.pattern)), F.lit(0)).alias(rule.name))
        text = F.regexp_replace(text, rule.pattern, rule.mark)
    want = plain.select("own", text.alias("text"), F.struct(*counts).alias("n")).collect()
    assert sorted((repr(x.own), repr(x.text), *sorted(x.redactions.items())) for x in done) == sorted((repr(x.own), repr(x.text), *sorted(x.n.asDict().items())) for x in want)
    assert all(sum(x.redactions[rule.name] for x in done) > 0 for rule in redact.LATIN[:3])


def test_a_text_without_the_sign_is_not_searched_for_mails(spark):
    df = spark.createDataFrame([("x" * 300_000,)], "text string")
    began = time.perf_counter()
    assert redact.redact(df, redact.LATIN[:1]).select("redactions").first().redactions["email"] == 0
    assert time.perf_counter() - began < 20  # one start for each letter takes 4e10 steps
