"""All phrases in one scan: the same matches as each name's own pattern, as Spark runs it."""

import random

import pytest

from clauseframe.lexicon import hebrew as H
from clauseframe.lexicon.phrases import any_of
from clauseframe.plans import facts as X
from clauseframe.plans import mentions as M
from pyspark.sql import functions as F

LATIN = [("A", ("rent", "rent increase", "increase of rent")), ("B", ("ren*", "increase")), ("C", ("straße", "kelvin", "rent increase rent")), ("A", ("of",))]
PIECES = ["rent", "Rent", "RENTS", "increase", "of", "straße", "STRASSE", "Kelvin", "3", "²", "_", "-", "rent²", "הrent", "ושrent", "é", "é", "😀"]


def texts_of(named, more, n, seed):
    r = random.Random(seed)
    words = more + [w.rstrip("*") + r.choice(["", "ים"]) for _, phrases in named for p in phrases for w in p.split()]
    words += [r.choice("ושהבלמכא") + w for w in words] + [r.choice("ושהבלמכא") + r.choice("ושהבלמכ") + w for w in words]
    phrases = [p.replace("*", "") for _, own in named for p in own]
    gaps = [" ", " ", " ", "  ", "\n", "\t", ", ", ". ", "", " ", "-", "\""]
    return ["".join(r.choice(words if r.random() < 0.6 else phrases) + r.choice(gaps) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("named,more", [(LATIN, PIECES), (list(H.NAMES.items()), ["rent", "3", "של"]), ([(i, p) for i, (p, _) in enumerate(H.OWNERS)], ["5,000", "ימים"])])
def test_equal_to_the_patterns(spark, named, more):
    texts = [*texts_of(named, more, 250, len(named)), "", None, " ", "rent " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(8).checkpoint()
    got = sorted(tuple(r) for r in M.mentions(df, ["k"], "text", named).collect())

    def by_pattern(i, phrases):
        return F.transform(X.occurrences(F.col("text"), any_of(*phrases)), lambda x: F.struct(F.lit(i).alias("name"), x["at"].alias("at"), x["hit"].alias("hit")))

    found = F.concat(*(by_pattern(i, p) for i, (_, p) in enumerate(named)))
    want = sorted((r.k, r.x.name, r.x.at, r.x.hit) for r in df.where("text IS NOT NULL").select("k", F.explode(found).alias("x")).collect())
    assert got == want and len(want) > 500
    names = {}
    for k, i, _, _ in want:
        names[k, named[i][0]] = names.get((k, named[i][0]), 0) + 1
    counted = M.counts(df.withColumn("other", F.col("text")), ["k"], ("text", "other"), [(str(n), p) for n, p in named]).collect()
    assert {(r.k, r.name): r.n for r in counted if r.field == "text"} == {(k, str(n)): v for (k, n), v in names.items()} == {(r.k, r.name): r.n for r in counted if r.field == "other"}


def test_phrases_are_letters():
    with pytest.raises(ValueError, match="letters"):
        M.Phrases([("x", ("a1",))])
    assert M.Phrases([]).found("anything") == [] and M.Phrases([("x", ("a",))]).found(None) == []
    many = M.Phrases([("x", ("a b",))])
    assert many.found("a b a b a\nb a") == [(0, 0, 3), (0, 4, 7), (0, 8, 11)]
    assert M.runs("ab²c_d") == [(0, 2), (3, 4), (5, 6)]
