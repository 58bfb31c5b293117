"""Pairs of parts that are alike by their terms, where the group stands."""

import contextlib
import io
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from clauseframe.functions import similarity as S
from clauseframe.queries import QUERIES


def rows(seed: int = 4, groups: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    made = [(g, p, " ".join(["the", "of"] + rng.choices(vocabulary, k=rng.randint(0, 9)))) for g in range(groups) for p in range(rng.randint(1, 12))]
    # a part on two rows, an empty one, one without text, a long group, and keys that are null
    return [*made, (0, 0, "w1 w2 w3 again"), (1, 0, ""), (2, 0, None), (None, 1, "w1 w2"), (None, 2, "w1 w2"), (3, None, "w5 w6 w7"), *((900, p, f"w{p % 7} w{p % 5} x{p % 9} the") for p in range(70))]


def found(df) -> dict:
    out = [((r.g, r.part_a, r.part_b), r.score) for r in df.collect()]
    assert len(out) == len(dict(out))
    return dict(out)


def test_a_group_in_one_task_is_what_the_joins_give(spark):
    df = spark.createDataFrame(rows(), "g long, p int, t string").repartition(5)
    terms = F.filter(F.split("t", " "), lambda w: w != "")
    for least in (0.1, 0.3, 0.9):
        want = found(S.tfidf_pairs(df.select("g", "p", F.explode(terms).alias("t")), "g", "p", "t", least))
        for most in (S.MOST_IN_TASK, 200, 0):  # all in a task, some, none
            got = found(S.part_pairs(df, "g", "p", terms, F.length("t"), least, most))
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want
    assert found(S.part_pairs(df.limit(0), "g", "p", terms, F.length("t"), 0.3)) == {}


def test_products_held_at_once_are_bounded():
    own = sorted((g, p, t.split()) for g, p, t in rows() if g is not None and p is not None and t)
    table = pa.table({"g": [r[0] for r in own], "p": [r[1] for r in own], "t": [r[2] for r in own]})
    joined = lambda held: [np.concatenate(c) for c in zip(*S.products(table, 0.2, held), strict=True)]
    for a, b in zip(joined(50), joined(10**9), strict=True):
        assert np.allclose(a, b)
    assert len(list(S.products(table, 0.2, 50))) > len(list(S.products(table, 0.2, 10**9))) == 1


def test_lines_travel_once(spark, sf):
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        QUERIES["tfidf_pairs"](spark, sf).explain()
    assert told.getvalue().count("Exchange") == 1 and "Join" not in told.getvalue()
