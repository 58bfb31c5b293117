"""Likeness joins on small inputs."""

import random

from pyspark.sql import functions as F

from clauseframe.functions import similarity as S
from clauseframe.functions import text as T
from clauseframe.queries import QUERIES


def test_nearest_deals_by_row_count(spark):
    """No block grows with the tables, and the blocks together give what all pairs give."""
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    for side in S.dealt_pairs(df, df, "vec_id", "v", 20):
        held = side.groupBy("qb", "vb").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("blocks")).first()
        assert held.most <= 60 and held.blocks == 45 * 45
    few = df.where("vec_id % 7 = 0")
    got, whole = (S.nearest(few, df, "vec_id", "v", 3, rows=n).collect() for n in (20, 10_000))
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and len(got) == 3 * 129


def test_documents_are_scored(spark, sf):
    """The registered queries score documents against the benchmark, whatever the length."""
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "benchmark"))
    for name in ("trigram_dice_documents", "jaccard_words_documents"):
        rows = QUERIES[name](spark, sf).select("doc_id", "item_id").distinct().count()
        assert 0.5 * docs * items < rows <= docs * items


def test_bag_overlap_equals_inverted_index(spark):
    """Also over several blocks, with repeats, white space, letters beyond the first plane, short and null texts."""
    texts = ["abcabcabc", " ab\tc\x0babc", "ab", None, "", "\U0001f600bc\U0001f600bc", "no one", "bcabca xyz"] * 3
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    right = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:8])], "item_id int, text string")
    grams = lambda df, key: df.select(key, T.trigrams("text").alias("g"))
    want = S.multiset_overlap(grams(left, "doc_id"), grams(right, "item_id"), "doc_id", "item_id", "g").select("doc_id", "item_id", "shared", "n_left", "n_right")
    got = S.bag_overlap(left, right, "doc_id", "item_id", "text", S.trigram_bag, chars=20, right_chars=9, right_rows=3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_links_of_dealt_blocks(spark):
    import itertools
    import math
    import random

    rng = random.Random(5)
    rows = [(i, i % 7 and "hot", [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    rows = [(i, g or "cold", v) for i, g, v in rows] + [(200, None, [1.0] * 4), (201, "hot", None), (202, "hot", [1.0, None, 1.0, 1.0]), (203, "hot", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    unit = {i: (g, [x / math.hypot(*v) for x in v]) for i, g, v in rows if i < 200}
    want = {(a, b) for a, b in itertools.combinations(unit, 2) if unit[a][0] == unit[b][0] and sum(x * y for x, y in zip(unit[a][1], unit[b][1], strict=True)) >= 0.4}
    for size in (16, 2048):
        found = [(r.a, r.b) for r in S.linked(df, "g", "id", "v", 0.4, rows=size).collect()]
        assert len(found) == len(want) and set(found) == want
        counted = {r.id: r.n_links for r in S.linked(df, "g", "id", "v", 0.4, counts=True, rows=size).collect()}
        assert counted == {i: n for i in unit if (n := sum(i in p for p in want))}
    assert S.linked(df.limit(0), "g", "id", "v", 0.4).count() == 0


def test_few_pairs_meet_in_the_threshold_join(spark):
    import math
    import random
    from collections import Counter, defaultdict

    rng = random.Random(9)
    rows = []
    for group in range(3):
        for part in range(60):
            words = ["the", "of", "and"] * 3 + rng.choices([f"w{i}" for i in range(150)], k=12)
            rows += [(group, part, w) for w in words]
        rows += [(group, 100 + k, w) for k in range(3) for w in ("same", "rare", "words", "the")]
    rows.append((7, 1, "alone"))
    terms = spark.createDataFrame(rows, "g int, p int, t string")
    tf, df, parts = Counter(rows), Counter(), defaultdict(set)
    for g, p, t in tf:
        df[g, t] += 1
        parts[g].add(p)
    vectors = defaultdict(dict)
    for (g, p, t), n in tf.items():
        if (w := n * math.log((1 + len(parts[g])) / (1 + df[g, t]))) > 0:
            vectors[g, p][t] = w
    length = {k: math.sqrt(sum(w * w for w in v.values())) for k, v in vectors.items()}
    for least in (0.1, 0.3, 0.9):
        want = {}
        for (g, p), v in vectors.items():
            for (h, q), u in vectors.items():
                if g == h and p < q and (s := sum(w * u.get(t, 0) for t, w in v.items()) / length[g, p] / length[h, q]) >= least:
                    want[g, p, q] = s
        got = {(r.g, r.part_a, r.part_b): r.score for r in S.tfidf_pairs(terms, "g", "p", "t", least).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    scaled = S.weighted_terms(terms, "g", "p", "t")
    every = sum(len(p) * (len(p) - 1) // 2 for p in parts.values())
    assert S.threshold_candidates(scaled, "g", "p", "t", 0.3).count() < 0.5 * every
    assert S.threshold_candidates(scaled, "g", "p", "t", 0.9).count() < 0.1 * every


def test_blocks_that_lie_far_apart_do_not_meet(spark):
    import numpy as np

    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.05).tolist()) for i in range(960)]
    awkward = [(2000, None), (2001, [0.0] * 16), (2002, [None] * 16), (2003, [1.0, 2.0]), (2004, [2.0, 1.0]), (2005, []), (None, [1.0] * 16), (2006, rows[5][1])]
    for extra in ([], awkward):
        df = spark.createDataFrame(rows + extra, "vec_id long, v array<double>")
        queries = df.where("vec_id % 7 = 0 OR vec_id >= 2000")
        ranked = lambda d: sorted((r.query, r.rank, r.vec_id, r.score) for r in d.collect())
        got, want = ranked(S.nearest(queries, df, "vec_id", "v", 5, rows=40)), ranked(S.nearest(queries, df, "vec_id", "v", 5))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(g[3] == w[3] or abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want, strict=True) if g[3] is not None)
    known = S.unit(spark.createDataFrame(rows, "vec_id long, v array<double>"), "v")
    pivots = S.pivots_of(known, "vec_id", "v", 48)
    q, v = (S.celled(d, "vec_id", "v", pivots, 40).checkpoint() for d in (known.where("vec_id % 7 = 0"), known))
    blocks = [d.select("dim", "pivot", "sub").distinct().count() for d in (q, v)]
    assert S.near_blocks(q, v, pivots, "vec_id", "v", 5).count() < 0.5 * blocks[0] * blocks[1]
