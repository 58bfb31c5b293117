"""Clusters, languages and hard negatives against brute force and held-out accuracy; exact products at any width."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseframe.llm import clusters, languages, negatives, secrets, topk, vectors
from clauseframe.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


# ---- exact products --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("width", "bits"), [(3, 10), (64, 30), (5, 62), (3072, 40), (4097, 62)])
def test_products_are_exact(width, bits):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-(2**bits), 2**bits, (n, width)) for n in (4, 7))
    b[0] = rng.integers(-3, 4, width)  # a small row beside large ones
    want = a.astype(object) @ b.astype(object).T
    want = np.minimum(np.maximum(want, -(2**63)), 2**63 - 1)
    assert (vectors.products(a, b).astype(object) == want).all()
    for c in b:
        far = np.minimum(((a.astype(object) - c.astype(object)) ** 2).sum(axis=1), 2**63 - 1)
        assert (vectors.squared_distances(a, c).astype(object) == far).all()


# ---- clusters --------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k=40, rounds=5):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of (vec_id, vector) rows, in Python's integers."""
    kept = [(i, [min(2**63 - 1, max(-(2**63), math.floor(256 * x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(((digest(i), v) for i, v in kept if i is not None))[:k]]
    if not centroids:
        return []
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        for j, vs in members.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    most = 2**63 - 1
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += min(most, d)
    sha = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return [(i, j, min(most, d), min(most, inertia[j]), min(most, sum(inertia.values())), sha(j)) for i, d, j in last]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_clusters_equal_plain_rounds(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = plain_clusters([(r.vec_id, r.embedding) for r in table.collect()])
    assert ordered(QUERIES["op11_block_norm_clusters"](spark, sf).collect()) == ordered(want)


def awkward_vectors():
    rng = random.Random(5)
    vector = lambda: [rng.gauss(0, 0.1) for _ in range(64)]
    rows = [(i, vector(), i % 3) for i in range(90)]
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (7, vector(), 1), (None, vector(), 2), (900, vector(), None), (100, rows[3][1], 0)]  # repeats, ties, nulls
    rows += [(200, None, 1), (201, [], 1), (202, vector()[:63], 1), (203, vector() + [0.5], 1), (204, [NAN, *vector()[1:]], 1), (205, [INF, *vector()[1:]], 1), (206, [None, *vector()[1:]], 1)]
    rows += [(300 + i, rows[0][1], 2) for i in range(40)]  # a hot vector
    return rows


def test_clusters_of_awkward_rows(spark):
    rows = awkward_vectors()
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS v", "1 AS norms", "2 AS cluster", "3 AS h")
    assert ordered(clusters.cluster(frame, k=6).collect()) == ordered(plain_clusters([r[:2] for r in rows], 6))
    few = rows[:3]
    assert ordered(clusters.cluster(spark.createDataFrame(few, VECTORS)).collect()) == ordered(plain_clusters([r[:2] for r in few]))
    nothing = clusters.cluster(spark.createDataFrame([], VECTORS))
    assert nothing.collect() == [] and nothing.columns == clusters.cluster(frame, k=2, rounds=0).columns


def test_clusters_of_huge_components(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(64)]) for i in range(30)]
    rows += [(100 + i, [10.0 ** (6 + 3 * i) * rng.choice((-1, 1)) for _ in range(64)]) for i in range(6)]
    got = clusters.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    assert ordered(got) == ordered(plain_clusters(rows, 5))


def test_screening_prunes_and_never_errs(spark, sf):
    x = np.floor(256 * np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], np.float64)).astype(np.int64)
    now = clusters.Centroids(x[:40])
    at, d = now.nearest(x, clusters.block_norms(x).reshape(len(x), -1))
    every = ((x[:, None] - x[None, :40]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert now.exact < 0.5 * every.size


# ---- hard negatives --------------------------------------------------------------------------------------------------


def plain_negatives(rows):
    known = [(i, (y + 1) % 10 if i % 7 == 0 else y, [min(2**63 - 1, max(-(2**63), math.floor(256 * c))) for c in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    stop = lambda s: min(2**63 - 1, max(-(2**63), s))
    out = []
    for a, (i, y, v) in enumerate(known):
        if i % 100 == 0:
            scored = sorted((-stop(sum(s * t for s, t in zip(v, w, strict=True))), j, b) for b, (j, _, w) in enumerate(known) if b != a and len(w) == len(v))
            for s, j, _ in [x for x in scored if known[x[2]][1] == y][:5]:
                negatives_ = [(t, n) for t, n, b in scored if known[b][1] != y and 30 * -s <= 100 * -t <= 90 * -s][:10]
                out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(negatives_, 1)]
    return out


def test_negatives_equal_all_products(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain_negatives(rows)
    assert want and ordered(QUERIES["op13_ball_tree_negatives"](spark, sf).collect()) == ordered(want)


@pytest.mark.parametrize(("block", "leaf"), [(16384, 64), (25, 4)])
def test_negatives_of_awkward_rows(spark, monkeypatch, block, leaf):
    rows = [*awkward_vectors(), (100, awkward_vectors()[3][1], 0), (-100, awkward_vectors()[9][1], -4), (400, [1.0, 2.0], 1), (401, [1.0, 2.5], 1), (402, [0.5, 1.0], 2), (500, [], 1), (501, [], 2)]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS v", "1 AS key", "2 AS rank")
    usable = vectors.whole_numbers(frame.where("vec_id IS NOT NULL AND label IS NOT NULL").select("vec_id", "label", "embedding"), 256.0)
    monkeypatch.setattr(negatives, "HELD", 50)
    built = negatives.BallTree.__init__
    monkeypatch.setattr(negatives.BallTree, "__init__", lambda self, x, y, _=None: built(self, x, y, leaf))
    assert ordered(negatives.embedding_negatives(frame).collect()) == ordered(plain_negatives(rows))
    labelled = usable.selectExpr("vec_id", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", "v")
    got = negatives.hard_negatives(labelled, labelled.vec_id % 100 == 0, query_block=3, block=block)
    assert ordered(got.collect()) == ordered(plain_negatives(rows))
    assert negatives.embedding_negatives(spark.createDataFrame([], VECTORS)).collect() == []


def test_searches_in_small_trees_with_ties_and_few_hits():
    rng = np.random.default_rng(3)
    for trial in range(30):
        n, k, same = int(rng.integers(1, 80)), int(rng.integers(1, 7)), bool(trial % 2)
        x, labels = rng.integers(-2, 3, (n, 3)), rng.integers(0, 3, n)
        ids, keys = rng.integers(0, 40, n), np.arange(n)
        q = x[: min(5, n)]
        of = np.repeat(np.arange(len(q)), 2)
        low, high = rng.integers(-8, 3, len(of)), rng.integers(0, 9, len(of))
        search = negatives.Searches(q, labels[: len(q)], keys[: len(q)], of, low, high, k, same)
        tree = negatives.BallTree.__init__
        negatives.BallTree.__init__ = lambda self, a, b, _=None, tree=tree: tree(self, a, b, 3)
        try:
            hits = search.run(x, ids, keys, labels)
        finally:
            negatives.BallTree.__init__ = tree
        got = list(zip(*(h.tolist() for h in hits), strict=True))
        want = []
        for u, a in enumerate(of):
            scores = [(-int(x[r] @ q[a]), int(ids[r]), r) for r in range(n) if r != a and (labels[r] == labels[a]) == same and low[u] <= x[r] @ q[a] <= high[u]]
            want += [(u, -s, i, r) for s, i, r in sorted(scores)[:k]]
        assert got == want


def test_balls_outside_the_window_stay_closed():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 200, (32, 16))
    x = np.floor(centres[np.arange(4096) % 32] + rng.normal(0, 5, (4096, 16))).astype(np.int64)
    labels = np.arange(4096) % 3
    q = x[:50]
    search = negatives.Searches(q, labels[:50], np.arange(50), np.arange(50), np.full(50, -(2**63)), np.full(50, 2**63 - 1), 5, True)
    search.run(x, np.arange(4096), np.arange(4096), labels)
    assert search.opened < 0.25 * len(q) * len(x)


# ---- languages -------------------------------------------------------------------------------------------------------


def plain_model(texts, order):
    """log P of the character after a context, for one language's texts, straight from the definition."""
    high = Counter()
    for t in texts:
        t = " " * (order - 2) + t
        high.update(t[i : i + order] for i in range(len(t) - order + 1))
    counts = {order: high}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    context, discount = {}, {}
    for n, c in counts.items():
        ones, twos = (sum(v == want for v in c.values()) for want in (1, 2))
        discount[n] = ones / (ones + 2 * twos) if ones and twos else 0.5
        context[n] = defaultdict(lambda: [0, 0])
        for g, v in c.items():
            context[n][g[:-1]][0] += v
            context[n][g[:-1]][1] += 1

    def p(gram, characters):
        if not gram:
            return 1 / (characters + 1)
        n = len(gram)
        lower = p(gram[1:], characters)
        total, kinds = context[n].get(gram[:-1], (0, 0))
        return lower if not total else max(counts[n][gram] - discount[n], 0) / total + discount[n] * kinds / total * lower

    return p


@pytest.mark.parametrize("order", [3, 5])
def test_kneser_ney_equals_its_definition(order):
    learned = {"a": ["the cat sat on the mat", "that hat"], "b": ["le chat et la table", "chateau çà"], "c": ["x"]}
    letters = languages.Letters()
    text = lambda c: c.tobytes().decode("utf-32-le")
    clean = {k: [text(letters(t)) for t in v] for k, v in learned.items()}
    counts = {}
    for name, texts in clean.items():
        c = Counter()
        for t in texts:
            t = " " * (order - 2) + t
            c.update(t[i : i + order] for i in range(len(t) - order + 1))
        counts[name] = np.array([[ord(x) for x in g] for g in c], np.uint32), np.array(list(c.values()))
    model = languages.kneser_ney(counts, order)
    characters = len({x for texts in clean.values() for t in texts for x in " " + t})
    for probe in ("the chat sat", "zzz", "x", "Le Mat, et\n\nÇA 42 x", "ththth" * 50):
        c = letters(probe)
        total, n = model.log_likelihood(c)
        padded = " " * (order - 2) + text(c)
        grams = [padded[i : i + order] for i in range(len(padded) - order + 1)]
        assert n == len(grams)
        for j, name in enumerate(model.languages):
            p = plain_model(clean[name], order)
            assert total[j] == pytest.approx(sum(math.log(p(g, characters)) for g in grams), rel=1e-4)


def test_pieces_of_a_long_text_add_up(monkeypatch):
    letters = languages.Letters()
    c = letters("the cat sat on the mat " * 500)
    grams, n = np.unique(np.lib.stride_tricks.sliding_window_view(languages.padded(c, 4), 4), axis=0, return_counts=True)
    model = languages.kneser_ney({"a": (grams, n)}, 4)
    whole = model.log_likelihood(c)
    monkeypatch.setattr(languages, "PIECE", 97)
    assert model.log_likelihood(c)[0] == pytest.approx(whole[0], rel=1e-6)


def test_languages_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r for r in docs.collect()}
    got = QUERIES["op12_kneser_ney_language"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == want[r.doc_id].lang for r in held) >= 0.95 * len(held) > 0
    assert sum(r.accepted for r in held) >= 0.9 * len(held)


def test_no_input_but_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = languages.learned_fold() == 2
    turned = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    rows = lambda d: ordered(languages.language_predictions(d).collect())
    assert rows(turned) == rows(docs)


def test_languages_of_awkward_rows(spark):
    rng = random.Random(1)
    words = {"en": ["the", "and", "with", "this", "house"], "fr": ["le", "et", "avec", "cette", "maison"]}
    make = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(40))
    rows = [(i, make(lang), lang) for i, lang in enumerate(["en", "fr"] * 40)]
    rows += [(1, rows[1][1], "fr"), (1, rows[1][1], "fr"), (None, make("en"), "en"), (500, None, "en"), (501, "", None), (502, "12 !? \n", "fr"), (503, "😀".encode("utf-16", "surrogatepass").decode("utf-16"), None), (504, make("fr") * 5000, None), (505, "数字", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS class", "3 AS held_out", "4 AS gram")
    got = languages.language_predictions(frame).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score, by[i].bits, by[i].accepted) == ("und", 0.0, None, False) for i in (500, 501, 502, 503))
    assert by[504].lang_pred == "fr" and by[505].lang_pred in ("en", "fr") and not by[505].accepted and not by[None].held_out
    assert all(r.lang_pred == rows[r.doc_id][2] for r in got if r.doc_id is not None and r.doc_id < 80)
    nothing = [(i, t, None) for i, t, _ in rows[:5]]
    assert {(r.lang_pred, r.score) for r in languages.language_predictions(spark.createDataFrame(nothing, frame.select("doc_id", "text", "lang").schema)).collect()} == {("und", 0.0)}
    assert languages.language_predictions(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_the_sample_is_bounded_and_repeated_rows_count_once(spark):
    rows = [(i, f"text {i}", "en") for i in range(3000)] + [(9, "text 9", "en")] * 500 + [(i, "texte", "fr") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = Counter(r.lang for r in languages.chosen(frame, 300).collect())
    assert 200 <= counts["en"] <= 300
    outside = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(20))
    assert counts["fr"] == outside


def test_a_model_over_its_bound_takes_a_lower_order(spark, monkeypatch):
    rows = [(i, "the cat sat on the mat and a bat" * (1 + i % 3), "en") for i in range(60)] + [(100 + i, "le chat dort sur la table ici", "fr") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(languages, "MOST_CELLS", 120)
    model = languages.fit(frame)
    assert model.order < languages.ORDER
    assert all(r.lang_pred == ("en" if r.doc_id < 100 else "fr") for r in languages.identify(frame, model).collect())


# ---- earlier operators, mended ---------------------------------------------------------------------------------------


def test_topk_of_wide_and_huge_vectors_and_repeated_ids(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=3072).tolist()) for i in range(0, 60, 2)]
    rows += [(10, rng.normal(size=3072).tolist()), (0, rows[0][1]), (0, rows[0][1]), (7, [1e15] + [0.5] * 3071), (9, [-1e17] * 3072), (20, [1e17] * 3072)]
    rows += [(100, [2.0**40, 1.0]), (101, [2.0**41, -1.0]), (102, [3.0, 4.0]), (110, []), (111, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    stop = lambda s: min(2**63 - 1, max(-(2**63), s))
    known = [(i, [stop(math.floor(1024 * c)) for c in v]) for i, v in rows]
    want = []
    for a, (i, v) in enumerate(known):
        if i % 10 == 0:
            scored = sorted((-stop(sum(s * t for s, t in zip(v, w, strict=True))), j) for b, (j, w) in enumerate(known) if a != b and len(w) == len(v))
            want += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:4], 1)]
    assert ordered(topk.embedding_topk(frame, 4, 10).collect()) == ordered(want)
    keyed = topk.whole(frame, 1024.0).withColumn("key", F.monotonically_increasing_id()).checkpoint()
    assert ordered(topk.search(keyed, keyed.where("vec_id % 10 = 0"), 4, query_block=3, block=7, key="key").collect()) == ordered(want)


def test_a_pair_of_blocks_of_wide_vectors_takes_seconds():
    rng = np.random.default_rng(8)
    q, x = rng.integers(-300, 300, (64, 3072)), rng.integers(-300, 300, (4096, 3072))
    x[17, 5] = 2**50
    begun = time.process_time()
    found = [*topk.best(np.arange(64) + 10**6, q, np.arange(4096), x, 10)]
    assert time.process_time() - begun < 60
    plain = x.astype(object) @ q[3].astype(object)
    assert found[3][0].tolist() == sorted(range(4096), key=lambda j: (-plain[j], j))[:10]


@pytest.mark.parametrize("unit", ["a", "A", "-", "aB3_", "eyJhbGciOi.", "eyJ.", "ab/+\n", "token ", "AKIA", "secret=", "A" * 64 + "\n"])
def test_a_full_stop_makes_no_search_slow(unit):
    for text in ("x. " + unit * (5_000_000 // len(unit)), unit * (5_000_000 // len(unit)) + " x. y"):
        begun = time.process_time()
        secrets.find(text)
        assert time.process_time() - begun < 8


def test_dotted_runs_are_those_of_the_plain_pattern():
    rng = random.Random(9)
    plain = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+){2,}")
    for _ in range(3000):
        text = "".join(rng.choices("ab_-.. !", k=rng.randrange(40)))
        assert [m.span() for m in secrets.DOTTED.finditer(text)] == [m.span() for m in plain.finditer(text)]
