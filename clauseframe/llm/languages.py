"""Language identification with interpolated Kneser-Ney character models.

A text becomes its lower-case letters, each run of anything else one space. For every language a model of ``ORDER`` characters is
counted: the highest order by occurrences, lower ones by the number of different characters in front, each discounted by what
its counts of one and two suggest and interpolated with the order below, down to an even share of all characters. The models of all
languages share one sorted array of hashes for each order, with a row of log-probabilities and back-off weights; where a gram
is unknown to a language its row already holds what backing off gives. The language of least cross-entropy for each character wins.

How sure that is, is calibrated on texts that the counts leave out: the posterior's sharpness, the score below which a prediction
is rejected, and the cross-entropy above which a text is none of the known languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, written

ORDER = 5
MOST_TEXTS = 2000  # of each language, chosen by a hash of the id, are learned from
MOST_CELLS: int | None = None  # grams times languages from which a caller who sets it has the highest order left out; None: the order is ORDER at any size
PIECE = 2**20  # characters looked at at once
CALIBRATION = 8  # one in so many of the chosen texts calibrates
SPACE, UNKNOWN = 32, "und"
STEADY = 160  # the cross-entropy of texts of one language varies less with their length up to here
LENGTHS = (10, 20, 40, 80, 160, 0)  # of the calibration's pieces; 0: the whole text
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Letters:
    """Text -> code points of its lower-case letters with single spaces between and around. The table of letters is made once."""

    def __init__(self):
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str) -> np.ndarray:
        """Empty if there is no letter."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        own = self.is_letter[c]
        if not own.any():
            return c[:0]
        out = np.full(len(c) + 2, SPACE, np.uint32)
        out[1:-1] = np.where(own, c, SPACE)
        space = out == SPACE
        return out[~(space & np.append(False, space[:-1]))]


def gram_hashes(c: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n up to ``order`` the hashes of the runs of n characters, by where they start."""
    h = mixed(c.astype(np.uint64))
    out = [h]
    for n in range(2, order + 1):
        out.append(mixed(out[-1][: len(c) - n + 1] * FACTOR + c[n - 1 :]) if len(c) >= n else h[:0])
    return out


def padded(c: np.ndarray, order: int) -> np.ndarray:
    """With ``order - 2`` more spaces in front, so that the first letter has a whole context."""
    return np.concatenate([np.full(order - 2, SPACE, np.uint32), c])


class Hashes:
    """Ascending hashes and a directory over their highest bits, by which a hash is found in a few steps."""

    def __init__(self, values: np.ndarray):
        self.values = values
        bits = max(1, int(np.ceil(np.log2(max(2, len(values))))))
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(values >> self.shift, np.arange(2**bits + 1, dtype=np.uint64)).astype(np.int64)
        self.steps = int(np.diff(self.start).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each stands, -1 if nowhere."""
        top = (h >> self.shift).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        out = np.full(len(h), -1, np.int64)
        left = np.flatnonzero(at < end)
        at = at[left]
        for _ in range(self.steps):
            same = self.values[at] == h[left]
            out[left[same]] = at[same]
            at = at + 1
            more = ~same & (at < end[left])
            left, at = left[more], at[more]
            if not len(left):
                break
        return out


@dataclass
class Model:
    """The languages in order, and for each order its hashes with log-probabilities and back-off weights, a column for each language."""

    languages: list[str]
    order: int = ORDER
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # of a character never seen
    hashes: list[Hashes] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    sharpness: tuple[float, float] = (1.0, 0.5)
    least: float = 0.0  # scores below are rejected
    usual: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))  # of each language: mean and spread of the cross-entropy, and how many spreads are accepted

    def log_likelihood(self, c: np.ndarray) -> tuple[np.ndarray, int]:
        """(natural log-likelihood of the text's characters in each language, their number). Works piece by piece, so memory is bounded."""
        total, n = np.zeros(len(self.languages)), max(0, len(c) - 1)
        c = padded(c, self.order)
        for at in range(0, len(c) - self.order + 1, PIECE):
            total += self.piece(gram_hashes(c[at : at + PIECE + self.order - 1], self.order))
        return total, n

    def piece(self, h: list[np.ndarray]) -> np.ndarray:
        """The sum over all full-length grams, from the highest order down; what an order does not know pays its context's back-off weight."""
        total = np.zeros(len(self.languages))
        at = np.arange(len(h[self.order - 1]))
        for n in range(self.order, 0, -1):
            shift = self.order - n  # the gram of n characters that ends at the same place
            row = self.hashes[n - 1].find(h[n - 1][at + shift])
            known = row >= 0
            total += self.logp[n - 1][row[known]].sum(axis=0, dtype=np.float64)
            at = at[~known]
            if not len(at):
                return total
            if n > 1:
                context = self.hashes[n - 2].find(h[n - 2][at + shift])
                total += self.backoff[n - 2][context[context >= 0]].sum(axis=0, dtype=np.float64)
        return total + len(at) * self.floor.astype(np.float64)

    def posterior(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(texts x languages) calibrated probabilities from log-likelihoods of ``n`` characters."""
        scale, power = self.sharpness
        x = scale * total / np.maximum(n, 1)[:, None] * np.maximum(n, 1)[:, None] ** power
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def judged(self, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, cross-entropy in bits a character, accepted) of texts with ``n`` characters, ``n`` at least 1."""
        best = total.argmax(axis=1)  # ties to the language that sorts first
        rows = np.arange(len(total))
        score = self.posterior(total, n)[rows, best]
        bits = -total[rows, best] / n / np.log(2)
        accepted = score >= self.least
        if len(self.usual):
            mean, spread, most = self.usual[best].T
            accepted &= (bits - mean) * np.sqrt(np.minimum(n, STEADY)) <= most * spread
        return best, score, bits, accepted


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """The model of ``counts``: language -> (code points of its grams of ``order`` characters, a row each; how often each occurs)."""
    model = Model(sorted(counts), order)
    k = len(model.languages)
    characters = np.unique(np.concatenate([g.ravel() for g, _ in counts.values()] or [np.zeros(0, np.uint32)]))
    tables = []  # for each language, by order: (hash, context's, suffix's, count) of its grams, then of what are contexts only
    for name in model.languages:
        grams, n = counts[name]
        orders, above = [], grams[:0]
        for size in range(order, 0, -1):
            if size < order:  # how many different characters stand in front
                above = np.unique(grams[:, :-1], axis=0)
                grams, n = np.unique(grams[:, 1:], axis=0, return_counts=True)
            own, only = ((hashed(g), hashed(g[:, :-1]), hashed(g[:, 1:])) for g in (grams, above))
            orders.append((*own, n.astype(np.float64), only))
        tables.append(orders[::-1])
    model.floor = np.full(k, -np.log(len(characters) + 1.0), np.float32)
    lower: np.ndarray | None = None
    for size in range(1, order + 1):
        parts = [side for t in tables for side in (t[size - 1], t[size - 1][4])]
        every = np.unique(np.concatenate([side[0] for side in parts] or [np.zeros(0, np.uint64)]))
        # the suffixes of all that stands here stand in the order below
        below = np.zeros((len(every), k))
        if size > 1:
            suffix, context = np.zeros(len(every), np.uint64), np.zeros(len(every), np.uint64)
            for side in parts:
                at = np.searchsorted(every, side[0])
                context[at], suffix[at] = side[1], side[2]
            below = lower[model.hashes[-1].find(suffix)]
            before = model.hashes[-1].find(context)
        else:
            below[:] = 1.0 / (len(characters) + 1)
        p = np.empty_like(below)
        weights = np.zeros((len(model.hashes[-1].values) if size > 1 else 1, k), np.float32)
        for j, t in enumerate(tables):
            whole, ctx, _, n, _ = t[size - 1]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            group, inverse, kinds = np.unique(ctx, return_inverse=True, return_counts=True)
            sums = np.bincount(inverse, n, len(group))
            gamma = discount * kinds / sums
            if size > 1:
                # what a context takes from the order below; one that the language never saw takes all of it
                place = model.hashes[-1].find(group)
                full = np.ones(len(model.hashes[-1].values))
                full[place] = gamma
                weights[:, j] = np.log(full)
                p[:, j] = np.where(before < 0, 1.0, full[before]) * below[:, j]
            elif len(gamma):
                p[:, j] = gamma[0] * below[:, j]
                model.floor[j] = np.log(gamma[0] / (len(characters) + 1))
            else:
                p[:, j] = below[:, j]
            p[np.searchsorted(every, whole), j] += np.maximum(n - discount, 0) / sums[inverse]
        if size > 1:
            model.backoff.append(weights)
        model.hashes.append(Hashes(every))
        model.logp.append(np.log(p).astype(np.float32))
        lower = p
    return model


def hashed(grams: np.ndarray) -> np.ndarray:
    """The hash of each row, as ``gram_hashes`` gives it; 0 for rows without characters."""
    if not grams.shape[1]:
        return np.zeros(len(grams), np.uint64)
    h = mixed(grams[:, 0].astype(np.uint64))
    for i in range(1, grams.shape[1]):
        h = mixed(h * FACTOR + grams[:, i])
    return h


def learned_fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out. A null id has no fold and is not learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def chosen(docs: DataFrame, most: int = MOST_TEXTS) -> DataFrame:
    """lang, calibrates, text: one text (the smallest) of each id and language outside the held-out fold, of at most ``most`` ids a language.

    Ids are ranked by a hash. Only counts by language and class of hash reach the driver, 1,024 classes of a language at most; the last class that
    still fits is the language's limit, so no language's ids meet in one task.
    """
    known = docs.where(F.col("lang").isNotNull() & (learned_fold() != 2)).select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    share = (F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") + 1) / F.lit(2.0**53)
    known = known.withColumn("class", F.floor(-16 * F.log2(share)).cast("int"))
    classes = known.select("lang", "doc_id", "class").distinct().groupBy("lang", "class").count()
    up = Window.partitionBy("lang").orderBy(F.desc("class"))
    limits = classes.withColumn("n", F.sum("count").over(up)).where(F.col("n") <= most).groupBy("lang").agg(F.min("class").alias("limit"))
    texts = known.join(F.broadcast(limits), "lang").where(F.col("class") >= F.col("limit")).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    return texts.select("lang", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION)) == 0).alias("calibrates"), "text")


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram (string of ``order`` characters), n. A task counts each text's grams before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                c = letters(text)
                if len(c):
                    c = padded(c, order)
                    for at in range(0, len(c) - order + 1, PIECE):
                        part = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(c[at : at + PIECE + order - 1], order))
                        grams, n = np.unique(part.view(f"V{4 * order}").ravel(), return_counts=True)
                        text_of = grams.tobytes().decode("utf-32-le", "surrogatepass")
                        rows = [text_of[i : i + order] for i in range(0, len(text_of), order)]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(rows, pa.string()), pa.array(n)], ["lang", "gram", "n"])

    return texts.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, most: int = MOST_TEXTS, order: int = ORDER) -> Model:
    """The calibrated model of all languages of ``docs``; without any, a model without languages.

    What reaches the driver are the grams of ``most`` texts a language and some numbers of each calibration text; neither grows with the
    table beyond that. The order is the same at any size unless a caller sets ``MOST_CELLS``.
    """
    texts = written(chosen(docs, most), "learned")
    counts = written(gram_counts(texts.where(~F.col("calibrates")), order), "grams")
    if MOST_CELLS is not None:
        size = counts.agg(F.count("*").alias("n"), F.countDistinct("lang").alias("k")).first()
        n = size.n
        while n * size.k > MOST_CELLS and order > 2:
            order -= 1
            counts = written(counts.groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.sum("n").alias("n")), "grams")
            n = counts.count()
    table = counts.toArrow()
    lang, n = np.array(table.column("lang").to_pylist(), object), table.column("n").to_numpy()
    # languages whose chosen texts all calibrate have no counts and are not known
    grams = np.frombuffer("".join(table.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, order)
    model = kneser_ney({name: (grams[lang == name], n[lang == name]) for name in set(lang)}, order)
    if model.languages:
        calibrate(model, texts.where("calibrates"))
    return model


def calibrate(model: Model, texts: DataFrame) -> None:
    """Sets the sharpness, the least score and the usual cross-entropies from whole texts and pieces of them that the counts left out."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, model = Letters(), shared.value
        place = {name: i for i, name in enumerate(model.languages)}
        for b in batches:
            out = []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                c = letters(text)
                for size in LENGTHS if lang in place and len(c) else ():
                    if not size or len(c) > size + 2:
                        total, n = model.log_likelihood(c[: size + 2] if size else c)
                        out.append((place[lang], size == 0, n, total.tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["lang", "whole", "n", "total"])

    table = texts.select("lang", "text").mapInArrow(run, "lang int, whole boolean, n long, total array<double>").toArrow()
    if not table.num_rows:
        return
    lang, whole, n = (table.column(c).to_numpy() for c in ("lang", "whole", "n"))
    total = np.array(table.column("total").to_pylist())
    order = np.lexsort((total[:, 0], n, lang))
    lang, whole, n, total = lang[order], whole[order], n[order], total[order]
    rows = np.arange(len(lang))

    def loss(how: tuple[float, float]) -> float:
        model.sharpness = how
        return float(-np.log(np.maximum(model.posterior(total, n)[rows, lang], 1e-12)).mean())

    model.sharpness = min(((s, p) for p in (0.5, 0.75, 1.0) for s in (0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.5, 4.0)), key=loss)
    best, score, bits, _ = model.judged(total, n)
    # the least score above which no more than one in a hundred is wrong
    down = np.argsort(-score, kind="stable")
    wrong = np.cumsum(best[down] != lang[down]) / (np.arange(len(down)) + 1)
    good = np.flatnonzero(wrong <= 0.01)
    model.least = float(score[down][good[-1]]) if len(good) else 1.0
    usual = np.zeros((len(model.languages), 3))
    for j in range(len(model.languages)):
        own = lang == j
        if not own.any():
            usual[j] = 0, 1, np.inf
            continue
        mean = float(np.average(bits[own], weights=n[own]))
        away = (bits[own] - mean) * np.sqrt(np.minimum(n[own], STEADY))
        spread = float(np.sqrt((away**2).mean())) + 1e-9
        usual[j] = mean, spread, float(np.quantile(away, 0.999)) / spread + 1
    model.usual = usual


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` of ``docs`` with lang_pred, score (the calibrated probability of that language), bits (cross-entropy a character) and
    accepted (false where the calibration rejects the prediction). Narrow: one pass, no shuffle.

    A text that is null or has no letter is ``und``, with score 0 and without bits, and so is every text if no language is known. Ties
    go to the language that sorts first. Repeated rows are judged one by one; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of MOST_TEXTS texts a language
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, model = Letters(), shared.value
        for b in batches:
            if not b.num_rows:
                continue
            total, n = np.zeros((b.num_rows, len(model.languages))), np.zeros(b.num_rows, np.int64)
            for i in range(b.num_rows if model.languages else 0):
                c = letters(b.column("text")[i].as_py() or "")
                if len(c):
                    total[i], n[i] = model.log_likelihood(c)
            some = np.flatnonzero(n)
            names, score, bits, accepted = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows), np.full(b.num_rows, np.nan), np.zeros(b.num_rows, bool)
            if len(some):
                best, score[some], bits[some], accepted[some] = model.judged(total[some], n[some])
                names[some] = np.array(model.languages, object)[best]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(bits, from_pandas=True), pa.array(accepted)], ["doc_id", "lang_pred", "score", "bits", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits double, accepted boolean")


def language_predictions(docs: DataFrame) -> DataFrame:
    """The contract's columns, then bits and accepted. A null doc_id is in no fold: not held out, and not learned from."""
    held = F.coalesce(learned_fold() == 2, F.lit(False)).alias("held_out")
    return identify(docs, fit(docs)).select("doc_id", held, "lang_pred", "score", "bits", "accepted")
