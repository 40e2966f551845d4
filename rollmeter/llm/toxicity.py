"""Toxicity by nearest labelled examples.

Terms are words and word beginnings; each counts again for every band of its
rate and count in a text that it reaches, so that "often" and "once" are
different terms.  The vocabulary holds all banded terms that LEAST_TEXTS toxic
examples have and that these have LIFT times as often as others; document
frequencies are counted over the whole corpus.  Examples are TF-IDF vectors in
a block-max inverted index: a term's postings are cut at blocks of examples,
each piece with its largest weight.  A query visits blocks in the order of
their upper bounds, reads only its own terms' postings there, and stops when
no bound reaches its k-th best cosine, so the k nearest are exact.  Votes
weighted by the squared cosine are calibrated by a logistic map fitted on
left-one-out votes.

Defined results: null and empty texts, and texts without a vocabulary term,
have no neighbours and get the rate of such examples; of equal cosines (to
twelve decimals) those of the least example number count, and examples are
numbered by a hash of their id; repeated rows get equal scores; without both
labels in the training rows every score is the rate of label 1, which without
any label is 0; an empty table gives an empty one.  Texts are never cut.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_pass, written
from .textcore import U64, NameSet, Words, chunks, clean, distinct, mix, ranges, seeds, signed

TOXIC_EXAMPLES, OTHER_EXAMPLES = 4000, 8000  # bounds of the labelled sample, about, by a hash of the id
LEAST_TEXTS, LIFT = 4, 3.0  # a term: toxic texts that have it, and how much more often than others
RATES = (0.0, 1 / 256, 1 / 128, 1 / 64)
BANDS = 2 * len(RATES)
PREFIXES = range(3, 9)
NEIGHBOURS = 16
BLOCK = 32
CACHED = 4096  # results of a worker's last different vectors, about a KB each
_EQUAL = 1e-11


def base_terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(names of the words and word beginnings, the text of each)."""
    size, salt = words.end - words.start, seeds(12, 31)
    name, doc = [mix(words.name ^ salt[0])], [words.doc]
    for k in PREFIXES:
        at = size > k
        name.append(mix(words.codes.names(words.start[at], words.start[at] + k) ^ salt[k]))
        doc.append(words.doc[at])
    return np.concatenate(name), np.concatenate(doc)


def counted(words: Words, known: NameSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term number, count) of the known terms of each text."""
    name, doc = base_terms(words)
    at, term = known.find(name)
    key, count = np.unique(doc[at] * (len(known.names) + 1) + term, return_counts=True)
    return key // (len(known.names) + 1), key % (len(known.names) + 1), count


def banded(words: Words, known: NameSet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, band, count): a row for every band that a term of a text reaches."""
    doc, term, count = counted(words, known)
    rate = count / words.counts[doc]
    rows = [(np.flatnonzero((rate >= r) & (count >= 1 + twice)), 2 * i + twice) for i, r in enumerate(RATES) for twice in (0, 1)]
    at = np.concatenate([x for x, _ in rows])
    return doc[at], term[at], np.repeat([b for _, b in rows], [len(x) for x, _ in rows]), count[at]


class Vocabulary:
    def __init__(self, terms: np.ndarray, bands: np.ndarray):
        self.known = NameSet(terms)
        self.number = np.full((len(self.known.names), BANDS), -1)
        order = np.lexsort((bands, terms))
        self.number[np.searchsorted(self.known.names, terms[order]), bands[order]] = np.arange(len(terms))
        self.size = len(terms)

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, 1 + ln count), by text."""
        doc, term, band, count = banded(Words(texts), self.known)
        feature = self.number[term, band]
        at = np.flatnonzero(feature >= 0)
        at = at[np.lexsort((feature[at], doc[at]))]
        return doc[at], feature[at], 1 + np.log(count[at])


@dataclass
class Index:
    """Labelled examples: postings by feature and example, cut at blocks of examples, with each piece's largest weight."""

    idf: np.ndarray
    ids: np.ndarray
    votes: np.ndarray  # 1 if toxic
    weight: np.ndarray  # what an example stands for, as the two classes are sampled at their own rates
    posted: tuple[np.ndarray, np.ndarray, np.ndarray]  # feature, example, value of each posting, by feature and example
    at: np.ndarray = field(init=False)  # where the pieces of a feature begin
    block: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)  # where the postings of a piece begin
    most: np.ndarray = field(init=False)

    def __post_init__(self):
        feature, example, value = self.posted
        self.blocks = max(1, -(-len(self.ids) // BLOCK))
        key, start = np.unique(feature.astype(np.int64) * self.blocks + example // BLOCK, return_index=True)
        most = np.maximum.reduceat(value, start).astype(np.float32) if len(key) else np.zeros(0, np.float32)
        self.most = np.nextafter(most, np.float32(2))  # rounding never lowers a bound
        self.block = (key % self.blocks).astype(np.int32)
        self.first = np.append(start, len(value))
        self.at = np.searchsorted(key, np.arange(len(self.idf) + 1) * self.blocks)
        self.posted = example.astype(np.int32), value

    def nearest(self, feature: np.ndarray, value: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, example numbers) of the k nearest examples that share a feature; `without` is left out."""
        example, weight = self.posted
        count = self.at[feature + 1] - self.at[feature]
        piece, own = ranges(self.at[feature], count), np.repeat(value, count)
        bound = np.bincount(self.block[piece], own * self.most[piece], self.blocks)
        order = np.argsort(-bound, kind="stable")[: int(np.count_nonzero(bound > 0))]
        turn = np.empty(self.blocks, np.int64)  # of a block in the order of the bounds
        turn[order] = np.arange(len(order))
        by_turn = np.argsort(turn[self.block[piece]], kind="stable")
        piece, own = piece[by_turn], own[by_turn]
        begin = np.searchsorted(turn[self.block[piece]], np.arange(len(order) + 1))
        best, who, at, step = np.zeros(0), np.zeros(0, np.int64), 0, 2
        while at < len(order) and (len(best) < k or bound[order[at]] > best[-1] - _EQUAL):
            stop = min(len(order), at + step)
            p, w = piece[begin[at] : begin[stop]], own[begin[at] : begin[stop]]
            n = self.first[p + 1] - self.first[p]
            post = ranges(self.first[p], n)
            place = (turn[example[post] // BLOCK] - at) * BLOCK + example[post] % BLOCK
            got = np.bincount(place, np.repeat(w, n) * weight[post], (stop - at) * BLOCK)
            found = np.flatnonzero(got > 0)
            number = order[at + found // BLOCK] * BLOCK + found % BLOCK
            keep = number != without
            best, who = np.concatenate((best, got[found[keep]])), np.concatenate((who, number[keep]))
            top = np.lexsort((who, -np.round(best, 12)))[:k]
            best, who, at, step = best[top], who[top], stop, min(64, step * 2)
        return np.minimum(best, 1.0), who

    def vote(self, cosines: np.ndarray, who: np.ndarray, prior: float) -> float:
        """Share of toxic among the neighbours, drawn to the prior where they are few or far."""
        w = cosines**2 * self.weight[who]
        unit = 0.25 * self.weight.mean()
        return float((w @ self.votes[who] + unit * prior) / (w.sum() + unit))


@dataclass
class Model:
    vocabulary: Vocabulary | None
    index: Index | None
    prior: float
    alone: float  # rate of label 1 among examples without a feature
    slope: float = 1.0
    shift: float = 0.0

    def calibrated(self, vote: float) -> float:
        v = min(max(vote, 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-(self.slope * np.log(v / (1 - v)) + self.shift))))

    def score(self, texts: list[str], cache: dict | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(scores, evidence): evidence is the nearest examples' ids and cosines."""
        none = np.zeros(0, np.int64), np.zeros(0)
        score, evidence, cache = np.full(len(texts), self.alone), [none] * len(texts), {} if cache is None else cache
        if self.index is None or not len(self.index.ids):
            return score, evidence
        doc, feature, tf = self.vocabulary.vectors(texts)
        value = tf * self.index.idf[feature]
        edge = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
        for a, b in zip(edge, edge[1:]):
            v = value[a:b] / np.sqrt((value[a:b] ** 2).sum())
            key = hashlib.blake2b(feature[a:b].tobytes() + value[a:b].tobytes(), digest_size=16).digest()
            if key not in cache:
                if len(cache) >= CACHED:
                    cache.clear()
                cosines, who = self.index.nearest(feature[a:b], v)
                cache[key] = self.calibrated(self.index.vote(cosines, who, self.prior)), (self.index.ids[who], cosines)
            score[doc[a]], evidence[doc[a]] = cache[key]
        return score, evidence


def platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic map, slightly shrunk to the identity."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = w * (p - y), w * p * (1 - p) + 1e-9
        g = np.array([(r * x).sum() + (a - 1), r.sum() + b * 0.1])
        hess = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0.05 else (1.0, 0.0)


def _sample(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[DataFrame, dict[int, float]]:
    """(written table: id, dice, text, toxic; what a row of each label stands for)."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(learn)
    total = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {k: min(1.0, bound / total[k]) for k, bound in ((1, TOXIC_EXAMPLES), (0, OTHER_EXAMPLES)) if k in total}
    dice = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 40))
    limit = F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)) * float(1 << 40)
    chosen = known.withColumn("dice", dice).where(F.col("dice") < limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most about TOXIC_EXAMPLES + OTHER_EXAMPLES ids
    return written(rows.select("doc_id", "dice", "text", "toxic")), {k: 1 / x for k, x in share.items()}


def _select(sample: DataFrame) -> Vocabulary | None:
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None

    def all_terms():
        def step(batch):
            texts = clean(batch.column("text").to_pylist())
            for a, b in chunks(map(len, texts)):
                term, n = np.unique(distinct(*base_terms(Words(texts[a:b])), b - a)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(term)), pa.array(n)], names=["term", "n"])

        return step

    seen = arrow_pass(sample.where("toxic = 1").select("text"), all_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    terms = np.array([r.term for r in seen.select("term").collect()], np.int64).view(U64)
    known = sample.sparkSession.sparkContext.broadcast(NameSet(terms))  # terms of at most about TOXIC_EXAMPLES texts

    def bands():
        own = known.value

        def step(batch):
            texts, toxic = clean(batch.column("text").to_pylist()), np.array(batch.column("toxic").to_pylist())
            for a, b in chunks(map(len, texts)):
                doc, term, band, _ = banded(Words(texts[a:b]), own)
                key, n = np.unique((term * BANDS + band) * 2 + toxic[a:b][doc], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

        return step

    n = arrow_pass(sample.select("text", "toxic"), bands, "key long, n long").groupBy((F.col("key") / 2).cast("long").alias("key")).agg(
        F.sum(F.when(F.col("key") % 2 == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("key") % 2 == 0, F.col("n")).otherwise(0)).alias("other")
    )
    lift = (F.col("toxic") / sizes[1]) / ((F.col("other") + 0.5) / (sizes[0] + 1))
    rows = n.where((F.col("toxic") >= LEAST_TEXTS) & (lift >= LIFT)).select("key").collect()
    if not rows:
        return None
    key = np.sort(np.array([r.key for r in rows]))
    return Vocabulary(known.value.names[key // BANDS], key % BANDS)


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """A model from the labels of rows where `learn` (over doc_id) holds and from all texts of docs."""
    spark = docs.sparkSession
    sample, stands = _sample(docs, labels, learn)
    vocabulary = _select(sample)
    rates = {r.toxic: r["count"] * stands[r.toxic] for r in sample.groupBy("toxic").count().collect()}
    prior = rates.get(1, 0.0) / max(1.0, sum(rates.values()))
    if vocabulary is None:
        return Model(None, None, prior, prior)
    shared = spark.sparkContext.broadcast(vocabulary)  # terms of the sample

    def frequencies():
        own = shared.value

        def step(batch):
            texts, n = clean(batch.column("text").to_pylist()), np.zeros(own.size, np.int64)
            for a, b in chunks(map(len, texts)):
                n += np.bincount(own.vectors(texts[a:b])[1], minlength=own.size)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[some], len(texts)))], names=["feature", "n"])

        return step

    df = np.zeros(vocabulary.size)
    total = 0
    for r in arrow_pass(docs.select("text"), frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if r.feature < 0:
            total = r.n
        else:
            df[r.feature] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1

    def vectors():
        own = shared.value

        def step(batch):
            texts = clean(batch.column("text").to_pylist())
            doc, feature, tf = own.vectors(texts)
            at = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (feature, tf)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "dice", "toxic")), *lists], names=["doc_id", "dice", "toxic", "feature", "tf"])

        return step

    rows = arrow_pass(sample.select("doc_id", "dice", "toxic", "text"), vectors, "doc_id long, dice long, toxic int, feature array<long>, tf array<double>").collect()
    return _indexed(vocabulary, idf, rows, stands, prior)


def _indexed(vocabulary, idf, rows, stands, prior) -> Model:
    bare = {0: 0.0, 1: 0.0}
    some = []
    for r in rows:
        if not r.feature:
            bare[r.toxic] += stands[r.toxic]
            continue
        f = np.array(r.feature)
        v = np.array(r.tf) * idf[f]
        some.append((int(f[v.argmax()]), r.dice, r.doc_id, f, v / np.sqrt((v * v).sum()), r.toxic))
    some.sort(key=lambda x: (x[0], x[1], x[2], x[3].tobytes(), x[5]))
    alone = (bare[1] + 0.5 * prior) / (bare[0] + bare[1] + 0.5)
    if not some:
        return Model(vocabulary, None, prior, alone)
    feature, example = np.concatenate([x[3] for x in some]), np.repeat(np.arange(len(some)), [len(x[3]) for x in some])
    order = np.argsort(feature, kind="stable")
    posted = feature[order], example[order], np.concatenate([x[4] for x in some])[order]
    index = Index(idf, np.array([x[2] for x in some]), np.array([x[5] for x in some], float), np.array([stands[x[5]] for x in some]), posted)
    votes = np.array([index.vote(*index.nearest(x[3], x[4], without=i), prior) for i, x in enumerate(some)])
    v = np.clip(votes, 1e-6, 1 - 1e-6)
    return Model(vocabulary, index, prior, alone, *platt(np.log(v / (1 - v)), index.votes, index.weight / index.weight.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, predicted and evidence; columns of these names are replaced."""
    kept = [f for f in docs.schema if f.name not in ("score", "predicted", "evidence")]
    names = [f.name for f in kept]
    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType())]))
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", evidence)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the bounds of the sample

    def make():
        own, cache = shared.value, {}

        def step(batch):
            texts = clean(batch.column("text").to_pylist())
            for a, b in chunks(map(len, texts)):
                got, why = own.score(texts[a:b], cache)
                at = np.concatenate(([0], np.cumsum([len(x) for x, _ in why]))).astype(np.int32)
                fields = [pa.array(np.concatenate(x), t) for x, t in zip(zip(*why), (pa.int64(), pa.float64()))]
                why = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, ["doc_id", "cosine"]))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(got), pa.array((got >= 0.5).astype(np.int32)), why], names=[*names, "score", "predicted", "evidence"])

        return step

    return arrow_pass(docs.select(*names), make, schema)
