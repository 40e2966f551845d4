"""Document fingerprints by locally consistent parsing.

A text is parsed bottom-up.  At each level runs of one symbol become one
symbol; deterministic coin tossing reduces the symbols to a few labels, of
which neighbours differ; local maxima of the labels start phrases; and a
phrase is named by its content.  Where a phrase starts depends on a few
symbols around it, so equal substrings are parsed alike in their interior,
whatever their offsets.  A fingerprint is the name of the whole text followed
by a MinHash sketch of the phrase names of each level.

Defined results: null and empty texts have the fingerprint of no phrases and
are like one another; equal texts have equal fingerprints; rows are ordered by
doc_id (null first), then text, so repeated rows follow each other; the only
row is its own next; an empty table gives an empty one; columns other than
doc_id and text are not used.  Texts are never cut.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, partitions
from .textcore import _GOLD, U64, Codes, char_values, chunks, mix, seeds

LEVELS = 5
SLOTS = 16
WEIGHTS = (0.25, 1.0, 1.0, 1.0, 0.5)  # of the levels' likeness
_TOSSES = 3  # after the first toss, of 64-bit names
_LEAST = -(1 << 63)


def _toss(x: np.ndarray, first: np.ndarray, dtype) -> np.ndarray:
    """2k + bit k of x, k being the lowest bit in which x differs from its predecessor in its text."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]
    diff = x ^ before
    k = np.bitwise_count((diff & (~diff + x.dtype.type(1))) - x.dtype.type(1)).astype(x.dtype)
    return (k * x.dtype.type(2) + ((x >> k) & x.dtype.type(1))).astype(dtype)


def landmarks(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases start: each text's first symbol, and local maxima of the labels.  No two neighbours of a text are equal."""
    label = _toss(x, first, np.uint8)
    for _ in range(_TOSSES):
        label = _toss(label, first, np.uint8)
    start = np.zeros(len(x), bool)
    start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    start[first] = True
    last = np.append(first[1:] - 1, len(x) - 1)
    start[last] &= np.isin(last, first)
    return np.flatnonzero(start)


def collapse(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol as one symbol, named by symbol and length."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[first] = True
    at = np.flatnonzero(new)
    if len(at) == len(x):
        return x, first
    size = np.diff(np.append(at, len(x)))
    out = x[at].copy()
    many = size > 1
    out[many] = mix(out[many] * U64(0xA24BAED4963EE407) + size[many].astype(U64))
    return out, np.searchsorted(at, first)


def level_up(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of the symbols x, and each text's first phrase."""
    x, first = collapse(x, first)
    at = landmarks(x, first)
    size = np.diff(np.append(at, len(x)))
    name, open_, step = mix(size.astype(U64) * _GOLD), np.arange(len(at)), 0
    while len(open_):  # a phrase has a few symbols: its labels rise and fall once
        name[open_] = mix(name[open_] ^ x[at[open_] + step])
        step += 1
        open_ = open_[size[open_] > step]
    return name, np.searchsorted(at, first)


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(names of the whole texts, (texts, LEVELS, SLOTS) sketches; an unused slot is 0)."""
    codes = Codes(texts)
    root = codes.names(codes.starts, codes.ends) ^ codes.lens.astype(U64)
    out = np.zeros((len(texts), LEVELS, SLOTS), np.uint16)
    some = np.flatnonzero(codes.lens)
    if not len(some):
        return root, out
    keep = np.ones(len(codes.cp), bool)
    keep[codes.ends] = False
    x = char_values()[codes.cp[keep]]
    first = np.cumsum(codes.lens[some]) - codes.lens[some]
    factors = seeds(SLOTS, 71)
    for level in range(LEVELS):
        x, first = level_up(x, first)
        for slot, factor in enumerate(factors):
            low = np.minimum.reduceat(x * factor, first)
            out[some, level, slot] = (mix(low) % U64(65535)).astype(np.uint16) + 1
    return root, out


def text_of(root: np.ndarray, sketch: np.ndarray) -> list[str]:
    """Fingerprints as hex: 16 digits of the whole text's name, then 4 for each slot."""
    body = sketch.reshape(len(sketch), -1).astype(">u2")
    return [f"{r:016x}" + row.tobytes().hex() for r, row in zip(root.tolist(), body)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted share of equal slots of two arrays of sketches; levels without phrases in both do not count."""
    used = (a[:, :, 0] > 0) | (b[:, :, 0] > 0)
    same = ((a == b) & (a > 0)).mean(2)
    w = used * np.array(WEIGHTS)
    total = w.sum(1)
    return np.where(total > 0, (same * w).sum(1) / np.where(total > 0, total, 1), 1.0)


def edited(text: str, after: str) -> str:
    """text with its last half replaced by as much of the beginning of the text after it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _bounds(rows: DataFrame, n: int) -> list[int]:
    """Ids that cut the rows into at most n ranges of about equal size."""
    cuts = [i / n for i in range(1, n)]
    return sorted(set(rows.agg(F.percentile_approx("id", cuts, max(10_000, 4 * n))).first()[0] or [])) if cuts else []


def _below(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are below the value, by binary search in one literal array."""
    if not bounds:
        return F.lit(0)
    every = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, s: at + F.when((at + s <= len(bounds)) & (F.try_element_at(every, at + s) < value), s).otherwise(0))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, ahead, doc_id, text) in buckets of neighbouring ids; `ahead` rows stand for what follows a bucket's last.

    One shuffle of the texts: a bucket is a range of ids between quantiles and
    a partition of its own.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.coalesce("doc_id", F.lit(_LEAST)))
    rows = rows.withColumn("bucket", _below(_bounds(rows.select("id"), n), F.col("id")))
    heads = sorted((r.bucket, r.head) for r in rows.groupBy("bucket").agg(F.min("id").alias("head")).collect())  # a row for each bucket
    before = {head: b for (b, _), (_, head) in zip(heads[-1:] + heads[:-1], heads)}
    own = F.struct("bucket", F.lit(0).alias("ahead"))
    places = F.array(own)
    if heads:
        to = F.from_json(F.lit(json.dumps(before)), "map<string,int>")
        more = F.struct(to[F.col("id").cast("string")].alias("bucket"), F.lit(1).alias("ahead"))
        places = F.when(F.col("id").isin(list(before)), F.array(own, more)).otherwise(places)
    dealt = rows.select(F.explode(places).alias("place"), "id", "doc_id", "text").select("place.*", "id", "doc_id", "text")
    return dealt.repartitionById(n, "bucket").sortWithinPartitions("bucket", "ahead", "id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    bounded_batches(docs.sparkSession)

    def judged(ids, texts):
        """texts has one more: what follows the last."""
        k = len(ids)
        for a, b in chunks((len(t) for t in texts[:k])):
            root, sketch = sketches(texts[a : b + 1])
            changed = [edited(t, after) for t, after in zip(texts[a:b], texts[a + 1 : b + 1])]
            root2, sketch2 = sketches(changed)
            digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
            sketch1 = sketch[: b - a]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a:b], pa.int64()), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(digest), pa.array(text_of(root[: b - a], sketch1)), pa.array(text_of(root2, sketch2)), pa.array(likeness(sketch1, sketch2)), pa.array(likeness(sketch1, sketch[1:]))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    def run(batches):
        ids, texts, current, closed = [], [], None, False
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "text")]
            for bucket, ahead, i, text in zip(*cols):
                if bucket != current:
                    ids, texts, current, closed = [], [], bucket, False
                if closed:
                    continue  # further rows of the id that follows
                texts.append(text)
                if ahead:
                    yield from judged(ids, texts)
                    closed = True
                    continue
                ids.append(i)
            if not closed and len(ids) > 1:
                yield from judged(ids[:-1], texts)
                ids, texts = ids[-1:], texts[-1:]

    return with_next(docs).select("bucket", "ahead", "doc_id", "text").mapInArrow(run, schema)
