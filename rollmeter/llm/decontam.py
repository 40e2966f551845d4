"""Benchmark decontamination by SimHash windows.

Every run of words as long as a benchmark item is a window; a text with fewer
words than the item is one window of all its words.  A window's fingerprint is
the SimHash of its weighted five-word shingles; a multi-index, for each of the
fingerprint's eight bytes a table of the items by the bytes within two bits of
theirs, finds every item of that length within RADIUS bits (a pair within
8 * 3 - 1 bits agrees in some byte up to two bits), and the exact weighted
Jaccard similarity of the shingle sets decides.  A shingle's weight is
1 + ln(items / items that have it), over the whole benchmark.  Windows without
any shingle of an item of their length have similarity 0 and are not
fingerprinted.

Defined results: null and empty texts, and items without a word, match
nothing; an item of one to four words matches where these words stand in a
row; of equally similar windows the first counts; repeated documents are
reported each, an item_id once for each, by the best of its texts; a null
item_id is no item; an empty table of documents or items gives an empty result; other columns are
not used.  Texts are never cut.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_pass, small, written
from .textcore import SHINGLE_WORDS, U64, NameSet, Words, chunks, clean, mix, ranges, seeds, signed

THRESHOLD = 0.8
BLOCKS, BLOCK_RADIUS = 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
PASS_ITEMS, PASS_CHARS = 20_000, 20_000_000  # of the benchmark in one pass over the documents
PIECE_WORDS, PIECE_PAIRS = 1 << 14, 1 << 20  # of a text fingerprinted at once; of windows and items compared at once


def runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(names of all runs of `size` words, whether a run lies in one text), by first word."""
    m = max(0, len(words.name) - size + 1)
    name, factor = np.zeros(m, U64), seeds(SHINGLE_WORDS, 5)
    for k in range(size):
        name += words.name[k : k + m] * factor[k]
    return mix(name + U64(size)), words.doc[:m] == words.doc[size - 1 :][:m]


def simhash(names: np.ndarray, weights: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Fingerprints of the ranges [start, stop) of weighted names."""
    bits = ((mix(names)[:, None] >> np.arange(64, dtype=U64)) & U64(1)).astype(np.float64) * 2 - 1
    total = np.zeros((len(names) + 1, 64))
    np.cumsum(bits * weights[:, None], axis=0, out=total[1:])
    return ((total[stop] - total[start] > 1e-9).astype(U64) << np.arange(64, dtype=U64)).sum(1, dtype=U64)


def as_bytes(prints: np.ndarray) -> np.ndarray:
    return ((prints[:, None] >> (np.arange(BLOCKS, dtype=U64) * U64(8))) & U64(255)).astype(np.int64)


NEAR_BYTES = [np.flatnonzero(np.bitwise_count(np.arange(256) ^ v) <= BLOCK_RADIUS) for v in range(256)]


class Group:
    """Items of one length in words, and a table for each block: the items by each byte near theirs."""

    def __init__(self, size: int, items: list[int], sets: list[dict[int, float]], prints: np.ndarray):
        self.size, self.items, self.sets, self.prints = size, items, sets, prints
        self.total = np.array([sum(s.values()) for s in sets])
        self.tables = []
        for value in as_bytes(prints).T:
            near = np.concatenate([NEAR_BYTES[v] for v in value])
            order = np.argsort(near, kind="stable")
            self.tables.append((np.searchsorted(near[order], np.arange(257)), np.repeat(np.arange(len(items), dtype=np.int32), [len(NEAR_BYTES[v]) for v in value])[order]))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, bits) of all pairs within RADIUS."""
        out, step = [], max(1, PIECE_PAIRS // (BLOCKS * len(self.items)))
        for a in range(0, len(prints), step):
            found = []
            for (first, listed), value in zip(self.tables, as_bytes(prints[a : a + step]).T):
                n = first[value + 1] - first[value]
                found.append(np.repeat(np.arange(len(value)), n) * len(self.items) + listed[ranges(first[value], n)])
            pair = np.unique(np.concatenate(found))
            w, k = a + pair // len(self.items), pair % len(self.items)
            bits = np.bitwise_count(prints[w] ^ self.prints[k])
            keep = bits <= RADIUS
            out.append((w[keep], k[keep], bits[keep]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def item_shingles(words: Words) -> dict[int, np.ndarray]:
    """The shingles of each text with a word: runs of five words, or of all where it has fewer."""
    sizes = words.counts.tolist()
    name = {k: runs(words, k)[0] for k in {min(n, SHINGLE_WORDS) for n in sizes if n}}
    first = words.first.tolist()
    return {i: name[min(n, SHINGLE_WORDS)][first[i] : first[i] + n - min(n, SHINGLE_WORDS) + 1] for i, n in enumerate(sizes) if n}


class Shared:
    """Shingles of at least two items of a benchmark, with the number of items; any other is of one item at most."""

    def __init__(self, total: int, names: np.ndarray, n: np.ndarray):
        order = np.argsort(names)
        self.total, self.names, self.n = total, NameSet(names), n[order]

    @property
    def unseen(self) -> float:
        return 1 + float(np.log(max(1, self.total)))

    def weights(self, names: np.ndarray) -> np.ndarray:
        out = np.full(len(names), self.unseen)
        at, entry = self.names.find(names)
        out[at] = 1 + np.log(self.total / self.n[entry])
        return out


class Benchmark:
    """Items of a pass: one NameSet for each shingle size, groups by length; weights by the whole benchmark."""

    def __init__(self, ids: list[int], texts: list[str], shared: Shared):
        words = Words(texts)
        self.ids, sizes = ids, words.counts
        by_size, member = defaultdict(list), defaultdict(set)
        for i, n in enumerate(sizes.tolist()):
            if n:
                by_size[n].append(i)
        spans = item_shingles(words)
        for i, span in spans.items():
            for s in span.tolist():
                member[s].add(i)
        self.shared = shared
        shingles = np.fromiter(member, U64, len(member))
        self.weight = dict(zip(shingles.tolist(), shared.weights(shingles).tolist()))
        self.names = {k: NameSet(np.concatenate([spans[i] for n, items in by_size.items() if min(n, SHINGLE_WORDS) == k for i in items])) for k in {min(n, SHINGLE_WORDS) for n in by_size}}
        self.weights = {k: np.array([self.weight[s] for s in v.names.tolist()]) for k, v in self.names.items()}
        self.sizes_of = {k: [sorted({int(sizes[i]) for i in member[s]}) for s in v.names.tolist()] for k, v in self.names.items()}
        self.groups = {}
        for n, items in by_size.items():
            prints = np.concatenate([simhash(spans[i], np.array([self.weight[s] for s in spans[i].tolist()]), np.zeros(1, int), np.array([len(spans[i])])) for i in items])
            self.groups[n] = Group(n, items, [{s: self.weight[s] for s in spans[i].tolist()} for i in items], prints)

    def search(self, texts: list[str], threshold: float = THRESHOLD) -> list[tuple[int, int, float, int, int, int]]:
        """(text, item, similarity, bits, first word, words) of the best window of each text and item at the threshold."""
        words, best = Words(texts), {}
        for k, known in self.names.items():
            name, inside = runs(words, k)
            at, entry = known.find(name)
            ok = inside[at]
            at, entry = at[ok], entry[ok]
            doc = words.doc[at]
            edge = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
            for a, b in zip(edge, edge[1:]):
                sizes = sorted({n for e in np.unique(entry[a:b]).tolist() for n in self.sizes_of[k][e]})
                for n in sizes:
                    self._windows(words, name, k, int(doc[a]), at[a:b], self.groups[n], threshold, best)
        return [(d, i, *v) for (d, i), v in sorted(best.items())]

    def _windows(self, words, name, k, doc, at, group, threshold, best) -> None:
        size = min(group.size, int(words.first[doc + 1] - words.first[doc]))
        width = size - k + 1  # shingles of a window
        lo, hi = words.first[doc], words.first[doc + 1] - size  # first and last start
        while len(at):  # hits in ascending order, a piece of the text after the other
            n = int(np.searchsorted(at, at[0] + max(PIECE_WORDS, width)))
            base = int(at[0]) - width + 1
            cover = np.zeros(int(at[n - 1]) - base + 2, np.int32)  # how many hits the window from here on has
            np.add.at(cover, at[:n] - width + 1 - base, 1)
            np.add.at(cover, at[:n] + 1 - base, -1)
            begin = base + np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            begin = begin[(begin >= lo) & (begin <= hi)]
            if len(begin):
                self._piece(name, doc, at, begin, width, size, int(lo), group, threshold, best)
            at = at[n:] if n < len(at) else at[:0]

    def _piece(self, name, doc, at, starts, width, size, lo, group, threshold, best) -> None:
        a, b = int(starts[0]), int(starts[-1]) + width
        span = name[a:b]
        weight = self.shared.weights(span)
        here = at[(at >= a) & (at < b)] - a
        window, item, bits = group.within(simhash(span, weight, starts - a, starts - a + width))
        known = np.zeros(b - a + 1)
        known[1:][here] = weight[here]
        most = np.cumsum(known)
        shared = most[starts - a + width] - most[starts - a]  # at least what a window has in common with any item
        keep = shared[window] >= threshold * group.total[item] - 1e-9
        names, weights = span.tolist(), weight.tolist()
        for w, i, d in zip(window[keep].tolist(), item[keep].tolist(), bits[keep].tolist()):
            s = int(starts[w]) - a
            own = dict(zip(names[s : s + width], weights[s : s + width]))
            other = group.sets[i]
            common = sum(v for x, v in own.items() if x in other)
            like = common / (sum(own.values()) + group.total[i] - common)
            key, first = (doc, self.ids[group.items[i]]), s + a - lo
            if like >= threshold - 1e-9 and (key not in best or (-like, first, size) < (-best[key][0], best[key][2], best[key][3])):
                best[key] = float(min(1.0, like)), int(d), first, size


def counts(items: DataFrame, total: int) -> Shared:
    """How many of the items (item_id, text; all different) have each shingle that more than one has."""

    def make():
        def step(batch):
            texts = clean(batch.column("text").to_pylist())
            for a, b in chunks(map(len, texts)):
                spans = item_shingles(Words(texts[a:b]))
                if spans:
                    name, n = np.unique(np.concatenate([np.unique(x) for x in spans.values()]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(n)], names=["name", "n"])

        return step

    rows = arrow_pass(items.select("text"), make, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    return Shared(total, rows.column("name").to_numpy().view(U64), rows.column("n").to_numpy())


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, bits, first_word, n_words): the best window of each document and item at the threshold."""
    schema = "doc_id long, item_id long, similarity double, bits int, first_word long, n_words long"
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes = max(1, -(-n // PASS_ITEMS), -(-chars // PASS_CHARS))
    common = counts(items, n)
    out = None
    for p in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        rows = sorted(part.collect())
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark([r.item_id for r in rows], [r.text for r in rows], common))  # of about PASS_ITEMS items

        def make(shared=shared):
            own = shared.value

            def step(batch):
                texts, ids = clean(batch.column("text").to_pylist()), batch.column("doc_id").to_pylist()
                for a, b in chunks(map(len, texts)):
                    found = own.search(texts[a:b], threshold)
                    if found:
                        cols = list(zip(*found))
                        types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
                        cols[0] = [ids[a + d] for d in cols[0]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "similarity", "bits", "first_word", "n_words"])

            return step

        got = arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)
        out = got if out is None else out.union(got)
    return out


def without(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that hold a benchmark item; all columns as they were."""
    hit = small(written(find(docs, benchmark, threshold).select("doc_id").distinct()))
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["doc_id"]), "left_anti")
