"""Byte-level BPE encoding and decoding.

Two tiers.  A whole pre-token that is an entry of the vocabulary is resolved
by a minimal perfect hash, for a whole batch at a time.  The others, once
each, are merged by a heap of adjacent pairs over a linked list of bytes.
Hashes only propose: every pre-token is compared, code point by code point,
with the entry found for it, and one that differs is merged by itself.

Defined results: a null text is encoded as the empty text, which has no ids;
repeated rows are encoded alike; no text is cut.  A text that holds lone
surrogates cannot come from Spark.  Input columns other than the text pass
through; columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_pass
from .textcore import BREAK, LETTER, SPACE, U64, Codes, char_classes, chunks, clean, mix, ranges, seeds

CACHE_PRETOKENS, CACHE_CHARS = 1 << 19, 1 << 22  # per Python worker; only a cache, it is emptied when full
_APOSTROPHE, _BLANK = 0x27, 0x20


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit names: levels of bit maps, each key alone in its bit, numbered by rank."""

    def __init__(self, names: np.ndarray):
        left, self.levels, base = np.asarray(names, U64), [], 0
        salts = seeds(64, 9)
        while len(left):
            salt, size = salts[len(self.levels)], max(64, 2 * len(left))
            at = self._place(left, salt, size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((salt, size, alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.n = base

    @staticmethod
    def _place(names: np.ndarray, salt: np.uint64, size: int) -> np.ndarray:
        return (mix(names ^ salt) % U64(size)).astype(np.int64)

    def index(self, names: np.ndarray) -> np.ndarray:
        """0..n-1, a different one for each key; an arbitrary one or -1 for other names."""
        out, open_ = np.full(len(names), -1, np.int64), np.arange(len(names))
        for salt, size, alone, rank in self.levels:
            at = self._place(names[open_], salt, size)
            hit = alone[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pretokens(codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every match of the public split pattern, in order.

    Runs of one character class are the matches, with four corrections: the
    last blank before a run belongs to it; a run of white space gives up its
    last character when text follows; white space that ends a text is one
    match; and the seven English contractions are matches when the apostrophe
    is a run by itself with no blank before it.
    """
    cp = codes.cp
    cls = char_classes()[cp].copy()
    cls[codes.ends] = BREAK
    begin = np.flatnonzero(np.concatenate(([True], (cls[1:] != cls[:-1]) | (cls[1:] == BREAK))))
    end = np.append(begin[1:], len(cp))
    kind = cls[begin]
    n = len(begin)
    after = np.append(kind[1:], BREAK)
    last_blank = (kind == SPACE) & (cp[end - 1] == _BLANK)
    inner = (kind == SPACE) & (after != BREAK)
    glued = np.zeros(n, bool)
    glued[1:] = last_blank[:-1] & (kind[1:] < SPACE)
    first, stop = np.empty((n, 2), np.int64), np.empty((n, 2), np.int64)
    first[:, 0], stop[:, 0] = begin - glued, np.where(inner, end - 1, end)
    first[:, 1], stop[:, 1] = np.where(inner & ~last_blank, end - 1, end), end
    alone = np.flatnonzero((kind == 0) & ~glued & (end - begin == 1) & (cp[begin] == _APOSTROPHE) & (after == LETTER))
    if len(alone):
        a = cp[end[alone]]
        b = np.where(end[alone + 1] - begin[alone + 1] > 1, cp[np.minimum(end[alone] + 1, len(cp) - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(alone), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        taken = np.where(one, 1, np.where(two, 2, 0))
        stop[alone, 0] += taken
        first[alone + 1, 0] += taken
    first, stop = first.ravel(), stop.ravel()
    real = (stop > first) & (np.repeat(kind, 2) != BREAK)
    return first[real], stop[real]


class _Grown:
    """An array that doubles."""

    def __init__(self, dtype):
        self.n, self._all = 0, np.empty(1 << 16, dtype)

    def add(self, more) -> None:
        while self.n + len(more) > len(self._all):
            self._all = np.concatenate((self._all, np.empty_like(self._all)))
        self._all[self.n : self.n + len(more)] = more
        self.n += len(more)

    def values(self) -> np.ndarray:
        return self._all[: self.n]


class _Slots:
    """Open-addressing table from 64-bit names to small numbers; a batch is probed or filled at once."""

    BITS = 20  # twice the entries of a full cache

    def __init__(self):
        self.key, self.value, self.n = np.zeros(1 << self.BITS, U64), np.zeros(1 << self.BITS, np.int32), 0

    def _home(self, names: np.ndarray) -> np.ndarray:
        return (names >> U64(64 - self.BITS)).astype(np.int64)

    def find(self, names: np.ndarray) -> np.ndarray:
        out, at, open_ = np.full(len(names), -1, np.int64), self._home(names), np.arange(len(names))
        while len(open_):
            key = self.key[at]
            hit = key == names[open_]
            out[open_[hit]] = self.value[at[hit]]
            more = ~hit & (key != 0)
            open_, at = open_[more], (at[more] + 1) & ((1 << self.BITS) - 1)
        return out

    def add(self, names: np.ndarray, values: np.ndarray) -> None:
        """names: distinct, none of them present, none 0."""
        at, self.n = self._home(names), self.n + len(names)
        while len(names):
            free = self.key[at] == 0
            self.key[at[free]] = names[free]
            placed = self.key[at] == names
            self.value[at[placed]] = values[placed]
            names, values, at = names[~placed], values[~placed], (at[~placed] + 1) & ((1 << self.BITS) - 1)


class ByteBPE:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.token[rank] = piece
        self.sizes = np.fromiter(map(len, self.token), np.int64, len(self.token))
        words, ids = [], []
        for piece, rank in ranks.items():
            try:
                words.append(piece.decode("utf-8"))
                ids.append(rank)
            except UnicodeDecodeError:  # not a whole text, so never a whole pre-token
                pass
        codes = Codes(words)
        names = codes.names(codes.starts, codes.ends)
        self.hash = PerfectHash(names)
        slot = self.hash.index(names)
        self.slot_name, order = np.zeros(len(names), U64), np.argsort(slot)
        self.slot_name[slot] = names
        self._words = codes.cp[ranges(codes.starts[order], codes.lens[order])], codes.lens[order], np.array(ids, np.int32)[order]
        self._forget()

    def _forget(self) -> None:
        """Entries are whole words of the vocabulary, in the order of their slots; then pre-tokens met."""
        cp, size, ids = self._words
        self.known = _Slots()
        self.cp, self.cp_at, self.pool, self.pool_at = _Grown(np.uint32), _Grown(np.int64), _Grown(np.int32), _Grown(np.int64)
        self.cp.add(cp)
        self.cp_at.add(np.concatenate(([0], np.cumsum(size))))
        self.pool.add(ids)
        self.pool_at.add(np.arange(len(ids) + 1))

    def _enter(self, codes: Codes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of new entries for these spans."""
        ids, stops, n = [], [], self.pool.n
        for i, j in zip(start.tolist(), end.tolist()):
            ids += self.merge(codes.text[i:j].encode("utf-8", "surrogatepass"))
            stops.append(n + len(ids))
        number = self.pool_at.n - 1 + np.arange(len(start))
        self.pool.add(ids)
        self.pool_at.add(stops)
        self.cp_at.add(self.cp.n + np.cumsum(end - start))
        self.cp.add(codes.cp[ranges(start, end - start)])
        return number

    def _differ(self, codes: Codes, start: np.ndarray, end: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """The spans that are not, code point by code point, the entries found for them."""
        at, size = self.cp_at.values(), end - start
        bad = at[entry + 1] - at[entry] != size
        same = np.flatnonzero(~bad)
        n = size[same]
        unlike = np.flatnonzero(codes.cp[ranges(start[same], n)] != self.cp.values()[ranges(at[entry[same]], n)])
        bad[same[np.searchsorted(np.cumsum(n), unlike, "right")]] = True
        return np.flatnonzero(bad)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank is merged first, the leftmost of equal ones.

        A heap entry packs the rank, the start and the end of a pair.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, rank_of = len(piece), self.ranks.get
        after, before = list(range(1, n + 2)), list(range(-1, n))  # each part's next and previous start
        heap = [rank << 64 | i << 32 | i + 2 for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i, stop = top >> 32 & 0xFFFFFFFF, top & 0xFFFFFFFF
            j = after[i]
            if not i < j < stop or after[j] != stop:  # one of the two parts has changed since
                continue
            after[i], after[j] = stop, 0
            if stop < n:
                before[stop] = i
                rank = rank_of(piece[i : after[stop]])
                if rank is not None:
                    push(heap, rank << 64 | i << 32 | after[stop])
            if i:
                h = before[i]
                rank = rank_of(piece[h:stop])
                if rank is not None:
                    push(heap, rank << 64 | h << 32 | stop)
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(rank_of(piece[i:j]))
            i = j
        return out

    def encode_spans(self, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, n ids) of each pre-token and the ids of all, in order."""
        start, end = pretokens(codes)
        names = codes.names(start, end)
        entry = self.hash.index(names)
        missed = np.flatnonzero((entry < 0) | (self.slot_name[entry] != names)) if len(self.slot_name) else np.arange(len(names))
        if len(missed):
            one, where, back = np.unique(names[missed], return_index=True, return_inverse=True)
            one |= U64(one == 0)
            at = self.known.find(one)
            new = np.flatnonzero(at < 0)
            if self.known.n and self.known.n + len(new) > CACHE_PRETOKENS or self.pool_at.n > 2 * CACHE_PRETOKENS or self.cp.n > CACHE_CHARS:
                self._forget()
                at, new = np.full(len(one), -1, np.int64), np.arange(len(one))
            spans = missed[where[new]]
            at[new] = self._enter(codes, start[spans], end[spans])
            if len(one) <= CACHE_PRETOKENS:
                self.known.add(one[new], at[new])
            entry[missed] = at[back]
        bad = self._differ(codes, start, end, entry)
        if len(bad):
            entry[bad] = self._enter(codes, start[bad], end[bad])
        at = self.pool_at.values()
        count = at[entry + 1] - at[entry]
        return start, end, count, self.pool.values()[ranges(at[entry], count)]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n ids of each text, all ids)."""
        codes = Codes(texts)
        start, _, count, ids = self.encode_spans(codes)
        before = np.concatenate(([0], np.cumsum(count)))
        first = np.append(np.searchsorted(start, codes.starts), len(start))
        return np.diff(before[first]), ids

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[1].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(2)
def load(path: str) -> ByteBPE:
    return ByteBPE(read_ranks(path))


def _kept(df: DataFrame, drop: tuple[str, ...]) -> list[T.StructField]:
    return [f for f in df.schema if f.name not in drop]


def encode(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """df with `ids` (array of int) and `n_tokens` of its text column, which is dropped.

    `path` is the rank file; every executor reads its own copy, as it is part
    of the installed vocabulary package and not of the data.
    """
    kept = _kept(df, (column, "ids", "n_tokens"))
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    names = [f.name for f in kept]

    def make():
        bpe = load(path)

        def step(batch):
            texts = clean(batch.column(column).to_pylist())
            for a, b in chunks(map(len, texts)):
                n, ids = bpe.encode_batch(texts[a:b])
                at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(n), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], names=[*names, "n_tokens", "ids"])

        return step

    return arrow_pass(df.select(*names, column), make, schema)


def decode(df: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """df with `decoded` (binary), the bytes of its id column, which stays.  Null ids decode to no bytes."""
    kept = _kept(df, ("decoded",))
    schema = T.StructType([*kept, T.StructField("decoded", T.BinaryType())])
    names = [f.name for f in kept]

    def make():
        bpe = load(path)

        def step(batch):
            flat = batch.column(column)
            at, ids = flat.offsets.to_pylist(), flat.values.to_pylist()
            size = np.fromiter((len(x or b"") for x in bpe.token), np.int64, len(bpe.token))
            cum = np.concatenate(([0], np.cumsum(size[np.asarray(ids, np.int64)]))) if ids else np.zeros(1, np.int64)
            for a, b in chunks([int(cum[y] - cum[x]) for x, y in zip(at, at[1:])], 4_000_000):
                part = batch.slice(a, b - a)
                texts = [bpe.decode(ids[at[i] : at[i + 1]]) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(texts, pa.binary())], names=[*names, "decoded"])

        return step

    return arrow_pass(df.select(*names), make, schema)


def round_trip(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """df with `n_tokens`, `ids` and `decoded` (binary) in place of its text column: encode() then decode() in one pass."""
    kept = _kept(df, (column, "ids", "n_tokens", "decoded"))
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    names = [f.name for f in kept]

    def make():
        bpe = load(path)

        def step(batch):
            texts = clean(batch.column(column).to_pylist())
            for a, b in chunks(map(len, texts)):
                n, ids = bpe.encode_batch(texts[a:b])
                at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                flat = ids.tolist()
                back = [bpe.decode(flat[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                part = batch.slice(a, b - a)
                arrays = [*(part.column(x) for x in names), pa.array(n), pa.ListArray.from_arrays(pa.array(at), pa.array(ids)), pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_tokens", "ids", "decoded"])

        return step

    return arrow_pass(df.select(*names, column), make, schema)


def digests(df: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every text of df, encoded and decoded."""
    coded = round_trip(df.select(key, "text"), path)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(key, "n_tokens", F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
