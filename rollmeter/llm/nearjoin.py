"""N-gram Jaccard self-join by a MinHash LSH forest.

Texts are sets of five-word shingles.  Equal sets form a copy class, and only
classes go on.  A forest has TREES prefix tries over signatures of DEPTH
MinHash values.  Classes that share the shortest prefix any of them needs meet
in one place, and are sorted there by the rest of their signatures, so that
every longer prefix is a run of neighbours.  Matching starts from whole
prefixes, which are shortened value by value: a class takes part down to the
length at which the least similarity that a link of a set of its size can have
is met with the target recall, and no further once it is represented by an
almost equal class.  Classes that meet are grouped around leaders by their
signatures, which gives few edges for many near copies; the components of
these edges hold every possible link.  A large node is cut into parts, and
every two parts meet in a task of their own.  Within a component all pairs are
verified on the shingle sets themselves, in blocks of bounded size, so a large
group is spread over many tasks and its pairs are counted, never written out.

Defined results: null and empty texts, and texts without a word, are copies of
one another and linked to nothing else; a text of one to four words is one
shingle; repeated rows are copies; ties cannot occur, as a pair at exactly the
threshold is a link; a null doc_id sorts first, so it names its classes; an
empty table gives an empty one.  Columns of documents other than doc_id and
text are not used.  Texts are never cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_pass, bounded_batches, hot_join, partitions, small, written
from .graph import components
from .textcore import U64, Words, chunks, clean, distinct, mix, seeds, shingles, signed

THRESHOLD, RECALL = 0.8, 0.9999
TREES, DEPTH = 20, 6
NODE_CLASSES = 2048  # of a part of a trie node; every two parts of a larger node meet in a task
SMALL_NODE = 64  # classes that are compared at the shortest prefix at once
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 300_000
SAME_LEADER, NEAR_LEADER = 0.9, 0.45  # estimated likeness to a leader: of its group; connected to it
SALTS = 8  # into which the classes of a node are dealt while they are joined
SAME_CLASS = 0.97  # estimated likeness to a leader that represents a class at shorter prefixes


def depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, longest: int = DEPTH) -> int:
    """The prefix length: shortened from the longest until a pair at the threshold shares one with the recall."""
    d = longest
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


@lru_cache(4096)
def least_link(n: int, threshold: float = THRESHOLD) -> float | None:
    """The least similarity at the threshold or above that a set of n names can have with a different set; None without any."""
    found = None
    for m in range(max(1, int(threshold * n)), int(n / threshold) + 2):
        c = min(n, m, max(0, int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))))
        s = c / (n + m - c)
        if s >= threshold - 1e-9 and not n == m == c:
            found = min(s, found or 1.0)
    return found


def needed(sizes: np.ndarray, threshold: float, recall: float) -> np.ndarray:
    """For sets of these sizes, the shortest prefix a link has to be looked for with; 0 where there can be no link."""
    every = depth(threshold, recall)
    out = np.full(len(sizes), every)
    for n in np.unique(sizes[sizes < 128]).tolist():
        s = least_link(n, threshold)
        out[sizes == n] = depth(s, recall) if s else 0
    return out


@dataclass
class Sets:
    """Shingle sets of some texts: names in ascending order, each text's first index, keys of the sets."""

    names: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Sets:
        name, doc, _ = shingles(Words(texts))
        return cls(*distinct(name, doc, len(texts)))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def keys(self) -> list[bytes]:
        """128-bit names of the sets."""
        out = np.empty((len(self.first) - 1, 2), ">u8")
        for k, salt in enumerate(seeds(2, 41)):
            total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(self.names ^ salt))))
            out[:, k] = mix(total[self.first[1:]] - total[self.first[:-1]] + self.sizes.astype(U64) * salt)
        return [row.tobytes() for row in out]

    def minima(self, n: int) -> np.ndarray:
        """(texts, n) MinHash values; of an empty set all ones."""
        some = self.sizes > 0
        out = np.full((len(some), n), ~U64(0))
        at = self.first[:-1][some]
        for j, factor in enumerate(seeds(n, 51)):
            if len(at):
                out[some, j] = np.minimum.reduceat(self.names * factor, at)
        return out


def _signed_rows(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """doc_id, key, n, nodes (a 64-bit name of each tree's shortest prefix), sig (a byte of each MinHash value)."""
    d = depth(threshold, recall)

    def make():
        factor = seeds(d, 61)

        def step(batch):
            texts, ids = clean(batch.column("text").to_pylist()), batch.column("doc_id")
            for a, b in chunks(map(len, texts), 600_000):
                sets = Sets.of(texts[a:b])
                low = sets.minima(TREES * DEPTH).reshape(-1, TREES, DEPTH)
                nodes = mix((low[:, :, :d] * factor).sum(2, dtype=U64) + np.arange(TREES, dtype=U64) * U64(0x9E3779B97F4A7C15))
                sig = (mix(low.reshape(len(low), -1)) & U64(255)).astype(np.uint8)
                some = needed(sets.sizes, threshold, recall) > 0
                at = pa.array(np.concatenate(([0], np.cumsum(np.where(some, TREES, 0)))).astype(np.int32))
                lists = pa.ListArray.from_arrays(at, pa.array(signed(nodes[some].ravel())))
                arrays = [ids.slice(a, b - a), pa.array(sets.keys(), pa.binary()), pa.array(sets.sizes), lists, pa.array([x.tobytes() for x in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "n", "nodes", "sig"])

        return step

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, key binary, n long, nodes array<long>, sig binary")


def likeness(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from signature bytes, of which 1 in 256 agree by chance."""
    return ((sig == one).mean(1) - 1 / 256) * (256 / 255)


def leaders(sig: np.ndarray, same: float = SAME_LEADER) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leader, those near it that no earlier leader has joined to it, its group) until each is in the group of a leader.

    The distance is a metric: of two sets at the threshold one is in a
    leader's group (0.1) and so the other is within 0.3 of that leader.  Only
    joins that are new are told, so there are fewer of them than sets.
    """
    left, group, out = np.arange(len(sig)), np.arange(len(sig)), []
    while len(left):
        one = int(left[0])
        like = likeness(sig[left], sig[one])
        near = left[1:][like[1:] >= NEAR_LEADER]
        _, at = np.unique(group[near], return_index=True)
        new = near[at][group[near[at]] != group[one]]
        if len(new):
            group[np.isin(group, group[new])] = group[one]
        out.append((one, new, left[1:][like[1:] >= same]))
        left = left[1:][like[1:] < same]
    return out


def matched(sig: np.ndarray, tree: int, need: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Edges (leader, class) of the classes of one trie node, all below one shortest prefix.

    Prefixes longer than the shortest are runs of classes in the order of the
    signature bytes behind it; bytes that agree by chance only lengthen a run.
    A class within 0.03 of a leader is represented by it at shorter prefixes:
    representatives of two sets at the threshold are within 0.32, and a leader
    of one of them within 0.42 of the other.
    """
    if len(sig) <= SMALL_NODE:
        return [(i, j) for i, new, _ in leaders(sig) for j in new.tolist()]
    rest = sig[:, tree * DEPTH + shortest : (tree + 1) * DEPTH]
    live, out = np.lexsort(rest.T[::-1]), []
    for length in range(DEPTH, shortest, -1):
        here = live[need[live] <= length]
        prefix = rest[here, : length - shortest]
        edge = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]).any(1), [True])))
        gone = []
        for a, b in zip(edge, edge[1:]):
            if b - a > 1:
                run = here[a:b]
                for i, new, group in leaders(sig[run], SAME_CLASS):
                    out += [(int(run[i]), int(run[j])) for j in new]
                    gone.append(run[group])
        live = here[~np.isin(here, np.concatenate(gone))] if gone else here
    live = live[need[live] <= shortest]
    return out + [(int(live[i]), int(live[j])) for i, new, _ in leaders(sig[live]) for j in new]


def grouped(batches, by: list[str]):
    """The rows of each run of equal `by` values in a sorted stream, as lists of columns."""
    held, key = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        keys = list(zip(*(cols[c] for c in by)))
        a = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[a]:
                part = {c: v[a:i] for c, v in cols.items()}
                if held is not None and keys[a] == key:
                    for c in held:
                        held[c] += part[c]
                else:
                    if held is not None:
                        yield key, held
                    held, key = part, keys[a]
                a = i
    if held is not None:
        yield key, held


def _candidates(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Edges whose components hold every pair of classes that share a trie node and may be a link."""
    shortest = depth(threshold, recall)
    at = classes.select("key", F.posexplode("nodes").alias("tree", "node")).withColumn("salt", F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(SALTS)))
    shared = at.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rows = at.join(shared, ["node", "salt"]).join(classes.select("key", "n", "sig"), "key")
    parts = F.ceil(F.col("m") / NODE_CLASSES)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.select("node", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "tree", "key", "n", "sig")
    by = ["node", "i", "j"]
    bounded_batches(rows.sparkSession)

    def run(batches):
        a, b = [], []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for _, g in grouped(batches, by):
            sig = np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(len(g["sig"]), -1)
            for x, y in matched(sig, g["tree"][0], needed(np.array(g["n"]), threshold, recall), shortest):
                a.append(g["key"][y])
                b.append(g["key"][x])
            if len(a) > 10_000:
                yield batch()
                a.clear()
                b.clear()
        yield batch()

    dealt = rows.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by, "key")
    return dealt.mapInArrow(run, "a binary, b binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of sets of names, each of `left` with each of `right` (None: of left)."""
    every = left + (right or [])
    names, owner = np.concatenate(every), np.repeat(np.arange(len(every)), [len(x) for x in every])
    names, number, count = np.unique(names, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    keep = count[number] > 1
    width = -(-max(1, int((count > 1).sum())) // 64)
    bits = np.zeros((len(every), width), U64)
    spot = place[number[keep]]
    np.bitwise_or.at(bits, (owner[keep], spot // 64), U64(1) << (spot % 64).astype(U64))
    b = bits[len(left) :] if right else bits
    return np.stack([np.bitwise_count(row & b).sum(1) for row in bits[: len(left)]])


def linked(sizes_a: np.ndarray, sizes_b: np.ndarray, common: np.ndarray, threshold: float) -> np.ndarray:
    return common >= threshold * (sizes_a[:, None] + sizes_b[None, :] - common) - 1e-9


def _verified(members: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, texts, rows): b null: class a has so many links, to classes of so many rows, in a block; else an edge of a block's links."""
    size = written(members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("s")))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("s") / BLOCK_SHINGLES))
    parts = F.when(F.col("m") <= 2, F.lit(1)).otherwise(parts)
    own = hot_join(members, size, "component", "m").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "key"), F.col("parts")))
    own = small(written(own.select("key", "rep", "component", "parts", "part", "copies")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(own, F.col("doc_id").eqNullSafe(F.col("rep")))
    blocks = texts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = blocks.select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "key", "copies", "text")
    by = ["component", "i", "j"]
    bounded_batches(docs.sparkSession)

    def run(batches):
        names = ["a", "b", "texts", "rows"]

        def with_sets():
            for batch in batches:
                texts = clean(batch.column("text").to_pylist())
                for a, b in chunks(map(len, texts), 600_000):
                    sets = Sets.of(texts[a:b])
                    same = [x == y for x, y in zip(sets.keys(), batch.column("key").slice(a, b - a).to_pylist())]
                    part = batch.slice(a, b - a)
                    lists = pa.ListArray.from_arrays(pa.array(sets.first.astype(np.int32)), pa.array(signed(sets.names)))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*by, "part", "key", "copies")), lists], names=[*by, "part", "key", "copies", "set"]).filter(pa.array(same))

        for (_, i, j), g in grouped(_sliced(with_sets()), by):
            one = {}
            for part, key, copies, names_ in zip(g["part"], g["key"], g["copies"], g["set"]):
                one[part, key] = copies, np.array(names_, np.int64).view(U64)  # rows of one id and text come twice
            rows = sorted(one)
            left = [r for r in rows if r[0] == i]
            right = [r for r in rows if r[0] == j] if i != j else None
            if not left or right == []:
                continue
            sets_l, sets_r = [one[r][1] for r in left], [one[r][1] for r in right] if right else None
            n_l = np.array([len(x) for x in sets_l])
            n_r = np.array([len(x) for x in sets_r]) if right else n_l
            link = linked(n_l, n_r, overlaps(sets_l, sets_r).astype(np.int64), threshold)
            if not right:
                np.fill_diagonal(link, False)
            w_l = np.array([one[r][0] for r in left])
            w_r = np.array([one[r][0] for r in right]) if right else w_l
            out = [(r[1], None, int(t), int(c)) for r, t, c in zip(left, link.sum(1), link @ w_r) if t]
            if right:
                out += [(r[1], None, int(t), int(c)) for r, t, c in zip(right, link.sum(0), w_l @ link) if t]
            out += [(left[x][1], (right or left)[y][1], None, None) for x, y in _spanning(link, bool(right))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=names)

    dealt = blocks.repartition(partitions(docs.sparkSession), *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, "a binary, b binary, texts long, rows long")


def _sliced(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            yield batch.slice(a, 64)


def _spanning(link: np.ndarray, two_sided: bool) -> list[tuple[int, int]]:
    """A forest of the links with the same components."""
    n = link.shape[0]
    root = list(range(n + (link.shape[1] if two_sided else 0)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x in range(n):
        for y in np.flatnonzero(link[x]).tolist():
            a, b = find(x), find(y + n if two_sided else y)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


def near_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of docs: doc_id, key (of its shingle set), copy_id, class_id, n_copies, n_links.

    copy_id: least doc_id of equal shingle sets; class_id: least doc_id of the
    component of links; n_copies: other rows of the same set; n_links: other
    rows at the threshold or above, the copies among them.
    """
    rows = written(_signed_rows(docs, threshold, recall))
    classes = written(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("nodes").alias("nodes"), F.any_value("sig").alias("sig")))
    maybe = components(_candidates(classes, threshold, recall)).select(F.col("node").alias("key"), "component")
    members = written(classes.select("key", "rep", "copies", "n").join(maybe, "key"))
    found = written(_verified(members, docs, threshold))
    links = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("rows").alias("near"))
    group = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("key"), "component")
    named = written(classes.select("key", "rep", "copies").join(group, "key", "left").withColumn("component", F.coalesce("component", "key")))
    least = written(named.groupBy("component").agg(F.min("rep").alias("class_id"), F.count("*").alias("m")))
    named = hot_join(named, least, "component", "m").join(links, "key", "left")
    named = named.select("key", F.col("rep").alias("copy_id"), "class_id", (F.col("copies") - 1).alias("n_copies"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), "copies")
    return hot_join(rows.select("doc_id", "key"), written(named), "key", "copies").select("doc_id", "key", "copy_id", "class_id", "n_copies", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group of linked texts: that of the least doc_id, all columns as they were."""
    joined = written(near_join(docs, threshold))
    gone = joined.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id").distinct()
    repeated = joined.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        gone = small(written(gone))
        return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]), "left_anti")
    # ids that name several rows: each row is judged by its own set, and equal ones are made one
    key = next(c for c in map("_key{}".format, range(len(docs.columns) + 1)) if c not in docs.columns)
    keyed = _keyed(docs, key)
    stay = joined.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("id"), F.col("key").alias("set")).distinct()
    kept = keyed.join(stay, keyed["doc_id"].cast("long").eqNullSafe(stay["id"]) & (keyed[key] == stay["set"]), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).select(*docs.columns)


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with the names of its texts' sets in a column that it has not."""
    schema = T.StructType([*docs.schema, T.StructField(key, T.BinaryType())])

    def make():
        def step(batch):
            texts = clean(batch.column("text").to_pylist())
            for a, b in chunks(map(len, texts), 600_000):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(Sets.of(texts[a:b]).keys(), pa.binary())], names=[*part.schema.names, key])

        return step

    return arrow_pass(docs, make, schema)
