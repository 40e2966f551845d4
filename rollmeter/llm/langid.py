"""Language identification by a linear-chain conditional random field.

States are languages.  A word's emission adds the weights of its affixes, of
its character n-grams (hashed) and of its entry in a lexicon of training
words; transitions are learned from training sequences of which some switch
between documents of two languages.  Forward-backward gives each word's
posterior, so code-switched text is labelled word by word; a text's language
is the one of the highest mean posterior.

Defined results: null text, empty text and text without a letter get `und`
and score 0; equal mean posteriors go to the first language in sorted order;
repeated rows get equal results; without any labelled text all is `und`; an
empty table gives an empty one.  Any number of languages is learned: time and
memory grow with the square of it, for which texts are taken in smaller
batches and longer windows.  Texts are never cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_pass
from .textcore import CHUNK_CHARS, U64, Codes, NameSet, Words, chunks, clean, mix, ranges, seeds

ROWS_PER_LANGUAGE = 240  # bound of the training sample, about, by a hash of the id
SAMPLE_CHARS = 3_000_000  # bound of its characters, shared by the languages
TRAIN_WORDS = 240_000
BUCKETS = 1 << 17  # of hashed features; halved while languages times buckets pass WEIGHTS
WEIGHTS = 1 << 23
TABLES = 1 << 24  # entries of the transfer matrices of a batch, about
LEXICON = 60_000
SEQUENCE, BATCH, EPOCHS, SWITCHED = 24, 512, 8, 0.3
WINDOW = 32
UNKNOWN = "und"
_NO_LEXICON = -1


def buckets(k: int) -> int:
    """The hash buckets of a model of k languages."""
    n = BUCKETS
    while n > 1024 and n * k > WEIGHTS:
        n //= 2
    return n


def batch_chars(k: int) -> int:
    """Characters of a batch for k languages: fewer for many, as each word has a row of them."""
    return max(2000, min(CHUNK_CHARS, CHUNK_CHARS * 32 // k))


def features(codes: Codes, start: np.ndarray, end: np.ndarray, n: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(hash buckets of all words' affixes and n-grams, each word's number of them)."""
    size = end - start
    spans, salt = [], seeds(16, 21)
    who = np.arange(len(start))
    for k in (1, 2, 3, 4):
        at = who[size >= k]
        spans.append((at, start[at], k, salt[k]))
        spans.append((at, end[at] - k, k, salt[k + 4]))
    for k in (2, 3):
        count = np.maximum(size - k + 1, 0)
        spans.append((np.repeat(who, count), ranges(start, count), k, salt[k + 8]))
    word = np.concatenate([x[0] for x in spans])
    bucket = np.concatenate([(mix(codes.names(s, s + k) ^ z) & U64(n - 1)).astype(np.int32) for _, s, k, z in spans])
    order = np.argsort(word, kind="stable")
    return bucket[order], np.bincount(word, minlength=len(start))


def posteriors(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Forward-backward over texts of any lengths.

    emission: (words, K) potentials; first: index of each text's first word,
    one more at the end.  Each text is cut into windows whose transfer matrices
    are multiplied side by side, then chained, so a long text costs few steps.
    """
    n, k = emission.shape
    if not n:
        return emission
    window = max(WINDOW, n * k * k // TABLES)
    count = np.diff(first)
    wins = -(-count // window)
    at_win = np.concatenate(([0], np.cumsum(wins)))
    nw = int(at_win[-1])
    owner = np.repeat(np.arange(len(count)), wins)
    begin = first[owner] + (np.arange(nw) - at_win[owner]) * window
    size = np.minimum(first[owner + 1] - begin, window)
    order = np.argsort(-size, kind="stable")  # full windows first, so a step touches a prefix
    begin, size = begin[order], size[order]
    place = np.empty(nw, np.int64)
    place[order] = np.arange(nw)
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(window)]  # windows with a word at step t
    moved = np.broadcast_to(np.eye(k), (nw, k, k)).copy()
    head = np.zeros(nw, bool)
    head[place[at_win[:-1][count > 0]]] = True
    for t in range(int(size[0])):
        m = live[t]
        e = emission[begin[:m] + t]
        step = (moved[:m].reshape(-1, k) @ trans).reshape(m, k, k)
        if t == 0:
            step[head[:m]] = np.eye(k)  # a text's first word has the prior before it, not a transition
        moved[:m] = step * e[:, None, :]
    moved /= moved.max((1, 2), keepdims=True)
    enter, leave = np.ones((nw, k)), np.ones((nw, k))
    by_len = np.argsort(-wins, kind="stable")
    by_len = by_len[wins[by_len] > 0]
    longest = int(wins.max())
    heads = at_win[by_len]
    state = np.tile(prior / prior.sum(), (len(by_len), 1))
    alive = [int(np.searchsorted(-wins[by_len], -j, "left")) for j in range(longest)]
    for j in range(longest):
        w = place[heads[: alive[j]] + j]
        enter[w] = state[: alive[j]]
        new = np.einsum("ni,nij->nj", state[: alive[j]], moved[w])
        state[: alive[j]] = new / new.sum(1, keepdims=True)
    back = np.ones((len(by_len), k))
    for j in range(longest - 1, -1, -1):
        w = place[heads[: alive[j]] + j]
        leave[w] = back[: alive[j]]
        new = np.einsum("nij,nj->ni", moved[w], back[: alive[j]])
        back[: alive[j]] = new / new.sum(1, keepdims=True)
    out = np.empty((n, k))
    a = enter
    for t in range(int(size[0])):
        m = live[t]
        step = a[:m] @ trans
        if t == 0:
            step[head[:m]] = a[:m][head[:m]]
        step *= emission[begin[:m] + t]
        a[:m] = step / step.sum(1, keepdims=True)
        out[begin[:m] + t] = a[:m]
    b = leave
    for t in range(int(size[0]) - 1, -1, -1):
        m = live[t]
        w = begin[:m] + t
        out[w] *= b[:m]
        step = (emission[w] * b[:m]) @ trans.T
        b[:m] = step / step.sum(1, keepdims=True)
    return out / out.sum(1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    hashed: np.ndarray  # (BUCKETS, K)
    lexicon: NameSet
    words: np.ndarray  # (lexicon, K)
    trans: np.ndarray  # potentials
    prior: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """Potentials of every word; computed once for each different word."""
        names, where, back = np.unique(words.name, return_index=True, return_inverse=True)
        bucket, count = features(words.codes, words.start[where], words.end[where], len(self.hashed))
        z = np.add.reduceat(self.hashed[bucket], np.cumsum(count) - count, axis=0) if len(names) else np.zeros((0, len(self.languages)))
        at, entry = self.lexicon.find(names)
        z[at] += self.words[entry]
        z = np.maximum(z - z.max(1, keepdims=True), -8.0)
        return np.exp(z, dtype=np.float64)[back]

    def label(self, texts: list[str]) -> tuple[Words, np.ndarray]:
        words = Words(texts, letters_only=True)
        return words, posteriors(self.emissions(words), words.first, self.trans, self.prior)

    def classify(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        words, post = self.label(texts)
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        some = np.flatnonzero(words.counts)
        if len(some):
            mean = np.add.reduceat(post, words.first[:-1][some], axis=0) / words.counts[some, None]
            best[some] = np.round(mean, 12).argmax(1)
            score[some] = np.minimum(mean.max(1), 1.0)
        return [self.languages[i] if i >= 0 else UNKNOWN for i in best], score


def sequences(texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> tuple[Words, np.ndarray, np.ndarray]:
    """Training sequences (word numbers, states), SWITCHED of them from two texts."""
    words = Words(texts, letters_only=True)
    starts, of = [], []
    for d in range(len(texts)):
        a, b = words.first[d], words.first[d + 1]
        k = (b - a) // SEQUENCE
        starts.append(a + SEQUENCE * np.arange(k))
        if b - a - k * SEQUENCE >= 6 and b >= SEQUENCE:  # the rest, reaching back into whatever stands before
            starts.append(np.array([b - SEQUENCE]))
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    starts = starts[rng.permutation(len(starts))][: TRAIN_WORDS // SEQUENCE]
    seq = starts[:, None] + np.arange(SEQUENCE)
    other = seq[rng.permutation(len(seq))]
    cut = np.where(rng.random(len(seq)) < SWITCHED, rng.integers(1, SEQUENCE, len(seq)), SEQUENCE)
    seq = np.where(np.arange(SEQUENCE) < cut[:, None], seq, other)
    return words, seq, labels[words.doc[seq]]


def fit(texts: list[str], labels: list[str], rounds: int = EPOCHS) -> Model | None:
    """Maximum conditional likelihood by AdaGrad on mini-batches; deterministic."""
    languages = sorted(set(labels))
    if not languages:
        return None
    k, rng = len(languages), np.random.default_rng(7)
    words, seq, gold = sequences(texts, np.searchsorted(languages, labels), rng)
    names, where, back = np.unique(words.name, return_index=True, return_inverse=True)
    frequent = np.sort(np.argsort(-np.bincount(back, minlength=len(names)), kind="stable")[:LEXICON])
    lexicon = NameSet(names[frequent])
    size = buckets(k)
    bucket, count = features(words.codes, words.start[where], words.end[where], size)
    at = np.cumsum(count) - count
    entry = np.full(len(names), _NO_LEXICON)
    hit, found = lexicon.find(names)
    entry[hit] = found
    w = {"hashed": np.zeros((size, k)), "words": np.zeros((len(lexicon.names), k)), "trans": np.eye(k) * 2.0, "prior": np.zeros(k)}
    g2 = {x: np.full(v.shape, 1e-3) for x, v in w.items()}
    for _ in range(rounds):
        mixed = rng.permutation(len(seq))
        for a in range(0, len(seq), BATCH):
            rows = mixed[a : a + BATCH]
            s, y = seq[rows], gold[rows]
            used, inv = np.unique(back[s.ravel()], return_inverse=True)
            flat = bucket[ranges(at[used], count[used])]
            own = np.repeat(np.arange(len(used)), count[used])
            z = np.add.reduceat(w["hashed"][flat], np.cumsum(count[used]) - count[used], axis=0)
            lex = entry[used]
            z[lex >= 0] += w["words"][lex[lex >= 0]]
            e = np.exp(np.maximum(z - z.max(1, keepdims=True), -8.0))[inv].reshape(*s.shape, k)
            trans, prior = np.exp(w["trans"]), np.exp(w["prior"])
            alpha, beta = np.empty_like(e), np.ones_like(e)
            v = prior * e[:, 0]
            alpha[:, 0] = v / v.sum(1, keepdims=True)
            for t in range(1, SEQUENCE):
                v = (alpha[:, t - 1] @ trans) * e[:, t]
                alpha[:, t] = v / v.sum(1, keepdims=True)
            for t in range(SEQUENCE - 2, -1, -1):
                v = (e[:, t + 1] * beta[:, t + 1]) @ trans.T
                beta[:, t] = v / v.sum(1, keepdims=True)
            post = alpha * beta
            post /= post.sum(2, keepdims=True)
            error = np.eye(k)[y] - post
            pair = alpha[:, :-1, :, None] * trans * (e * beta)[:, 1:, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            true = np.zeros((k, k))
            np.add.at(true, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
            flat_error = error.reshape(-1, k)
            per_word = np.stack([np.bincount(inv, flat_error[:, j], len(used)) for j in range(k)], 1)
            step = {
                "hashed": np.stack([np.bincount(flat, per_word[own, j], size) for j in range(k)], 1),
                "words": np.zeros_like(w["words"]),
                "trans": true - pair.sum((0, 1)),
                "prior": error[:, 0].sum(0),
            }
            np.add.at(step["words"], lex[lex >= 0], per_word[lex >= 0])
            for x, g in step.items():
                g = g / len(rows) - 1e-5 * w[x]
                g2[x] += g * g
                w[x] += 0.25 * g / np.sqrt(g2[x])
    trans = np.exp(w["trans"])
    return Model(languages, w["hashed"].astype(np.float32), lexicon, w["words"].astype(np.float32), trans / trans.max(), np.exp(w["prior"]))


def sample(docs: DataFrame, learn, label: str = "lang") -> tuple[list[str], list[str]]:
    """The bounded training sample: about ROWS_PER_LANGUAGE texts of each language, by a hash of their content and id."""
    labelled = docs.where(learn & F.col("text").isNotNull() & F.col(label).isNotNull())
    counts = sorted(labelled.groupBy(label).count().collect())  # a row a language
    if not counts:
        return [], []
    dice = F.pmod(F.xxhash64(F.lit(11), "doc_id", label), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(ROWS_PER_LANGUAGE / n))])
    rows = labelled.select("text", F.col(label).alias("_label"), dice.alias("_dice"), share[F.col(label)].alias("_share")).where("_dice < _share")
    limit = SAMPLE_CHARS // len(counts)
    order = Window.partitionBy("_label").orderBy(F.length("text") > limit, "_dice", "text")  # of the sample alone; over-long texts last
    sums = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_sum", sums).withColumn("_n", F.row_number().over(order))
    got = rows.where((F.col("_sum") <= limit) | (F.col("_n") == 1)).select("text", "_label", "_dice").collect()
    got.sort(key=lambda r: (r._dice, r._label, r.text))
    return [r.text for r in got], [r._label for r in got]


def train(docs: DataFrame, learn) -> Model | None:
    return fit(*sample(docs.select("doc_id", "text", "lang"), learn))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    kept = [f for f in docs.schema if f.name not in ("lang_pred", "score")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if model is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size set by the constants above

    def make():
        own = shared.value

        def step(batch):
            texts = clean(batch.column("text").to_pylist())
            for a, b in chunks(map(len, texts), batch_chars(len(own.languages))):
                best, score = own.classify(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

        return step

    return arrow_pass(docs.select(*names), make, schema)


def word_labels(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and, for each word, its place in code points, its language and that language's posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("posterior", pa.float64())]))

    def make():
        own = shared.value

        def step(batch):
            texts, ids = clean(batch.column("text").to_pylist()), batch.column("doc_id")
            for a, b in chunks(map(len, texts), batch_chars(len(own.languages))):
                words, post = own.label(texts[a:b])
                base, best = words.codes.starts[words.doc], post.argmax(1) if len(post) else np.zeros(0, int)
                rows = list(zip((words.start - base).tolist(), (words.end - base).tolist(), (own.languages[i] for i in best), post.max(1).tolist() if len(post) else []))
                out = [[dict(zip(("start", "end", "lang", "posterior"), r)) for r in rows[x:y]] for x, y in zip(words.first[:-1], words.first[1:])]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(out, kind)], names=["doc_id", "words"])

        return step

    return arrow_pass(docs.select("doc_id", "text"), make, "doc_id long, words array<struct<start:long,end:long,lang:string,posterior:double>>")
