"""Token counts by offset-mapped attribution.

A text is encoded once, as a whole.  Each token has a span of bytes; sections
are intervals of the same text; the tokens' spans are joined to the intervals
by binary search.  A token that crosses a boundary goes, whole, to the section
that holds the larger part of its bytes, and to the earlier one on a tie; so
the counts of a text's sections add up to the tokens of the text.

Defined results: a null or empty text has no sections and no rows; a section
without a token counts 0; so does a null section or one with a null bound,
which is empty at the text's beginning; null sections of a text are none;
repeated rows give equal counts; text outside given sections is counted as
section -1, if it holds tokens; an empty table gives an empty one; columns
other than doc_id, the text and the sections are not used.  Texts are never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBPE, load
from .frames import arrow_pass
from .textcore import Codes, chunks, clean

OUTSIDE = -1


def utf8_widths(cp: np.ndarray) -> np.ndarray:
    return 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)


class Spans:
    """Tokens of some texts with their bytes' places, counted through all texts."""

    def __init__(self, bpe: ByteBPE, texts: list[str]):
        self.codes = Codes(texts)
        start, end, count, self.ids = bpe.encode_spans(self.codes)
        self.byte = np.concatenate(([0], np.cumsum(utf8_widths(self.codes.cp))))  # of each code point, with the breaks between texts
        size = bpe.sizes[self.ids]
        first = np.cumsum(count) - count  # of each pre-token's tokens
        inside = np.cumsum(size) - size
        if len(first):
            inside = inside - np.repeat(inside[first], count)
        self.start = np.repeat(self.byte[start], count) + inside
        self.end = self.start + size

    def owners(self, cuts: np.ndarray) -> np.ndarray:
        """For each token the interval between `cuts` (ascending places in bytes) that holds the larger part of it.

        Interval k is [cuts[k], cuts[k + 1]); every token must start at or after cuts[0].
        """
        k = np.searchsorted(cuts, self.start, "right") - 1
        stop = np.append(cuts, np.iinfo(np.int64).max)
        best, most = k.copy(), np.minimum(self.end, stop[k + 1]) - self.start
        cross = np.flatnonzero(self.end > stop[k + 1])
        while len(cross):
            k[cross] += 1
            part = np.minimum(self.end[cross], stop[k[cross] + 1]) - stop[k[cross]]
            more = part > most[cross]
            best[cross[more]], most[cross[more]] = k[cross[more]], part[more]
            cross = cross[self.end[cross] > stop[k[cross] + 1]]
        return best


def _bounds(section: dict | None) -> tuple[int, int]:
    start, end = (section["start"], section["end"]) if section else (None, None)
    return (0, 0) if start is None or end is None else (start, end)


def _rows(bpe: ByteBPE, texts: list[str], sections: list[list[tuple[int, int]]] | None) -> tuple[list[np.ndarray], ...]:
    """(text, section, start, end, tokens) of every section; without sections, a text's lines with their line ends."""
    spans = Spans(bpe, texts)
    codes = spans.codes
    if sections is None:
        breaks = np.flatnonzero(codes.cp[:-1] == 10) + 1 if len(codes.cp) else np.zeros(0, np.int64)
        starts = np.unique(np.concatenate((codes.starts[codes.lens > 0], breaks)))
        doc = np.searchsorted(codes.starts, starts, "right") - 1
        inside = starts < codes.ends[doc]
        starts, doc = starts[inside], doc[inside]
        stop = np.minimum(np.append(starts[1:], len(codes.cp)), codes.ends[doc])
        number = np.arange(len(doc)) - np.searchsorted(doc, doc)
        tokens = np.bincount(spans.owners(spans.byte[starts]), minlength=len(starts)) if len(spans.ids) else np.zeros(len(starts), np.int64)
        return doc, number, starts - codes.starts[doc], stop - codes.starts[doc], tokens
    edges, who = [], []
    for d, given in enumerate(sections):
        at = 0
        for k, (a, b) in sorted(enumerate(given or []), key=lambda x: x[1]):
            a, b = max(at, min(a, int(codes.lens[d]))), max(at, min(b, int(codes.lens[d])))
            if a > at:
                edges.append((d, at, a))
                who.append(OUTSIDE)
            edges.append((d, a, b))
            who.append(k)
            at = b
        if at < codes.lens[d]:
            edges.append((d, at, int(codes.lens[d])))
            who.append(OUTSIDE)
    if not edges:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    d, a, b = (np.array(x, np.int64) for x in zip(*edges))
    filled = np.flatnonzero(b > a)
    tokens = np.zeros(len(d), np.int64)
    if len(spans.ids):
        own = spans.owners(spans.byte[codes.starts[d[filled]] + a[filled]])
        tokens[filled] = np.bincount(own, minlength=len(filled))
    number = np.array(who)
    keep = (number != OUTSIDE) | (tokens > 0)
    return d[keep], number[keep], a[keep], b[keep], tokens[keep]


def attribute(docs: DataFrame, path: str, sections: str | None = None) -> DataFrame:
    """(doc_id, section, start, end, n_tokens) for every section of every text.

    sections: a column of array<struct<start:long,end:long>> of intervals of
    code points (cut to the text; where they overlap, the earlier start keeps
    the overlap); without it the sections are the text's lines.
    """
    names = ["doc_id", "section", "start", "end", "n_tokens"]

    def make():
        bpe = load(path)

        def step(batch):
            texts, ids = clean(batch.column("text").to_pylist()), batch.column("doc_id")
            given = [[_bounds(x) for x in r or []] for r in batch.column("sections").to_pylist()] if sections else None
            for a, b in chunks(map(len, texts)):
                doc, *rest = _rows(bpe, texts[a:b], given[a:b] if given else None)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + a)), *map(pa.array, rest)], names=names)

        return step

    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(sections).alias("sections")] if sections else [])]
    return arrow_pass(docs.select(*columns), make, "doc_id long, section long, start long, end long, n_tokens long")
