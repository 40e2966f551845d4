"""Softmax, entropy and divergences over arrays of logits, and token-array rules, as higher-order column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from . import let


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    def shifted(a: Column) -> Column:
        def by_top(top: Column) -> Column:
            log_sum = F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
            return let(log_sum, lambda z: F.transform(a, lambda x: x - top - z))

        return let(F.array_max(a), by_top)

    return let(F.transform(logits, lambda x: x.cast("double") / temperature), shifted)


def entropy(logp: Column) -> Column:
    """In nats."""
    return -F.aggregate(logp, F.lit(0.0), lambda s, x: s + F.exp(x) * x)


def argmax(a: Column) -> Column:
    """Place of the first largest element, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def gather(a: Column, place: Column) -> Column:
    return F.element_at(a, (place + 1).cast("int"))


def forward_kl(logp: Column, logq: Column) -> Column:
    return total(F.zip_with(logp, logq, lambda p, q: F.exp(p) * (p - q)))


def clipped_kl(logp: Column, logq: Column, clip: float = K.TOKEN_CLIP) -> Column:
    """Each element's part is cut at `clip` before the sum, which may be negative."""
    return total(F.zip_with(logp, logq, lambda p, q: F.least(F.exp(p) * (p - q), F.lit(clip))))


def masked_mean(values: Column, mask: Column) -> Column:
    hit = F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(0.0))
    return total(hit) / F.greatest(F.size(F.filter(mask, lambda m: m)), F.lit(1))


def logit(p: Column, eps: float = K.PROBABILITY_EPS) -> Column:
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(p / (1 - p))


def floor_bin(x: Column, k: int) -> Column:
    return F.least(F.greatest(F.floor(x * k), F.lit(0)), F.lit(k - 1)).cast("int")


def loss_horizon(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def loss_windows(length: Column, fractions: tuple[float, ...], width: int) -> Column:
    """Places covered by windows of `width` around bround(fraction * length), cut to the sequence; sorted, each once."""
    spans = []
    for f in fractions:
        center = F.bround(F.lit(f) * length, 0).cast("int")
        lo, hi = F.greatest(center - width // 2, F.lit(0)), F.least(center + (width - width // 2), length)
        spans.append(F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>")))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*spans))))


def windows_of(places: Column) -> Column:
    """Sorted places as [start, end) windows of consecutive ones."""
    start = F.array().cast("array<struct<start:int,end:int>>")

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), (x + 1).alias("end"))))
        new = F.concat(done, F.array(F.struct(x.alias("start"), (x + 1).alias("end"))))
        return F.when(F.when(F.size(done) > 0, last["end"] == x).otherwise(False), grown).otherwise(new)

    return F.aggregate(places, start, step)


def until_stop(ids: Column, stops: tuple[int, ...]) -> tuple[Column, Column]:
    """(ids up to and with the first stop id, finish reason)."""
    at = F.array_min(F.filter(F.array(*(F.array_position(ids, F.lit(s).cast("int")) for s in stops)), lambda x: x > 0))
    return F.coalesce(F.slice(ids, F.lit(1), at.cast("int")), ids), F.when(at.isNull(), "length").otherwise("stop")


def categories(ids: Column, boundary: tuple[int, ...]) -> Column:
    """`think` before the first boundary id, `answer` from it on; without one all is `think`.  No ids give no labels."""
    at = F.coalesce(F.array_min(F.filter(F.array(*(F.array_position(ids, F.lit(b).cast("int")) for b in boundary)), lambda x: x > 0)), F.size(ids) + 1)
    return let(at, lambda first: F.transform(ids, lambda _, i: F.when(i + 1 < first, "think").otherwise("answer")))


def coverage(places: Column, length: Column) -> Column:
    """Share of a completion's tokens that the loss is taken on; null for an empty completion."""
    return F.try_divide(F.size(places).cast("double"), length.cast("double"))


def reaches_answer(places: Column, reasoning: Column) -> Column:
    """Whether the last of the ascending places lies behind the reasoning; null without places."""
    return F.try_element_at(places, F.lit(-1)) >= reasoning


def with_eos(ids: Column, reason: Column, eos: int) -> Column:
    """A stopped completion ends with the end id."""
    ends = F.when(F.size(ids) > 0, F.element_at(ids, -1) == eos).otherwise(False)
    return F.when((reason == "stop") & ~ends, F.concat(ids, F.array(F.lit(eos).cast("int")))).otherwise(ids)


def fork_weight(marker: Column, mode: str) -> Column:
    """A token's weight in the loss: off 1; exclude 0 for markers; downweight 0.1 for markers."""
    return {"off": F.lit(1.0), "exclude": F.when(marker, 0.0).otherwise(1.0), "downweight": F.when(marker, 0.1).otherwise(1.0)}[mode]


def linear_decay(step: Column, steps: int, rate: float) -> Column:
    return F.lit(rate) * F.greatest(F.lit(0.0), 1 - step / F.lit(float(steps)))
