"""Overlap of a corpus with benchmark items: exact, and by eight-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import let
from ..functions.text import normalize_exact, preview, shingle_names, shingles, tokens
from .common import broadcast_if_small


def _sets(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    both = let(tokens(F.col(text)), lambda w: F.struct(F.size(w).alias("n_tokens"), shingle_names(w, n).alias("set")))
    return df.select(F.col(key), both.alias("_s")).select(key, "_s.*")


def _named(df: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """A row for each shingle by name, with the size of its set."""
    names = shingle_names(tokens(F.col("text")), n)
    pair = let(names, lambda s: F.transform(s, lambda x: F.struct(x.alias("name"), F.size(s).alias(size))))
    return df.select(key, F.explode(pair).alias("_p")).select(key, "_p.*")


def overlaps(corpus: DataFrame, benchmark: DataFrame, n: int = K.SHINGLE) -> DataFrame:
    """(item_id, doc_id, common, n_item, n_doc, example) of every pair that shares a shingle.

    The corpus is named shingle by shingle and joined to the benchmark's names,
    which are the broadcast side while they are few, so only shared shingles
    leave the scan.  Spellings are kept on the benchmark's side alone.
    """
    both = let(tokens(F.col("text")), lambda w: F.arrays_zip(shingles(w, n).alias("shingle"), shingle_names(w, n).alias("name")))
    items = benchmark.select("item_id", F.size(both).alias("n_item"), F.explode(both).alias("_p")).select("item_id", "n_item", "_p.shingle", "_p.name")
    docs = _named(corpus, "doc_id", "n_doc", n)
    pairs = docs.join(broadcast_if_small(items), "name")
    longest = F.min(F.struct((-F.length("shingle")).alias("l"), "shingle"))
    return pairs.groupBy("item_id", "doc_id").agg(F.count("*").alias("common"), F.max("n_item").alias("n_item"), F.max("n_doc").alias("n_doc"), longest.alias("_e")).withColumn("example", F.col("_e.shingle")).drop("_e")


def _digests(df: DataFrame, key: str) -> DataFrame:
    """(key, _norm): md5 of the text once all but letters and digits are gone; a text of none of these has no row.

    A generator's output is filtered behind it, so the text is normalized once
    a row; a filter over a plain column would be pushed to the scan with a
    second copy of the expression.
    """
    norm = let(normalize_exact(F.col("text")), lambda x: F.when(x != "", F.array(F.unhex(F.md5(x.cast("binary"))))))
    return df.select(key, F.explode_outer(norm).alias("_norm")).where("_norm is not null")


def exact(corpus: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(item_id, n_exact, first_exact): how many documents are equal to an item, once all but letters and digits are gone, and the first.

    Documents are counted by digest before they meet the items, so m copies of
    a text are one row and not m times m.
    """
    docs = _digests(corpus, "doc_id").groupBy("_norm").agg(F.count("*").alias("n_exact"), F.min("doc_id").alias("first_exact"))
    return docs.join(_digests(benchmark, "item_id"), "_norm").select("item_id", "n_exact", "first_exact")


def report(corpus: DataFrame, benchmark: DataFrame, n: int = K.SHINGLE) -> DataFrame:
    """One row for each item: best Jaccard and containment, exact matches, and the flag."""
    pairs = overlaps(corpus, benchmark, n).withColumn("jaccard", F.col("common") / (F.col("n_item") + F.col("n_doc") - F.col("common"))).withColumn("containment", F.col("common") / F.col("n_item"))
    best = pairs.groupBy("item_id").agg(
        F.count("*").alias("n_candidates"),
        F.max(F.struct("jaccard", (-F.col("doc_id")).alias("d"))).alias("j"),
        F.max(F.struct("containment", (-F.col("doc_id")).alias("d"), "example")).alias("c"),
    )
    same = exact(corpus, benchmark)
    sized = _sets(benchmark, "item_id", "text", n).select("item_id", "n_tokens", F.size("set").alias("n_shingles")).join(benchmark.select("item_id", preview(F.col("text")).alias("question_preview")), "item_id")
    out = sized.join(best, "item_id", "left").join(same, "item_id", "left")
    zero = F.lit(0)
    return out.select(
        "item_id", "question_preview", "n_tokens", "n_shingles",
        F.coalesce("n_candidates", zero).alias("n_candidates"), F.coalesce("n_exact", zero).alias("n_exact"),
        F.coalesce("j.jaccard", F.lit(0.0)).alias("best_jaccard"), (-F.col("j.d")).alias("best_jaccard_doc"),
        F.coalesce("c.containment", F.lit(0.0)).alias("best_containment"), (-F.col("c.d")).alias("best_containment_doc"),
        (F.coalesce("n_exact", zero) > 0).alias("exact_match"),
        ((F.coalesce("n_exact", zero) > 0) | (F.coalesce("c.containment", F.lit(0.0)) >= K.FLAG_CONTAINMENT)).alias("flagged"),
        F.col("c.example").alias("example_shared"),
    )


def summary(rows: DataFrame, name: str = "benchmark") -> DataFrame:
    return rows.agg(F.count("*").alias("n_items"), F.count_if("exact_match").alias("n_exact"), F.count_if("flagged").alias("n_flagged"), F.max("best_jaccard").alias("max_jaccard"), F.max("best_containment").alias("max_containment")).withColumn("benchmark", F.lit(name))


def closest(rows: DataFrame, k: int = 5) -> DataFrame:
    return rows.orderBy(F.desc("best_jaccard"), "item_id").limit(k)


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def first_of_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """df with the first key of each equal text."""
    return df.withColumn("first_id", F.min(key).over(Window.partitionBy(text)))
