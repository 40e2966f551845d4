"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from . import let


def normalize_exact(text: Column) -> Column:
    """Lower case, without anything but a-z and 0-9."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case, once $ and backslash are deleted; other characters split."""
    return F.regexp_extract_all(F.translate(F.lower(text), "$\\", ""), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(words: Column, n: int = K.SHINGLE) -> Column:
    """The set of runs of n words, each joined by blanks; empty if there are fewer words."""

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def shingle_names(words: Column, n: int = K.SHINGLE) -> Column:
    """The same set by 64-bit names, which cost neither strings nor their comparison."""

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.slice(w, i + 1, n)))
        return F.when(F.size(w) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))

    return let(words, runs)


def normalize_question(text: Column) -> Column:
    """Lower case, white space (Unicode) runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def strip_space(text: Column) -> Column:
    """Without any white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def normalize_answer(text: Column) -> Column:
    """Trimmed, without outer $, whole numbers in their shortest form."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^(?U)\s+|\s+$", ""), r"^\$+|\$+$", "")
    return F.coalesce(F.try_to_number(F.regexp_extract(bare, r"^[+-]?\d{1,18}$", 0), F.lit("S999999999999999999")).cast("bigint").cast("string"), bare)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def preview(text: Column, n: int = 120) -> Column:
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" "))


def fill(template: str, **values: Column) -> Column:
    """The template with {name} parts replaced by columns."""
    parts, rest = [], template
    while rest:
        cut = min(((rest.index("{" + n + "}"), n) for n in values if "{" + n + "}" in rest), default=None)
        if cut is None:
            parts.append(F.lit(rest))
            break
        at, name = cut
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def reference_text(condition: Column, body: Column, answer: Column) -> Column:
    """A view's text for the teacher: the body and the boxed answer, or the latter alone."""
    sentence = fill(K.ANSWER_SENTENCE, answer=answer)
    return F.when(condition == "answer_only", sentence).otherwise(F.concat(body, F.lit("\n\n"), sentence))


def student_prompt(question: Column, official: bool = False) -> Column:
    return fill(K.OFFICIAL_STUDENT_PROMPT if official else K.STUDENT_PROMPT, question=question)


def teacher_prompt(question: Column, reference: Column, official: bool = False) -> Column:
    return fill(K.OFFICIAL_TEACHER_PROMPT if official else K.TEACHER_PROMPT, question=question, reference=reference)


def evaluator_prompt(question: Column) -> Column:
    return fill(K.OFFICIAL_EVALUATOR_PROMPT, question=question)


def marker_count(text: Column, markers=K.CORRECTION_MARKERS) -> Column:
    """How often the markers occur as whole words, each counted by itself."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, (F.regexp_count(low, F.lit(rf"(?U)\b{m}\b")) for m in markers))


def has_marker(piece: Column, markers=K.CORRECTION_MARKERS) -> Column:
    """Whether a token piece contains a marker anywhere; the two blank symbols of tokenizers count as blanks."""
    return F.lower(F.translate(piece, "Ġ▁", "  ")).rlike("|".join(markers))


def extract_boxed(text: Column) -> Column:
    """The trimmed body of the last \\boxed{...}; null if there is none, its braces do not close, or something stands before them."""
    tail = F.regexp_extract(text, r"(?s)^.*(\\boxed.*)$", 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        at = s["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((s["end"] == 0) & (c == "}") & (depth == 0), at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(tail, ""), start, step, lambda s: s["end"])
    body = F.substring(tail, F.lit(8), end - 8)
    return F.when(tail.startswith("\\boxed{") & (end > 0), F.regexp_replace(body, r"^(?U)\s+|(?U)\s+$", ""))


def split_name(name: Column, part: int) -> Column:
    """A part of a name at underscores, counted from 0."""
    return F.split_part(name, F.lit("_"), F.lit(part + 1))


def cell_name(run: Column, step: Column, mode: str) -> Column:
    return F.concat(F.replace(run, F.lit("_"), F.lit("-")), F.lit("-step"), step.cast("string"), F.lit(f"-{mode}"))


def padded(number: Column, width: int = 3) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def signed(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNull(), F.lit("—")).otherwise(F.format_string(f"%+.{digits}f", x))


def with_interval(x: Column, lo: Column, hi: Column, unit: str = "pp") -> Column:
    return F.when(x.isNull(), F.lit("—")).otherwise(F.format_string(f"%+.2f {unit} [%+.2f, %+.2f]", x, lo, hi))


def p_text(p: Column) -> Column:
    return F.when(p.isNull(), F.lit("—")).when(p < 0.001, F.lit("<0.001")).otherwise(F.format_string("%.3f", p))


def prefix_text(text: Column, k: Column) -> Column:
    """The first k tokens of a text; the default tokenizer splits at white space."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), k), " ")
