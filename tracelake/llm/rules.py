"""Quality rules as a short-circuit cascade ordered by measured rejection per cost.

Native: DataFrame functions only.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

SYMBOLS = r"[#*$%&|<>]"
#: Documents, as expected, on which costs and selectivities are estimated; the order of rules never changes a verdict.
SAMPLE_ROWS = 2_000
#: Passes over the sample for each rule, and the least cost that a rule is given.
TIMED_RUNS, LEAST_SECONDS = 3, 1e-3


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition over the text column ``text`` or the columns that ``measure`` adds."""

    name: str
    fails: str


#: Measures of a text; each is computed once and shared by the rules that name it.
BASE_RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
)
RULES = (
    Rule("odd_word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines > 10 and 2 * n_dup_lines > n_words / 8"),
    Rule("shouting", "2 * (length(text) - length(regexp_replace(text, '\\\\p{Lu}', ''))) > word_chars"),
    Rule("no_letters", "not text rlike '\\\\p{L}'"),
)


def _windows(words: Column) -> Column:
    """The 3-word windows of a text sorted by hash, then by their words: equal ones are neighbours."""
    return F.sort_array(F.transform(
        F.when(F.size(words) >= 4, F.sequence(F.lit(1), F.size(words) - 2)),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"),
            F.concat_ws(" ", F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("w"),
            i.alias("at"),
        ),
    ))


def _repeated_places(windows: Column) -> Column:
    """Places, in order, of the windows that have an equal neighbour."""

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["w"] == y["w"]), F.lit(False))

    marked = F.transform(windows, lambda x, i: F.when(
        same(x, F.get(windows, i + 1)) | same(x, F.get(windows, i - 1)), x["at"]
    ))
    return F.sort_array(F.array_compact(marked))


def _covered_words(places: Column) -> Column:
    """Words under the windows at ``places``: each covers 3, or as many as lie after the one before."""
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("sum")),
        lambda s, p: F.struct((p + 2).alias("upto"), (s["sum"] + F.least(F.lit(3), p + 2 - s["upto"])).alias("sum")),
        lambda s: s["sum"],
    )
    return F.coalesce(covered, F.lit(0)).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("__words", F.array_remove(F.split("text", SPACES), ""))
    rows = rows.withColumn("__windows", _windows(F.col("__words")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        "doc_id",
        "text",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _covered_words(_repeated_places(F.col("__windows"))).alias("n_repeat_words"),
    )


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 5) -> DataFrame:
    """About ``rows`` rows from all over ``docs``, by one draw for each row; a smaller table is taken whole.

    A limit would take its full number from every partition before it is met, and so grow with the table.
    """
    return docs.sample(min(1.0, rows / max(1, docs.count())), seed)


def order_rules(measured: DataFrame, rules: Sequence[Rule] = RULES, runs: int = TIMED_RUNS, reached: Column | None = None) -> list[Rule]:
    """The rules by rejected share per second, highest first, as seen on ``measured``, the measures of a bounded sample.

    Only rows of the sample for which ``reached`` holds count, as the cascade sees no others.
    A rule's cost is its fastest of ``runs`` passes over the cached sample, less the fastest pass without
    any rule: what a job costs by itself says nothing about a rule. The sample only sets the order in
    which rules are tried. A rule that rejects nothing there comes last; ties keep the given order.
    """
    cached = measured.cache()
    # The condition is put on the cached rows: pushed into the measures, it would compute them anew.
    cached.count()
    sample = cached if reached is None else cached.filter(reached)
    n = max(1, sample.count())

    def timed(condition: str) -> tuple[int, float]:
        rejected, best = 0, float("inf")
        for _ in range(runs):
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(F.expr(condition))).first()[0]
            best = min(best, time.perf_counter() - began)
        return rejected, best

    # ``text is null`` never holds and reads the column that the dearest rules read.
    _, idle = timed("text is null")
    worth = {}
    for rule in rules:
        rejected, seconds = timed(rule.fails)
        worth[rule.name] = rejected / n / max(seconds - idle, LEAST_SECONDS)
    cached.unpersist()
    return sorted(rules, key=lambda r: -worth[r.name])


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects a row, null if none does; later rules are then not evaluated."""
    first = F.lit(None).cast("string")
    for rule in reversed(rules):
        first = F.when(F.expr(rule.fails), F.lit(rule.name)).otherwise(first)
    return first


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Sequence[Rule] = BASE_RULES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: its measures, ``base_failed``, ``rejected_by`` and ``kept``.

    Null counts as an empty text, which has no words and so fails the base rules. The cascade runs only
    on documents that pass the base; which rule is named depends on the order, ``kept`` does not.
    Repeated rows are judged alike, an empty table gives an empty result, other columns are not read.
    """
    measured = measure(docs, id_col, text_col)
    failed = F.lit(False)
    for rule in base:
        failed = failed | F.expr(rule.fails)
    rules = order_rules(measure(sample_of(docs), id_col, text_col), rules, reached=~failed)
    out = measured.withColumn("base_failed", failed)
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(rules)))
    return out.withColumn("kept", F.col("rejected_by").isNull()).drop("text")
