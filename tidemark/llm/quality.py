"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule is a boolean column over the text that is true when the document fails it. The cascade runs every rule
on a small sample, takes its time there as cost and its share of failures as selectivity, and chains the rules by
failures per second in one CASE, so that a row which fails an early rule never evaluates the later ones. The order
changes the time and the reported first failure, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.registry import query, table
from tidemark.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a non-null text, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def word_chars(text: Column) -> Column:
    """Code points that are in words."""
    return F.length(F.regexp_replace(text, SPACE, "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    def count(lines: Column) -> Column:
        return F.size(lines) - F.size(F.array_distinct(lines))

    return bind(lines_of(text), count).cast("bigint")


def bind(value: Column, body) -> Column:
    """``body`` over ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_repeat_words(text: Column) -> Column:
    """Words inside five-word windows that occur at least twice in the text.

    Windows are compared by a 64-bit hash; only texts with an equal pair of hashes go on to sort the windows.
    """

    def windows(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(words) - WINDOW)
        hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))
        return F.when(F.size(words) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            bind(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), union)
        )

    def union(ordered: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            return F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))

        twice = F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            F.sort_array(F.transform(twice, lambda x: x["i"])),
            start,
            lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n")),
            lambda acc: acc["n"],
        )

    return bind(bind(words_of(text), windows), covered).cast("bigint")


@dataclass(frozen=True)
class Rule:
    """``fails``: from the text column to a boolean column, true where the document fails."""

    name: str
    fails: object


def few_words(text: Column) -> Column:
    return n_words(text) < 10


def repeats(text: Column) -> Column:
    return 100 * n_repeat_words(text) > 20 * n_words(text)


def symbols(text: Column) -> Column:
    return 100 * n_symbols(text) > 30 * n_words(text)


def word_length(text: Column) -> Column:
    return ~word_chars(text).between(2 * n_words(text), 15 * n_words(text))


def dup_lines(text: Column) -> Column:
    return 100 * n_dup_lines(text) > 40 * F.size(lines_of(text))


BASE = (Rule("few_words", few_words), Rule("repeats", repeats))
RULES = (*BASE, Rule("symbols", symbols), Rule("word_length", word_length), Rule("dup_lines", dup_lines))


def plan_cascade(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = 2_000) -> list[tuple[Rule, float, float]]:
    """Rules with (seconds, share of failures) on a sample of ``sample_rows`` rows, best failures per second first.

    Each row is drawn by chance, so that tasks send on their part of the sample only. A rule's seconds are the lesser of two runs
    behind a first one that compiles the plan. Only the order is taken from the sample; an empty table keeps the given order.
    """
    share = min(1.0, 2.0 * sample_rows / max(1, docs.count()))
    drawn = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).sample(fraction=share, seed=7)
    sample = materialize(drawn.limit(sample_rows), "sample")
    timed = []
    for rule in rules:
        failures = sample.agg(F.sum(rule.fails(F.col("text")).cast("int")), F.count("*"))
        took = []
        for _ in range(3):
            start = time.perf_counter()
            failed, rows = failures.first()
            took.append(time.perf_counter() - start)
        timed.append((rule, min(took[1:]), (failed or 0) / max(1, rows)))
    return sorted(timed, key=lambda x: -x[2] / x[1])


def first_failure(text: Column, rules) -> Column:
    """Name of the first rule that the text fails, null where it passes all; later rules are not evaluated."""
    case = F
    for rule in rules:
        case = case.when(rule.fails(text), F.lit(rule.name))
    return case if case is not F else F.lit(None).cast("string")


def quality_cascade(docs: DataFrame, rules=RULES, text: str = "text", out: str = "failed_rule", sample_rows: int = 2_000) -> DataFrame:
    """``docs`` with column ``out``: the first rule of the cascade that the text fails, else null.

    A null text counts as empty. Repeated rows get equal verdicts; all other columns stay as they are.
    """
    order = [rule for rule, _, _ in plan_cascade(docs, rules, text, sample_rows)]
    return docs.withColumn(out, first_failure(F.coalesce(F.col(f"`{text}`"), F.lit("")), order))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: the documents that pass every rule, with the columns they came with."""
    kept = quality_cascade(docs, out="__failed_rule")
    return kept.where(F.col("__failed_rule").isNull()).drop("__failed_rule")


SQL7 = r"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
wi as (
  select doc_id, unnest(range(1, len(ws) - 3)) as i, ws from w where len(ws) >= 5),
win as (select doc_id, i, list_slice(ws, i, i + 4) as g from wi),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from rep) group by doc_id),
m as (
  select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, len(ls) as n_lines
  from w left join cov on cov.doc_id is not distinct from w.doc_id),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and 100 * n_symbols <= 30 * n_words and word_chars between 2 * n_words and 15 * n_words
       and 100 * n_dup_lines <= 40 * n_lines as kept
from b
"""


@query("op7_quality", SQL7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the verdict of the base rules and that of the cascade over the other rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rest = [rule for rule, _, _ in plan_cascade(docs, RULES[len(BASE):])]
    t = F.col("text")
    counted = docs.select(
        "doc_id", "text", n_words(t).alias("n_words"), word_chars(t).alias("word_chars"), n_symbols(t).alias("n_symbols"),
        n_dup_lines(t).alias("n_dup_lines"), n_repeat_words(t).alias("n_repeat_words"),
    )
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", base).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(first_failure(t, rest).isNull()).alias("kept"),
    )
