"""Quality rules as a short-circuit cascade, in DataFrame functions only.

On a sample every rule is timed and its verdicts are counted by pattern. The order is greedy: next
comes the rule with the most rejections per second among the sample's rows that earlier ones left.
A row is then asked rule by rule in one CASE expression and the rest is not evaluated once a
rule rejects it. The order decides what the cascade costs and which rule is named, never what is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.llm.common import query, table
from newsloom.session import materialize

#: Rows of the sample that rules are timed on, about; timings are the least of so many.
SAMPLE_ROWS, RUNS = 2_000, 3

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """``fails``: the condition that rejects a row; a null counts as passed."""

    name: str
    fails: Callable[[], Column]


@dataclass(frozen=True)
class Estimate:
    """Seconds a row and the share of rows rejected after the rules before this one."""

    rule: Rule
    cost: float
    rejects: float


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more among ``words``.

    Windows are sorted with their places, so equal ones are neighbours; a place counts the words up
    to the next repeated one, three at most.
    """
    n = F.greatest(F.size(words) - 2, F.lit(0))
    part = lambda k: F.slice(words, F.lit(k), n).alias(f"w{k}")
    windows = F.sort_array(F.arrays_zip(part(1), part(2), part(3), F.sequence(F.lit(1), F.greatest(n, F.lit(1))).alias("at")))

    def places(s: Column) -> Column:
        equal = lambda x, y: (x["w1"] == y["w1"]) & (x["w2"] == y["w2"]) & (x["w3"] == y["w3"])
        again = F.filter(s, lambda x, j: equal(x, F.get(s, j + 1)) | equal(x, F.get(s, j - 1)))
        return F.sort_array(F.transform(again, lambda x: x["at"]))

    def covered(p: Column) -> Column:
        new = F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - i, F.lit(3))))
        return F.aggregate(new, F.lit(0), lambda total, n: total + n)

    return F.when(F.size(words) >= 4, let(let(windows, places), covered)).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` as a struct ``row``, with text, words and the counts that rules ask for.

    Adds n_words, word_chars (code points in words), n_symbols, n_lines (with a word), n_dup_lines
    (of those, equal to an earlier one) and n_repeat_words. A null text counts as empty and has
    none of all. Columns of ``docs`` keep their names inside ``row``, so none can clash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"))
    split = read.select(
        "row", "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        lines_with_words(F.col("text")).alias("lines"),
    )
    counts = split.select(
        "row", "text", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    return counts


def rules() -> list[Rule]:
    """Rules that prose passes, over the columns of `measured`.

    The shares are the usual ones for web text, but for duplicate lines: short clean documents repeat
    up to half of their lines, so a rule at three tenths would reject some.
    """
    n = lambda: F.col("n_words")
    capitals = lambda: F.regexp_count("text", F.lit(r"\p{Lu}"))
    no_letter = lambda: F.size(F.filter("words", lambda w: ~w.rlike(r"^\P{L}*+\p{L}")))
    lines = lambda test: F.size(F.filter(F.split("text", "\n"), test))
    dots = lambda x: F.rtrim(x, F.lit(SPACES)).endswith("...") | F.rtrim(x, F.lit(SPACES)).endswith("…")
    bullet = lambda x: F.substring(F.ltrim(x, F.lit(SPACES)), 1, 1).isin("-", "•", "*")
    return [
        Rule("symbols", lambda: F.col("n_symbols") * 10 > n()),
        Rule("short words", lambda: F.col("word_chars") < 3 * n()),
        Rule("long words", lambda: F.col("word_chars") > 10 * n()),
        Rule("duplicate lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("words without letters", lambda: 5 * no_letter() > n()),
        Rule("capitals", lambda: 2 * capitals() > F.col("word_chars")),
        Rule("cut lines", lambda: 10 * lines(dots) > 3 * F.col("n_lines")),
        Rule("lists", lambda: 10 * lines(bullet) > 9 * F.col("n_lines")),
    ]


def failed(rule: Rule) -> Column:
    return F.coalesce(rule.fails(), F.lit(False))


def estimate(docs: DataFrame, some: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """The rules in the order of the cascade, with what the sample says of them.

    The sample is drawn from all of ``docs`` at a rate for about ``sample_rows`` rows, measured and
    kept as one file in the shared folder, so that a rule's time is that of one core; a bare scan's
    time is taken off. Of an empty sample the order is by cost alone.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    drawn = materialize(docs.sample(share, seed=1), "quality-drawn")
    sample = materialize(measured(drawn.coalesce(1)), "quality-sample")
    flags = [failed(r).alias(f"f{i}") for i, r in enumerate(some)]
    patterns = sample.select(*flags).groupBy(*[f"f{i}" for i in range(len(some))]).count().collect()
    total = sum(p["count"] for p in patterns)

    def seconds(column: Column) -> float:
        times = []
        for _ in range(RUNS):
            started = time.perf_counter()
            sample.agg(F.count_if(column)).first()
            times.append(time.perf_counter() - started)
        return min(times)

    scan = seconds(F.length("text") + F.size("words") < 0)
    cost = [max(seconds(failed(r)) - scan, 1e-4) / max(1, total) for r in some]
    left, order = list(range(len(some))), []
    while left:
        rejected = {i: sum(p["count"] for p in patterns if p[f"f{i}"]) for i in left}
        best = max(left, key=lambda i: (rejected[i] / cost[i], -cost[i], -i))
        alive = sum(p["count"] for p in patterns)
        order.append(Estimate(some[best], cost[best], rejected[best] / alive if alive else 0.0))
        patterns = [p for p in patterns if not p[f"f{best}"]]
        left.remove(best)
    return order


def first_failed(order: list[Estimate]) -> Column:
    """The name of the first rule in ``order`` that rejects the row; null if none does."""
    verdict = F.lit(None).cast("string")
    for e in reversed(order):
        verdict = F.when(failed(e.rule), e.rule.name).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, some: list[Rule] | None = None, base: Callable[[], Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns of `measured` with ``base_failed``, ``failed_rule`` (null if kept) and ``kept``.

    ``base`` rejects before the cascade; rows that it rejects are asked nothing more. Equal rows get
    equal verdicts; an empty table gives an empty result; a text without words fails whatever the
    base says of zero words, and no rule of the cascade.
    """
    some = rules() if some is None else some
    rows = measured(docs)
    bad = F.lit(False) if base is None else F.coalesce(base(), F.lit(False))
    order = estimate(docs, some, sample_rows)
    judged = rows.withColumn("base_failed", bad)
    judged = judged.withColumn("failed_rule", F.when(F.col("base_failed"), "base").otherwise(first_failed(order)))
    return judged.withColumn("kept", F.col("failed_rule").isNull())


def few_or_repeated() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w) x),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS c FROM g) x WHERE c > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS k FROM again) x GROUP BY r),
m AS (SELECT doc_id, t, ws, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_symbols * 10 > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 2 * n_dup_lines > n_lines
  OR 5 * len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) > n_words
  OR 2 * length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > word_chars
  OR 10 * len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * n_lines
  OR 10 * len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-•*]'))) > 9 * n_lines AS bad FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM v"""


@query("op12_quality_rules", _SQL)
def op12(spark, sf):
    judged = judge(table(spark, sf, "documents"), base=few_or_repeated)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("row.doc_id", *counts, "base_failed", "kept")
