"""Quality filtering by rules that vote and are weighed by estimated accuracy."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_CLASS, let, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: name: (measure, votes bad at, votes good at); between the two a rule abstains. Measures are of the columns of ``measures``.
RULES: dict[str, tuple[str, str, str]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", "> 0.06", "<= 0.02"),
    "marks": ("n_marks / greatest(word_chars, 1)", "> 0.15", "<= 0.08"),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 6)", "> 0.3", "<= 0.15"),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", "> 0.15", "<= 0.05"),
    "capitals": ("n_capitals / greatest(word_chars, 1)", "> 0.3", "<= 0.12"),
    "word_length": ("abs(word_chars / greatest(n_words, 1) - 5.5)", "> 2", "<= 1.25"),
    "variety": ("ln(greatest(n_distinct, 1)) / ln(greatest(n_words, 2))", "< 0.75", ">= 0.82"),
}


def _repeat_words(w: Column) -> Column:
    """Words in windows of WINDOW words that the text holds twice or more. Windows are compared by 64-bit hash within one text."""

    def covered(order: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(order, i)["h"] == F.get(order, j)["h"], F.lit(False))
        twice = F.filter(order, lambda x, i: same(i, i - 1) | same(i, i + 1))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            at, start, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"]
        )

    grams = F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    found = let(
        grams,
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(
            let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)
        ),
    )
    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("bigint")).otherwise(found)


def measures(text: Column) -> Column:
    """Struct of counts over the whole text (null: no words), the base of all rules."""
    text = F.coalesce(text, F.lit(""))
    count = lambda t, pattern: F.regexp_count(t, F.lit(pattern)).cast("bigint")

    def over_lines(t: Column, w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(WS_CHARS))) > 0)
        return let(lines, lambda ls: over_words(t, w, ls))

    def over_words(t: Column, w: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            (F.length(t) - count(t, f"[{WS_CLASS}]")).cast("bigint").alias("word_chars"),
            count(t, f"[{SYMBOLS}]").alias("n_symbols"),
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            count(t, r"\p{Lu}").alias("n_capitals"),
            count(t, rf"[^\p{{L}}\p{{M}}\p{{N}}{WS_CLASS}]").alias("n_marks"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
        )

    return let(text, lambda t: let(words(t), lambda w: over_lines(t, w)))


def votes() -> dict[str, Column]:
    """1 (good), -1 (bad) or 0 (abstains) for each rule, over the fields of a column ``_m`` of measures."""
    out = {}
    for name, (what, bad, good) in RULES.items():
        what = re.sub(r"\b(n_\w+|word_chars)\b", r"_m.\1", what)
        out[name] = F.expr(f"CASE WHEN {what} {bad} THEN -1 WHEN {what} {good} THEN 1 ELSE 0 END")
    return out


def _base_failed() -> Column:
    return (F.col("_m.n_words") < 20) | (F.col("_m.n_repeat_words") * 100 > F.col("_m.n_words") * 30)


#: What is expected of a rule that votes before any row is seen: how often it votes bad among good rows and among bad rows (a
#: text is bad in one way or another, so a bad text gets few bad votes), and the share of good rows. These priors weigh
#: as much as WEIGHT of all rows, so they count alike at every size: they tell the classes apart and speak where data are few.
BAD_VOTES, GOOD_SHARE, WEIGHT = (0.01, 0.3), 0.9, 0.02

Tables = list[dict[int, tuple[float, float]]]


def fit_accuracies(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500, weight: float = WEIGHT) -> tuple[float, Tables]:
    """Expectation-maximisation for rules that err independently given the class and abstain whatever the class.

    patterns: (votes, rows) for each vote pattern that occurs. Returns the share of good rows and for each rule
    {vote: (its probability among good rows, among bad rows)}, given that it votes: the mode of the posterior under
    Beta priors (BAD_VOTES, GOOD_SHARE) that weigh as much as ``weight`` of the rows. A rule is never taken to vote bad
    more often among good rows than among bad ones.
    """
    patterns = sorted(patterns)
    table = lambda good, bad: {1: (1 - good, 1 - bad), -1: (good, bad)}
    share, tables = GOOD_SHARE, [table(*BAD_VOTES) for _ in range(len(patterns[0][0]) if patterns else len(RULES))]
    total = sum(n for _, n in patterns)
    extra = max(weight * total, 1)
    for _ in range(rounds if total else 0):
        good_rows = [n * _posterior(share, tables, v) for v, n in patterns]
        before, share = share, (sum(good_rows) + extra * GOOD_SHARE) / (total + extra)
        for j in range(len(tables)):
            seen = {v: [extra * (p if v < 0 else 1 - p) for p in BAD_VOTES] for v in (-1, 1)}
            for (v, n), g in zip(patterns, good_rows, strict=True):
                if v[j]:
                    seen[v[j]][0] += g
                    seen[v[j]][1] += n - g
            good, bad = (seen[-1][k] / (seen[1][k] + seen[-1][k]) for k in (0, 1))
            tables[j] = table(min(good, bad), bad)
        if abs(before - share) < 1e-9:
            break
    return share, tables


def _posterior(share: float, tables: Tables, vote: tuple[int, ...]) -> float:
    z = math.log(share / (1 - share)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, vote, strict=True) if v)
    return 1 / (1 + math.exp(-max(min(z, 700), -700)))


def _pattern_counts(measured: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """Of the rows that do not fail the base. At most 3 to the number of rules rows, whatever the input."""
    found = measured.where(~_base_failed()).select(*[v.alias(k) for k, v in votes().items()]).groupBy(*RULES).agg(F.count(F.lit(1)).alias("_n")).collect()
    return [(tuple(r[k] for k in RULES), r["_n"]) for r in found]


def _probability(prior: float, tables: Tables) -> Column:
    z = F.lit(math.log(prior / (1 - prior)))
    for vote, rates in zip(votes().values(), tables, strict=True):
        weight = {v: F.lit(math.log(a / b)) for v, (a, b) in rates.items()}
        z = z + F.when(vote == 1, weight[1]).when(vote == -1, weight[-1]).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def quality(docs: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The measures of each row, base_failed, the posterior probability p_good that the text is good, and kept.

    Rules vote or abstain on measures of the whole text; accuracies come from all rows by expectation-maximisation over
    the counts of vote patterns (3 to the number of rules at most, whatever the input). kept: not base_failed and p_good
    at least ``threshold``. A null or empty text has no words, so it fails the base. Each row is judged for itself, also
    where ids repeat or are null; further columns are ignored. An empty table gives no rows. Measures are written to
    the shared folder once, so that texts are read once.
    """
    measured = written(docs.select(F.col(doc_id).alias("_id"), measures(F.col(text)).alias("_m")), "quality")
    p = _probability(*fit_accuracies(_pattern_counts(measured)))
    out = measured.select(F.col("_id").alias(doc_id), F.col("_m"), _base_failed().alias("base_failed"), p.alias("p_good"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).select(doc_id, "_m.*", "base_failed", "p_good", "kept")


def keep_good(docs: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs that ``quality`` keeps, all columns. Rows are written to the shared folder with their measures, so that texts are measured once; nothing is shuffled."""
    rows = written(docs.select(F.struct("*").alias("_in"), measures(F.col(text)).alias("_m")), "measured")
    p = _probability(*fit_accuracies(_pattern_counts(rows)))
    return rows.where(~_base_failed() & (p >= threshold)).select("_in.*")


def op7_query(docs: DataFrame) -> DataFrame:
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
