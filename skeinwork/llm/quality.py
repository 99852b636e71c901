"""Quality rules: line-first cleaning, by DataFrame expressions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed;
a document that loses too large a share of its words that way, or fails a base rule on the whole
text, is rejected.

Cases: a null text counts as empty; an empty text, or one of white space only, has no words and
fails the base rule; repeated rows are judged alike, each by itself; an empty table gives an empty
result; columns of the input other than the text are passed through untouched, and result columns
are appended under ``prefix``, so clashing names are the caller's choice of prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm._shared import let, spare_name, words


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the verdict."""

    max_symbol_share: float = 0.10  # characters of [#*$%&|<>] against characters in words
    min_bars: int = 2  # separators that make a line a menu or a table row
    max_caps_share: float = 0.70  # upper-case letters against letters ...
    min_caps_letters: int = 12  # ... in lines with that many
    max_exclaim_share: float = 0.30  # words that end in "!!" against words
    max_run_share: float = 0.50  # words equal to the word before them, against words
    max_lost_share: float = 0.30  # words in removed lines against words of the document
    boilerplate: tuple[str, ...] = (  # in lower case
        "licensed under the ",
        "all rights reserved",
        "cookie policy",
        "cookies policy",
        "cookie settings",
        "cookies settings",
        "accept cookies",
        "accept all cookies",
        "terms of use",
        "terms of service",
        "privacy policy",
        "subscribe to our",
        "sign up for our",
        "click here to",
        "copyright (c)",
        "copyright ©",
    )


def _count(s: Column, others: str) -> Column:
    """Characters of s that the pattern of the other ones leaves."""
    return F.length(F.regexp_replace(s, others, ""))


def line_reason(line: Column, w: Column, rules: LineRules) -> Column:
    """The first rule a line with words w fails, or null. Costly counts are made only where a quick look allows the rule to fail."""
    low = F.lower(line)
    shouted = F.size(F.filter(w, lambda x: F.endswith(x, F.lit("!!"))))
    run = F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1))))
    # most letters being capitals, two of them follow each other
    dense = line.rlike(r"\p{Lu}\P{L}*+\p{Lu}")
    letters, caps = _count(line, r"\P{L}+"), _count(line, r"\P{Lu}+")
    known = low.contains(rules.boilerplate[0])
    for phrase in rules.boilerplate[1:]:
        known = known | low.contains(phrase)
    return (
        F.when(line.rlike(r"[|»›]") & (_count(line, r"[^|»›]+") >= rules.min_bars), "navigation")
        .when(line.rlike(r"[#*$%&|<>]") & (_count(line, r"[^#*$%&|<>]+") > rules.max_symbol_share * F.length(F.array_join(w, ""))), "symbols")
        .when(dense & (letters >= rules.min_caps_letters) & (caps > rules.max_caps_share * letters), "capitals")
        .when(line.contains("!!") & (shouted > rules.max_exclaim_share * F.size(w)), "punctuation")
        .when(run > rules.max_run_share * F.size(w), "stutter")
        .when(known, "boilerplate")
    )


def repeated_window_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the array w.

    The windows' hashes are sorted with their places, equal neighbours are repeats; the union of the
    repeats' spans follows from the gaps between their sorted places. O(n log n) for any text.
    """

    def places(a: Column) -> Column:
        hashed = F.transform(
            F.when(F.size(a) >= 3, F.sequence(F.lit(0), F.size(a) - 3)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)).alias("h"), i.alias("i")),
        )
        return let(
            F.array_sort(hashed),
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    return let(let(w, places), covered)


def judge(df: DataFrame, text: str = "text", rules: LineRules = LineRules(), prefix: str = "") -> DataFrame:
    """Append base counts, the cleaned text and the verdict to every row of df.

    Appended: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words,
    cleaned (the text without failing lines), kept.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    judged = F.transform(
        F.split(t, "\n", -1),
        lambda x: let(words(x), lambda w: F.struct(x.alias("line"), line_reason(x, w, rules).isNotNull().alias("bad"), F.size(w).alias("n"))),
    )
    base = let(
        words(F.col(text)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_window_words(w).cast("long").alias("n_repeat")),
    )
    of_lines = let(
        judged,
        lambda a: F.struct(
            F.aggregate(a, F.lit(0), lambda acc, x: acc + F.when(x["bad"], x["n"]).otherwise(0)).cast("long").alias("lost"),
            let(F.transform(F.filter(a, lambda x: x["n"] > 0), lambda x: x["line"]), lambda b: F.size(b) - F.size(F.array_distinct(b))).cast("long").alias("dup"),
            F.array_join(F.transform(F.filter(a, lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("cleaned"),
        ),
    )
    held = spare_name(df.columns, "quality")
    out = df.select(
        *(F.col(f"`{c}`") for c in df.columns),
        F.struct(base.alias("base"), _count(t, r"[^#*$%&|<>]+").cast("long").alias("n_symbols"), of_lines.alias("lines")).alias(held),
    )
    q = F.col(held)
    n, rep = q["base"]["n_words"], q["base"]["n_repeat"]
    failed = (n < 50) | (100 * rep > 50 * n)
    made = {
        "n_words": n,
        "word_chars": q["base"]["chars"],
        "n_symbols": q["n_symbols"],
        "n_dup_lines": q["lines"]["dup"],
        "n_repeat_words": rep,
        "base_failed": failed,
        "lost_words": q["lines"]["lost"],
        "cleaned": q["lines"]["cleaned"],
        "kept": ~failed & (q["lines"]["lost"] <= rules.max_lost_share * n),
    }
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *(c.alias(prefix + k) for k, c in made.items()))


def clean(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows of df that are kept, with the cleaned text in place of the text; all other columns, whatever their names, stay."""
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    kept = judge(df, text, rules, prefix).filter(F.col(f"{prefix}kept"))
    return kept.select(*((F.col(f"{prefix}cleaned") if c == text else F.col(f"`{c}`")).alias(c) for c in df.columns))
