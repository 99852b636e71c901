"""Groups of spelling variants: words one edit apart, and the much more frequent word each belongs to.

Each word's bigrams are ordered by how many words have them, the rarest first, then by text and position. One edit spoils at
most two bigrams of a word, and keeps the others' order and, but for one place, their positions; so two near
words have a bigram among the three rarest of each in common, at positions one apart at most. The edit lies
before or behind that bigram: either both words are equal up to its end (at equal positions), or both are equal from it
on. Words therefore meet by the bigram together with all that is before it, or all that is behind it, and pairs
whose lengths, and so positions, are more than one apart are never formed. Every pair that met is verified.

A rare bigram at a word's edge can still gather many words. Keys of more than CROWDED words are refined: instead of
the key alone, words meet by the key and the whole word, or what is left of it without one character. Words of equal length that are near
are the same without the character that differs, of others the longer one is the shorter one without a character. Such a meeting has
an alphabet's worth of words for each place at most, however many words there are, and misses no pair.

Bigrams are ordered by their own frequency, positions kept beside them: an edit shifts positions, so an order by bigram and
position would not be the same in both words.

Cases: null texts have no words; a null id counts as an empty one; a row given twice counts twice; ties between near words: the
least in code-point order; very long texts are read whole; an empty table gives no words; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm._shared import discard, maybe_broadcast, stage

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bigrams of a word that an edit leaves whole in number all but two; the three rarest always hold one.
PREFIX = 3

#: Keys shared by more words than this are refined.
CROWDED = 200


def runs(text: Column) -> Column:
    """The maximal runs of letters of a text, A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), f"[^{LETTERS}]+"), lambda w: w != "")


def slipped(key: Column, word: Column, every: int = 31) -> Column:
    """The word, or without one code point where `every` divides its digest with the key."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % every == 0, cut).otherwise(word)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2) -> DataFrame:
    """word, n: the words of at least `shortest` code points found at least `least` times."""
    # outer, as for plain explode the optimizer splits every text once more, ahead of it, to leave out those without runs
    found = docs.select(F.col(f"`{key}`").alias("id"), F.explode_outer(F.filter(runs(F.col(f"`{text}`")), lambda w: F.length(w) >= shortest)).alias("run"))
    counts = found.filter("run is not null").select(slipped(F.col("id"), F.col("run")).alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least)


def _grams(words: DataFrame) -> DataFrame:
    """word, gram, at: every bigram of every word (of two code points at least)."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    return words.filter(F.length("word") > 1).select("word", F.inline(F.transform(places, lambda i: F.struct(F.substring(F.col("word"), i, F.lit(2)).alias("gram"), i.alias("at")))))


def rarest(words: DataFrame) -> DataFrame:
    """word, at: where the PREFIX rarest bigrams of each word are."""
    grams = _grams(words)
    spread = grams.groupBy("gram").agg(F.count("*").alias("held"))
    ranked = grams.join(maybe_broadcast(spread, 48), "gram").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("held", "gram", "at"))).alias("g"))
    return ranked.select("word", F.explode(F.slice("g", 1, PREFIX)["at"]).alias("at"))  # a word's bigrams are bounded by its length


def meetings(words: DataFrame) -> DataFrame:
    """key, word: each word under the text up to the end of each of its rarest bigrams, and from it on."""
    before = F.concat(F.lit("<"), F.substring(F.col("word"), F.lit(1), F.col("at") + 1))
    behind = F.concat(F.lit(">"), F.substring(F.col("word"), F.col("at"), F.length("word")))
    return rarest(words).select("word", F.explode(F.array(before, behind)).alias("key")).distinct()


def _refined(rows: DataFrame) -> DataFrame:
    """The rows under their key and all ways to lose one character of what the key does not hold."""
    word, key = F.col("word"), F.col("key")
    held, n = F.length(key) - 1, F.length(word)
    first = F.when(key.startswith("<"), held + 1).otherwise(1)
    last = F.when(key.startswith("<"), n).otherwise(n - held)
    without = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n))
    losses = F.when(last >= first, F.transform(F.sequence(first, last), lambda i: F.concat_ws("|", key, without(i))))
    keys = F.concat(F.array(F.concat_ws("|", key, word)), F.coalesce(losses, F.array().cast("array<string>")))
    return rows.select(F.explode(F.array_distinct(keys)).alias("key"), "word")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: all pairs of words one edit apart, each once, a before b. `words` has distinct words."""
    met = stage(meetings(words.select("word")), "spelling-meetings")
    crowded = met.groupBy("key").count().filter(F.col("count") > CROWDED).select("key")
    marked = stage(met.join(crowded.withColumn("crowded", F.lit(True)), "key", "left"), "spelling-crowds")
    plain = marked.filter("crowded is null").select("key", "word")
    keyed = plain.unionByName(_refined(marked.filter("crowded").select("key", "word")))
    left, right = keyed.select("key", F.col("word").alias("a")), keyed.select("key", F.col("word").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    pairs = stage(left.join(right.hint("shuffle_merge"), (left["key"] == right["key"]) & near).select("a", "b").distinct(), "spelling-pairs")
    discard(met, marked)
    return pairs


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents.

    The form is the near word of largest count, if it is `times` the word's at least; the root is where following forms ends. A form's
    count is `times` the word's, so the chain's length is bounded by a logarithm of the largest count, and is halved by each join.
    """
    words = stage(vocabulary(docs, key, text, shortest, least), "spelling-words")
    pairs = near_pairs(words)
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = links.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("m"), F.col("b"))).alias("best"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("best.b").alias("near"), (-F.col("best.col1")).alias("near_n"))
    forms = words.join(best, "word", "left").withColumn("fits", F.coalesce(F.col("near_n") >= times * F.col("n"), F.lit(False)))
    forms = stage(
        forms.select("word", F.when(F.col("fits"), F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("near_n")).alias("form_n")),
        "spelling-forms",
    )
    roots = _roots(forms, int(words.agg(F.max("n")).first()[0] or 1), least, times)
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame, largest: int, least: int, times: int) -> DataFrame:
    """word, root of the words that have a form."""
    longest = math.log(max(1.0, largest / least), times) + 1  # steps of any chain
    hops = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(longest + 1)))):
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = stage(hops.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return hops


