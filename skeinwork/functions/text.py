"""Text expressions: normalization, titles, evidence and prompt formatting, sentences and claims.

All are plain column expressions. White space means Unicode white space, as in the usual scripting
languages, not only the ASCII space that Spark's trim removes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+\z", "")


def ends_sentence(x: Column) -> Column:
    """Whether the text ends in a full stop, question or exclamation mark."""
    return F.right(x, F.lit(1)).isin(".", "?", "!")


def join_title(title: Column, content: Column) -> Column:
    """Title and content as one text, with a full stop between them if the title has none of its own."""
    t = strip(title)
    return F.concat(t, F.when(ends_sentence(t), F.lit(" ")).otherwise(F.lit(". ")), strip(content))


def encoder_input(style: str, title: Column, content: Column, separator: str = "[SEP]") -> Column:
    """Encoder input: 'separated' (title, separator, content), 'dotted', 'pair' (array of both) or 'joined'."""
    if style == "separated":
        return F.concat(title, F.lit(separator), content)
    if style == "dotted":
        return F.replace(F.replace(F.concat_ws(". ", title, content), F.lit(".."), F.lit(".")), F.lit("?."), F.lit("?"))
    if style == "pair":
        return F.array(title, content)
    if style == "joined":
        return join_title(title, content)
    raise ValueError(f"unknown encoder input style: {style}")


def encoder_style(encoder: str) -> str:
    """Input style by encoder name."""
    name = encoder.lower()
    found = [style for part, style in (("specter", "separated"), ("contriever", "dotted"), ("medcpt", "pair")) if part in name]
    return found[0] if found else "joined"


def article_encoder(encoder: str) -> str:
    """The index side's encoder of a pair of unlike encoders."""
    return encoder.replace("Query-Encoder", "Article-Encoder")


def collapse_space(x: Column) -> Column:
    return F.regexp_replace(x, SPACE, " ")


def drop_reference_marks(x: Column) -> Column:
    """Remove numeric reference marks such as [7] or [1, 2], and the gaps they leave; [S1] stays."""
    x = F.regexp_replace(x, r"(?U)\s*\[\d+(\s*,\s*\d+)*\]", "")
    x = F.regexp_replace(x, r"(?U)\s+([.,;:])", "$1")
    return strip(F.regexp_replace(x, r"[ \t]{2,}", " "))


def split_title(title: Column, separator: str = " -- ") -> Column:
    """struct<document, section> of a hierarchical title; section is null if there is none."""
    parts = F.transform(F.split(title, r"\Q" + separator + r"\E", -1), strip)
    rest = F.array_join(F.filter(F.slice(parts, 2, 1 << 30), lambda p: p != ""), separator)
    return F.struct(F.get(parts, F.lit(0)).alias("document"), F.nullif(rest, F.lit("")).alias("section"))


def token_estimate(x: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(x, SPACE), lambda t: t != ""))


def label(document: Column, section: Column) -> Column:
    return F.when(section.isNull() | (section == ""), document).otherwise(F.concat(document, F.lit(" - "), section))


def options_block(options: Column) -> Column:
    """Answer options by key, one a line; empty if there are none."""
    lines = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"]))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def context_lines(hits: Column) -> Column:
    """Context lines of array<struct<title, content>>, numbered from 0; one empty line if there are no hits."""
    lines = F.transform(hits, lambda h, i: F.concat(F.lit("Document ["), i.cast("string"), F.lit("] (Title: "), h["title"], F.lit(") "), h["content"]))
    return F.when(F.size(hits) > 0, lines).otherwise(F.array(F.lit("")))


def evidence(hits: Column) -> Column:
    """Evidence block of array<struct<rank, source_type, document, section, text>>."""

    def entry(h: Column) -> Column:
        kind = F.when(h["source_type"] == "statpearls", "StatPearls").otherwise("Textbook")
        return F.concat(F.lit("[S"), (h["rank"] + 1).cast("string"), F.lit("] ("), kind, F.lit(" - "), label(h["document"], h["section"]), F.lit(")\n"), h["text"])

    return F.array_join(F.transform(hits, entry), "\n\n")


def truncate_tokens(x: Column, budget: int) -> Column:
    """The first `budget` words, single-spaced; models.cutter cuts by a model's own tokens."""
    return F.array_join(F.slice(F.filter(F.split(x, SPACE), lambda t: t != ""), 1, budget), " ")


def fill(template: str, **values: Column) -> Column:
    """Fill {{name}} slots of a template."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{{" + kv[0] + "}}"), kv[1]), values.items(), F.lit(template))


def messages(*pairs: tuple[str, Column]) -> Column:
    """array<struct<role, content>>."""
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in pairs))


def with_disclaimer(answer: Column, disclaimer: str) -> Column:
    return F.concat(rstrip(answer), F.lit(f"\n\n---\n{disclaimer}"))


def sentences(x: Column) -> Column:
    """Sentences: split behind . ! ? before white space; empty ones go."""
    return F.filter(F.transform(F.split(strip(x), r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


#: Openings of sentences that frame an answer and claim nothing, and the word of a model that finds no evidence.
FRAMING = (
    r"^(the )?(evidence|snippets?|corpus|passages?|context)\b",
    r"^(based on|according to|in summary|overall|however|note that)\b",
    r"^(this|these) (answer|response|summary)\b",
)
INSUFFICIENT = "INSUFFICIENT_EVIDENCE"
MARKER = r"\[S\d+\]"


def is_claim(sentence: Column) -> Column:
    """Five words or more that neither frame the answer nor say that evidence is missing."""
    low = F.lower(strip(sentence))
    return (token_estimate(low) >= 5) & ~low.rlike("|".join((*FRAMING, INSUFFICIENT.lower())))


def uncited_claims(answer: Column) -> Column:
    return F.filter(sentences(answer), lambda s: is_claim(s) & ~s.rlike(MARKER))


def parse_queries(x: Column) -> Column:
    """The list after `"output":` in a model's reply, without leading numbers; null if there is none to parse."""
    found = F.from_json(F.nullif(F.regexp_extract(x, r'(?s)output": (\[.*\])', 1), F.lit("")), "array<string>")
    return F.transform(found, lambda q: F.regexp_replace(strip(q), r"^\d+\.\s*", ""))


def cut_at_stop(x: Column, stops: tuple[str, ...] = ("###", "User:", "\n\n\n")) -> Column:
    """The text before the first stop string."""
    return reduce(lambda t, s: F.substring_index(t, s, 1), stops, x)


def is_final(reply: Column) -> Column:
    return reply.contains("## Answer") | F.lower(reply).contains("answer is")


def asks_queries(reply: Column) -> Column:
    """Whether the reply's last query section has text."""
    return reply.contains("## Queries") & (strip(F.substring_index(reply, "## Queries", -1)) != "")


def tokens(x: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: The usual short list of English stop words.
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def s_stem(term: Column) -> Column:
    """A term without its plural ending (Harman's weak stemmer)."""
    return (
        F.when(F.length(term) <= 3, term)
        .when(term.rlike("[^ea]ies$"), F.regexp_replace(term, "ies$", "y"))
        .when(term.rlike("[^aeo]es$"), F.regexp_replace(term, "es$", "e"))
        .when(term.rlike("[^us]s$"), F.regexp_replace(term, "s$", ""))
        .otherwise(term)
    )


def analyzer(
    stop: tuple[str, ...] = (), stem: Callable[[Column], Column] | None = None, split: Callable[[Column], Column] = tokens, stem_all: Callable[[Column], Column] | None = None
) -> Callable[[Column], Column]:
    """Text -> terms for a lexical index: `split`, then stop words go, then terms are stemmed, each by `stem` or the whole array by
    `stem_all` (functions.stem.stems)."""

    def run(x: Column) -> Column:
        terms = F.filter(split(x), lambda t: ~t.isin(*stop)) if stop else split(x)
        terms = F.transform(terms, stem) if stem else terms
        return stem_all(terms) if stem_all else terms

    return run


def token_set(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), SPACE), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; 0 if either is empty."""
    inter, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(inter / F.greatest(union, F.lit(1)))


#: What stands around the turns of the known chat styles; {} is the turn's text.
CHAT_STYLES = {
    "inst": {"start": "<s>", "user": "[INST] {} [/INST]", "assistant": "{}</s>"},
    "sections": {"start": "", "user": "### User:\n{}\n", "assistant": "### Assistant:\n{}\n"},
}


def _turns(chat: Column) -> tuple[Column, Column]:
    """The leading system message's text or null, and the turns behind it."""
    system = F.when(F.get(chat, F.lit(0))["role"] == "system", F.get(chat, F.lit(0))["content"])
    return system, F.when(F.get(chat, F.lit(0))["role"] == "system", F.slice(chat, 2, 1 << 30)).otherwise(chat)


def alternates(chat: Column) -> Column:
    """Whether user and assistant take turns in array<struct<role, content>>, the user first, a leading system message aside."""
    _, turns = _turns(chat)
    return ~F.exists(F.transform(turns, lambda m, i: m["role"] != F.when(i % 2 == 0, "user").otherwise("assistant")), lambda b: b)


def chat_template(chat: Column, style: str | dict[str, str] = "inst") -> Column:
    """Prompt text of array<struct<role, content>>: a leading system message goes into the first user turn, roles must alternate.
    A style is a name of CHAT_STYLES, or start, user and assistant themselves (sources.tables.read_chat_style)."""
    form = style if isinstance(style, dict) else CHAT_STYLES.get(style, CHAT_STYLES["sections"])

    def around(role: str, body: Column) -> Column:
        before, _, after = form[role].partition("{}")
        return F.concat(F.lit(before), body, F.lit(after))

    system, turns = _turns(chat)

    def turn(m: Column, i: Column) -> Column:
        body = strip(F.when((i == 0) & system.isNotNull(), F.concat(system, F.lit("\n\n"), m["content"])).otherwise(m["content"]))
        return F.when(m["role"] == "user", around("user", body)).otherwise(around("assistant", body))

    text = F.concat(F.lit(form.get("start", "")), F.array_join(F.transform(turns, turn), ""))
    return F.when(~alternates(chat), F.raise_error(F.lit("conversation roles must alternate user/assistant"))).otherwise(text)
