"""Queries of text normalization, formatting and message handling."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.functions import models
from skeinwork.functions import text as T
from skeinwork.operators import chunking, citations, evaluate, fusion, safety, sampling
from skeinwork.plans import answer, prompts
from skeinwork.plans.registry import query, table
from skeinwork.sources import scratch, tables

#: documents as raw chunks: source is the title's first part, lang its second.
_RAW = "raw AS (SELECT doc_id::VARCHAR AS id, source || ' -- ' || lang AS title, text AS content FROM documents)"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit(" -- "), "lang").alias("title"), F.col("text").alias("content"), F.lit(None).cast("string").alias("contents"))


_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


@query(f"""WITH {_RAW}
SELECT id, md5({_STRIP.format('title')} || CASE WHEN right({_STRIP.format('title')}, 1) IN ('.', '?', '!') THEN ' ' ELSE '. ' END || {_STRIP.format('content')}) AS contents_md5 FROM raw""")
def title_content_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("id", F.md5(T.join_title(F.col("title"), F.col("content")).cast("binary")).alias("contents_md5"))


@query(f"""WITH {_RAW}
SELECT id, md5(title || '[SEP]' || content) AS separated, md5(replace(replace(title || '. ' || content, '..', '.'), '?.', '?')) AS dotted FROM raw""")
def encoder_input_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = F.col("title"), F.col("content")
    return _raw(spark, sf_dir).select("id", *(F.md5(T.encoder_input(s, *args).cast("binary")).alias(s) for s in ("separated", "dotted")))


@query(r"SELECT doc_id, md5(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed FROM documents")
def collapse_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse_space(F.col("text")).cast("binary")).alias("collapsed"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


_MARKED = r"replace(replace(text, ', ', ' [1, 2] , '), '. ', ' [7]. ')"


@query(rf"""
SELECT doc_id, md5({_STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(" + _MARKED + r", '\s*\[\d+(\s*,\s*\d+)*\]', '', 'g'), '\s+([.,;:])', '\1', 'g'), '[ \t]{2,}', ' ', 'g')")}) AS stripped FROM documents""")
def strip_reference_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On texts with marks put behind commas and sentences."""
    marked = F.replace(F.replace("text", F.lit(", "), F.lit(" [1, 2] , ")), F.lit(". "), F.lit(" [7]. "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.drop_reference_marks(marked).cast("binary")).alias("stripped"))


@query(f"WITH {_RAW} SELECT DISTINCT title, split_part(title, ' -- ', 1) AS document, nullif(split_part(title, ' -- ', 2), '') AS section FROM raw")
def parse_hierarchical_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.split_title(F.col("title"))
    return _raw(spark, sf_dir).select("title", parts["document"].alias("document"), parts["section"].alias("section")).distinct()


@query(rf"""WITH {_RAW}, n AS (SELECT id AS chunk_id, title || '. ' || content AS c, split_part(title, ' -- ', 1) AS document, split_part(title, ' -- ', 2) AS section FROM raw)
SELECT chunk_id, md5({_STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(c, '\s*\[\d+(\s*,\s*\d+)*\]', '', 'g'), '\s+([.,;:])', '\1', 'g'), '[ \t]{2,}', ' ', 'g')")}) AS text_md5,
       document, section, len(list_filter(string_split_regex(c, '\s+'), lambda t: t <> '')) AS token_estimate, document || ' - ' || section AS label FROM n""")
def normalize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = chunking.normalize(_raw(spark, sf_dir), "statpearls")
    return n.select("chunk_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "document", "section", F.col("token_estimate").cast("long").alias("token_estimate"), T.label(F.col("document"), F.col("section")).alias("label"))


_SENTENCES = rf"list_filter(list_transform(string_split_regex(regexp_replace({_STRIP.format('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_STRIP.format('s')}), lambda s: s <> '')"


@query(f"SELECT doc_id, len({_SENTENCES}) AS n, md5(array_to_string({_SENTENCES}, chr(10))) AS joined FROM documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "\n").cast("binary")).alias("joined"))


_FRAMING = "|".join((*T.FRAMING, T.INSUFFICIENT.lower()))


@query(rf"""
SELECT doc_id, len(list_filter({_SENTENCES}, lambda s: len(list_filter(string_split_regex(lower(s), '\s+'), lambda t: t <> '')) >= 5 AND NOT regexp_matches(lower(s), '{_FRAMING}'))) AS claims FROM documents""")
def claim_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(T.sentences(F.col("text")), T.is_claim)).cast("long").alias("claims"))


@query(rf"""
WITH a AS (SELECT doc_id, regexp_replace(text, '\.', ' [S1].', 'g') || ' [S9] [S2]' AS t FROM documents),
c AS (SELECT doc_id, {_STRIP.format("regexp_replace(replace(t, '[S9]', ''), ' +', ' ', 'g')")} AS text FROM a)
SELECT doc_id, md5(text) AS cleaned_md5, '[S9]' AS dropped, contains(text, '[S1]') AS cites_first,
  len(list_filter({_SENTENCES}, lambda s: len(list_filter(string_split_regex(lower(s), '\s+'), lambda t: t <> '')) >= 5 AND NOT regexp_matches(lower(s), '{_FRAMING}') AND NOT regexp_matches(s, '\[S\d+\]'))) AS unsupported
FROM c""")
def citation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On texts whose sentences cite [S1], closed by one marker too many; there are two hits."""
    answers = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.regexp_replace("text", r"\.", " [S1]."), F.lit(" [S9] [S2]")).alias("answer"), F.array(F.lit("a"), F.lit("b")).alias("hits"))
    v = citations.validate(answers)
    return v.select("doc_id", F.md5(F.col("cleaned").cast("binary")).alias("cleaned_md5"), F.array_join("dropped", ",").alias("dropped"), F.map_contains_key("citations", F.lit("[S1]")).alias("cites_first"), F.size("unsupported").cast("long").alias("unsupported"))


_RULES = " ".join(f"WHEN regexp_matches(q, '{p}') THEN '{r.replace(chr(39), chr(39) * 2)}'" for p, r in safety.ADVICE_RULES)
_ASKED = "'Question: ' || CASE conv_id % 6 WHEN 0 THEN 'Should I stop? ' WHEN 1 THEN 'Can I take it? ' WHEN 2 THEN 'My doctor said so. ' WHEN 3 THEN 'Do I need this? ' WHEN 4 THEN 'What is known? ' ELSE 'I have it. ' END || text"


@query(f"SELECT conv_id, turn, CASE {_RULES} END AS reason FROM (SELECT conv_id, turn, lower({_ASKED}) AS q FROM conversations WHERE role = 'user')")
def safety_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On user turns behind openings that some of the rules know."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("q", F.expr(_ASKED))
    return asked.select("conv_id", "turn", safety.screen(F.col("q"))["reason"].alias("reason"))


@query("""
WITH h AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank, lang FROM documents)
SELECT source, md5(string_agg('Document [' || rank || '] (Title: ' || lang || ') ' || text, chr(10) ORDER BY rank)) AS context_md5,
       md5(string_agg('[S' || (rank + 1) || '] (Textbook - ' || lang || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS evidence_md5 FROM h WHERE rank < 8 GROUP BY source""")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context and evidence blocks of each source's first eight documents (a top list)."""
    at = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    top = table(spark, sf_dir, "documents").withColumn("rank", at).filter("rank < 8")
    hit = F.struct("rank", F.col("lang").alias("title"), F.col("text").alias("content"), F.lit("textbook").alias("source_type"), F.col("lang").alias("document"), F.lit(None).cast("string").alias("section"), "text")
    lists = top.groupBy("source").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    context = F.array_join(T.context_lines(F.col("hits")), "\n")
    return lists.select("source", F.md5(context.cast("binary")).alias("context_md5"), F.md5(T.evidence(F.col("hits")).cast("binary")).alias("evidence_md5"))


@query(r"SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')[1:50], ' ')) AS cut FROM documents")
def token_budget_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.truncate_tokens(F.col("text"), 50).cast("binary")).alias("cut"))


@query("""
SELECT conv_id, string_agg(lpad((turn + 1)::VARCHAR, 6, '0') || '. ' || text, chr(10) ORDER BY turn) AS options FROM conversations GROUP BY conv_id""")
def options_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options by number out of all of a conversation's turns."""
    entry = F.struct(F.lpad((F.col("turn") + 1).cast("string"), 6, "0").alias("k"), "text")
    maps = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(entry)).alias("o"))
    return maps.select("conv_id", T.options_block(F.col("o")).alias("options"))


@query("""
WITH p AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - CASE WHEN first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'system' THEN 1 ELSE 0 END AS n FROM conversations)
SELECT conv_id, coalesce(bool_and(role = CASE WHEN n % 2 = 1 THEN 'user' ELSE 'assistant' END) FILTER (n > 0), TRUE) AS alternates FROM p GROUP BY conv_id""")
def role_alternation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chats(spark, sf_dir).select("conv_id", T.alternates(F.col("chat")).alias("alternates"))


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("c"))
    return chats.select("conv_id", F.transform("c", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("chat"))


@query(rf"""
WITH s AS (SELECT conv_id, max(CASE WHEN turn = 0 AND role = 'system' THEN text END) AS sys, bool_or(turn = 0 AND role = 'system') AS has FROM conversations GROUP BY 1),
t AS (SELECT c.conv_id, role, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS n, turn, sys, text FROM conversations c JOIN s USING (conv_id) WHERE NOT (turn = 0 AND role = 'system')),
b AS (SELECT conv_id, turn, role, {_STRIP.format("CASE WHEN n = 1 AND sys IS NOT NULL THEN sys || chr(10) || chr(10) || text ELSE text END")} AS body FROM t)
SELECT conv_id, md5('<s>' || string_agg(CASE WHEN role = 'user' THEN '[INST] ' || body || ' [/INST]' ELSE body || '</s>' END, '' ORDER BY turn)) AS prompt_md5 FROM b GROUP BY conv_id""")
def conversation_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction-style prompts of whole conversations."""
    return _chats(spark, sf_dir).select("conv_id", F.md5(T.chat_template(F.col("chat")).cast("binary")).alias("prompt_md5"))


@query("""
WITH u AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply, role FROM conversations)
SELECT conv_id, md5(string_agg('Query: ' || text || chr(10) || 'Answer: ' || reply, chr(10) || chr(10) ORDER BY turn)) AS context_md5, max(turn) AS last_round FROM u WHERE role = 'user' AND reply IS NOT NULL GROUP BY conv_id""")
def round_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a round's searches add to the context, and the last that found anything; user turns as queries, the turns behind them as what was found."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("found", F.lead("text").over(turns)).filter("role = 'user'")
    more = answer.round_context(rows.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("at"), F.col("text").alias("question"), "found"))
    return more.select(F.col("question_id").alias("conv_id"), F.md5(F.col("more").cast("binary")).alias("context_md5"), F.col("last").alias("last_round"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::BIGINT AS batch FROM documents")
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.batch_number(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100).select("doc_id", "batch")


@query("SELECT source, lang, text_md5 FROM (SELECT source, lang, md5(text) AS text_md5, row_number() OVER (PARTITION BY source || lang ORDER BY doc_id DESC) AS n FROM documents) WHERE n = 1")
def keyed_upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat("source", "lang").alias("k"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return fusion.last_per_key(docs, "k", "doc_id").select("source", "lang", "text_md5")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS had FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)")
def incremental_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resumed output: it holds the labelled documents, then what is missing is appended, twice."""
    path, labelled, docs = scratch.fresh(spark, "resumed"), table(spark, sf_dir, "labels").select("doc_id").distinct(), table(spark, sf_dir, "documents").select("doc_id")
    labelled.withColumn("had", F.lit(True)).write.parquet(path)
    for _ in range(2):
        tables.write_missing(docs.withColumn("had", F.lit(False)), path, "doc_id")
    return spark.read.parquet(path).select("doc_id", "had")


@query("SELECT lang, count(*) AS n, list_aggregate(list_sort(list_distinct(list(source))), 'string_agg', ',') AS files FROM documents GROUP BY lang")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a sample: a row a source of it, here the language."""
    made = sampling.manifest(table(spark, sf_dir, "documents"), "lang", "source", "doc_id", 1508)
    return spark.createDataFrame([(k, v["count"], ",".join(v["files"])) for k, v in made["sources"].items()], "lang string, n long, files string")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 3")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.most_frequent(table(spark, sf_dir, "documents"), "source", 3)


_DRAW = "md5({0} || '|1508')"
_UNIT = "(('0x' || left(" + _DRAW + ", 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query(f"""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW.format('doc_id')}, doc_id) AS n FROM documents)
WHERE n <= 200 // (SELECT count(DISTINCT lang) FROM documents)""")
def source_balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced(table(spark, sf_dir, "documents").select("doc_id", "lang"), 200, "lang", "doc_id")


@query(f"""
WITH f AS (SELECT source AS path, sum(n_chars)::BIGINT AS size FROM documents GROUP BY source),
s AS (SELECT *, sum(size) OVER (ORDER BY {_UNIT.format('path')}) AS hi FROM f),
d AS (SELECT {_UNIT.format('id')} * (SELECT sum(size) FROM f) AS place FROM range(100) r(id))
SELECT f.path, f.size, (SELECT count(*) FROM d, s WHERE s.path = f.path AND place >= hi - s.size AND place < hi) AS slots FROM f""")
def size_proportional_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("path")).agg(F.sum("n_chars").alias("size"))
    return sampling.size_slots(files, 100).select("path", "size", "slots")


@query()
def recursive_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_documents(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


_SECTIONS = [*evaluate.QUESTIONS, "Introduction"]


@query(f"""
WITH c AS (SELECT doc_id, text, 'Topic ' || lang || (doc_id % 50) AS document, {_SECTIONS!r}[doc_id % 10 + 1] AS section FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY document, section ORDER BY doc_id) AS n FROM c WHERE section <> 'Introduction')
SELECT replace({[*evaluate.QUESTIONS.values()]!r}[list_position({_SECTIONS!r}, section)], '{{}}', lower(document)) AS question, doc_id AS chunk_id, md5(text) AS reference_md5, document, section
FROM f WHERE n = 1 ORDER BY doc_id LIMIT 400""")
def gold_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from templates by section; documents stand for chunks, sections and topics go by their number."""
    section = F.element_at(F.array(*map(F.lit, _SECTIONS)), (F.col("doc_id") % 10 + 1).cast("int"))
    topic = F.concat(F.lit("Topic "), "lang", (F.col("doc_id") % 50).cast("string"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.lit("statpearls").alias("source_type"), topic.alias("document"), section.alias("section"))
    return evaluate.gold_set(chunks, limit=400).select("question", "chunk_id", F.md5(F.col("reference").cast("binary")).alias("reference_md5"), "document", "section")


@query(f"SELECT item_id, '{prompts.SYSTEM_EVIDENCE.replace(chr(39), chr(39) * 2)}' AS system, 'Documents:' || chr(10) || text AS user FROM benchmark")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = T.messages(("system", F.lit(prompts.SYSTEM_EVIDENCE)), ("user", F.concat(F.lit("Documents:\n"), "text")))
    rows = table(spark, sf_dir, "benchmark").select("item_id", chat.alias("m"))
    return rows.select("item_id", F.get("m", F.lit(0))["content"].alias("system"), F.get("m", F.lit(1))["content"].alias("user"))


_XML = r"replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""
SELECT doc_id || '_0' AS id, lang || ' -- ' || source AS title, md5({_STRIP.format('text')}) AS content_md5, md5(lang || ' -- ' || source || '. ' || {_STRIP.format('text')}) AS contents_md5
FROM documents WHERE {_STRIP.format('text')} <> ''""")
def article_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of sectioned articles; each document is an article of one section and paragraph."""
    files = table(spark, sf_dir, "documents").filter(T.strip(F.col("text")) != "").select(
        F.col("doc_id").cast("string").alias("name"),
        F.concat(F.lit("<article><front><title>"), "lang", F.lit("</title></front><sec><title>"), "source", F.lit("</title><p>"), F.expr(_XML.format("text")), F.lit("</p></sec></article>")).alias("xml"),
    )
    made = chunking.article_chunks(files)
    return made.select("id", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.md5(F.col("contents").cast("binary")).alias("contents_md5"))


def _digest_of_prompt():
    return lambda chat: hashlib.md5(chat[-1]["content"].encode()).hexdigest()


@query(rf"""
WITH q AS (SELECT conv_id, text AS question FROM conversations WHERE turn = 0),
s AS (SELECT conv_id, string_agg('Document [' || i || '] (Title: ' || role || ') ' || text, chr(10) ORDER BY i) AS lines
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE turn > 0) GROUP BY conv_id),
c AS (SELECT conv_id, question, array_to_string(list_filter(string_split_regex(coalesce(lines, ''), '\s+'), lambda t: t <> '')[1:64], ' ') AS context FROM q LEFT JOIN s USING (conv_id))
SELECT conv_id, md5('Documents:' || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. yes' || chr(10) || 'B. no' || chr(10) || chr(10) || 'Reply as JSON:') AS answer FROM c""")
def context_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a context cut to 64 tokens; the stand-in model replies with a digest of its prompt. Opening turns ask, the others are snippets."""
    rows = table(spark, sf_dir, "conversations").withColumn("question_id", F.col("conv_id"))
    options = F.create_map(F.lit("B"), F.lit("no"), F.lit("A"), F.lit("yes"))
    questions = rows.filter("turn = 0").select("question_id", F.col("text").alias("question"), options.alias("options"))
    snippets = rows.filter("turn > 0").select("question_id", F.col("turn").alias("rank"), F.col("role").alias("title"), F.col("text").alias("content"))
    got = answer.context_answers(questions, snippets, models.generator(_digest_of_prompt), 64)
    return got.select(F.col("question_id").alias("conv_id"), "answer")
