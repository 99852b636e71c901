"""The jobs as registered queries: each runs its job twice into a folder of its own and gives what stands there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import index_corpus, study_corpus
from skeinwork.sources.scratch import scratch_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/skeinwork-jobs/{name}-{uuid.uuid4().hex}"


def job1_index_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "index")
    s = index_corpus.Settings(corpus=f"{sf_dir}/documents.parquet", output=f"{folder}/index", checkpoint=f"{folder}/checkpoint")
    for _ in range(2):
        index_corpus.index_corpus(spark, s)
    return index_corpus.output(spark, s).select("term", "doc_id", "tf", "length")


def job2_study_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = study_corpus.Settings(corpus=f"{sf_dir}/documents.parquet", output=_folder(spark, "study"), size=SIZE)
    for _ in range(2):
        study_corpus.study_corpus(spark, s)
    rows = study_corpus.output(spark, s)
    return rows.select("source", "chunk_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "document", "section", F.col("token_estimate").cast("long").alias("token_estimate"), "available", "drawn")


SIZE = 500

_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_SPACES = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_CLEAN = _SPACES.format(r"regexp_replace(regexp_replace(regexp_replace(c, '\s*\[\d+(\s*,\s*\d+)*\]', '', 'g'), '\s+([.,;:])', '\1', 'g'), '[ \t]{2,}', ' ', 'g')")

ORACLES = {
    "job1_index_corpus": f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), t AS (SELECT doc_id, len(ts) AS length, unnest(ts) AS term FROM d)
SELECT term, doc_id, count(*) AS tf, any_value(length)::BIGINT AS length FROM t GROUP BY term, doc_id""",
    "job2_study_corpus": rf"""
WITH a AS (SELECT doc_id::VARCHAR AS id, coalesce(source, 'none') AS source, lang, text FROM documents WHERE doc_id IS NOT NULL AND {_SPACES.format('text')} <> ''),
m AS (SELECT *, md5(id || '|1508') AS draw, row_number() OVER (PARTITION BY source ORDER BY md5(id || '|1508'), id) AS n FROM a),
e AS (SELECT {SIZE} // count(DISTINCT source) AS each FROM a),
o AS (SELECT m.* FROM m, e WHERE n <= each),
r AS (SELECT m.*, row_number() OVER (ORDER BY draw, id, source) AS place FROM m, e WHERE n > each),
s AS (SELECT id, source, lang, text FROM o UNION ALL SELECT id, source, lang, text FROM r WHERE place <= {SIZE} - (SELECT count(*) FROM o)),
c AS (SELECT *, source || ' -- ' || lang || '. ' || {_SPACES.format('text')} AS c FROM s)
SELECT c.source, id AS chunk_id, md5({_CLEAN}) AS text_md5, source AS document, lang AS section, len(list_filter(string_split_regex(c, '\s+'), lambda t: t <> ''))::BIGINT AS token_estimate,
  (SELECT count(DISTINCT id) FROM a WHERE a.source = c.source) AS available, (SELECT count(*) FROM s WHERE s.source = c.source) AS drawn FROM c""",
}

QUERIES = {"job1_index_corpus": job1_index_corpus, "job2_study_corpus": job2_study_corpus}
