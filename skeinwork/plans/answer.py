"""Plans from questions to checked answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.functions import models
from skeinwork.functions import text as T
from skeinwork.operators import citations, dense, fusion, lexical, safety
from skeinwork.plans import prompts
from skeinwork.sources import tables
from skeinwork.sources.scratch import stage


def gated_answers(
    questions: DataFrame, corpus: DataFrame, chunks: DataFrame, generate: Callable[[Column], Column], k: int = 8, floor: float = 0.33, per_document: int = 3,
    encode: Callable[[Column], Column] | None = None, center: DataFrame | None = None, attribution_floor: float = 0.20,
) -> DataFrame:
    """question_id, question, answer, refused, abstained, grounded, hits, citations, attributions, dropped, unsupported, reason.

    questions: question_id, question, embedding; corpus: id, document, embedding (both centered);
    chunks: id, source_type, document, section, text. Refused questions and those without a hit never
    reach the model: they are filtered out before it and joined back.

    Claims without a marker are attributed to the hit that is closest to them in centered space, if that reaches
    `attribution_floor`: only they and their hits are encoded, by `encode`, about `center` (one row, `center`; see citations.attribute).
    attributions: array of sentence, marker, id, score. What no hit is close to is unsupported, and an answer is grounded if nothing is.
    Without an encoder no claim is attributed.
    """
    screened = questions.withColumn("refusal", safety.screen(F.col("question")))
    open_ = screened.filter(F.col("refusal").isNull())
    hits = dense.search(corpus, open_.select(F.col("question_id").alias("query_id"), "embedding"), k, floor, per_document, among=dense.over_fetch(k, per_document))
    texts = fusion.lookup(hits.select("query_id", "id", "score", "rank"), chunks.select("id", "source_type", "document", "section", "text"))
    lists = texts.groupBy(F.col("query_id").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "source_type", "document", "section", "text"))).alias("hits"))
    prompt = F.concat(F.lit("Passages:\n"), T.evidence(F.col("hits")), F.lit("\n\nQuestion: "), F.col("question"))
    asked = open_.join(lists, "question_id").withColumn("reply", generate(T.messages(("system", F.lit(prompts.SYSTEM_EVIDENCE)), ("user", prompt))))
    replies = asked.select("question_id", "reply", "hits")
    empty = F.array().cast(lists.schema["hits"].dataType)
    rows = screened.drop("embedding").join(replies, "question_id", "left").withColumn("hits", F.coalesce("hits", empty))
    refused = F.col("refusal").isNotNull()
    abstained = ~refused & (F.col("reply").isNull() | F.col("reply").contains(T.INSUFFICIENT))
    checked = citations.validate(rows.withColumn("answer", F.when(~refused & ~abstained, F.col("reply")).otherwise(F.lit(""))))
    checked = checked.withColumns({"refused": refused, "abstained": abstained})
    traced = _attributed(checked, encode, center, attribution_floor)
    said = F.when(F.col("refused"), F.col("refusal.message")).when(F.col("abstained"), F.lit(safety.ABSTENTION)).otherwise(F.col("cleaned"))
    return traced.select(
        "question_id",
        "question",
        T.with_disclaimer(said, safety.DISCLAIMER).alias("answer"),
        "refused",
        "abstained",
        (~F.col("refused") & ~F.col("abstained") & (F.size("unsupported") == 0)).alias("grounded"),
        "hits",
        "citations",
        "attributions",
        "dropped",
        "unsupported",
        F.col("refusal.reason").alias("reason"),
    )


def _attributed(checked: DataFrame, encode: Callable[[Column], Column] | None, center: DataFrame | None, floor: float) -> DataFrame:
    """Checked answers with attributions; unsupported keeps the claims that no hit is close to."""
    found_type = f"array<struct<sentence:string,marker:string,id:{checked.schema['hits'].dataType.elementType['id'].dataType.simpleString()},score:double>>"
    none = F.array().cast(found_type)
    if encode is None:
        return checked.withColumn("attributions", none)
    checked = stage(checked, "checked-answers")  # the model is asked once
    uncited = checked.filter((F.size("unsupported") > 0) & (F.size("hits") > 0)).select(F.col("question_id").alias("answer_id"), "unsupported", "hits")
    claims = uncited.select("answer_id", F.posexplode("unsupported").alias("sentence_no", "sentence"))
    places = uncited.select("answer_id", F.explode("hits").alias("h")).select("answer_id", "h.rank", "h.id", "h.text")
    passages = places.select("id", "text").distinct().withColumn("vector", encode(F.col("text")))  # once, however many answers they serve
    snippets = places.join(passages.select("id", "text", "vector"), ["id", "text"])
    best = citations.attribute(claims.select("answer_id", "sentence_no", encode(F.col("sentence")).alias("vector")), snippets.select("answer_id", "rank", "vector"), floor, center)
    named = claims.join(best.select("answer_id", "sentence_no", "rank", "score", "marker"), ["answer_id", "sentence_no"]).join(places.select("answer_id", "rank", "id"), ["answer_id", "rank"])
    listed = F.array_sort(F.collect_list(F.struct("sentence_no", "sentence", "marker", "id", "score")))
    traced = named.groupBy(F.col("answer_id").alias("question_id")).agg(listed.alias("traced"))
    close = F.transform(F.filter("traced", lambda t: t["marker"].isNotNull()), lambda t: F.struct(t["sentence"].alias("sentence"), t["marker"].alias("marker"), t["id"].alias("id"), t["score"].alias("score")))
    far = F.transform(F.filter("traced", lambda t: t["marker"].isNull()), lambda t: t["sentence"])
    joined = checked.join(traced, "question_id", "left")
    return joined.withColumns({"attributions": F.coalesce(close.cast(found_type), none), "unsupported": F.coalesce(far, "unsupported")}).drop("traced")


def _chat(form: str, **slots: Column) -> Column:
    system, user = prompts.FORMS[form]
    said = ("user", T.fill(user, **slots))
    return T.messages(("system", F.lit(system)), said) if system else T.messages(said)


def context_answers(
    questions: DataFrame, snippets: DataFrame | None, generate: Callable[[Column], Column], budget: int = 1024, model: str = "", cut: Callable[[Column], Column] | None = None,
    ids: DataFrame | None = None, texts: DataFrame | None = None, search: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Answers to questions (question_id, question, options map) with the context of snippets, or without any.

    A question's evidence is what comes first of: its snippets (question_id, rank, title, content); its ids (question_id, rank, id), whose
    title and content are looked up in texts (id, title, content); what `search` finds for it (questions -> question_id, rank, title, content).
    Without any of the three no context is asked for. `search` is called for questions that have neither snippets nor ids.
    The context is cut to `budget` words, or by `cut` (models.cutter, by the model's tokens); replies are single-spaced; the prompt's
    form goes by the model's name.
    """
    options = T.options_block(F.col("options"))
    found = _evidence(questions, snippets, ids, texts, search)
    if found is None:
        rows, chat = questions, _chat(prompts.form_for(model, False), context=F.lit(""), question=F.col("question"), options=options)
    else:
        lists = found.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "content"))).alias("snippets"))
        none = F.array().cast(lists.schema["snippets"].dataType)
        rows = questions.join(lists, "question_id", "left").withColumn("snippets", F.coalesce("snippets", none))
        lines = F.array_join(T.context_lines(F.col("snippets")), "\n")
        context = cut(lines) if cut is not None else T.truncate_tokens(lines, budget)
        chat = _chat(prompts.form_for(model, True), context=context, question=F.col("question"), options=options)
    return rows.withColumn("answer", T.collapse_space(generate(chat)))


def _evidence(questions: DataFrame, snippets: DataFrame | None, ids: DataFrame | None, texts: DataFrame | None, search: Callable[[DataFrame], DataFrame] | None) -> DataFrame | None:
    """question_id, rank, title, content by precedence, or None if there is no source of it."""
    columns, parts, open_ = ("question_id", "rank", "title", "content"), [], questions
    if snippets is not None:
        parts.append(snippets.select(*columns))
    if ids is not None:
        if texts is None:
            raise ValueError("ids are looked up in texts: give both")
        rest = ids.join(parts[0].select("question_id").distinct(), "question_id", "left_anti") if parts else ids
        parts.append(fusion.lookup(rest, texts.select("id", "title", "content")).select(*columns))
    if search is not None:
        for p in (snippets, ids):
            open_ = open_ if p is None else open_.join(p.select("question_id").distinct(), "question_id", "left_anti")
        parts.append(search(open_).select(*columns))
    return reduce(DataFrame.unionByName, parts) if parts else None


#: A retriever: questions (query_id, query) and a number of hits -> query_id, id, score; best first or, for distances, least first.
Retriever = Callable[[DataFrame, int], DataFrame]


def lexical_retriever(indexes: list[lexical.Index], **options) -> Retriever:
    """BM25 over one or more corpora; options as of lexical.bm25."""

    def run(questions: DataFrame, k: int) -> DataFrame:
        hits = reduce(DataFrame.unionByName, [lexical.bm25(i, questions, k, **options) for i in indexes])
        return hits.select("query_id", "id", F.round("score", 9).alias("score"))  # as ranked there, so equal texts tie here too

    return run


def dense_retriever(corpora: list[DataFrame], encode: Callable[[Column], Column], center: DataFrame | None = None, metric: str = "ip") -> Retriever:
    """Vectors of one or more corpora (id, document, embedding): questions are encoded, and centered where the corpora are."""

    def run(questions: DataFrame, k: int) -> DataFrame:
        asked = questions.select("query_id", encode(F.col("query")).alias("embedding"))
        asked = stage(dense.centered(asked, center) if center is not None else asked, "encoded-questions")  # the encoder is asked once
        return fusion.together([dense.search(c, asked, k, metric=metric).select("query_id", "id", "score") for c in corpora])

    return run


def find(questions: DataFrame, retrievers: dict[str, Retriever], texts: DataFrame | None = None, k: int = 32, rrf_k: int = 100) -> DataFrame:
    """From question texts (query_id, query) to ranked results in one call: query_id, id, score, rank (from 0), and the columns of
    texts (id, ...) if they are given; without, ids only.

    Every retriever searches all its corpora; several are fused, in the order of their names given. Blank questions find nothing.
    """
    asked = questions.filter(T.strip(F.col("query")) != "")
    wide = fusion.over_fetch(k) if len(retrievers) > 1 else k
    hits = retrieve({name: search(asked, wide) for name, search in retrievers.items()}, k=k, rrf_k=rrf_k).select("query_id", "id", "score", "rank")
    return hits if texts is None else fusion.lookup(hits, texts)


def retrieve(lists: dict[str, DataFrame], distances: frozenset[str] = frozenset(), k: int = 32, rrf_k: int = 100) -> DataFrame:
    """One ranking out of each retriever's hits over all corpora (query_id, id, score), in the order of the names given.

    One retriever: its own scores, best first (distances: least first). Several: reciprocal rank fusion.
    """
    merged = {name: fusion.merge_corpora(hits, ascending=name in distances) for name, hits in lists.items()}
    if len(merged) == 1:
        return next(iter(merged.values())).filter(F.col("rank") < k)
    wide = fusion.over_fetch(k)
    rows = [h.filter(F.col("rank") < wide).select(F.lit(i).alias("retriever"), "query_id", "id", "rank") for i, h in enumerate(merged.values())]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return fusion.reciprocal_rank_fusion(out, k, rrf_k)


@dataclass
class Rounds:
    """The tables of one run of `iterate` in a folder. A round counts once its `round-N` is whole, which is written last; a round that is
    run again writes its tables again."""

    spark: SparkSession
    path: str

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def last(self) -> tuple[int, DataFrame] | None:
        """Number and table of the last whole round, if there is one."""
        n = 0
        while tables.exists(self.spark, f"{self.path}/round-{n}/_SUCCESS"):
            n += 1
        return (n - 1, self.spark.read.parquet(f"{self.path}/round-{n - 1}")) if n else None

    def _all(self, name: str, schema: str) -> DataFrame:
        if not tables.exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def messages(self) -> DataFrame:
        """question_id, step, role, content: what was said, in order of the steps."""
        return self._all("messages", tables.MESSAGE + ", round int").drop("round")

    def errors(self) -> DataFrame:
        """question_id, round, place (reply, close, queries or answer), error."""
        return self._all("errors", "question_id string, place string, error string, round int").select("question_id", "round", "place", "error")

    def cache(self) -> DataFrame:
        """question_id, round (from 0, of those that searched), context: what sources.tables.resume takes."""
        held = self._all("contexts", "question_id string, context string, round int")
        return held.withColumn("round", F.row_number().over(Window.partitionBy("question_id").orderBy("round")) - 1)


def iterate(
    questions: DataFrame,
    generate: Callable[[Column], Column],
    answer: Callable[[DataFrame], DataFrame],
    save: Callable[[DataFrame, str], DataFrame] | None = None,
    n_rounds: int = 4,
    n_queries: int = 3,
    cached: DataFrame | None = None,
    run: Rounds | None = None,
) -> DataFrame:
    """Rounds of follow-up searches: question_id, answer, rounds, context of questions (question_id, question, options map).

    A round is one batch over the questions still open: a reply is asked for; its queries are answered
    by `answer` (query_id, question -> query_id, answer, and error if it has one) and added to the context; past the last round a
    reply that answers closes the question. At most n_rounds + 3 rounds; then the last reply stands.
    `save` writes a table and reads it back, which ends lineage. `cached` (question_id, context, left) resumes.

    With models.attempts for a model, a call that fails costs its question that step only: it is open again in the next round, a search
    whose query list or answer failed adds nothing. With `run` in place of `save` messages, errors and contexts are kept by round, and a run that
    was stopped goes on behind its last whole round.
    """
    keep = run.save if run is not None else save
    if keep is None:
        raise ValueError("iterate needs save or run")
    begun = run.last() if run is not None else None
    if begun is None:
        asked = T.fill("Here is the question:\n{{question}}\n\n{{options}}", question=F.col("question"), options=T.options_block(F.col("options")))
        state = questions.select("question_id", asked.alias("prompt"))
        if cached is not None:
            state = state.join(cached, "question_id", "left")
        else:
            state = state.withColumns({"context": F.lit(None).cast("string"), "left": F.lit(None).cast("long")})
        state = state.select(
            "question_id", "prompt", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("left", F.lit(n_rounds)).cast("long").alias("left"),
            F.lit("").alias("reply"), F.lit(None).cast("string").alias("answer"), F.lit(0).alias("rounds"),
        )
        begun = 0, keep(state, "round-0")
    first, state = begun
    for i in range(first, n_rounds + 3):
        open_ = state.filter(F.col("answer").isNull() & (F.col("left") + 3 > i))
        if not open_.limit(1).count():
            break
        state = _round(i, state, open_, generate, answer, keep, run, n_queries)
    return state.select("question_id", F.coalesce("answer", "reply").alias("answer"), "rounds", "context")


def round_context(found: DataFrame) -> DataFrame:
    """question_id, more, last: what a round's searches (question_id, at, question, found) add to the context, in order, and the last `at` that
    adds to it; those that found nothing add nothing."""
    said = F.concat(F.lit("Query: "), "question", F.lit("\nAnswer: "), "found")
    rows = found.filter(F.col("found").isNotNull()).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("at", said.alias("s")))).alias("s"), F.max("at").alias("last"))
    return rows.select("question_id", F.array_join(F.transform("s", lambda x: x["s"]), "\n\n").alias("more"), "last")


def _round(i: int, state: DataFrame, open_: DataFrame, generate: Callable, answer: Callable, keep: Callable, run: Rounds | None, n_queries: int) -> DataFrame:
    """The state behind round i."""
    late = F.col("left") <= i
    system = F.lit(prompts.FOLLOW_UP_SYSTEM)
    user = F.concat_ws("\n\n", F.nullif("context", F.lit("")), "prompt", F.when(late, F.lit(prompts.ANSWER)).otherwise(F.lit(prompts.ASK.replace("{{n}}", str(n_queries)))))
    replied = keep(models.told(open_.withColumn("user", user).withColumn("before", F.col("reply")), "reply", generate(T.messages(("system", system), ("user", F.col("user"))))), f"reply-{i}")
    heard, failed = replied.filter(F.col("reply").isNotNull()), replied.filter(F.col("reply").isNull()).withColumn("reply", F.col("before"))
    final = late & T.is_final(F.col("reply"))
    closing = T.messages(("user", F.col("user")), ("assistant", F.col("reply")), ("user", F.lit(prompts.AS_JSON)))
    closed = keep(models.told(heard.filter(final).drop("answer"), "answer", generate(closing)), f"closed-{i}")
    going = heard.filter(~final)
    lists = going.filter(T.asks_queries(F.col("reply"))).select("question_id", "reply")
    lists = keep(models.told(lists, "list", generate(T.messages(("user", T.fill(prompts.EXTRACT, reply=F.col("reply"))))))
                 .withColumn("queries", T.parse_queries(F.col("list"))).drop("reply"), f"lists-{i}")
    each = lists.select("question_id", F.posexplode("queries").alias("at", "q")).filter(T.strip(F.col("q")) != "")
    numbered = keep(each.select(F.concat_ws("#", "question_id", F.lit(i), "at").alias("query_id"), "question_id", "at", F.col("q").alias("question")), f"queries-{i}")
    got = answer(numbered.select("query_id", "question"))
    problem = F.col("error").cast("string") if "error" in got.columns else F.lit(None).cast("string")
    found = keep(got.select("query_id", F.col("answer").alias("found"), problem.alias("error")), f"answers-{i}")
    texts = round_context(numbered.join(found, "query_id"))
    grown = going.join(texts, "question_id", "left").withColumn("context", F.concat_ws("\n\n", F.nullif("context", F.lit("")), "more"))
    columns = state.columns
    parts = [df.withColumn("rounds", F.lit(i + 1)).select(*columns) for df in (closed, grown, failed)]
    done = state.join(open_.select("question_id"), "question_id", "left_anti").select(*columns)
    after = done.unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[2])
    if run is not None:
        named = lambda df, step, role, text: df.select("question_id", F.lit(step).alias("step"), F.lit(role).alias("role"), text.alias("content"))
        talk = [named(replied, 4 * i + 1, "user", F.col("user")), named(heard, 4 * i + 2, "assistant", F.col("reply"))]
        talk += [named(closed, 4 * i + 3, "user", F.lit(prompts.AS_JSON)), named(closed.filter(F.col("answer").isNotNull()), 4 * i + 4, "assistant", F.col("answer"))]
        talk += [named(open_, 0, "system", system)] * (i == 0)
        keep(reduce(DataFrame.unionByName, talk), f"messages/round={i}")
        wrong = lambda df, place, error: df.select("question_id", F.lit(place).alias("place"), error.alias("error")).filter(F.col("error").isNotNull())
        unread = F.coalesce("list_error", F.when(F.col("queries").isNull(), F.lit("the reply holds no list of queries")))
        trouble = [wrong(replied, "reply", F.col("reply_error")), wrong(closed, "close", F.col("answer_error")), wrong(lists, "queries", unread)]
        trouble += [wrong(numbered.join(found, "query_id"), "answer", F.col("error"))]
        keep(reduce(DataFrame.unionByName, trouble), f"errors/round={i}")
        keep(grown.join(lists.filter(F.col("queries").isNotNull()), "question_id", "left_semi").select("question_id", "context"), f"contexts/round={i}")
    return keep(after, f"round-{i + 1}")
