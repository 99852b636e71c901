from pyspark.sql import functions as F

from skeinwork import config
from skeinwork.functions import text as T
from skeinwork.operators import chunking, safety


def one(spark, expression, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("zero")).select(expression.alias("x")).first()["x"]


def test_join_title(spark):
    assert one(spark, T.join_title(F.lit(" A title "), F.lit(" text "))) == "A title. text"
    assert one(spark, T.join_title(F.lit("Why?"), F.lit("text"))) == "Why? text"
    assert one(spark, T.ends_sentence(F.lit("a.\n"))) is False


def test_encoder_input(spark):
    assert one(spark, T.encoder_input("separated", F.lit("t"), F.lit("c"))) == "t[SEP]c"
    assert one(spark, T.encoder_input("dotted", F.lit("Why?"), F.lit("c"))) == "Why? c"
    assert one(spark, T.encoder_input("dotted", F.lit("End."), F.lit("c"))) == "End. c"
    assert one(spark, T.encoder_input("pair", F.lit("t"), F.lit("c"))) == ["t", "c"]
    assert T.encoder_style("ncbi/MedCPT-Query-Encoder") == "pair"
    assert T.article_encoder("ncbi/MedCPT-Query-Encoder") == "ncbi/MedCPT-Article-Encoder"


def test_reference_marks(spark):
    assert one(spark, T.drop_reference_marks(F.lit("Known [7]. Also [1, 2] , and  more [S1]."))) == "Known. Also, and more [S1]."


def test_split_title(spark):
    got = [tuple(one(spark, T.split_title(F.lit(t)))) for t in ("A -- B", "A -- B -- C", "A-B", "A", "A -- ")]
    assert got == [("A", "B"), ("A", "B -- C"), ("A-B", None), ("A", None), ("A", None)]


def test_tokens_and_space(spark):
    assert one(spark, T.token_estimate(F.lit("  a  b c "))) == 3
    assert one(spark, T.collapse_space(F.lit("a \n b"))) == "a b"
    assert one(spark, T.truncate_tokens(F.lit("a  b c d"), 2)) == "a b"


def test_blocks(spark):
    options = F.create_map(F.lit("B"), F.lit("two"), F.lit("A"), F.lit("one"))
    assert one(spark, T.options_block(options)) == "A. one\nB. two"
    assert one(spark, T.options_block(F.lit(None).cast("map<string,string>"))) == ""
    hit = F.struct(F.lit(0).alias("rank"), F.lit("statpearls").alias("source_type"), F.lit("D").alias("document"), F.lit("S").alias("section"), F.lit("body").alias("text"), F.lit("t").alias("title"), F.lit("c").alias("content"))
    assert one(spark, T.evidence(F.array(hit))) == "[S1] (StatPearls - D - S)\nbody"
    assert one(spark, T.context_lines(F.array(hit))) == ["Document [0] (Title: t) c"]
    assert one(spark, T.context_lines(F.slice(F.array(hit), 1, 0))) == [""]


def test_sentences_and_claims(spark):
    assert one(spark, T.sentences(F.lit(" One. [S1] Two!  Three"))) == ["One.", "[S1] Two!", "Three"]
    text = "The disease affects many small airways. Based on the evidence this is known. Short one. It also harms the large airways [S1]."
    assert one(spark, T.uncited_claims(F.lit(text))) == ["The disease affects many small airways."]


def test_model_replies(spark):
    assert one(spark, T.parse_queries(F.lit('x {"output": ["1. a b", "c"]} y'))) == ["a b", "c"]
    assert one(spark, T.parse_queries(F.lit("nothing"))) is None
    assert one(spark, T.cut_at_stop(F.lit("a\n\n\nb###c"))) == "a"
    assert one(spark, T.is_final(F.lit("The Answer is B"))) and not one(spark, T.is_final(F.lit("no")))
    assert one(spark, T.asks_queries(F.lit("## Queries\n1. x"))) and not one(spark, T.asks_queries(F.lit("## Queries\n ")))
    assert one(spark, T.with_disclaimer(F.lit("a \n"), "D")) == "a\n\n---\nD"


def test_chat_template(spark):
    chat = T.messages(("system", F.lit("be brief")), ("user", F.lit(" hi ")), ("assistant", F.lit("yes")))
    assert one(spark, T.chat_template(chat)) == "<s>[INST] be brief\n\n hi [/INST]yes</s>"
    try:
        one(spark, T.chat_template(T.messages(("assistant", F.lit("x")))))
        raise AssertionError("roles out of turn must fail")
    except Exception as e:
        assert "alternate" in str(e)


def test_safety(spark):
    refused = ["Should I stop aspirin?", "Can I take ibuprofen with it?", "My doctor said I need it", "do i have asthma", "How much insulin should I take?"]
    passed = ["What is the dose of aspirin in adults?", "What causes asthma?", "What are signs of overdose?"]
    df = spark.createDataFrame([(q,) for q in refused + passed], "q string").select("q", safety.screen(F.col("q")).alias("r"))
    got = {r["q"]: r["r"] for r in df.collect()}
    assert all(got[q] for q in refused) and not any(got[q] for q in passed)
    assert got["How much insulin should I take?"]["matched_pattern"] == r"\bshould i\b"


def test_split_text():
    text = "\n\n".join(" ".join(f"word{i}" for i in range(n)) for n in (10, 200, 50, 400))
    pieces = chunking.split_text(text, 300, 60)
    assert all(len(p) <= 300 for p in pieces) and {w for p in pieces for w in p.split()} == set(text.split())
    assert chunking.split_text("", 300, 60) == [] and chunking.split_text("x" * 700, 300, 60)[0] == "x" * 300


ARTICLE = """<article><title>Asthma</title><sec><title>Etiology</title><p>{long}</p><p>short <i>one</i> here</p>
<p><bold>Triggers</bold></p><list><item><p>dust</p></item><item><p>cold</p></item></list><p>after</p></sec><sec><p>no title</p></sec></article>"""


def test_article_sections(spark):
    xml = ARTICLE.format(long="a " * 150)
    got = chunking.article_sections(xml, "f")
    assert [(c["id"], c["title"]) for c in got] == [("f_0", "Asthma -- Etiology"), ("f_1", "Asthma -- Etiology -- Triggers")]
    assert got[0]["content"].endswith("short one here") and got[1]["content"] == "dust cold after"
    rows = chunking.article_chunks(spark.createDataFrame([("f", xml)], "name string, xml string")).collect()
    assert [r["contents"] for r in rows] == [c["contents"] for c in got]


def test_citation_chunks(spark):
    xml = """<PMID Version="1">11</PMID><Article PubModel="x"><ArticleTitle>One.</ArticleTitle><AbstractText Label="a">p</AbstractText><AbstractText>q</AbstractText></Article>
<PMID>12</PMID><Article><ArticleTitle>None</ArticleTitle></Article>"""
    rows = chunking.citation_chunks(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert [tuple(r) for r in rows] == [("PMID:11", "One.", "p q", "One. p q")]


def test_normalize(spark):
    raw = spark.createDataFrame([("a", "Doc -- Sec", "body [1].", None), ("b", None, "x", "")], "id string, title string, content string, contents string")
    rows = {r["chunk_id"]: r for r in chunking.normalize(raw, "statpearls").collect()}
    assert rows["a"]["text"] == "Doc -- Sec. body." and (rows["a"]["document"], rows["a"]["section"]) == ("Doc", "Sec") and rows["a"]["token_estimate"] == 5
    assert rows["b"]["text"] == ". x"


def test_batch_number(spark):
    rows = chunking.batch_number(spark.range(1005).select(F.col("id").alias("k")), "k", 100).collect()
    assert {r["k"]: r["batch"] for r in rows} == {i: i // 100 for i in range(1005)}


def test_config(monkeypatch):
    assert config.window("gpt-4-32k") == (32768, 30000) and config.window("Llama-3.1-8B") == (131072, 128000) and config.window("other") == (2048, 1024)
    assert config.metric("allenai/specter") == "l2" and config.members(config.CORPORA, "MedText") == ("textbooks", "statpearls")
    monkeypatch.setenv("SKEINWORK_TOP_K", "5")
    assert config.Settings.from_env().top_k == 5
