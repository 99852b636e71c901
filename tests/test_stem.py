"""Porter stems of the published examples, the slot for them in the index, token budgets and XML records."""

import random

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import models
from skeinwork.functions import text as T
from skeinwork.functions.stem import porter, stems
from skeinwork.operators import chunking, lexical
from skeinwork.sources import tables

#: The algorithm's published examples, after all steps.
EXAMPLES = dict(
    pair.split(":")
    for pair in (
        "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size"
        " hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc"
        " hesitanci:hesit digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper"
        " feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal"
        " electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens"
        " irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ angulariti:angular homologous:homolog"
        " effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll is:is a:a"
    ).split()
)


@pytest.mark.parametrize("word", sorted(EXAMPLES))
def test_examples(word):
    assert porter(word) == EXAMPLES[word]


def test_stems_in_an_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "The ponies hopping, hopped"), (2, None), (3, "A pony")], "id int, text string")
    analyze = T.analyzer(T.STOP_WORDS, stem_all=stems)
    assert [r[0] for r in df.orderBy("id").select(analyze(F.col("text"))).collect()] == [["poni", "hop", "hop"], None, ["poni"]]
    lexical.write_index(df, f"{tmp_path}/i", analyze=analyze)
    got = lexical.bm25(lexical.open_index(spark, f"{tmp_path}/i"), spark.createDataFrame([(7, "hops of a pony")], "query_id int, query string"), analyze=analyze)
    assert [r["id"] for r in got.orderBy("rank").collect()] == [1, 3]


def _pairs():
    """Tokens of two characters, white space between words in none."""
    return lambda text: [(i, min(i + 2, len(text))) for i in range(0, len(text), 2) if not text[i : i + 2].isspace()]


def test_budget_of_a_models_tokens(spark):
    df = spark.createDataFrame([("abcdefg",), ("ab",), ("",), (None,), ("a  b  c d",)], "t string")
    cut = {n: [r[0] for r in df.select(models.cutter(_pairs, n)(F.col("t"))).collect()] for n in (0, 2, 100)}
    assert cut[2] == ["abcd", "ab", "", None, "a  b"] and cut[100] == ["abcdefg", "ab", "", None, "a  b  c d"] and cut[0] == ["", "", "", None, ""]


def test_budget_of_a_byte_pair_tokenizer(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")

    def make():
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: t.encode(text, add_special_tokens=False).offsets

    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect() if r["text"]]
    places = make()
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(models.cutter(make, 50)(F.col("t"))).collect()]
    for text, part in zip(texts, got):
        assert text.startswith(part) and (len(places(part)) <= 51 or part == text) and (part == text) == (len(places(text)) <= 50)


def test_xml_records_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    records = [f'<PubmedArticle>\n<PMID Version="1">{i}</PMID><Article><ArticleTitle>Title {i}</ArticleTitle>' + f"<AbstractText>{'word ' * rng.randint(0, 60)}</AbstractText>" * rng.randint(0, 2) + "</Article></PubmedArticle>" for i in range(3000)]
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><Set>' + "\n".join(records) + "</Set>\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = tables.read_xml_records(spark, str(tmp_path), "*.xml")
        assert rows.rdd.getNumPartitions() > 4
        assert rows.agg(F.max(F.length("xml"))).first()[0] < 2000 and rows.count() == 3001
        got = chunking.citation_chunks(rows).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = chunking.citation_chunks(tables.read_whole_xml(spark, str(tmp_path), "*.xml")).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole)) and len(got) > 1000
