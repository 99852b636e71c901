"""Language ID, HTML extraction, decontamination and packing."""

import html.parser
import random
import time
import zlib

import numpy as np
import pytest
from conftest import *  # noqa: F403
from pyspark.sql import functions as F

from skeinwork.llm import decontam, htmltext, langid, packing, queries

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.98 and all(0 <= r["score"] <= 1 for r in got)


def test_language_cases(spark, docs, no_docs):
    model = langid.fit(spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "xx"), ("123", "yy")], "text string, lang string"), "text", "lang")
    assert model.languages == ["en", "fr"]
    rows = spark.createDataFrame([("the dog",), ("le chien",), (None,), ("",), ("12 34!",), ("the " * 200_000,)], "text string")
    assert [r["lang_pred"] for r in langid.predict(rows.coalesce(1), model).collect()] == ["en", "fr", "und", "und", "und", "en"]
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(no_docs, "text", "lang")).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0


def test_copies_do_not_crowd_out_a_language(spark):
    texts = [(f"text number {i}",) for i in range(200)]
    placed = [r["t"] for r in spark.createDataFrame(texts, "t string").orderBy(F.pmod(F.xxhash64("t"), F.lit(1 << 30))).collect()]
    rows = [(placed[0], "aa")] * 100 + [(t, "aa") for t in placed[1:6]] + [(placed[-1], "zz")]
    bounds = langid.Bounds(per_class=3)
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", bounds)
    assert model.languages == ["aa", "zz"]
    assert (model.scores([placed[-1]]).argmax(axis=1) == 1).all()


def test_repeated_rows_do_not_hide_languages(spark):
    rows = [(f"an english text number {i}", "en") for i in range(400)] + [("un texte en français", "fr")] * 5000 + [("ein deutscher Text", "de")] * 5000
    assert langid.fit(spark.createDataFrame(rows, "text string, lang string"), "text", "lang").languages == ["de", "en", "fr"]


def test_many_languages_are_all_learned(spark):
    rows = [(f"{chr(0x4E00 + i) * 3} {k}", f"l{i:03}") for i in range(300) for k in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", langid.Bounds(sample=600, marks=300))
    assert len(model.languages) == 300 and all(model.languages[model.scores([t])[0].argmax()] == lang for t, lang in rows[::50])


def test_scores_are_kernel_ridge_regression():
    """With every text a landmark the scores are those of kernel ridge regression, solved here in full."""
    rng = random.Random(5)
    samples = {lang: [" ".join(rng.choice(words) for _ in range(6)) for _ in range(n)] for lang, words, n in (("a", ["abra", "caba", "rab"], 7), ("b", ["cabo", "orab", "bor"], 5), ("c", ["xyz", "zab"], 4))}
    model = langid.fit_texts(samples, langid.Bounds(landmarks=50, ridge=0.5))
    texts = [t for lang in "abc" for t in samples[lang]]

    def grams(t):
        t = f" {t} "
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    known = set().union(*map(grams, texts))

    def kernel(x, y):
        x, y = grams(x) & known, grams(y) & known
        return len(x & y) / (len(x) * len(y)) ** 0.5 if x and y else 0.0

    k = np.array([[kernel(x, y) for y in texts] for x in texts])
    sizes = np.array([len(samples[lang]) for lang in "abc" for _ in samples[lang]], float)
    target = np.array([[1.0 if own == lang else -1.0 for lang in "abc"] for own in "abc" for _ in samples[own]])
    alpha = np.linalg.lstsq(k + 0.5 * np.diag(sizes), target, rcond=None)[0]
    asked = texts + ["abra orab", "zab xyz caba", "bor"]
    want = np.array([[kernel(x, y) for y in texts] for x in asked]) @ alpha
    assert np.abs(model.scores(asked) - want).max() < 5e-3


def test_predict_replaces_columns(spark):
    model = langid.fit_texts({"en": ["the dog"], "fr": ["le chien"]})
    got = langid.predict(spark.createDataFrame([("the dog", "x", 7)], "text string, lang_pred string, score int"), model)
    assert got.columns == ["text", "lang_pred", "score"] and got.first()["lang_pred"] == "en"


def test_kernel_is_normalised_overlap():
    model = langid.fit_texts({"a": ["abc abd", "abx"], "b": ["zzy zyx", "yyz"]})
    f = model.features(["abc abd", "abd abc"])
    assert f[0, 0] == pytest.approx(1, abs=1e-5) and (f >= 0).all() and (f <= 1 + 1e-5).all()


PAGE = """<html><body class="has-sidebar"><nav><a href=x>home</a></nav><header>top</header><div class="cookie-notice">we use</div><article><h1>Head &amp; more</h1>
<p>One <b>two</b>three</p><div class="ad">buy</div><script>if (a<b) "</p>"</script><p>four<br>five&nbsp;six<ul><li>a<li>b</ul></article><section id="comments"><p>first!</section><footer>&copy;</footer>"""


def test_html_parse():
    page = htmltext.parse(PAGE)
    assert page.text(None) == "Head & more One twothree four five six a b"
    assert htmltext.parse("").text(None) == "" and htmltext.parse("plain  text").text(None) == "plain text"
    rng = random.Random(2)
    for _ in range(300):  # any cut or shuffled markup must be read to its end
        pieces = [PAGE[rng.randrange(len(PAGE)) :][: rng.randint(0, 60)] for _ in range(6)]
        htmltext.parse("".join(pieces)).text("/html/body")


def test_html_names_are_weights():
    body = "<p>" + "the story goes on " * 20 + "</p>"
    said = ("the story goes on " * 20).strip()
    for page in (
        f'<div class="content has-sidebar"><article>{body}</article></div>',
        f'<article class="post social">{body}</article><div class="social">follow us</div>',
        f'<div class="share wrapper"><div class="text">{body}</div></div><p>x</p>',
        f'<article><header><h1>Head</h1></header>{body}</article>',
        f'<div id="main-content" class="no-sidebar">{body}</div><div class="acme-sidebar"><p>other words</p></div><div class="related-posts"><p>more words</p></div>',
        f'<article>{body}</article><section class="comments"><article class="comment"><p>{"first of all, no. " * 200}</p></article></section>',
        f'<article>{body}<a class="share" href="x">share this</a><div class="ad-slot ads300x250">buy</div></article>',
    ):
        assert htmltext.parse(f"<html><body>{page}</body></html>").text(None) in (said, f"{said} x")


class PlainText(html.parser.HTMLParser):
    """Text of an article by the standard library's parser: unwanted elements by tag or whole class."""

    unwanted = {"nav", "header", "footer", "aside", "form", "script", "style", "comments", "ad", "sidebar", "cookie-notice", "share", "breadcrumb"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.out.append(" ")
            return
        self.open.append((tag, bool({tag, *(dict(attrs).get("class") or "").split()} & self.unwanted)))
        self.out.append(" " if tag in htmltext._BLOCKS or self.open[-1][1] else "")

    def handle_endtag(self, tag):
        while self.open:
            t, bad = self.open.pop()
            self.out.append(" " if t in htmltext._BLOCKS or bad else "")
            if t == tag:
                break

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(bad for _, bad in self.open):
            self.out.append(data)


def test_html_against_a_plain_parser():
    rng = random.Random(8)

    def words(n):
        return " ".join(rng.choice(["alpha", "beta &amp; gamma", "d&eacute;lta", "1 &lt; 2", "omega\n  psi", "&#8212;", "x<b>y</b>z", '<a href="u">link</a>']) for _ in range(n))

    def noise():
        return rng.choice([f"<nav><ul><li><a href=x>{words(2)}</a></li></ul></nav>", f"<aside><p>{words(5)}</p></aside>", f"<script>if (a < b) {{ '<p>' }}</script>", f"<div class='ad'>{words(4)}</div>", f"<div class='share x'>{words(1)}</div>", f"<!-- {words(2)} <p> -->", "<form><input name=q><p>find</p></form>"])

    def block():
        return rng.choice([f"<p>{words(rng.randint(1, 30))}</p>", f"<h2>{words(3)}</h2>", f"<ul><li>{words(3)}</li><li>{words(2)}</li></ul>", f"<blockquote><p>{words(9)}</p></blockquote>", f"<p>{words(2)}<br>{words(2)}</p>", noise()])

    for _ in range(200):
        main = "".join(block() for _ in range(rng.randint(2, 12))) + f"<p>{words(60)}</p>"
        page = f"<html><head><title>{words(2)}</title><style>p {{}}</style></head><body class='has-sidebar'><header><h1>{words(2)}</h1></header>{noise()}<div class='layout-sidebar'><article class='post'>{main}</article><div class='sidebar'><p>{words(8)}</p></div></div><section class='comments'><p>{words(40)}</p></section><footer>{words(6)}</footer></body></html>"
        plain = PlainText()
        plain.feed(page)
        assert htmltext.parse(page).text(None) == " ".join("".join(plain.out).split())


def test_very_long_page():
    page = "<article>" + "<p>some words here</p>" * 50_000 + "</article>"
    assert len(htmltext.parse(page).text(None)) == 50_000 * 16 - 1


def test_html_host_consensus(spark):
    page = "<body><div class='post-{i}'><p>{text}</p></div><div class='links'><p>{other}</p></div></body>"
    rows = [(i, "http://h/x", page.format(i=i, text="main words here " * 20, other="more")) for i in range(9)]
    rows += [(9, "http://h/y", page.format(i=9, text="short main", other="long list of other things " * 30)), (10, None, None), (11, "http://h/z", "<p>unlike"), (9, "http://h/y", "")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in htmltext.extract(df).collect()]
    assert (9, "short main") in got and (10, "") in got and (11, "unlike") in got and (9, "") in got and len(got) == len(rows)
    assert htmltext.extract(df.limit(0)).count() == 0


def edit_distance_within(p, t):
    before = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        row = [i]
        for j, b in enumerate(t, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(3, 12))) for i in range(10)] + [(50, "short"), (51, None), (52, "")]  # noqa: F405
    rows = [(0, None), (1, ""), (2, " ")]
    for i in range(3, 80):
        text, p = prose(rng, rng.randint(0, 30)), list(rng.choice(items[:10])[1])  # noqa: F405
        for _ in range(rng.randint(0, len(p) // 7)):
            k = rng.randrange(len(p))
            p[k : k + 1] = rng.choice([["q"], [], ["q", p[k]]])
        rows.append((i, f"{text}\n{''.join(p).upper()}  {text}" if rng.random() < 0.7 else text))
    rows.append((3, rows[3][1]))
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.annotate(df, bench).collect()
    assert len(got) == len(rows)
    for r in got:
        t = decontam.normal(r["text"])
        want = {i for i, p in items if p and len(decontam.normal(p)) >= decontam.Q and edit_distance_within(decontam.normal(p), t) <= decontam.edits_allowed(len(decontam.normal(p)))}
        assert {m["item"] for m in r["matches"]} == want
    assert decontam.clean(df, bench).columns == df.columns
    assert decontam.annotate(df, bench.limit(0)).filter("size(matches) > 0").count() == 0 and decontam.annotate(df.limit(0), bench).count() == 0


def test_decontamination_of_items_with_one_opening(spark):
    """Many items that share an opening, texts that repeat it: what is found is what brute force finds, in bounded time."""
    rng = random.Random(3)
    opening = prose(rng, 8)  # noqa: F405
    items = [(i, f"{opening} {prose(rng, rng.randint(4, 20))}") for i in range(60)]  # noqa: F405
    index = decontam.index_items([(i, decontam.normal(t)) for i, t in items])
    for _ in range(12):
        some = list(decontam.normal(rng.choice(items)[1]))
        for _ in range(rng.randint(0, len(some) // 9)):
            k = rng.randrange(len(some))
            some[k : k + 1] = rng.choice([["q"], [], ["q", some[k]]])
        text = decontam.normal(f"{opening} {prose(rng, 30)} {opening} {''.join(some)} {prose(rng, 9)} {opening}")  # noqa: F405
        want = {i for i, p in items if edit_distance_within(decontam.normal(p), text) <= decontam.edits_allowed(len(decontam.normal(p)))}
        assert {index.ids[k] for k, *_ in decontam.find(text, index)} == want
    many = decontam.index_items([(i, f"{opening} {prose(rng, 30)}") for i in range(1000)])  # noqa: F405
    text = f"{opening} {prose(rng, 3300)}"[:20_000]  # noqa: F405
    began = time.perf_counter()
    assert decontam.find(text, many) == [] and time.perf_counter() - began < 5


@pytest.mark.parametrize("hits", [50, 400])
def test_decontamination_of_crowded_runs(monkeypatch, hits):
    """Runs cut in two and items in groups give the same matches."""
    rng = random.Random(6)
    items = [(i, decontam.normal(prose(rng, 8))) for i in range(12)]  # noqa: F405
    text = decontam.normal(" ".join([prose(rng, 20), items[3][1], prose(rng, 150), items[7][1], items[3][1]]))  # noqa: F405
    want = decontam.find(text, decontam.index_items(items))
    assert {k for k, *_ in want} >= {3, 7}
    monkeypatch.setattr(decontam, "HITS", hits)
    assert decontam.find(text, decontam.index_items(items)) == want


def test_piece_distances_are_lower_bounds():
    rng = random.Random(7)
    for _ in range(30):
        patterns = ["".join(rng.choice("abcd") for _ in range(rng.choice([1, 9, 63, 64]))) for _ in range(5)]
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 90)))
        which = np.array([0, 1, 2, 3, 4, 0])
        start = np.array([rng.randint(0, len(text)) for _ in which])
        end = np.array([rng.randint(s, len(text)) for s in start])
        got = decontam._piece_distances([decontam.points(p) for p in patterns], which, decontam.points(text), start, end)
        assert got.tolist() == [edit_distance_within(patterns[w], text[s:e]) for w, s, e in zip(which, start, end)]


def test_decontamination_replaces_its_column(spark):
    df = spark.createDataFrame([(1, "x", "a text")], "doc_id long, matches string, text string")
    got = decontam.annotate(df, spark.createDataFrame([(1, "some item text")], "item_id long, text string"))
    assert got.columns == ["doc_id", "text", "matches"] and got.first()["matches"] == []


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, prose(rng, 10)) for i in range(4)]  # noqa: F405
    df = spark.createDataFrame([(i, f"a {p} b") for i, p in items], "doc_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK", 100)
    got = decontam.annotate(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: [m["item"] for m in r["matches"]] for r in got} == {i: [i] for i, _ in items}


def test_knapsack_and_plan():
    value, pattern = packing.knapsack(np.array([0.1, 0.3, 0.25, 0.5]), 7)
    assert value == pytest.approx(1.0) and pattern @ np.arange(1, 5) <= 7
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = rng.integers(0, 40, 16)
        plan = packing.solve(counts)
        assert (sum((p * n for p, n in plan), np.zeros(16, int)) == counts).all() and all(p @ np.arange(1, 17) <= 16 for p, _ in plan)
        bins: list[int] = []
        for size in np.repeat(np.arange(1, 17), counts)[::-1]:  # first fit by falling size
            k = next((k for k, room in enumerate(bins) if room >= size), None)
            if k is None:
                bins.append(16 - size)
            else:
                bins[k] -= size
        assert sum(n for _, n in plan) <= len(bins) + 4


def test_packing_round_trip(spark, docs, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    reference = Tokenizer.from_file(path)
    want = sorted((i or -1, tuple(reference.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in odd_docs)
    pieces = packing.cut(docs, path).collect()
    whole = {}
    for r in pieces:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        whole.setdefault((r["doc_id"], r["place"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    parts = docs.rdd.getNumPartitions()
    assert parts and sum(len(v) for v in whole.values()) == len(pieces)
    packed = packing.pack_documents(docs, path).collect()
    assert sum(r["length"] for r in packed) == sum(len(t) for _, t in want)
    assert sorted((r["ids_crc32"], r["start"], r["length"]) for r in packed) == sorted((r["ids_crc32"], r["start"], r["length"]) for r in pieces)
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert packing.pack_documents(no_docs, path).count() == 0


def test_word_tokens_match_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    reference, words = Tokenizer.from_file(path), packing.WordTokens(path)
    rng = random.Random(3)
    alphabet = [*"abcABC.,!#'<>|&;:?-_ \n\t\x1c\xa0éÉßİΣς½²٣日\u0301«»’12$", "'s", "'re", "<|endoftext|>", "ing", "the "]
    for _ in range(3000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert words(x).tolist() == reference.encode(x, add_special_tokens=False).ids, x


def test_a_language_of_long_texts_is_learned(spark):
    rng = random.Random(2)
    rows = [(i, ("the house and this other thing with them " * 800) + str(rng.random()), "en") for i in range(20)]
    rows += [(100 + i, f"le chat est dans une maison avec nous {rng.random()}", "fr") for i in range(20)]
    rows += [(200, "7" * 50_000 + " und der Hund ist nicht mit dabei", "de")]  # a stretch without a letter is not taken
    df = spark.createDataFrame(rows, "id long, text string, lang string").withColumn("__lang", F.lit("x"))
    model = langid.fit(df, "text", "lang")
    assert model.languages == ["de", "en", "fr"]
    got = {r["id"]: r for r in langid.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows) and got[0]["__lang"] == "x"
    lengths = df.select(F.length(langid.stretch(F.col("text"), 20_000)).alias("n")).collect()
    assert max(r["n"] for r in lengths) == 20_000


COMMENT_NAMES = "comments reviews feedback user-feedback responses discourse comentarios commentary conversation messages kommentare".split()


@pytest.mark.parametrize("name", COMMENT_NAMES)
def test_what_readers_say_is_left_out(name):
    article = "<article><h1>Title</h1>" + "<p>long words of the article go here and on</p>" * 20
    text = htmltext.parse(f"{article}<div class={name}><p>nice post</p></div></article>").text(None)
    assert "nice" not in text and text.startswith("Title long words") and text.count("article go") == 20


def test_names_an_article_may_have():
    page = "<body><nav>menu</nav><div class=review>" + "<p>long words of the article go here and on</p>" * 20 + "</div></body>"
    assert htmltext.parse(page).text(None).count("article go") == 20


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep text" + "</div>" * 100_000, "<div>" * 3000 + "</span>" * 30_000 + "</p>" * 30_000 + "deep text", "<ul><li>" * 20_000 + "deep text"])
def test_depth_is_linear(page):
    began = time.perf_counter()
    got = htmltext.parse(page)
    assert got.text(got.path(got.best())) == "deep text" and time.perf_counter() - began < 5
    assert all(len(got.path(i)) < 1000 for i in range(0, len(got.paths), 997))


def test_whole_query_against_plain_votes(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rng = random.Random(3)
    for i in range(120):
        main = " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randint(5, 60)))
        side = " ".join(rng.choice("one two three".split()) for _ in range(rng.randint(0, 90)))
        rows.append((10_000 + i, f"https://H{i % 4}.example/p{i}", f"<body><nav>m</nav><div class=main{i % 3}><p>{main}</p></div><div class=extra><p>{side}</p></div><div class=comments>x</div></body>"))
    rows += [(20_000, None, None), (20_001, "http://h0.example/", ""), (20_002, None, "<p>no host</p>")]

    def host(url):
        return "" if not url or "://" not in url else url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0].lower()

    votes = {}
    for _, url, page in rows:
        parsed = htmltext.parse(page or "")
        k = parsed.best()
        if parsed.scores[k] > 0:
            n = votes.setdefault(host(url), {}).setdefault(parsed.path(k), [0, 0.0])
            n[0] += 1
            n[1] += parsed.scores[k]
    best = {h: max((n, float(round(total)), p) for p, (n, total) in v.items())[2] for h, v in votes.items()}
    want = {i: (url, htmltext.parse(page or "").text(best.get(host(url)))) for i, url, page in rows}
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string").repartition(5)
    assert {r["page_id"]: (r["url"], r["text"]) for r in htmltext.extract(df).collect()} == want
    assert any(want[10_000 + i][1] != htmltext.parse(rows[-123 + i][2]).text(None) for i in range(120))
