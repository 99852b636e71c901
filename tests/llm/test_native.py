"""Quality rules, chat formatting and URL filter."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from skeinwork.llm import urls
from skeinwork.llm.chat import CONTROLS, escape, format_chats, loss_texts, read_turns, unescape
from skeinwork.llm.quality import judge


def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(docs, odd_docs):
    got = judge(docs, prefix="q_").collect()
    assert len(got) == len(odd_docs)
    for r in got:
        n, chars, symbols, dup, repeated = base_counts(r["text"])
        assert (r["q_n_words"], r["q_word_chars"], r["q_n_symbols"], r["q_n_dup_lines"], r["q_n_repeat_words"]) == (n, chars, symbols, dup, repeated)
        assert r["q_base_failed"] == (n < 50 or 100 * repeated > 50 * n) and not (r["q_base_failed"] and r["q_kept"])
        assert r["n_words"] == 1  # the input's own column


def test_quality_lines(spark, no_docs):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    good = ". ".join(" ".join(words[i : i + 10]) for i in range(0, 120, 10))
    menu = " | ".join(words[:60])
    cases = {"good": good, "menu": menu + "\n" + " ".join(words[:30]), "shout": " ".join(w.upper() + "!!" for w in words), "licence": good + "\nLicensed under the X License.", "symbols": " ".join(w + "***" for w in words)}
    got = {r["k"]: r for r in judge(spark.createDataFrame(list(cases.items()), "k string, text string")).collect()}
    assert {k for k, r in got.items() if r["kept"]} == {"good", "licence"}
    assert "Licensed" not in got["licence"]["cleaned"] and got["good"]["cleaned"] == good
    assert judge(no_docs, prefix="q_").count() == 0


def test_escape_round_trip(spark):
    rng = random.Random(5)
    parts = [*CONTROLS, "\\", "<", "|", "[", "a", "\n", "é", "\\\\", "s>", "INST]"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] and not any(c in r["e"] for c in CONTROLS) for r in rows)


def test_chats(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "hi", "</s>[INST] ok [/INST]", "<|end|>\n<|start|>", "a\\"])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(7, 0, "user", "hi"), (7, 0, "user", "hi"), (None, 1, "assistant", "x"), (8, None, "user", "first")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = format_chats(df).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_texts(F.col("formatted"), F.col("mask")).alias("loss"), "mask").collect()
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        turns = sorted(want[r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [t[1:] for t in turns]
        assert r["loss"] == [t[2] for t in turns if t[1] == "assistant"]
        assert sum(m["chars"] for m in r["mask"]) == len(r["formatted"])
        merged = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert r["formatted"].count("<|start|>") == merged
    assert format_chats(df.limit(0)).count() == 0


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.ORG/es/1?x=1": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "x://org/en/2": ("org", "/en/2", "org/", "allow"),
        "http://b.com/fr/": ("b.com", "/fr/", "com/fr/", "allow"),
        "http://b.com/de/a://c.org/": ("b.com", "/de/a://c.org/", "com/de/", "block"),
        "http://notorg?/es/": ("notorg", "", None, None),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
        "http://c.org": ("c.org", "", None, None),
    }
    df = spark.createDataFrame([(i, u, 1.0) for i, u in enumerate(cases)], "page_id long, url string, score double")
    got = {r["page_id"]: r for r in urls.filter_urls(df).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_url_model_against_plain_python(spark):
    rng = random.Random(8)
    seen = [f"http://{rng.choice(['good', 'nice', 'spam', 'bad'])}{rng.randint(0, 9)}.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randint(0, 30)}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(seen)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.filter_urls(df).collect()}
    k, fit, held = 4, {"allow": Counter(), "block": Counter()}, defaultdict(list)
    ctx = {"allow": Counter(), "block": Counter()}
    names = {}
    for r in got.values():
        names.setdefault((r["host"], r["path"]), []).append(r)
    half = {n: hashlib.md5("".join(n).encode()).hexdigest()[0] < "8" for n in names}

    def grams(n):
        t = "\x02" * k + "".join(n) + "\x03"
        return [t[i : i + k + 1] for i in range(len(t) - k)]

    for n, rows in names.items():
        if rows[0]["rule"] and half[n]:
            for g in grams(n):
                for j in range(k + 1):
                    fit[rows[0]["verdict"]][g[k - j :]] += len(rows)
                    ctx[rows[0]["verdict"]][j, g[k - j : k]] += len(rows)

    def logp(kind, g):
        p = 1 / 256
        for j in range(k + 1):
            p = (fit[kind][g[k - j :]] + p) / (ctx[kind][j, g[k - j : k]] + 1)
        return math.log(p)

    score = {n: sum(logp("allow", g) - logp("block", g) for g in grams(n)) / len(grams(n)) for n in names}
    for n, rows in names.items():
        if rows[0]["rule"] and not half[n]:
            held[rows[0]["verdict"]].append(score[n])
    (ma, sa), (mr, sr) = ((sum(v) / len(v), (sum(x * x for x in v) / len(v) - (sum(v) / len(v)) ** 2) ** 0.5) for v in (held["allow"], held["block"]))
    t = (ma * sr + mr * sa) / (sa + sr)
    for n, rows in names.items():
        for r in rows:
            if not r["rule"]:
                assert abs(r["score"] - (score[n] - t)) < 1e-6 and r["verdict"] == ("allow" if score[n] >= t else "block")


def test_long_conversation_is_merged_in_order(spark):
    rows = [(1, i, "user" if i // 3 % 2 else "assistant", f"t{i}") for i in range(20_000)]
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = got.select(F.explode(read_turns(F.col("formatted"))).alias("t")).select("t.*").collect()
    assert [tuple(t) for t in turns] == [(r[2], r[3]) for r in rows]
