"""URL filter: rules first, then a character language-model ratio, by DataFrame expressions only.

URLs that a rule decides are the training text: accepted ones for one model, blocked ones for the
other. Each model is a Markov chain of variable order up to ``order`` over the characters of host
and path: the probability of a character after its longest context leans on the one after the next
shorter context, p_k = (c_k + strength * p_{k-1}) / (n_k + strength), down to a uniform one. A URL's
score is the mean over its characters of log p_accept - log p_reject. The threshold is calibrated on
URLs the models have not seen (half of the decided URLs, by a hash): the point as many standard
deviations above the blocked ones' mean as below the accepted ones'.

Everything is counted once per distinct n-gram: n-grams are pre-aggregated, log ratios are computed
for each distinct n-gram, and each distinct host and path is scored once; repeated URLs, however
many, only meet in a join that can be split.

Cases: null url, or one without "://": host and path empty, judged by the models as the empty
string; ties (score equal to the threshold): allow; no decided URLs at all, or none of one kind:
threshold 0 and a ratio from what there is; repeated rows: judged alike, each kept; empty table:
empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm._shared import discard, let, maybe_broadcast, stage


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: The rules of the pages table.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

START, STOP = "\x02", "\x03"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: Rule) -> Column:
    at = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
    return at & F.startswith(path, F.lit(rule.path))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    found = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        found = F.when(_fits(host, path, r), value) if found is None else found.when(_fits(host, path, r), value)
    return found


def _grams(order: int) -> Column:
    padded = F.concat(F.lit(START * order), "host", "path", F.lit(STOP))
    return let(padded, lambda u: F.transform(F.sequence(F.lit(1), F.length(u) - order), lambda i: F.substr(u, i, F.lit(order + 1))))


def _counts(grams: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Counts (a, r) of every suffix of the counted grams, and of every context of a suffix."""
    parts = grams.select(
        "a",
        "r",
        F.explode(
            F.array(*(F.struct(F.substring("gram", order + 1 - k, k + 1).alias("s"), F.substring("gram", order + 1 - k, k).alias("c")) for k in range(order + 1)))
        ).alias("p"),
    )
    suffixes = parts.groupBy(F.col("p.s").alias("s")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
    contexts = parts.groupBy(F.length("p.s").alias("k"), F.col("p.c").alias("c")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
    return suffixes, contexts


def _ratios(wanted: DataFrame, suffixes: DataFrame, contexts: DataFrame, order: int, strength: float) -> DataFrame:
    """Log ratio of the last character of each gram."""
    levels = wanted.select(
        "gram",
        F.explode(
            F.array(*(F.struct(F.lit(k + 1).alias("k"), F.substring("gram", order + 1 - k, k + 1).alias("s"), F.substring("gram", order + 1 - k, k).alias("c")) for k in range(order + 1)))
        ).alias("p"),
    ).select("gram", "p.k", "p.s", "p.c")
    found = levels.join(suffixes, "s", "left").join(contexts, ["k", "c"], "left")
    stats = F.struct("k", *(F.coalesce(F.col(x), F.lit(0)).cast("double").alias(x) for x in ("ca", "cr", "na", "nr")))
    by_gram = found.groupBy("gram").agg(F.array_sort(F.collect_list(stats)).alias("ks"))
    zero = F.struct(F.lit(1 / 256).alias("a"), F.lit(1 / 256).alias("r"))

    def step(p: Column, x: Column) -> Column:
        return F.struct(((x["ca"] + strength * p["a"]) / (x["na"] + strength)).alias("a"), ((x["cr"] + strength * p["r"]) / (x["nr"] + strength)).alias("r"))

    return by_gram.select("gram", F.aggregate("ks", zero, step, lambda p: F.ln(p["a"]) - F.ln(p["r"])).alias("ratio"))


def filter_urls(df: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, order: int = 4, strength: float = 1.0) -> DataFrame:
    """key, url, host, path, rule, verdict, score of every row; score is null where a rule decides."""
    rows = df.select(F.col(key).alias(key), F.col(url).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    names = stage(
        rows.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("hit", rule)
        .select("host", "path", "n", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"), (F.left(F.md5(F.concat("host", "path").cast("binary")), F.lit(1)) < "8").alias("fits")),
        "urls-names",
    )
    # a few names can come back as one piece, with n-grams for many tasks
    held = names.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "host", "path").select("*", F.explode(_grams(order)).alias("gram"))
    accepted, rejected = (F.col("n") * ((F.col("ruled") == v) & F.col("fits")).cast("int") for v in ("allow", "block"))
    grams = stage(held.groupBy("gram").agg(F.coalesce(F.sum(accepted), F.lit(0)).alias("a"), F.coalesce(F.sum(rejected), F.lit(0)).alias("r")), "urls-grams")
    suffixes, contexts = _counts(grams.filter("a + r > 0"), order)
    ratios = stage(_ratios(grams, suffixes, contexts, order, strength), "urls-ratios")
    scored = stage(
        held.join(maybe_broadcast(ratios, 80), "gram").groupBy("host", "path").agg(
            F.avg("ratio").alias("score"), F.first("n").alias("n"), F.first("rule").alias("rule"), F.first("ruled").alias("ruled"), F.first("fits").alias("fits")
        ),
        "urls-scored",
    )
    discard(names, grams, ratios)
    unseen = scored.filter(~F.col("fits") & F.col("ruled").isNotNull())
    got = unseen.groupBy("ruled").agg(F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("s"))
    fit = {r["ruled"]: (r["m"], r["s"]) for r in got.collect()}  # two rows at most
    threshold = 0.0
    if len(fit) == 2:
        (ma, sa), (mr, sr) = fit["allow"], fit["block"]
        threshold = (ma * sr + mr * sa) / (sa + sr) if sa + sr > 0 else (ma + mr) / 2
    verdicts = scored.select(
        "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("score") - threshold).alias("score"),
    )
    return rows.join(verdicts, ["host", "path"]).select(key, "url", "host", "path", "rule", "verdict", "score")
