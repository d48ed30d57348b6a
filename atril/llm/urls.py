"""URL filters: rules first, then gradient-boosted trees on lexical features, all in DataFrame operations.

The labelled URLs are those that a rule decides: the trees learn from a bounded sample of them, of at most
``MAX_LABELLED`` distinct URLs (those with the smallest hashes), and decide the rest. The fitted trees become one
nested CASE expression. Suffix statistics are of all distinct URLs that a rule decides, for two suffixes: that of the
host (its last label, such as ``org``) and that of the path (``html``, or none). They tell how often it occurs and how
often it is blocked, drawn towards the mean by ``PRIOR`` URLs; a suffix that none of them has gets share 0 and the mean.
Rules name host suffixes, and trees that knew these for all URLs of the sample would repeat the rules and have nothing
to say on other hosts; so half of the sample (by hash) is learnt from as if its host suffix were unknown. Each table is broadcast up to ``MAX_BROADCAST`` suffixes and joined by a shuffle
beyond. Both labels weigh the same in training, as rules do not occur in the proportions of the rest.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule, and are judged by their features (null
counts as empty). Ties: no two rules have one length and fit one URL. Where the sample lacks one of the two labels,
URLs without a rule are allowed. Repeated rows get equal verdicts; an empty table gives no rows; URLs of any length count
whole; columns other than page_id and url are not read, whatever their names.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: (rule, verdict): a host, its subdomains included, and the beginning of the path.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
MAX_LABELLED = 4000
MAX_BROADCAST = 10_000
FEATURES = ("length", "host_length", "labels", "depth", "digit_ratio", "hyphens", "entropy", "parameters", "has_fragment", "host_suffix_length", "host_suffix_share", "host_suffix_blocked", "path_suffix_share", "path_suffix_blocked")
SUFFIXES = ("host_suffix", "path_suffix")
#: URLs of the mean that a suffix's blocked share is drawn towards.
PRIOR = 10


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, url, host, path, rule and the rule's verdict. Longer rules are asked first."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule: Column = F.lit(None).cast("string")
    verdict: Column = F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        at, _, begin = name.partition("/")
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith("/" + begin)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rows.withColumns({"rule": rule, "said": verdict})


def suffix(kind: str) -> Column:
    return F.regexp_extract("host", r"[^.]*$", 0) if kind == "host_suffix" else F.regexp_extract("path", r"\.([^./]*)$", 1)


def lexical(rows: DataFrame) -> DataFrame:
    """``rows`` with the features of ``url`` but for those of the suffixes, and the suffixes."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    count = lambda of, what: F.length(of) - F.length(F.replace(of, F.lit(what), F.lit("")))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(F.array_distinct(F.split(url, "")), lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return rows.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "labels": count(F.col("host"), ".").cast("double"),
            "depth": count(F.col("path"), "/").cast("double"),
            "digit_ratio": (F.length(url) - F.length(F.translate(url, string.digits, ""))) / n,
            "hyphens": count(F.col("host"), "-").cast("double"),
            "entropy": entropy,
            "parameters": (count(url, "&") + F.when(F.locate("?", url) > 0, 1).otherwise(0)).cast("double"),
            "has_fragment": F.when(F.locate("#", url) > 0, 1.0).otherwise(0.0),
            "host_suffix_length": F.length(suffix("host_suffix")).cast("double"),
            **{kind: suffix(kind) for kind in SUFFIXES},
        }
    )


def _case(node, columns: tuple[str, ...]) -> Column:
    """A fitted tree as nested CASE."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(columns[split.featureIndex()]) <= float(split.threshold()), _case(node.leftChild(), columns)).otherwise(_case(node.rightChild(), columns))


def margin(model: GBTClassificationModel, columns: tuple[str, ...] = FEATURES) -> Column:
    total: Column = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        total = total + _case(tree._java_obj.rootNode(), columns) * F.lit(float(weight))
    return total


@dataclass(frozen=True)
class Suffixes:
    """Counts (suffix, n, blocked) of each kind of suffix, and the number of URLs counted and of those blocked."""

    tables: dict[str, DataFrame]
    n: int
    blocked: int


def suffixes(labelled: DataFrame) -> Suffixes:
    """Counts over all of ``labelled`` (host, path, said)."""
    count = lambda kind: labelled.groupBy(suffix(kind).alias(kind)).agg(F.count("*").alias("n"), F.count_if(F.col("said") == "block").alias("blocked"))
    tables = {kind: materialize(count(kind), kind) for kind in SUFFIXES}
    n, blocked = tables[SUFFIXES[0]].agg(F.sum("n"), F.sum("blocked")).first()
    return Suffixes(tables, n, blocked)


def with_suffixes(rows: DataFrame, stats: Suffixes, hidden: Column | None = None) -> DataFrame:
    """``rows`` with the share and the blocked share of their suffixes; where ``hidden``, those of an unknown host suffix."""
    mean = stats.blocked / stats.n
    for kind in SUFFIXES:
        table = stats.tables[kind]
        table = F.broadcast(table) if table.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else table
        n, blocked = (F.coalesce(F.when(~hidden, F.col(c)) if hidden is not None and kind == "host_suffix" else F.col(c), F.lit(0)) for c in ("n", "blocked"))
        rows = rows.join(table, kind, "left").withColumns({f"{kind}_share": n / stats.n, f"{kind}_blocked": (blocked + PRIOR * mean) / (n + PRIOR)}).drop("n", "blocked")
    return rows


def judge(pages: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides) of ``pages`` (page_id, url)."""
    rows = ruled(pages)
    labelled = rows.where("rule is not null").groupBy("url", "host", "path").agg(F.first("said").alias("said"))
    sample = labelled.orderBy(F.xxhash64("url"), "url").limit(max_labelled).withColumn("label", (F.col("said") == "block").cast("double"))
    sample = materialize(lexical(sample).coalesce(1), "labelled")
    n, blocked = sample.agg(F.count("*"), F.sum("label")).first()
    if not n or blocked in (0, n):
        return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    stats = suffixes(labelled)
    learn = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_suffixes(sample, stats, F.xxhash64(F.lit(1), "url") % 2 == 0))
    weighed = learn.select("features", "label", F.when(F.col("label") == 1, n / (2 * blocked)).otherwise(n / (2 * (n - blocked))).alias("weight"))
    model = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, seed=11, weightCol="weight").fit(weighed)
    scored = with_suffixes(lexical(rows), stats).withColumn("margin", margin(model))
    decided = F.when(F.col("rule").isNotNull(), F.col("said")).otherwise(F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", decided.alias("verdict"), F.when(F.col("rule").isNull(), F.col("margin")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: host, path, rule and verdict of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
