"""URL verdicts: host and path rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnspark.llm.tables import stored

#: Rules as host suffix / path prefix, with their verdicts.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
SAMPLE = 200_000  # fitting bound: expected labelled URLs
TREES = 20
DEPTH = 4
PRIOR = 20.0  # labelled URLs of average kind that every suffix starts with
FEATURES = ["length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "hyphens", "secure", "suffix_share"]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next of ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to the next of ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule whose host is the host or a parent of it and whose path begins the path; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _per(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def suffix_of(host: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host, ".", -2)


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features of ``url`` (empty for null) except ``suffix_share``; needs ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    size = F.length(url)
    letters = F.split(url, "")
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.greatest(size, F.lit(1)))
    entropy = F.aggregate(counts, F.lit(0.0), lambda total, p: total - p * F.log2(p))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return df.withColumns({
        "length": size.cast("double"),
        "depth": F.length(F.regexp_replace("path", "[^/]+", "")).cast("double"),
        "digit_ratio": _per(F.length(F.regexp_replace(url, "[^0-9]+", "")), size),
        "entropy": F.when(size > 0, entropy).otherwise(0.0),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
        "host_labels": F.size(F.split("host", r"\.")).cast("double"),
        "hyphens": F.length(F.regexp_replace("host", "[^-]+", "")).cast("double"),
        "secure": url.startswith("https").cast("double"),
        "suffix": suffix_of(F.col("host")),
    })


def parted(urls: DataFrame) -> DataFrame:
    return urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, float, GBTClassificationModel | None]:
    """Smoothed block share of each suffix, the share of all rows, and the trees, from ``url`` and ``label`` (1 is block).

    The shares are those of all labelled rows. The trees are fitted to about ``sample`` rows, picked by a hash of
    the URL. Without rows of both labels among them there is no model and nothing is blocked by it.
    """
    given = labelled.where("label is not null").select("url", F.col("label").cast("double").alias("label"))
    counted = given.groupBy(suffix_of(host_of(F.col("url"))).alias("suffix")).agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("n"))
    counted = stored(counted, "suffixes")
    n, blocked = counted.agg(F.sum("n"), F.sum("blocked")).first()
    mean = blocked / n if n else 0.0
    suffixes = counted.select("suffix", ((F.col("blocked") + PRIOR * mean) / (F.col("n") + PRIOR)).alias("suffix_share"))
    draw = F.pmod(F.xxhash64(F.lit("url"), "url"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, n or 0)))
    rows = stored(lexical(parted(given.where(draw))), "urls")
    least, most = rows.agg(F.min("label"), F.max("label")).first()
    if least == most:
        return suffixes, mean, None
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=1, maxBins=64)
    train = _assembled(rows, suffixes, mean).select("features", "label")
    return suffixes, mean, trees.fit(train)


def _assembled(rows: DataFrame, suffixes: DataFrame, mean: float) -> DataFrame:
    """Adds the features as a vector; a suffix without labelled rows has the share of all rows."""
    joined = rows.join(suffixes, "suffix", "left").fillna({"suffix_share": mean})
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(joined)


def judge(urls: DataFrame, labelled: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (the model's share for block) of each row.

    ``urls`` has ``page_id`` and ``url``. The longest fitting rule decides; other URLs are blocked if the trees
    give block more than half. Null URLs have an empty host and path; repeated rows get equal results.
    """
    suffixes, mean, model = fit(labelled, sample)
    rows = lexical(parted(urls.select("page_id", F.col("url").cast("string").alias("url"))))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    if model is None:
        rows = rows.withColumn("score", F.lit(0.0))
    else:
        rows = model.transform(_assembled(rows, suffixes, mean)).withColumn("score", vector_to_array("probability")[1])
    known = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    verdict = F.when(F.col("rule").isNotNull(), known[F.col("rule")]).otherwise(F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url`` and ``label`` of pages whose URL ends its path with the number of a labelled document.

    A page is to be blocked if the document has low quality or is toxic.
    """
    number = F.regexp_extract("url", r"/(\d{1,18})(?:[^\d/?#][^/?#]*|/)?(?:[?#].*)?$", 1)
    numbered = pages.select("url", F.when(number != "", number).cast("bigint").alias("doc_id")).where("doc_id is not null")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    return numbered.join(labels.select("doc_id", bad.alias("label")), "doc_id").select("url", "label")
