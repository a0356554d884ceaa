"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The URLs that a rule decides are the labelled ones; the trees learn from them and judge the URLs that no rule fits.
Features: length, host length, depth, digit ratio, character entropy, number of parameters, hyphens, host labels, and
suffix statistics (the smoothed share of blocked labels under the host's last label and last two labels).  Everything
is a column expression or Spark's own boosted trees; the suffix table is a grouped count joined back, from the other folds where
the row itself is labelled.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and is judged by the trees on
its other features; with labels of one kind only (or none) unruled URLs get that kind (or allow); repeated rows are
kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import table, written

#: (verdict, host, path): a rule fits its host and all subdomains whose path starts with the rule's; the longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Bound of the labelled rows the trees are fitted on.
SAMPLE = 50_000
#: Labels a suffix needs before its own share outweighs the overall one.
PRIOR = 20.0
TREES, DEPTH = 8, 4
#: Parts of the labelled rows, each of which gets its suffix statistics from the others.
FOLDS = 5
SUFFIXES = ("suffix1", "suffix2")
FEATURES = ["n_chars", "n_host", "depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "n_labels", "suffix1_share", "suffix2_share"]


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host (A-Z lower-cased) and path."""
    after = F.when(F.locate("://", F.col(url)) > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns({"host": F.coalesce(lower, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def ruled(df: DataFrame, rules=RULES) -> DataFrame:
    """``df`` (with host and path) with rule and its verdict; null where no rule fits."""
    rule: Column = F.lit(None).cast("string")
    verdict: Column = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # a longer rule is put around the shorter ones
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return df.withColumns({"rule": rule, "ruled": verdict})


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` (with host and path) with the lexical features and the two suffixes."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    count = lambda pattern: F.length(u) - F.length(F.regexp_replace(u, pattern, ""))
    times = F.transform(F.array_distinct(F.split(u, "")), lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))).cast("double"))
    spread = F.aggregate(times, F.lit(0.0), lambda s, k: s + F.when(k > 0, k * F.log2(k)).otherwise(0.0))
    labels = F.split("host", r"\.")
    return df.withColumns(
        {
            "n_chars": n.cast("double"),
            "n_host": F.length("host").cast("double"),
            "depth": (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double"),
            "digit_ratio": F.when(n > 0, count("[0-9]") / n).otherwise(0.0),
            "entropy": F.when(n > 0, F.log2(n.cast("double")) - spread / n).otherwise(0.0),
            "n_params": F.when(F.locate("?", u) > 0, F.size(F.split(F.regexp_extract(u, r"(?s)\?([^#]*)", 1), "&"))).otherwise(0).cast("double"),
            "n_hyphens": count("-").cast("double"),
            "n_labels": F.size(labels).cast("double"),
            "suffix1": F.substring_index("host", ".", -1),
            "suffix2": F.substring_index("host", ".", -2),
        }
    )


def with_suffix_shares(df: DataFrame, labelled: DataFrame, base: float) -> DataFrame:
    """``df`` with the smoothed share of blocked labels under each suffix; suffixes never labelled get the overall share.

    Rows with a fold get the share of the other folds' labels, so no label is among its own features.
    """
    for k in SUFFIXES:
        stats = labelled.groupBy(k, "fold").agg(F.sum("label").alias("s"), F.count("*").alias("n"))
        all_ = stats.groupBy(k).agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("s", "n")))).alias("_own"))  # FOLDS entries
        own = lambda f: F.coalesce(F.try_element_at("_own", F.coalesce("fold", F.lit(-1)))[f], F.lit(0))
        df = df.join(all_, k, "left").withColumn(f"{k}_share", F.coalesce((F.col("_s") - own("s") + PRIOR * base) / (F.col("_n") - own("n") + PRIOR), F.lit(base))).drop("_s", "_n", "_own")
    return df


def fit(features: DataFrame, n: int, sample: int) -> GBTClassificationModel:
    drawn = features if n <= sample else features.where(F.pmod(F.xxhash64("host", "path", F.lit("urls")), F.lit(1_000_003)) < 1_000_003 * sample / n)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(drawn).select("features", "label").repartition(4)
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32).fit(vectors)


def filter_urls(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """``pages`` (a column url) with host, path, rule and verdict, which take the place of columns of those names."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    columns = [*kept, "host", "path", "rule", "verdict"]
    fold = F.when(F.col("ruled").isNotNull(), F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    marked = lexical(ruled(parts(pages.select(*kept)), rules)).withColumns({"label": (F.col("ruled") == "block").cast("double"), "fold": fold})
    marked = written(marked, "urls-features")  # read once for each tree level
    labelled = marked.where(F.col("ruled").isNotNull())
    n, blocked = labelled.agg(F.count("*"), F.sum("label")).first()
    if not n or not 0 < blocked < n:
        other = F.lit("block" if n and blocked == n else "allow")
        return marked.withColumn("verdict", F.coalesce("ruled", other)).select(*columns)
    base = blocked / n
    model = fit(with_suffix_shares(labelled, labelled, base), n, sample)
    open_ = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_suffix_shares(marked.where(F.col("ruled").isNull()), labelled, base))
    judged = model.transform(open_).withColumn("verdict", F.when(F.col("prediction") > 0, "block").otherwise("allow"))
    return labelled.withColumn("verdict", F.col("ruled")).select(*columns).unionByName(judged.select(*columns))


def op5_urls(spark, sf_dir: str) -> DataFrame:
    """Every page's URL judged."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
