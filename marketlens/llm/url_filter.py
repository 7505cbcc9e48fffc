"""URL filter: host/path rules first, logistic regression on hashed character n-grams for the rest.

The model is trained on a small labelled URL table (at most ``TRAIN_ROWS`` distinct
host/path pairs, chosen by hash order). Features are the character n-grams of the
host and of the path, hashed into ``DIMS`` buckets each side; presence counts once.
The model is ``DIMS`` weights whatever the data size. DataFrame functions and Spark ML
only (``NGram``, ``HashingTF``, ``LogisticRegression`` on sparse vectors).

A null URL, or one without ``://``, has an empty host and path. With no labelled row
at all every score is 0.5; with one class only, every score is that class. Repeated
rows are judged alike; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 2048
GRAM = (3, 4)
TRAIN_ROWS = 4000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does.

    ``rules`` are (verdict, "host/path") pairs. A rule fits its host and every
    subdomain when the path starts with the rule's path.
    """
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (rule, verdict) if rule is not None else (none, none)


def features(df: DataFrame, out: str = "__x") -> DataFrame:
    """``df`` with the hashed n-grams of ``host`` (lower half) and ``path`` (upper half) as one sparse 0/1 vector."""
    steps, halves = [], []
    for side in ("host", "path"):
        df = df.withColumn(f"__{side}_chars", F.split(F.concat(F.lit("^"), side, F.lit("$")), ""))
        grams = [f"__{side}_{n}grams" for n in GRAM]
        steps += [NGram(n=n, inputCol=f"__{side}_chars", outputCol=g) for n, g in zip(GRAM, grams, strict=True)]
        steps += [SQLTransformer(statement=f"SELECT *, concat({', '.join(grams)}) AS __{side}_grams FROM __THIS__"),
                  HashingTF(numFeatures=DIMS // 2, binary=True, inputCol=f"__{side}_grams", outputCol=f"__{side}_x")]
        halves.append(f"__{side}_x")
    steps.append(VectorAssembler(inputCols=halves, outputCol=out))
    made = PipelineModel(steps).transform(df)
    return made.drop(*[c for c in made.columns if c.startswith(("__host_", "__path_"))])


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> LogisticRegressionModel | float:
    """Model of P(block) from columns host, path, blocked (0/1); a constant where there are not two classes."""
    sample = labelled.where("host is not null and path is not null and blocked is not null") \
        .groupBy("host", "path").agg(F.max("blocked").cast("double").alias("blocked")) \
        .orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows)
    data = features(sample).select("blocked", "__x").persist()
    try:
        classes = [r[0] for r in data.select("blocked").distinct().collect()]
        if len(classes) < 2:
            return classes[0] if classes else 0.5
        return LogisticRegression(featuresCol="__x", labelCol="blocked", probabilityCol="__p", rawPredictionCol="",
                                  predictionCol="", regParam=1e-3, maxIter=40, standardization=False).fit(data)
    finally:
        data.unpersist()


def score(df: DataFrame, model: LogisticRegressionModel | float, out: str = "score") -> DataFrame:
    """``df`` (host, path) with P(block) of every row."""
    if isinstance(model, float):
        return df.withColumn(out, F.lit(model))
    return model.transform(features(df)).withColumn(out, vector_to_array("__p")[1]).drop("__x", "__p")


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None,
          id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score.

    ``labelled`` (host, path, blocked) trains the model; left out, the URLs that a rule
    decides are the labelled table.
    """
    parts = pages.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    if labelled is None:
        labelled = parts.select("host", "path", (verdict == "block").cast("int").alias("blocked"))
    return score(parts, train(labelled)) \
        .select(id_col, "host", "path", rule.alias("rule"),
                F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
                F.col("score"))
