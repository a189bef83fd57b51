"""Problem 7: pages of keywords, links or product tags.

Features of density, entropy, repetition and function words are taken of every record's own lines. Per language their centre and scatter are estimated robustly,
from medians and then from the half of the records that lie nearest (concentration steps), over all records. A record is found if its
Mahalanobis distance is large and it deviates in the directions of spam.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.residue import slots
from corpusloom.plans.storage import materialize

#: Features, and the sign of spam in each.
FEATURES = {"func": -1, "sent": -1, "top": 1, "links": 1, "distinct": -1, "entropy": -1}
#: Squared robust distance beyond which a record is an outlier, and the least deviation along the direction of spam, in robust standard deviations.
DISTANCE, DIRECTION = 22.0, 2.5
#: One of these must hold too, since text of another language than its group's lacks function words as well: the most frequent words, or links where sentences lack, stand
#: out by so many robust standard deviations.
TOP, LINKS, SENTENCES = 2.0, 4.0, 2.0
#: So many lines of links make a list of them; menus have fewer.
LISTED = 10
#: Languages with fewer records share one estimate.
FEW = 100
#: Least standard deviation of a feature: below it differences mean nothing.
FLOOR = 0.04


def features(lines: DataFrame, filled: DataFrame | None = None) -> DataFrame:
    """(kind, id, lang, listed: number of lines of links, f: array of FEATURES): densities of the lines that aren't the site's template, and repetition over the record's windows. Records of mostly residue
    (``residue``) or with fewer than 8 words have none."""
    listed = (F.col("sent") == 0) & (F.col("recur") > 0) & (F.col("links") > 0)
    own = (slots(lines) if filled is None else filled).groupBy("kind", "id").agg(
        *[F.sum(c).alias(c) for c in ("letters", "words", "func")],
        # links to other pages read as sentences or have words that the record doesn't repeat; those of lists of products or sites do
        F.sum(F.when(listed, F.col("links")).otherwise(0)).alias("links"), F.sum(listed.cast("int")).alias("listed"), F.sum(F.col("letters") * F.col("sent")).alias("sent"), F.sum(F.when(F.col("cls").isin(1, 2, 3), F.col("letters")).otherwise(0)).alias("odd")
    )
    whole = lines.filter("no = 0").groupBy("kind", "id").agg(F.first("cls").alias("lang"), F.max("masked").alias("top"), F.max("func").alias("distinct"), F.max("recur").alias("entropy"))
    j = own.join(whole, ["kind", "id"]).filter("words >= 8 and odd * 2 < letters")
    share = lambda a, b: F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))
    f = [share("func", "words"), share("sent", "letters"), F.col("top") / 1000, share("links", "letters"), F.col("distinct") / 1000, F.col("entropy") / 1000]
    return j.select("kind", "id", "lang", "listed", F.array(*[x.cast("double") for x in f]).alias("f"))


def _moments(f: DataFrame) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Per group: number, mean and covariance, from sums; a few numbers for each group come to the driver."""
    k = len(FEATURES)
    sums = [F.sum(F.col("f")[i]).alias(f"s{i}") for i in range(k)] + [F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    out = {}
    for r in f.groupBy("g").agg(F.count("*").alias("n"), *sums).collect():
        mean = np.array([r[f"s{i}"] for i in range(k)]) / r["n"]
        cov = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / r["n"] - np.outer(mean, mean)
        out[r["g"]] = (r["n"], mean, cov)
    return out


def _distance(spark, f: DataFrame, model: dict) -> DataFrame:
    """``f`` with d2, the squared distance to the centre of its group, along, the deviation in the direction of spam, and z, that of each feature."""
    k = len(FEATURES)
    rows = []
    sign = np.array([*FEATURES.values()], float)
    for g, (mean, cov) in model.items():
        inverse = np.linalg.inv(cov)
        scale = np.sqrt(np.diag(cov))
        rows.append((g, mean.tolist(), inverse.flatten().tolist(), (sign / scale / np.sqrt(k)).tolist()))
    table = F.broadcast(spark.createDataFrame(rows, "g string, m array<double>, w array<double>, u array<double>"))
    dev = F.zip_with("f", "m", lambda a, b: a - b)
    j = f.join(table, "g").withColumn("v", dev)
    d2 = sum(F.col("v")[i] * F.col("v")[jj] * F.col("w")[i * k + jj] for i in range(k) for jj in range(k))
    along = sum(F.col("v")[i] * F.col("u")[i] for i in range(k))
    z = F.array(*[F.col("v")[i] * F.col("u")[i] * float(np.sqrt(k)) for i in range(k)])
    return j.withColumn("d2", d2).withColumn("along", along).withColumn("z", z).drop("m", "w", "u", "v")


def robust_model(f: DataFrame, steps: int = 2) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Group -> (centre, scatter). The first are medians and squared median deviations; each step takes the half of the records nearest to the last, and scales their covariance to that of all."""
    spark = f.sparkSession
    k = len(FEATURES)
    mid = f.groupBy("g").agg(*[F.percentile_approx(F.col("f")[i], 0.5, 2000).alias(f"m{i}") for i in range(k)])
    med = {r["g"]: np.array([r[f"m{i}"] for i in range(k)]) for r in mid.collect()}
    table = F.broadcast(spark.createDataFrame([(g, m.tolist()) for g, m in med.items()], "g string, m array<double>"))
    dev = f.join(table, "g").groupBy("g").agg(*[F.percentile_approx(F.abs(F.col("f")[i] - F.col("m")[i]), 0.5, 2000).alias(f"d{i}") for i in range(k)])
    model = {r["g"]: (med[r["g"]], np.diag(np.maximum(1.4826 * np.array([r[f"d{i}"] for i in range(k)]), FLOOR) ** 2)) for r in dev.collect()}
    for _ in range(steps):
        at = _distance(spark, f, model)
        half = {r["g"]: r["q"] for r in at.groupBy("g").agg(F.percentile_approx("d2", 0.5, 2000).alias("q")).collect()}
        cut = F.broadcast(spark.createDataFrame([(g, float(q)) for g, q in half.items()], "g string, q double"))
        near = _moments(at.join(cut, "g").filter("d2 <= q").select("g", "f"))
        model = {}
        for g, (_, mean, cov) in near.items():
            # the nearest half of normal data in six dimensions has about 0.4 of its scatter
            model[g] = (mean, cov * 2.5 + np.eye(k) * FLOOR**2)
    return model


def spam(lines: DataFrame, distance: float = DISTANCE, direction: float = DIRECTION, filled: DataFrame | None = None) -> DataFrame:
    """(record_kind, record_id, d2, along, spam) of the records of a ``line_table`` that have at least 8 words of their own; ``filled``: its ``slots``, if known.

    Records with fewer words or a null body have no row and aren't spam. Empty tables give no rows.
    """
    f = materialize(features(lines, filled), "features")
    counts = {r["lang"]: r["n"] for r in f.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return lines.sparkSession.createDataFrame([], "record_kind string, record_id long, d2 double, along double, spam boolean")
    often = [k for k, n in counts.items() if n >= FEW]
    f = f.withColumn("g", F.when(F.col("lang").isin(often), F.col("lang").cast("string")).otherwise("other") if often else F.lit("other"))
    at = _distance(lines.sparkSession, f, robust_model(f))
    place = [*FEATURES]
    z = lambda name: F.col("z")[place.index(name)]
    marked = (z("top") > TOP) | ((z("links") > LINKS) & (z("sent") > SENTENCES) & (F.col("listed") >= LISTED))
    return at.select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), "d2", "along", ((F.col("d2") > distance) & (F.col("along") > direction) & marked).alias("spam"))
