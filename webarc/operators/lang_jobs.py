"""Language jobs: dataset splits, profile training, evaluation."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.lang import BINS, text_vectors


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def create_dataset(texts: DataFrame, text: str = "text", lang: str = "lang", least_chars: int = 200, min_examples: int = 0, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """(lang, text, split): texts normalised, short ones and repeats left out, languages with too few left out, the rest split by a hash order.

    Link brackets go, and so do lines that open a document tag. The split is the same however the rows are ordered. Hashes that begin alike are ordered in a task, and counts say how many come before them, so no task sorts a whole language.
    """
    clean = F.replace(F.replace(_nfkc(F.col(text)), F.lit("[["), F.lit("")), F.lit("]]"), F.lit(""))
    rows = texts.select(F.col(lang).alias("lang"), F.trim(clean).alias("text")).filter((F.length("text") >= least_chars) & ~F.startswith("text", F.lit("<doc")))
    rows = rows.withColumn("h", F.sha1("text")).withColumn("part", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    rows = rows.repartition("part").dropDuplicates(["part", "h"])
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy("lang", "part").agg(F.count("*").alias("here"))  # of each language, 4096 rows at most
    placed = each.select("lang", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy("lang")).alias("n")).filter(F.col("n") >= min_examples)
    known = placed.select(F.col("lang").alias("l"), F.col("part").alias("p"), "before", "n")
    at = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))
    found = rows.withColumn("at", at).join(F.broadcast(known), F.col("lang").eqNullSafe(F.col("l")) & (F.col("part") == F.col("p")))
    share = (F.col("before") + F.col("at") - 1) / F.col("n")
    split = F.when(share < test, "test").when(share < test + val, "val").otherwise("train")
    return found.select("lang", "text", split.alias("split"))


def train_profiles(texts: DataFrame, text: str = "text", lang: str = "lang", bins: int = BINS) -> DataFrame:
    """(lang, profile): the whole mean of the vectors of a language's texts. A task sends one sum of vectors a language. Rows without text or language teach nothing."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            labels = batch.column(0).dictionary_encode()
            vectors, of = text_vectors(batch.column(1).to_pylist(), bins), np.asarray(labels.indices)
            for k, name in enumerate(labels.dictionary.to_pylist()):
                mine = vectors[of == k]
                n, total = sums.get(name, (0, np.zeros(bins, np.int64)))
                sums[name] = (n + len(mine), total + mine.sum(0, dtype=np.int64))
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "n": pa.array([n for n, _ in sums.values()], pa.int64()), "sums": pa.array([t.tolist() for _, t in sums.values()], pa.list_(pa.int64()))})

    known = texts.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("t")).filter("lang is not null and t is not null")
    each = known.mapInArrow(run, "lang string, n bigint, sums array<bigint>").select("lang", "n", F.posexplode("sums").alias("bin", "s"))
    whole = each.groupBy("lang", "bin").agg(F.least(F.expr("sum(s) div sum(n)"), F.lit(255)).cast("int").alias("v"))
    return whole.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "v"))), lambda x: x["v"]).alias("profile"))


def load_profiles(profiles: DataFrame, order: DataFrame | None = None) -> dict[str, list[int]]:
    """On the driver; one row a language. order (lang, place) puts widely used languages first, else they are sorted by name."""
    df = profiles.join(order, "lang", "left").orderBy(F.col("place").asc_nulls_last(), "lang") if order is not None else profiles.orderBy("lang")
    return {r["lang"]: list(r["profile"]) for r in df.select("lang", "profile").collect()}


def evaluate(predictions: DataFrame, truth: str = "lang", predicted: str = "predicted") -> DataFrame:
    """(lang, n, precision, recall, f1), best F1 first. Languages that are only predicted have n = 0."""
    cells = predictions.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    none = F.lit(0).cast("bigint")
    side = lambda lang, n, said, right: F.struct(F.col(lang).alias("lang"), n.alias("n"), said.alias("said"), right.alias("right"))
    right = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(none)
    both = cells.select(F.explode(F.array(side("t", F.col("n"), none, right), side("p", none, F.col("n"), none))).alias("x")).select("x.*")
    sums = both.filter("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"), F.sum("said").alias("said"), F.sum("right").alias("right"))
    p, r = F.coalesce(F.try_divide("right", "said"), F.lit(0.0)), F.coalesce(F.try_divide("right", "n"), F.lit(0.0))
    return sums.select("lang", "n", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")).orderBy(F.desc("f1"), "lang")


def confusion(predictions: DataFrame, truth: str = "lang", predicted: str = "predicted") -> DataFrame:
    """A row a true language, a column a predicted one."""
    return predictions.groupBy(F.col(truth).alias("lang")).pivot(predicted).count().na.fill(0)


def accuracy(predictions: DataFrame, truth: str = "lang", predicted: str = "predicted") -> DataFrame:
    return predictions.agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
