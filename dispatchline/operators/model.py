"""The retrainable classifier: TF-IDF of word and character grams, balanced logistic regression, versioned artifacts.

It is fitted on all labelled rows. The vocabulary (the grams in two or more of them) and the coefficients lie on the driver.
One task solves it from the texts (``logistic``), so that no gram is stored and no step is a job; the time and memory of that
task grow with the rows. IDF has the +1 of the usual definition and each block is scaled to length 1. Out-of-fold scores use five folds by group of near duplicates (``setjoin.near_duplicate_groups`` of
the core texts' words), so near copies never sit on both sides.
"""

from __future__ import annotations

import json
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LABELS, char_grams, core_text, long_words, rank, spaced, tokens, word_grams
from ..session import checkpointed
from . import logistic, setjoin

MAX_ITER = 2000
#: Terms in a row of what a solver gives.
TERMS = 20_000


def with_grams(rows: DataFrame, text_col: str = "body") -> DataFrame:
    """Adds the gram columns the pipeline reads; null texts have no grams."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return rows.withColumns({"_words": word_grams(text), "_chars": char_grams(text)})


class Fitted(LogisticRegressionModel):
    """A classifier with given coefficients; ``summary`` has how many products it took to find them."""

    @property
    def summary(self) -> SimpleNamespace:
        return SimpleNamespace(totalIterations=self.taken)


def labelled(train: DataFrame, text_col: str = "body", label_col: str = "label", fits: Column | None = None) -> DataFrame:
    """h, y, words, chars of all labelled rows, as the solver takes them, and ``fits``: a bit for each fit that takes the row."""
    rows = train.select(F.col(text_col).alias("text"), rank(F.col(label_col)).alias("y"), (F.lit(1) if fits is None else fits).cast("long").alias("fits")).where("y IS NOT NULL")
    text = F.coalesce("text", F.lit(""))
    return checkpointed(rows.select(F.xxhash64("text").alias("h"), "y", F.array_join(long_words(text), " ").alias("words"), spaced(text).alias("chars"), "fits"))


def _solver(number: int, max_iter: int):
    """Solves a task's rows: rows with the terms, the frequent ones first, and one with the intercepts and the products taken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, words, chars = array("b"), logistic.Lists(), logistic.Lists()
        for pdf in batches:
            y.extend(pdf["y"].tolist())
            words.add_texts(pdf["words"])
            chars.add_texts(pdf["chars"])
        blocks, coef, intercept, taken = logistic.solve(words, chars, np.array(y, np.int64), len(LABELS), max_iter)
        yield pd.DataFrame({"fit": [number], "block": [-1], "part": [0], "names": [""], "numbers": [np.append(intercept, taken).tobytes()]})
        low = 0
        for i, b in enumerate(blocks):
            order = sorted(range(len(b.names)), key=lambda j: (-b.count[j], b.names[j]))
            numbers = np.vstack([b.idf, coef[:, low : low + len(order)]])
            for k in range(0, len(order), TERMS):
                part = order[k : k + TERMS]
                yield pd.DataFrame({"fit": [number], "block": [i], "part": [k], "names": ["\n".join([b.names[j] for j in part])], "numbers": [numbers[:, part].tobytes()]})
            low += len(order)

    return run


def _parts(found: list[Row], max_iter: int) -> tuple[list, np.ndarray, int]:
    """Blocks of (names, idf, coefficients by class), the frequent terms first, intercepts and products taken; fails if they are no minimum."""
    *intercept, taken = np.frombuffer(next(r.numbers for r in found if r.block == -1))
    if taken >= max_iter:
        raise ValueError(f"no convergence in {max_iter} iterations")
    blocks = []
    for i in range(2):
        own = sorted((r for r in found if r.block == i), key=lambda r: r.part)
        numbers = [np.frombuffer(r.numbers).reshape(1 + len(LABELS), -1) for r in own]
        # where there is none, a term that no text has, as vectors can't be empty
        numbers = np.concatenate(numbers, axis=1) if own else np.eye(1 + len(LABELS), 1)
        blocks.append(("\n".join(r.names for r in own).split("\n"), numbers[0], numbers[1:]))  # no term holds white space but a blank
    return blocks, np.array(intercept), int(taken)


def _pipeline(blocks: list, intercept: np.ndarray, taken: int) -> PipelineModel:
    """The fitted stages."""
    stages = []
    for (names, idf, _), name in zip(blocks, ("words", "chars")):
        counts = CountVectorizerModel.from_vocabulary(names, inputCol=f"_{name}", outputCol=f"_{name}_tf")
        stages += [counts, ElementwiseProduct(inputCol=f"_{name}_tf", outputCol=f"_{name}_idf", scalingVec=Vectors.dense(idf)), Normalizer(inputCol=f"_{name}_idf", outputCol=f"_{name}_v", p=2.0)]
    sc = SparkSession.active().sparkContext
    w = np.concatenate([coef for _, _, coef in blocks], axis=1)
    matrix = DenseMatrix(*w.shape, w.ravel("F"))
    fitted = Fitted(sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"LogisticRegression_{uuid.uuid4().hex[:12]}", _py2java(sc, matrix), _py2java(sc, Vectors.dense(intercept)), len(LABELS), True))
    fitted.taken = taken
    return PipelineModel([*stages, VectorAssembler(inputCols=["_words_v", "_chars_v"], outputCol="features"), fitted])


def fit_all(rows: DataFrame, number: int, max_iter: int = MAX_ITER) -> list[tuple[list, np.ndarray, int]]:
    """What ``fit`` makes stages of, for each of some fits on ``labelled`` rows; each is solved by one task, all at once."""
    own = [rows.where(F.col("fits").bitwiseAND(F.lit(1 << i)) != 0).select("h", "y", "words", "chars") for i in range(number)]
    # sorted, as the same rows in the same order give the same sums
    parts = [r.coalesce(1).sortWithinPartitions("h", "y").mapInPandas(_solver(i, max_iter), "fit int, block int, part int, names string, numbers binary") for i, r in enumerate(own)]
    found = reduce(DataFrame.unionByName, parts).collect()
    return [_parts([r for r in found if r.fit == i], max_iter) for i in range(number)]


def fit(train: DataFrame, text_col: str = "body", label_col: str = "label", max_iter: int = MAX_ITER) -> PipelineModel:
    """Two gram blocks, then multinomial logistic regression with C = 1, classes weighted n / (k * n_class); fails if it doesn't converge."""
    return _pipeline(*fit_all(labelled(train, text_col, label_col), 1, max_iter)[0])


def scored(model: PipelineModel, rows: DataFrame, text_col: str = "body") -> DataFrame:
    """Adds ``predicted`` and ``p_urgent`` (1 - probability of routine), as the stages of the model give them; no gram becomes a row's string."""
    counts, weights, fitted = model.stages[0:4:3], model.stages[1:5:3], model.stages[-1]
    coef = fitted.coefficientMatrix.toArray()
    parts = np.split(coef, [len(counts[0].vocabulary)], axis=1)
    return _scored([(c.vocabulary, w.getScalingVec().toArray(), x) for c, w, x in zip(counts, weights, parts)], fitted.interceptVector.toArray(), rows, text_col)


def _scored(blocks: list, intercept: np.ndarray, rows: DataFrame, text_col: str) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast((blocks, intercept))

    @F.pandas_udf("predicted int, p double")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scorer = logistic.Scorer(*held.value)
        for words, chars in batches:
            p = scorer.probabilities(words.tolist(), chars.tolist())
            yield pd.DataFrame({"predicted": p.argmax(axis=0).astype(np.int32), "p": p[0]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = rows.withColumn("_p", apply(F.array_join(long_words(text), " "), spaced(text)))
    return out.select(*rows.columns, F.get(F.array(*[F.lit(x) for x in LABELS]), F.col("_p.predicted")).alias("predicted"), (1 - F.col("_p.p")).alias("p_urgent"))


def dealt(rows: DataFrame, folds: int = 5, text_col: str = "body") -> DataFrame:
    """Adds ``fold``: that of the row's group of near duplicates. Rows (by ``row_id``) without words form one group."""
    groups = setjoin.near_duplicate_groups(rows, "row_id", tokens(core_text(F.col(text_col)))).select(F.col("id").alias("row_id"), "root")
    return rows.join(groups, "row_id", "left").withColumn("fold", F.pmod(F.xxhash64(F.coalesce("root", F.lit(-1))), F.lit(folds))).drop("root")


def out_of_fold(train: DataFrame, folds: int = 5, text_col: str = "body", label_col: str = "label", prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Each row scored by a model that saw no row of its group of near duplicates.

    ``prepare`` makes the rows to fit on from those of the other folds, which it gets without their text; it may leave out
    rows (known by ``row_id``) and change labels. All rows are scored.
    """
    rows = checkpointed(dealt(train, folds, text_col))
    taken = [prepare(rows.drop(text_col).where(F.col("fold") != k)).select("row_id", label_col, F.lit(1 << k).cast("long").alias("fits")) for k in range(folds)]
    taken = reduce(DataFrame.unionByName, taken).groupBy("row_id", label_col).agg(F.bit_or("fits").alias("fits"))
    models = fit_all(labelled(rows.select("row_id", text_col).join(taken, "row_id"), text_col, label_col, F.col("fits")), folds)
    parts = [_scored(blocks, intercept, rows.where(F.col("fold") == k), text_col) for k, (blocks, intercept, _) in enumerate(models)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _file(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _file(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _get(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())  # a small file


def promote(spark: SparkSession, folder: str, version: int) -> None:
    """Make a written version the current one; earlier ones stay, so that this also rolls back."""
    fs, at = _file(spark, f"{folder}/v{version}")
    if not fs.exists(at):
        raise FileNotFoundError(f"there is no version {version} in {folder}")
    _put(spark, f"{folder}/current.txt", f"v{version}")


def save(model: PipelineModel, folder: str, config: dict) -> int:
    """Write a new version, whole, and only then make it the current one; returns its number. Any Hadoop file system."""
    spark = SparkSession.active()
    fs, root = _file(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    number = 1 + max((int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()), default=0)
    model.write().save(f"{folder}/v{number}/model")
    _put(spark, f"{folder}/v{number}/config.json", json.dumps({**config, "version": number, "classes": LABELS}))
    promote(spark, folder, number)
    return number


def current_config(spark: SparkSession, folder: str) -> dict:
    """The configuration of the current version."""
    return json.loads(_get(spark, f"{folder}/{_get(spark, f'{folder}/current.txt').strip()}/config.json"))


def load(folder: str) -> tuple[PipelineModel, dict]:
    """The current version and its configuration."""
    spark = SparkSession.active()
    config = current_config(spark, folder)
    return PipelineModel.load(f"{folder}/v{config['version']}/model"), config
