"""Labelled samples and calibration for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossmill.llm.common import crc_mod

#: Labelled rows that a classifier is fitted on, for each label at most, and their bytes; longer texts than a sixteenth of those
#: are not fitted on. All rows are scored; only fitting is bounded.
ROWS_PER_LABEL = 2000
BYTES_PER_LABEL = 16 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS_PER_LABEL, held: int = 1, of: int = 3, size: int = BYTES_PER_LABEL) -> list[tuple[str, int]]:
    """(text, label) of up to `rows` training documents and `size` bytes of each label, 0 and 1, in the order of a hash of their ids.

    Documents whose crc32 of the id modulo `of` is `held` are never read. The ids are chosen from the labels alone, so what is
    sent to the executors and what comes back is bounded by `rows` and `size`, whatever the size of the tables. Of an id's
    several labels or texts the least one counts.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), of) != held))
    usable = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.col(label).cast("int")).alias("_y"))
    order = F.xxhash64("_id")
    ids = [r for y in (0, 1) for r in usable.filter(F.col("_y") == y).orderBy(order, "_id").limit(rows).collect()]
    if not ids:
        return []
    wanted = docs.sparkSession.createDataFrame(ids, usable.schema)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") * 16 <= size)
    found = texts.join(F.broadcast(wanted), F.col("doc_id") == F.col("_id")).groupBy("_id", "_y").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("_y").orderBy(order, "_id").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("_upto", upto).filter(F.col("_upto") <= size)
    return [(r["text"], r["_y"]) for r in found.orderBy(order, "_id").collect()]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last one is the intercept, which is not penalised."""
    scale = np.append(np.maximum(x.std(0), 1e-9), 1.0)
    x = np.column_stack([x, np.ones(len(x))]) / scale
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty * len(x))
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
