"""A quality weight for texts: how usual a text is under a character model of the whole corpus.

The model is a trigram model over code points whose counts go by hashed buckets, so it has a
fixed size however many texts and characters there are; its counts cover every text. A
text's bits are its mean surprise for each character. Within a source the texts near its mean
weigh most; boiler plate (few bits) and noise (many) weigh less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosslake.functions.common import ship
from crosslake.llm.spans import _coded, _mix

BUCKETS = 1 << 16
SMOOTHING = 0.5
LEAST_WEIGHT = 0.05


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each three characters in a row, bucket of the first two of them)."""
    c = codes.astype(np.uint64)
    two = _mix(c[:-2], c[1:-1])
    return (_mix(two, c[2:]) % BUCKETS).astype(np.int64), (two % BUCKETS).astype(np.int64)


def _inside(lengths: np.ndarray, total: int) -> np.ndarray:
    """Which grams lie within one text."""
    ok = np.ones(max(0, total - 2), bool)
    ends = np.cumsum(lengths)
    for back in (1, 2):
        at = ends - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def train(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The counts of all trigrams and of their contexts, BUCKETS numbers each. Null and empty texts have none."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        three, two = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, codes, lengths in _coded(b.column(0)):
                if len(codes) > 2:
                    ok = _inside(lengths, len(codes))
                    g3, g2 = _grams(codes)
                    three += np.bincount(g3[ok], minlength=BUCKETS)
                    two += np.bincount(g2[ok], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(three), pa.array(two)], names=["b", "three", "two"])

    got = docs.select(text_col).mapInArrow(run, "b int, three bigint, two bigint").groupBy("b").agg(F.sum("three").alias("three"), F.sum("two").alias("two")).toArrow()  # BUCKETS rows
    three, two = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    at = got["b"].to_numpy()
    three[at], two[at] = got["three"].to_numpy(), got["two"].to_numpy()
    return three, two


def scorer(model: tuple[np.ndarray, np.ndarray]) -> Callable[[pa.Array], pa.Array]:
    """The mean bits of a character for each text of an array; null for texts of fewer than three characters."""
    kinds = max(1, int((model[0] > 0).sum()))
    top, below = np.log2(model[0] + SMOOTHING).astype(np.float64), np.log2(model[1] + SMOOTHING * kinds)

    def bits(texts: pa.Array) -> pa.Array:
        out = np.full(len(texts), np.nan)
        for first, codes, lengths in _coded(texts):
            if len(codes) < 3:
                continue
            g3, g2 = _grams(codes)
            run = np.r_[0.0, np.cumsum(below[g2] - top[g3])]
            end = np.cumsum(lengths)
            long = lengths > 2
            at = (end - lengths)[long]
            out[first : first + len(lengths)][long] = (run[end[long] - 2] - run[at]) / (lengths[long] - 2)
        return pa.array(out, pa.float64(), from_pandas=True)

    return bits


def usual_weight(bits: Column, mean: Column, deviation: Column) -> Column:
    """exp(-z²/2) of the distance from the source's mean in its standard deviations, LEAST_WEIGHT at least and for texts without bits."""
    z = F.when(deviation > 0, (bits - mean) / deviation).otherwise(0.0)
    return F.when(bits.isNotNull(), F.greatest(F.lit(LEAST_WEIGHT), F.exp(-z * z / 2))).otherwise(F.lit(LEAST_WEIGHT))
