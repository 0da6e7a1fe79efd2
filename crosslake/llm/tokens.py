"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslake.functions.common import ship

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the split pattern that belongs to this public vocabulary
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):  # noqa: ANN201
    """The tokenizer of a rank file; loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def shipped_tokenizer(spark: SparkSession, path: str) -> str:
    """Sends a tokenizer's file to all executors, once for each context; the name by which they find it."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_crosslake_tokenizers", set())
    if path not in sent:
        sc.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER_FILE, pattern: str = SPLIT_PATTERN, keep: tuple[str, ...] = (), score: tuple[str, Callable[[pa.Array], pa.Array]] | None = None) -> DataFrame:
    """``id_col``, the columns of ``keep``, and n_tokens: the whole text's size. Null and empty texts have 0 tokens.

    ``path`` is a file of the driver, which the executors get sent. ``score`` (name,
    function of a batch's texts) adds a column of numbers from the same pass.
    """
    ship(df.sparkSession)
    name = shipped_tokenizer(df.sparkSession, path)
    out = df.select(id_col, *keep).schema.add("n_tokens", "long")
    if score:
        out = out.add(score[0], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name), pattern)
        for b in batches:
            # a fresh text object for each row; a batch's texts are never all decoded at once
            n = [len(enc.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in b.column(b.num_columns - 1)]
            more = [score[1](b.column(b.num_columns - 1))] if score else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), *more], names=[f.name for f in out.fields])

    return df.select(id_col, *keep, F.col(text_col).alias("__text")).mapInArrow(run, out)
