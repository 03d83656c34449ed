"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflux.operators.components import cut, shared_dir  # noqa: F401

#: The six ASCII white space characters that separate words.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(taken: list[str], wanted: str) -> str:
    """``wanted``, or the first free variation of it, whatever case the taken names have."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def core(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the columns an operator works on, so that no other column can clash with its own names."""
    return df.select(F.col(id_col).alias(id_col), *[F.col(c).alias(c) for c in cols])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in smaller pieces, so that what is made from them stays small; freed memory goes back between them."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
        pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, col: str) -> Iterator[str]:
    """The strings of a column one by one; null counts as empty."""
    for x in batch.column(col):
        yield x.as_py() or ""


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the folder can be given in CANOPYFLUX_TOKENIZERS."""
    if folder := os.environ.get("CANOPYFLUX_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Memory(dict):
    """Remembers a bounded number of items. When full, what was used since it was last full stays for one more round."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most // 2, {}

    def missing(self, wanted: set) -> set:
        """Those of ``wanted`` that must be learnt; all others are items of this dictionary after the call."""
        new = wanted.difference(self)
        if len(self) + len(new) > self.most:
            self.old = dict(self)
            self.clear()
            new = wanted
        if self.old and (known := new.intersection(self.old)):
            self.update((x, self.old[x]) for x in known)
            new = new - known
        return new

    def forget(self) -> None:
        self.clear()
        self.old = {}
