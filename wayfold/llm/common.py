"""What the operators of this subpackage share: words, folds and safe reading of a column."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The white space that ends a word (space, tab to carriage return).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; null text gives an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


#: A-Z lowered and every white space a blank; all other bytes of UTF-8 are parts of words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def lower_words(text: str | None) -> list[bytes]:
    """The same words with A-Z lowered, in UTF-8: ``bytes`` split at these blanks alone, ``str`` at other Unicode blanks too."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


class WordHashes(dict):
    """``hash_of`` each word, kept for a bounded number of words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = hash_of(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = lower_words(text)
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def fold_is(doc_id: Column, parts: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``parts``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == fold, F.lit(False))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the tasks import this package wherever they run: its source goes along, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="source-")  # of the driver alone: the executors fetch the archive from it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(name, "w") as archive:
        for part in sorted(package.rglob("*.py")):
            archive.write(part, part.relative_to(package.parent))
    context.addPyFile(name)
    _shipped.add(context.applicationId)


def as_frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """The batch in pandas; whole numbers beside nulls stay whole numbers, which pandas would else round to floats."""
    frame = batch.to_pandas()
    for name, column in zip(batch.schema.names, batch.columns):
        if column.null_count and pa.types.is_integer(column.type):
            frame[name] = column.to_pandas(types_mapper={column.type: INTEGERS[column.type]}.get)
    return frame


INTEGERS = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInPandas`` whose function may use this package's modules, and which hands on 64-bit ids beside nulls unrounded."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(map(as_frame, batches)):
            # by way of a table: a text column may come in chunks, or in none
            yield from pa.Table.from_pandas(out, schema=kind, preserve_index=False).combine_chunks().to_batches()
            pa.default_memory_pool().release_unused()  # workers live on: what one task took is not kept for the next

    return map_arrow(df, frames, schema)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` whose function may use this package's modules; columns it hands on keep their exact values."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def byte_table(kept: bytes) -> bytes:
    """A ``bytes.translate`` table for UTF-8: A-Z lowered, ``kept`` and all bytes of non-ASCII characters as they are, the rest blank."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in kept else 32 for b in range(256))


#: A side of at most so many rows may be broadcast; beyond it, the parts that a hot key of the other side is dealt to.
BROADCAST, SALTS = 1 << 17, 16


def meet(many: DataFrame, few: DataFrame, on: list[str], most: int = BROADCAST, salts: int = SALTS) -> DataFrame:
    """Inner equi-join in which a key may hold any share of ``many``; ``few`` is a written table.

    A ``few`` of at most ``most`` rows is broadcast.  A larger one is sent ``salts`` times, once to each part that
    the rows of ``many`` are dealt to by a hash of all their columns.
    """
    if few.count() <= most:
        return many.join(F.broadcast(few), on)
    dealt = many.withColumn("__salt", F.pmod(F.xxhash64(*many.columns), F.lit(salts)))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, [*on, "__salt"]).drop("__salt")


def most_frequent(counts: DataFrame, count: str, most: int) -> DataFrame:
    """The rows whose count lies above a cut under which at most ``most`` rows remain.

    The cut comes from the table of counts, which has a row per distinct count; rows of the cut's own count
    stay out together, so nothing is sorted and the bound holds whatever the ties.
    """
    steps = counts.groupBy(count).agg(F.count(F.lit(1)).alias("__rows"))
    upward = Window.orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, 0)
    cut = (steps.withColumn("__above", F.sum("__rows").over(upward)).where(F.col("__above") > most)
           .agg(F.coalesce(F.max(count), F.lit(0))).first()[0])
    return counts.where(F.col(count) > cut)
