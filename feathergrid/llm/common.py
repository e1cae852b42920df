"""Small shared helpers: written tables in the shared folder, Arrow batches, hashing of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: ASCII white space, as the contracts name it: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    It cuts the lineage for every later step and survives lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_names(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; of columns with clashing names the exact one, by position."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def fresh_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not use (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def crc32_mod(column: str, k: int) -> Column:
    """crc32 of the column as text, modulo ``k``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % k


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: T.StructType, keep: bool = False) -> DataFrame:
    """Apply ``make()(batch) -> {name: values}`` to Arrow batches; ``make`` runs once per task.

    With ``keep`` the input columns go along unchanged before the new ones; an
    input column with the name of a new one gives way to it.
    Arrow keeps null and 64-bit keys exact, which pandas would turn into floats.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new_names = {f.name.lower() for f in schema}
    stay = [i for i, f in enumerate(df.schema.fields) if keep and f.name.lower() not in new_names]
    full = T.StructType([*(df.schema.fields[i] for i in stay), *schema.fields])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            found = work(batch)
            new = [pa.array(found[f.name], type=f.type) for f in target]
            old = [batch.column(i) for i in stay]
            yield pa.RecordBatch.from_arrays(old + new, names=[batch.schema.names[i] for i in stay] + target.names)

    return df.mapInArrow(run, full)


class WordHash(dict):
    """UTF-8 word -> 64-bit hash, kept for words already met; emptied when it gets large."""

    def __init__(self, size: int = 400_000):
        super().__init__()
        self.size = size

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.size:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8: `bytes.split` cuts at exactly these characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def bounded_sample(rows: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """About ``most`` rows of each label: those with the smallest hash of the key; null keys and labels never.

    Ranking moves only label and hash, at most ``most`` per label and task.
    The column ``h`` orders the sample.  Few labels are expected: one test each.
    """
    hashed = rows.where(f"`{key}` IS NOT NULL AND `{label}` IS NOT NULL").withColumn("h", F.xxhash64(key))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    ranked = hashed.select(F.col(label).alias("label"), "h").withColumn("k", rank).where(F.col("k") <= most)
    bounds = ranked.groupBy("label").agg(F.max("h").alias("top"), F.count("*").alias("n")).collect()
    test = F.lit(False)
    for b in bounds:
        test |= (F.col(label) == F.lit(b["label"])) & (F.col("h") <= b["top"])
    return hashed.where(test).limit(2 * sum(b["n"] for b in bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby inputs become unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))
