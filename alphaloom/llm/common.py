"""What the operators of this subpackage share: the shared scratch folder, row input and small column helpers."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.plans.stored import new_path, stored

#: Intermediate tables, in the folder that all executors share.
scratch, scratch_path = stored, new_path
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def free_name(df: DataFrame, name: str) -> str:
    """name, or the next like it that no column of df has; letters count alike in either case, as in Spark."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Into how many parts the rows of a key are dealt where what is known of the key is joined to them.
SALTS = 16


def spread_join(rows: DataFrame, known: DataFrame, key: str, by: str = "doc_id") -> DataFrame:
    """rows with the columns of known, which has few rows, one a key at most, or null.

    A key's rows are dealt to SALTS parts by the column by, so that one with a third of them all isn't one task's; known is
    repeated as often. They are dealt by content: rand() would deal a recomputed row to another part.
    """
    salt = free_name(rows, "salt")
    parts = known.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(F.lit(3), *(F.col(c) for c in rows.columns if c == by)), F.lit(SALTS)).cast("int"))
    return dealt.join(parts, [key, salt], "left").drop(salt)


def on_executors(spark: SparkSession) -> None:
    """Python workers find this package even if it is not installed and they start in another folder."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def blocks(batches: Iterator[pa.RecordBatch], column: str, chars: int = 2_000_000, rows: int = 2048) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about so many characters at most (one row at least), with the column as Python values."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        begin = 0
        while begin < batch.num_rows:
            part = batch.slice(begin, rows)
            values, total, n = [], 0, 0
            for value in part.column(at):
                value = value.as_py()
                values.append(value)
                n += 1
                total += len(value or "")
                if total >= chars:
                    break
            yield part.slice(0, n), values
            begin += n


def sample_ids(df: DataFrame, by: str, id_col: str, per_class: int, seed: int = 7) -> DataFrame:
    """About per_class rows of each value of `by`, chosen by a hash of the id, so that the choice is the same on every run and needs no shuffle of the rows.

    The classes' counts are collected: one row for each label. The expected size is per_class for each label.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(by).count().collect() if r[0] is not None}
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30))
    keep = F.lit(False)
    for value, n in sorted(sizes.items()):
        bound = 1 << 30 if n <= per_class else int((1 << 30) * per_class / n)
        keep = keep | ((F.col(by) == F.lit(value)) & (draw < F.lit(bound)))
    return df.where(keep)
