"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tarmac.operators.linked import components as components
from tarmac.session import prepare as prepare_session

#: White space between words, everywhere in this subpackage: \x20 and \x09-\x0D, as bytes.split() has it.
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_BLOCK = 1 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under `name`."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return run

    return add


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package; small Arrow batches, as one row may be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return prepare_session(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, of: int) -> Column:
    """crc32(id as text) mod `of`; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def blocks(text: bytes, size: int = _BLOCK) -> Iterator[bytes]:
    """The text cut at white space into pieces of about `size` bytes, so that long texts stay bounded."""
    at, n = 0, len(text)
    while n - at > size:
        m = _SPACE.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each row; null is empty."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def shielded(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """`docs` under column names that clash with nothing an operator adds, the new name of a column, and the way back."""
    names = {c: f"x{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names.__getitem__, lambda df: df.select(*(F.col(v).alias(c) for c, v in names.items()))


def annotate(docs: DataFrame, text_col: str, added: str, fn, keep_text: bool = False) -> DataFrame:
    """`docs` with the columns `added` (as a DDL string) that fn gives for a batch of texts (UTF-8 bytes).

    Columns of `docs` that have one of these names are replaced.
    """
    docs = docs.drop(*StructType.fromDDL(added).names)
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    at = [docs.columns.index(f.name) for f in kept]
    text = docs.columns.index(text_col)
    new = StructType.fromDDL(added)
    schema, kinds = StructType([*kept, *new.fields]), to_arrow_schema(new).types

    def run(batches):
        for b in batches:
            own = [b.column(i) for i in at]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, fn(texts(b.column(text))), kinds)], names=schema.names)

    return docs.mapInArrow(run, schema)
