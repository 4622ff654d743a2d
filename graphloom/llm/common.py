"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import configure

#: ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Words of digits, letters and all beyond ASCII, once A-Z are lower-cased; as
#: a pattern, and as a byte table that turns every other byte into a space.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_BYTES = bytes(b if b > 127 or chr(b).isdigit() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))

#: Texts reach Python in batches of bounded bytes, so that very long texts fit.
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings the operators rely on."""
    configure(spark)
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(text, UPPER, UPPER.lower())


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit ``repartition`` calls."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)
