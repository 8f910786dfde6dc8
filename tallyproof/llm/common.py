"""Helpers shared by the corpus operators.

Words are runs of characters outside ``[ \\t\\n\\v\\f\\r]`` everywhere in this subpackage; that set is
ASCII, so a UTF-8 buffer can be cut into words byte by byte.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Java and Python regular expression for the characters between two words.
GAP = "[ \\t-\\r]"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``. Only a local session (tests) gets a
    temporary one; a cluster without the setting is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a table written to the shared folder.

    Unlike ``checkpoint()``, a table read back has the size of its files, where the plan's estimates multiply with
    every join of a loop.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_array(text: Column) -> Column:
    """The words of ``text`` as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """Size of a text column in bytes, by one aggregation; it sizes buckets in proportion to the data."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


# ---------------------------------------------------------------- numpy inside tasks

_GAP_BYTE = np.zeros(256, dtype=bool)
_GAP_BYTE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.Generator(np.random.PCG64(20_240_117))
#: Odd multiplier of the rolling hash modulo 2**64 and one random value for each byte.
RADIX = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUE = _rng.integers(1, 2**63, size=256, dtype=np.uint64)


def _inverse(odd: int) -> int:
    return pow(int(odd), -1, 2**64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64. The longest table made so far is kept; n follows a batch's bytes."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), np.uint64(base), dtype=np.uint64)
        known[0] = 1
        _powers[base] = known = np.multiply.accumulate(known)
    return known[:n]


class RollingHash:
    """Rabin-Karp prefix sums over a sequence of 64-bit values: any range's hash in O(1).

    Arithmetic is modulo 2**64 with an odd radix, which has an inverse, so a range's sum is brought to
    exponent 0 by one multiplication.
    """

    def __init__(self, values: np.ndarray, radix: int = int(RADIX)):
        n = len(values)
        self.back = powers(_inverse(radix), n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(radix, n), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a UTF-8 byte array."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_GAP_BYTE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word, length included."""
    roll = RollingHash(BYTE_VALUE[data])
    return mixed(roll.of(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
