"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

OWN_CHECKPOINTS = "/tmp/clauseframe-checkpoints"
#: Spark's own bound on the number of buckets of a table; a fixed value.
MOST_BUCKETS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or, on a local master only, a folder of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        where = OWN_CHECKPOINTS
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def schema_with(df: DataFrame, **more: str) -> str:
    """The columns of ``df`` and ``more``, as a schema string."""
    quoted = lambda n: "`" + n.replace("`", "``") + "`"
    return ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields), *(f"{quoted(n)} {k}" for n, k in more.items())])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it is computed once, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, buckets: int = 1) -> DataFrame:
    """``df`` as a table in the shared folder that later steps group by ``key`` without a shuffle.

    There are as many buckets as shuffle partitions, or ``buckets`` if that is more. Only the session's catalog can tell Spark
    that files are bucketed, so a table name exists there while the frame is made; the files stay without it.
    """
    spark = df.sparkSession
    own = f"clauseframe_{name}_{uuid.uuid4().hex}"
    n = min(MOST_BUCKETS, max(partitions(spark), buckets))
    df.write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{own}").saveAsTable(own)
    table = spark.table(own)
    spark.sql(f"DROP TABLE {own}")
    return table


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def portions(batch: pa.RecordBatch, *names: str, size: int = 256) -> Iterator[tuple]:
    """The rows of a batch as Python values of the columns ``names``, ``size`` rows at a time, so that texts stand in
    memory twice for a few rows only."""
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` of a function of one batch. ``make`` runs once in each task and gives that function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """Word (bytes or str) -> 64-bit hash, computed once for each word until ``most`` are held."""

    def __init__(self, most: int = 400_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes | str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits: xor-shift and multiply, twice."""
    h = h ^ (h >> np.uint64(32))
    for _ in range(2):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` hashes, in order: hashes of runs of 1, 2, 4, ... are mixed pair by pair, and those that
    make up ``n`` are mixed one after another. No step is linear in what it takes, so runs have no collisions by construction."""
    factor, count = np.uint64(0x9E3779B97F4A7C15), len(h) - n + 1
    run, size, out, done = mixed(h), 1, None, 0
    while True:
        if n & size:
            part = run[done : done + count]
            out, done = part if out is None else mixed(out * factor + part), done + size
        if done == n:
            return out
        run, size = mixed(run[:-size] * factor + run[size:]), 2 * size


class Words(dict):
    """Words (bytes) as two 64-bit halves of their BLAKE2 digests, made once for each word while at most ``most`` are held.

    A word is what stands between ASCII white space, as ``bytes.split`` sees it.
    """

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most, self.made, self.digests, self.new = most, 0, np.empty((2, 1024), np.uint64), []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(blake2b(word, digest_size=16).digest())
        return at

    def halves(self, words: list[bytes]) -> np.ndarray:
        """Two rows, a column for each word."""
        if len(self) > self.most:
            self.clear()
            self.made = 0
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            more = np.frombuffer(b"".join(self.new), "<u8").reshape(-1, 2).T
            end = self.made + more.shape[1]
            if end > self.digests.shape[1]:
                grown = np.empty((2, 2 * end), np.uint64)
                grown[:, : self.made] = self.digests[:, : self.made]
                self.digests = grown
            self.digests[:, self.made : end] = more
            self.made, self.new = end, []
        return self.digests[:, at]


def gaps(ordered: np.ndarray) -> bytes:
    """Ascending whole numbers from 0 as gaps, seven bits a byte, the highest bit set where more follow. The cost grows with the
    logarithm of the gaps."""
    left = np.diff(ordered, prepend=0).astype(np.uint64)
    if not len(left):
        return b""
    size = np.ones(len(left), np.int64)
    more = left >> np.uint64(7)
    while more.any():
        size += more > 0
        more >>= np.uint64(7)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(int(size.max())):
        own = size > i
        low = (left[own] & np.uint64(127)).astype(np.uint8)
        out[start[own] + i] = np.where(size[own] > i + 1, low | 128, low)
        left >>= np.uint64(7)
    return out.tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    start = np.flatnonzero(np.append(True, last[:-1]))
    place = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), start))
