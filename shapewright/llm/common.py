"""Helpers shared by the text operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Names a checkpoint folder if the session has none (tests); a cluster's own setting is kept."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(folder or "/tmp/checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there: lost executors redo nothing before it."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; null is empty."""
    col = batch.column(name)
    if pa.types.is_null(col.type):
        return [b""] * len(col)
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def text_str(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def per_row(df: DataFrame, columns: list[str | Column], schema: str | T.StructType, fn: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """mapInArrow over the chosen columns. fn() is called once a task and returns what turns a batch into columns."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in batches:
            # few rows at a time: the lists and arrays made of them stay small
            for part in pieces(batch):
                out = work(part)
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes, a row at least."""
    n = batch.num_rows
    step = max(1, min(n, int(n * most / max(1, batch.nbytes))))
    for i in range(0, n, step):
        yield batch.slice(i, step)


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every word of the texts, one after the other, and where each text's words start.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, hashed eight bytes at a time, all words at once. The third
    array has one more entry than there are texts.
    """
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = b" ".join(texts) + b" "
    data += bytes(24 - len(data) % 8)
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    end = int(sizes.sum()) if len(texts) else 1
    space = space[:end]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    start, length = edges[0::2], edges[1::2] - edges[0::2]
    words = np.frombuffer(data, np.uint64)

    def load(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The eight bytes from a place on, those past n as zeros."""
        k, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        x = (words[k] >> shift) | ((words[k + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return x & _MASKS[np.minimum(n, 8)]

    n64 = length.astype(np.uint64)
    x = load(start, length)
    ka, kb = odd_constants(2, "words")
    a, b = mix((x ^ n64 * kb) * ka), mix((x ^ n64 * ka) * kb)
    at = np.flatnonzero(length > 8)
    done = 8
    while len(at):
        x = load(start[at] + done, length[at] - done)
        a[at], b[at] = mix((a[at] ^ x) * ka), mix((b[at] ^ x) * kb)
        done += 8
        at = at[length[at] > done]
    return a, b, np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))


@lru_cache(maxsize=256)
def odd_constants(n: int, tag: str) -> np.ndarray:
    """n fixed odd 64-bit factors, drawn from a hash of the tag."""
    return np.array([int.from_bytes(hashlib.blake2b(f"{tag}:{i}".encode(), digest_size=8).digest(), "little") | 1 for i in range(n)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_hash(words: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Hash of each run of len(factors) words; len(words) must be as long at least."""
    n = len(words) - len(factors) + 1
    out = words[:n] * factors[0]
    for j in range(1, len(factors)):
        out += words[j : n + j] * factors[j]
    return mix(out)


def text_size(df: DataFrame, name: str = "text") -> tuple[int, int]:
    """Rows and bytes of text; one column is read."""
    r = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()
    return r[0], r[1]


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    return [next(n + "_" * i for i in range(len(columns) + 1) if (n + "_" * i).lower() not in taken) for n in names]


def hex_sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
