"""Quality rules by compression bands.

Repetitive text compresses too well and random text hardly at all. A text's zstandard ratio (bytes over compressed
bytes) must lie in a band that depends on its length, since longer texts give the compressor more to refer back to.
The same holds for its fixed chunks, so that a stretch of junk in a longer text isn't averaged away. What is left after
the whole chunks is tested as a chunk that ends with the text.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import per_row, text_bytes

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits for ratios. `limits` has (bytes from, least, most), in order; chunks of `chunk` bytes have their own pair.

    A text fails if its own ratio is outside its band, or if more than `bad_share` of its chunks are outside theirs.
    Set by hand, wide of the ratios of ordinary prose in several languages (1.3 to 1.7 at 300 bytes, 2.2 to 2.6 at
    20 kB), and above those of encoded random bytes (1.33 from 3 kB on).
    """

    level: int = 3
    limits: tuple[tuple[int, float, float], ...] = ((0, 0.0, 3.0), (256, 1.15, 3.2), (512, 1.25, 3.4), (1024, 1.4, 3.6), (4096, 1.5, 4.2), (16384, 1.6, 4.8), (65536, 1.6, 5.5))
    chunk: int = 4096
    chunk_limits: tuple[float, float] = (1.45, 4.2)
    bad_share: float = 0.25

    def band(self, n: int) -> tuple[float, float]:
        return self.limits[bisect.bisect_right([x[0] for x in self.limits], n) - 1][1:]


BANDS = Bands()
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long, n_chunks long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    key = ids[:-2] * k + ids[1:-1]
    if k > 2_000_000:  # keys of three would not fit: pairs are numbered first
        key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    key = key * k + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def compression(data: bytes, compressor, bands: Bands) -> tuple[float, int, int, bool]:
    """(ratio, chunks outside the limits, chunks, within the bands); a text shorter than a chunk has none"""
    if not data:
        return 0.0, 0, 0, True
    ratio = len(data) / len(compressor.compress(data))
    least, most = bands.band(len(data))
    starts = list(range(0, len(data) - bands.chunk + 1, bands.chunk))
    if starts and len(data) % bands.chunk:
        starts.append(len(data) - bands.chunk)
    bad = 0
    for i in starts:
        r = bands.chunk / len(compressor.compress(data[i : i + bands.chunk]))
        bad += not bands.chunk_limits[0] <= r <= bands.chunk_limits[1]
    return ratio, bad, len(starts), least <= ratio <= most and bad <= bands.bad_share * len(starts)


def measure(data: bytes, compressor, bands: Bands = BANDS) -> dict:
    words = data.split()  # splits bytes at 0x20 and 0x09-0x0D, no others
    n = len(words)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeat = repeated_words(words)
    failed = n < 50 or 100 * repeat > 50 * n
    ratio, bad, chunks, fits = compression(data, compressor, bands)
    return {
        "n_words": n,
        # code points: bytes that don't continue one
        "word_chars": sum(map(len, words)) if data.isascii() else sum(len(w.decode("utf-8", "surrogatepass")) for w in words),
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat,
        "base_failed": failed,
        "kept": not failed and fits,
        "ratio": ratio,
        "bad_chunks": bad,
        "n_chunks": chunks,
    }


def quality(docs: DataFrame, bands: Bands = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, the base counts, base_failed, kept, and the compression figures.

    Null and empty texts have no words, so they fail the base rules and aren't kept. Repeated rows and null ids stay
    as they are; an empty table gives an empty table; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def fn():
        import zstandard

        z = zstandard.ZstdCompressor(level=bands.level)

        def work(batch):
            rows = [measure(x, z, bands) for x in text_bytes(batch, text_col)]
            return {id_col: batch.column(id_col)} | {k: [r[k] for r in rows] for k in (rows[0] if rows else [x.split()[0] for x in COLUMNS.split(", ")])}

        return work

    return per_row(docs, [id_col, text_col], f"`{id_col}` {kind}, {COLUMNS}", fn)


def keep_good(docs: DataFrame, bands: Bands = BANDS, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text passes; all columns stay, whatever their names, also if two share one.

    Null and empty texts go, as they have fewer than 50 words. Repeated rows stay or go alike; null ids don't matter; an
    empty table gives an empty table.
    """
    from pyspark.sql import types as T

    text = docs.columns.index(text_col)
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])

    def run(batches):
        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            yield b.filter(pa.array([measure(x, z, bands)["kept"] for x in text_bytes(b, f"c{text}")], pa.bool_()))

    return docs.toDF(*plain.names).mapInArrow(run, plain).toDF(*docs.columns)
