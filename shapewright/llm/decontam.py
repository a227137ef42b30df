"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark window (13 words of an item, or a whole shorter item) is a set of shingles that a document must hold
in full. Shingles are ordered by how rarely documents hold them, so the necessary prefix of a window is its rarest
shingle: a document without it cannot hold the window. Documents look up only these prefix shingles; a match must fit
by position (enough words before and after it in the text), and the window's words are then compared one by one.

The benchmark side is turned into an index that goes to every task. Its size is bounded: a benchmark beyond
`most_windows` is taken in blocks, each with its own pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_names, mix, odd_constants, pieces, text_bytes, window_hash

WINDOW = 13
SHINGLE = 3
# fixed values: A-Z to lower case, all other ASCII but letters and digits to a space
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield tuple(words[i : i + size])


@dataclass
class Index:
    """A block of the benchmark, as each task gets it. Words are numbered from 1; 0 is any other word."""

    numbers: dict[bytes, int] = field(default_factory=dict)
    windows: list[tuple[int, ...]] = field(default_factory=list)
    items: list[list[str]] = field(default_factory=list)  # of each window
    shingles: dict[int, np.ndarray] = field(default_factory=dict)  # by length: sorted hashes
    prefix: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)  # by length: hash -> (window, offset)
    keys: dict[int, np.ndarray] = field(default_factory=dict)  # by length: sorted hashes of prefix

    @staticmethod
    def build(rows: list[tuple[str, bytes]]) -> Index:
        out, seen, held = Index(), {}, []
        for item, text in rows:
            for w in windows_of(words_of(text)):
                key = tuple(out.numbers.setdefault(x, len(out.numbers) + 1) for x in w)
                if key not in seen:
                    seen[key] = len(out.windows)
                    out.windows.append(key)
                    held.append(set())
                held[seen[key]].add(item)
        out.items = [sorted(x) for x in held]
        by: dict[int, set[int]] = {}
        for w in out.windows:
            by.setdefault(min(SHINGLE, len(w)), set()).update(shingle_hashes(np.array(w)).tolist())
        out.shingles = {k: np.array(sorted(v), np.uint64) for k, v in by.items()}
        return out

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Chooses each window's rarest shingle; the hash decides between equals, so neighbours choose alike."""
        for n, w in enumerate(self.windows):
            size = min(SHINGLE, len(w))
            h = shingle_hashes(np.array(w))
            count = counts[size][np.searchsorted(self.shingles[size], h)]
            at = min(range(len(h)), key=lambda i: (count[i], h[i], i))
            self.prefix.setdefault(size, {}).setdefault(int(h[at]), []).append((n, at))
        self.keys = {k: np.array(sorted(v), np.uint64) for k, v in self.prefix.items()}


def shingle_hashes(numbers: np.ndarray, size: int | None = None) -> np.ndarray:
    size = size or min(SHINGLE, len(numbers))
    return window_hash(numbers.astype(np.uint64), odd_constants(size, f"shingle{size}"))


def positions(numbers: np.ndarray, size: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of shingles among wanted, their places in wanted)"""
    if len(numbers) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = numbers > 0
    full = known[: len(numbers) - size + 1].copy()
    for j in range(1, size):
        full &= known[j : len(numbers) - size + 1 + j]
    at = np.flatnonzero(full)
    if not len(at):
        return at, at
    factors = odd_constants(size, f"shingle{size}")
    h = numbers[at].astype(np.uint64) * factors[0]
    for j in range(1, size):
        h += numbers[at + j].astype(np.uint64) * factors[j]
    h = mix(h)
    k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
    ok = wanted[k] == h
    return at[ok], k[ok]


def numbered(words: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    get = numbers.get
    return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def rarity(docs: DataFrame, index: Index, text_col: str) -> dict[int, np.ndarray]:
    """How often all documents hold each shingle of the block."""
    shared = docs.sparkSession.sparkContext.broadcast((index.numbers, index.shingles))

    def run(batches):
        numbers, shingles = shared.value
        total = {k: np.zeros(len(v), np.int64) for k, v in shingles.items()}
        for b in batches:
            for data in text_bytes(b):
                ids = numbered(words_of(data), numbers)
                if not ids.any():
                    continue
                for k, wanted in shingles.items():
                    total[k] += np.bincount(positions(ids, k, wanted)[1], minlength=len(wanted))
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_pydict({"size": np.full(len(at), k, np.int32), "at": at.astype(np.int32), "n": v[at]})

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "size int, at int, n long").groupBy("size", "at").agg(F.sum("n").alias("n")).collect()  # at most the block's shingles
    out = {k: np.zeros(len(v), np.int64) for k, v in index.shingles.items()}
    for size, at, n in rows:
        out[size][at] = n
    return out


def hits(words: list[bytes], index: Index) -> tuple[np.ndarray, set[str]]:
    """Which words lie in an occurrence of a window, and the items that have such windows."""
    ids = numbered(words, index.numbers)
    hit = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    if not ids.any():
        return hit[:-1] > 0, items
    for size, keys in index.keys.items():
        prefix = index.prefix[size]
        at, k = positions(ids, size, keys)
        seen: dict[int, list[str]] = {}
        for i, key in zip(at.tolist(), keys[k].tolist()):
            for n, offset in prefix[key]:
                w = index.windows[n]
                start = i - offset
                if start < 0 or start + len(w) > len(ids):
                    continue
                if tuple(ids[start : start + len(w)].tolist()) == w:
                    hit[start] += 1
                    hit[start + len(w)] -= 1
                    seen[n] = index.items[n]
        for names in seen.values():
            items.update(names)
    return np.cumsum(hit)[:-1] > 0, items


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most_windows: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items as (name, text), as many at a time as give most_windows windows; only those are held."""
    rows: list[tuple[str, bytes]] = []
    n = 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        if item is None or not text:
            continue
        rows.append((item, bytes(text)))
        n += len(text) // 2 // 6 + 1
        if n >= most_windows:
            yield rows
            rows, n = [], 0
    if rows:
        yield rows


def marked(docs: DataFrame, benchmark: DataFrame, most_windows: int, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with the words that windows cover, and the names of the new columns: words, hit, bits, items.

    Each block of the benchmark is a pass of its own. Between passes the rows are written down, so a task holds one
    block's index at a time.
    """
    names = dict(zip(("words", "hit", "bits", "items"), free_names(docs.columns, "hit_words", "hit_hit", "hit_bits", "hit_items")))
    at, width = docs.columns.index(text_col), len(docs.columns)
    plain = [f"c{i}" for i in range(width)]
    out = docs.toDF(*plain).withColumns({names["words"]: F.lit(0).cast("long"), names["hit"]: F.lit(0).cast("long"), names["bits"]: F.lit(None).cast("binary"), names["items"]: F.array().cast("array<string>")})
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])

    def pass_over(before: DataFrame, shared) -> DataFrame:
        def run(batches):
            index = shared.value
            for b in batches:
                for part in pieces(b):
                    state = [part.column(width + i).to_pylist() for i in (2, 3)]
                    n_words, n_hit, bits, items = [], [], [], []
                    for data, old, had in zip(text_bytes(part, part.schema.names[at]), *state):
                        words = words_of(data)
                        hit, found = hits(words, index)
                        if old is not None:
                            hit |= np.unpackbits(np.frombuffer(old, np.uint8), count=len(words)).astype(bool)
                        n_words.append(len(words))
                        n_hit.append(int(hit.sum()))
                        bits.append(np.packbits(hit).tobytes() if hit.any() else None)
                        items.append(sorted(found.union(had or ())))
                    types = [part.schema.field(width + i).type for i in range(4)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], *(pa.array(x, t) for x, t in zip((n_words, n_hit, bits, items), types))], schema=part.schema)

        return before.mapInArrow(run, schema)

    first = True
    for rows in blocks(benchmark, item_col, item_text_col, most_windows):
        index = Index.build(rows)
        index.order(rarity(docs, index, text_col))
        out = pass_over(out if first else cut(out), docs.sparkSession.sparkContext.broadcast(index))
        first = False
    if first:  # nothing to look for: words are counted all the same
        out = pass_over(out, docs.sparkSession.sparkContext.broadcast(Index()))
    return out.toDF(*docs.columns, *names.values()), names


def leaked(names: dict[str, str]) -> Column:
    hit = F.col(names["hit"])
    return (hit > 0) & (20 * hit >= F.col(names["words"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_windows: int = 400_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; items without an id or words are left out, and repeated items count
    once. Repeated rows and null ids stay as they are; an empty benchmark hits nothing; an empty table gives an empty
    table; other columns are ignored. contaminated: a word is hit, and 20 times the hit words are as many as all words.
    """
    out, c = marked(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), benchmark, most_windows, text_col, item_col, item_text_col)
    return out.select(
        id_col,
        F.col(c["words"]).alias("n_words"),
        F.col(c["hit"]).alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c["items"]), 256).alias("items_sha256"),
        leaked(c).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, most_windows: int = 400_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with all their columns, whatever their names.

    One window is enough for a row to go: a share of the words, as in `contaminated`, would let long texts keep whole
    passages. Null and empty texts stay, as do null ids; repeated rows go or stay alike; an empty benchmark takes
    nothing away; an empty table gives an empty table.
    """
    out, c = marked(docs, benchmark, most_windows, text_col, item_col, item_text_col)
    return out.where(F.col(c["hit"]) == 0).drop(*c.values())
