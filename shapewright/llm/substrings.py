"""Exact removal of repeated passages, behind a count-min prefilter.

Texts are dealt into blocks of bounded size. A block's sketch has `DEPTH` rows; a row counts the block's distinct
windows by a hashed cell. Since nearly all cells of a block are empty, a sketch is stored as its sorted occupied cells,
cut into shards by cell range. Sketches are merged shard by shard; the merged counts only ever overestimate in how many
blocks a window stands. Each block gets back one bit a cell: whether the count is two or more. The windows whose every
cell has that bit (and, in a block, those that repeat there) go to the second pass, which groups them exactly by two
independent 64-bit hashes of word digests and answers, again with a bit, whether a smaller document has the window.
A block sends one row for a window whatever its number of copies there, so no window can fill a task.

The width of the sketch follows the number of words (8 to 16 cells a window), and so do the numbers of shards and blocks:
what one task holds stays the same at every size.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, odd_constants, text_bytes, text_size, window_hash

WINDOW = 13
DEPTH = 2
BLOCK_BYTES = 10_000_000
SHARD_CELLS = 3_000_000
BLOB = "key long, block long, blob binary"
LOW = 16


class Block:
    """The windows of a block's texts, in a fixed order."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("doc_id").to_pylist()
        texts = text_bytes(table)
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]
        wa, wb, at = hashed_words(self.texts)
        self.n_words = np.diff(at).tolist()
        n = max(0, len(wa) - window + 1)
        doc = np.repeat(np.arange(len(ids)), np.diff(at))[:n]
        # windows lie within one text
        ok = np.flatnonzero(np.arange(n) + window <= at[doc + 1])
        if any(i is None for i in self.ids):
            ok = ok[np.array([i is not None for i in self.ids])[doc[ok]]]
        self.doc = doc[ok]
        self.start = ok - at[self.doc]
        if n:
            self.a = window_hash(wa, odd_constants(window, "window-a"))[ok]
            self.b = window_hash(wb, odd_constants(window, "window-b"))[ok]
        else:
            self.a = self.b = np.zeros(0, np.uint64)
        self.order = np.argsort(self.a)

    def rows(self, bits: int):
        """For each row of the sketch: its occupied cells, sorted, and for the windows in some order the place of their cell."""
        for x, order in ((self.a, self.order), (self.b, None)):
            order = np.argsort(x) if order is None else order
            cells = x[order] >> np.uint64(64 - bits)
            first = np.ones(len(cells), bool)
            first[1:] = cells[1:] != cells[:-1]
            yield cells[first], order, np.cumsum(first) - 1


def shards_of(values: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bounds of the n equal ranges of bits-wide values in a sorted array."""
    edges = np.array([-(-(k << bits) // n) for k in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]]).astype(np.int64)


def packed(cells: np.ndarray) -> bytes:
    """Sorted cells as a list of (high part, count) and their low 16 bits."""
    high, n = np.unique(cells >> np.uint64(LOW), return_counts=True)
    return len(high).to_bytes(4, "little") + high.tobytes() + n.astype(np.uint32).tobytes() + (cells & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    k = int.from_bytes(blob[:4], "little")
    high = np.frombuffer(blob, np.uint64, k, 4)
    n = np.frombuffer(blob, np.uint32, k, 4 + 8 * k)
    low = np.frombuffer(blob, np.uint16, -1, 4 + 12 * k)
    return np.repeat(high << np.uint64(LOW), n) | low


def rows(keys: list[int], block: list[int], blobs: list[bytes]) -> pa.Table:
    return pa.table({"key": pa.array(keys, pa.int64()), "block": pa.array(block, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("key").to_pylist(), table.column("blob").to_pylist()))


def bits_of(blobs: list[bytes], sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for b, n in zip(blobs, sizes)] or [np.zeros(0, np.uint8)]).astype(bool)


class Plan:
    """Sizes fixed for a run; the functions of its passes."""

    def __init__(self, n_rows: int, n_bytes: int, window: int = WINDOW):
        self.window = window
        windows = max(1, n_bytes // 5)  # more than there can well be
        self.bits = min(62, max(LOW + 4, math.ceil(math.log2(windows)) + 3))
        self.shards = max(1, math.ceil(windows / SHARD_CELLS))
        self.blocks = max(1, math.ceil(n_bytes / BLOCK_BYTES), math.ceil(n_rows / 50_000))

    def sketch(self, key: tuple, table: pa.Table) -> pa.Table:
        """A block's sketch, a row for each of its rows and shards."""
        block = key[0].as_py()
        b = Block(table, self.window)
        out = ([], [], [])
        for r, (cells, _, _) in enumerate(b.rows(self.bits)):
            at = shards_of(cells, self.shards, self.bits)
            for s in range(self.shards):
                if at[s] < at[s + 1]:
                    for column, x in zip(out, (r * self.shards + s, block, packed(cells[at[s] : at[s + 1]]))):
                        column.append(x)
        return rows(*out)

    def merged(self, key: tuple, parts: pa.Table) -> pa.Table:
        """The merged counts of a shard, as bits for each block's own cells."""
        k = key[0].as_py()
        shard = k % self.shards
        low = -(-(shard << self.bits) // self.shards)
        count = np.zeros(-(-((shard + 1) << self.bits) // self.shards) - low, np.uint8)
        blocks, blobs = parts.column("block").to_pylist(), parts.column("blob").to_pylist()
        for blob in blobs:
            cells = unpacked(blob) - np.uint64(low)
            count[cells] = np.minimum(count[cells] + 1, 2)  # a block names a cell once
        return rows([k] * len(blocks), blocks, [np.packbits(count[unpacked(x) - np.uint64(low)] >= 2).tobytes() for x in blobs])

    def estimated(self, b: Block, got: dict[int, bytes]) -> np.ndarray:
        """Which windows every row of the merged sketch counts in two blocks or more."""
        out = np.ones(len(b.a), bool)
        for r, (own, order, place) in enumerate(b.rows(self.bits)):
            size = np.diff(shards_of(own, self.shards, self.bits))
            bits = bits_of([got[r * self.shards + s] for s in range(self.shards) if size[s]], size[size > 0])
            out[order] &= bits[place]
        return out

    def groups(self, b: Block, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows that repeat in the block or by estimate elsewhere, by hash and document; starts of groups; group of each)"""
        order = b.order
        same = b.a[order[1:]] == b.a[order[:-1]]
        pick = likely.copy()
        pick[order[1:][same]] = True
        pick[order[:-1][same]] = True
        pick = np.flatnonzero(pick)
        pick = pick[np.lexsort((b.doc[pick], b.b[pick], b.a[pick]))]
        first = np.ones(len(pick), bool)
        first[1:] = (b.a[pick[1:]] != b.a[pick[:-1]]) | (b.b[pick[1:]] != b.b[pick[:-1]])
        return pick, np.flatnonzero(first), np.cumsum(first) - 1

    def ask(self, key: tuple, texts: pa.Table, bits: pa.Table) -> pa.Table:
        """Requests for the exact pass: hash and smallest document of each window that may stand elsewhere.

        A row with a negative key carries the block's estimates to its last pass.
        """
        block = key[0].as_py()
        b = Block(texts, self.window)
        likely = self.estimated(b, answers(bits))
        pick, first, _ = self.groups(b, likely)
        send = pick[first][likely[pick[first]]]
        ids = np.array([i or 0 for i in b.ids], np.int64)
        at = shards_of(b.a[send], self.shards, 64)
        out = ([-1 - block], [block], [np.packbits(likely).tobytes()])
        for s in range(self.shards):
            x = send[at[s] : at[s + 1]]
            if len(x):
                for column, v in zip(out, (s, block, b.a[x].tobytes() + b.b[x].tobytes() + ids[b.doc[x]].tobytes())):
                    column.append(v)
        return rows(*out)

    def exact(self, key: tuple, table: pa.Table) -> pa.Table:
        """For each request, whether a smaller document of another block has the same window."""
        k = key[0].as_py()
        if k < 0:
            return table.select(["key", "block", "blob"])
        blocks, blobs = table.column("block").to_pylist(), table.column("blob").to_pylist()
        n = [len(x) // 24 for x in blobs]
        a = np.concatenate([np.frombuffer(x, np.uint64, c) for x, c in zip(blobs, n)])
        b = np.concatenate([np.frombuffer(x, np.uint64, c, 8 * c) for x, c in zip(blobs, n)])
        doc = np.concatenate([np.frombuffer(x, np.int64, c, 16 * c) for x, c in zip(blobs, n)])
        order = np.lexsort((doc, b, a))
        first = np.ones(len(order), bool)
        first[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        least = doc[order[np.flatnonzero(first)]][np.cumsum(first) - 1]
        smaller = np.zeros(len(order), bool)
        smaller[order] = doc[order] > least
        ends = np.cumsum([0, *n])
        return rows([k] * len(n), blocks, [np.packbits(smaller[i:j]).tobytes() for i, j in zip(ends, ends[1:])])

    def removed(self, texts: pa.Table, got: pa.Table) -> tuple[Block, list[np.ndarray | None]]:
        """The block, and which words of each text go (None: none)."""
        b = Block(texts, self.window)
        replies = answers(got)
        note = next((v for k, v in replies.items() if k < 0), b"")
        likely = np.unpackbits(np.frombuffer(note, np.uint8), count=len(b.a)).astype(bool)
        pick, first, group = self.groups(b, likely)
        gone: list[np.ndarray | None] = [None] * len(b.ids)
        if not len(pick):
            return b, gone
        asked = likely[pick[first]]
        send = pick[first][asked]
        size = np.diff(shards_of(b.a[send], self.shards, 64))
        elsewhere = np.zeros(len(first), bool)
        elsewhere[asked] = bits_of([replies[s] for s in range(self.shards) if size[s]], size[size > 0])
        ids = np.array([i or 0 for i in b.ids], np.int64)[b.doc[pick]]
        hit = pick[elsewhere[group] | (ids > ids[first][group])]
        hit.sort()
        docs, at = np.unique(b.doc[hit], return_index=True)
        for k, i, j in zip(docs.tolist(), at.tolist(), [*at[1:].tolist(), len(hit)]):
            edge = np.zeros(b.n_words[k] + 1, np.int64)
            np.add.at(edge, b.start[hit[i:j]], 1)
            np.add.at(edge, b.start[hit[i:j]] + self.window, -1)
            gone[k] = np.cumsum(edge)[:-1] > 0
        return b, gone

    def digest(self, key: tuple, texts: pa.Table, got: pa.Table) -> pa.Table:
        b, gone = self.removed(texts, got)
        sha = []
        for text, g in zip(b.texts, gone):
            words = text.split()
            sha.append(hashlib.sha256(b" ".join(words if g is None else [w for w, x in zip(words, g.tolist()) if not x])).hexdigest())
        return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "n_words": pa.array(b.n_words, pa.int64()), "n_removed": pa.array([0 if g is None else int(g.sum()) for g in gone], pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    def kept(self, key: tuple, texts: pa.Table, got: pa.Table) -> pa.Table:
        b, gone = self.removed(texts, got)
        out = []
        for text, g in zip(b.texts, gone):
            words = text.split()
            out.append((b" ".join(words if g is None else [w for w, x in zip(words, g.tolist()) if not x])).decode("utf-8", "replace"))
        return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "text": pa.array(out, pa.string()), "n_removed": pa.array([0 if g is None else int(g.sum()) for g in gone], pa.int64())})


def drop_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each word that a window of another, earlier text covers; documents are ordered by id.

    One row for each row of docs: doc_id, n_words, n_removed, kept_sha256; or doc_id, text, n_removed if texts is set.
    Null and empty texts have no words. A row with a null id is neither earlier nor later than another: it keeps its
    words and takes none away. Rows that share an id don't take words from each other. Texts shorter than a window keep
    their words; an empty table gives an empty table; other columns are ignored.
    """
    n_rows, n_bytes = text_size(docs, text_col)
    plan = Plan(n_rows, n_bytes, window)
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(plan.blocks / 4))
    # one exchange of the texts serves all three passes over them
    block = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(plan.blocks))
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), block.cast("long").alias("block")).repartition(parts, "block")
    texts_by = dealt.groupBy("block")
    sketches = texts_by.applyInArrow(lambda k, t: plan.sketch(k, t), BLOB)
    bits = sketches.groupBy("key").applyInArrow(lambda k, t: plan.merged(k, t), BLOB)
    asked = texts_by.cogroup(bits.groupBy("block")).applyInArrow(lambda k, t, g: plan.ask(k, t, g), BLOB)
    told = asked.groupBy("key").applyInArrow(lambda k, t: plan.exact(k, t), BLOB)
    last = texts_by.cogroup(told.groupBy("block"))
    if texts:
        return last.applyInArrow(lambda k, t, g: plan.kept(k, t, g), "doc_id long, text string, n_removed long")
    return last.applyInArrow(lambda k, t, g: plan.digest(k, t, g), "doc_id long, n_words long, n_removed long, kept_sha256 string")
