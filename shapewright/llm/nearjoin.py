"""Jaccard self-join of word n-gram sets along chosen paths.

Every text is the set of its five-word shingles. Sets are split recursively: at a node of a run's random tree, a set
follows the branches that the node samples from its tokens (min-hash positions of the set, so that every set has as many
and two sets share one with probability equal to their similarity). One branch is taken, and with probability
1 / threshold - 1 a second, so a pair at the threshold keeps one common branch on average. Small buckets are compared by
brute force; larger ones split further, down to `MOST_DEPTH`. Runs are repeated until a pair at the threshold meets with
probability `recall`, even if all its buckets are split to the last depth. All runs draw from the same min-hash
positions, so their number follows from the branching averaged over the number of positions in which a pair agrees; what
the sketches drop counts as lost.

The runs seek classes (chains of links) first, by links that hold them together. So a text is compared with a class
until one of its members is near enough: the first `FIRST_RUNS` runs find most of these links, and later ones leave out
the buckets that hold one class only and the pairs within a class. Brute force first compares 128-byte sketches, and confirms a pair on the whole sets, in the first bucket that
both texts share. A bucket that stays large at the last depth is dealt into parts, each compared in itself; then the
texts outside the bucket's largest class are compared with all its parts. Nothing is left out: each pair that meets is
compared, or its texts are in one class already. Rows grow with the texts times their branches; only a bucket of many
texts that are no near copies of each other adds rows, size / CELL for each text outside its largest class.

Then all links are listed: both texts of a link are in one class, so within each class every set is counted against every
other, whole. A large class is dealt into parts, and each two parts meet once: a text adds a row for each part.

Texts with equal sets are one representative throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, hashed_words, mix, odd_constants, per_row, text_bytes, window_hash

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99999
POSITIONS = 128
LEAST_DEPTH, MOST_DEPTH = 3, 4
FIRST_RUNS = 2
BUCKET = 512  # larger ones are split while they can be
CELL = 1024  # texts of a part of a bucket or class; one of up to two parts is compared whole
ELEMENTS = 2 << 20  # elements of the sets of a part of a class
EDGES = 100_000  # rows of ids of a task, in tables that few() makes
BROADCAST_IDS = 1_000_000  # more ids than that are looked up by a shuffle

_A = odd_constants(POSITIONS, "minhash-a")
_B = odd_constants(POSITIONS, "minhash-b")


def meets(depth: int, threshold: float, similarity: float | None = None) -> float:
    """Probability that a pair (at the threshold, unless a similarity is given) still shares a path of the given depth in one run."""
    second = min(1.0, 1 / threshold - 1)
    similarity = threshold if similarity is None else similarity
    lost = 0.0
    for _ in range(depth):
        one = 1 - similarity + similarity * lost
        lost = (1 - second) * one + second * one * one
    return 1 - lost


def agreeing(threshold: float) -> list[float]:
    """Probability of each number of positions in which a pair at the threshold agrees."""
    return [math.comb(POSITIONS, k) * threshold**k * (1 - threshold) ** (POSITIONS - k) for k in range(POSITIONS + 1)]


def least_agreeing(threshold: float, recall: float) -> int:
    """In how many positions two sketches must agree; fewer are a quarter of what may be lost, at most."""
    lost = 0.0
    for k, p in enumerate(agreeing(threshold)):
        lost += p
        if lost > (1 - recall) / 4:
            return k
    return POSITIONS


def missed(depth: int, threshold: float, runs: int, least: int) -> float:
    """Probability that a pair at the threshold isn't linked: its sketches agree too little, or it meets in no run."""
    return sum(p * (1.0 if k < least else (1 - meets(depth, threshold, k / POSITIONS)) ** runs) for k, p in enumerate(agreeing(threshold)))


def runs_for(depth: int, threshold: float, recall: float) -> int:
    least = least_agreeing(threshold, recall)
    for runs in range(1, 1001):
        if missed(depth, threshold, runs, least) <= 1 - recall:
            return runs
    raise ValueError(f"a recall of {recall} at similarity {threshold} is out of reach")


def shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of `size` words; a shorter text is one shingle of all its words."""
    words, _, at = hashed_words(texts)
    every = window_hash(words, odd_constants(size, f"set{size}")) if len(words) >= size else words[:0]
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        n = j - i
        out.append(np.unique(every[i : j - size + 1] if n >= size else window_hash(words[i:j], odd_constants(n, f"set{n}")) if n else words[:0]))
    return out


def minhash(elements: np.ndarray) -> np.ndarray:
    """POSITIONS minima, as uint32."""
    a, b = (_A >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_B >> np.uint64(32)).astype(np.uint32)
    low = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    x = (elements >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[None, i : i + 2048] * a[:, None] + b[:, None]).min(1), out=low)
    return low


def branch(path: np.ndarray, signature: np.ndarray, row: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The paths one step on, and which of the given ones each continues. signature[row[i]] belongs to path[i]."""
    draw = mix(path ^ np.uint64(0x9E3779B97F4A7C15))
    one = (draw % np.uint64(POSITIONS)).astype(np.int64)
    two = (one + 1 + ((draw >> np.uint64(20)) % np.uint64(POSITIONS - 1)).astype(np.int64)) % POSITIONS
    second = (draw >> np.uint64(40)).astype(np.float64) / float(1 << 24) < 1 / threshold - 1
    again = np.flatnonzero(second)
    source = np.concatenate([np.arange(len(path)), again])
    at = np.concatenate([one, two[again]])
    token = signature[row[source], at].astype(np.uint64)
    return mix(path[source] * np.uint64(0xD1342543DE82EF95) ^ mix(token * np.uint64(POSITIONS) + at.astype(np.uint64))), source


def first_paths(signature: np.ndarray, runs: range, depth: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(paths of the runs at a depth, their rows of signature)"""
    n = len(signature)
    row = np.tile(np.arange(n), len(runs))
    path = mix(np.repeat(np.array(runs, np.uint64) + np.uint64(1), n) * np.uint64(0xA0761D6478BD642F))
    for _ in range(depth):
        path, source = branch(path, signature, row, threshold)
        row = row[source]
    return path, row


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def few(df: DataFrame, rows: float) -> DataFrame:
    """df, of about `rows` rows of ids at most, in as few tasks as hold EDGES each: cut() writes a file for each task, and on a local disk an executor starts a process for each file."""
    return df.coalesce(max(1, math.ceil(rows / EDGES)))


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, digest of the set, the min-hashes, and the number of its elements."""

    def fn():
        def work(batch):
            digest, sig, n = [], [], []
            for s in shingles(text_bytes(batch, "text"), size):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(minhash(s).tobytes() if len(s) else None)
            return {"id": batch.column("id"), "digest": digest, "sig": sig, "n": n}

        return work

    return per_row(docs, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], "id long, digest binary, sig binary, n long", fn)


def signs(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, POSITIONS)


def paths_of(classes: DataFrame, runs: range, threshold: float) -> DataFrame:
    """(path, id, class) of every set in the runs, at the least depth."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                path, row = first_paths(signs(part), runs, LEAST_DEPTH, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(signed(path)), *(pa.array(part.column(c).to_numpy(zero_copy_only=False)[row]) for c in ("id", "class"))], ["path", "id", "class"])

    return classes.select("id", "class", "sig").mapInArrow(run, "path long, id long, class long")


def by_id(rows: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """A row an id, with the list of its keys (at most as many as branches of the runs, and parts) and its signature: the join makes no more rows than there are ids."""
    return rows.groupBy("id").agg(F.min("class").alias("class"), F.collect_set(key).alias("keys")).join(classes.select("id", "sig"), "id")


def split(large: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(path, id, class) one level deeper."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("keys").to_pylist()
            row = np.repeat(np.arange(b.num_rows), [len(k) for k in keys])
            path, source = branch(np.array([x for k in keys for x in k], np.int64).view(np.uint64), signs(b), row, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(signed(path)), *(pa.array(b.column(c).to_numpy()[row[source]]) for c in ("id", "class"))], ["path", "id", "class"])

    return by_id(large, "path", classes).mapInArrow(run, "path long, id long, class long")


def leaves(classes: DataFrame, n: int, runs: range, threshold: float) -> DataFrame:
    """(path, id, class, size) of all final buckets that hold two classes or more; n: the number of sets."""
    level = paths_of(classes, runs, threshold)
    rows = n * len(runs) * min(2.0, 1 / threshold) ** LEAST_DEPTH
    done = []
    for depth in range(LEAST_DEPTH, MOST_DEPTH + 1):
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("path", "size")
        level = cut(few(level.join(sizes, "path"), rows))
        done.append(level if depth == MOST_DEPTH else level.where(F.col("size") <= BUCKET))
        large = level.where(F.col("size") > BUCKET).select("path", "id", "class")
        if depth == MOST_DEPTH or large.isEmpty():
            break
        level = cut(split(large, classes, threshold))  # paths at the least depth are made twice instead: they take more to write
        rows = level.count()
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def part_of(size: Column) -> Column:
    """Number of a text's part in its bucket; 0 in a bucket of two parts at most."""
    return F.when(size > 2 * CELL, F.pmod(F.xxhash64("id", "path"), F.ceil(size / CELL).cast("int"))).otherwise(0).cast("int")


def parts(buckets: DataFrame) -> DataFrame:
    """(cell, id, class): small buckets whole, large ones in parts."""
    size = F.col("size")
    return buckets.select(F.when(size > 2 * CELL, F.xxhash64("path", part_of(size))).otherwise(F.col("path")).alias("cell"), "id", "class")


def across(large: DataFrame) -> DataFrame:
    """(cell, id, class): each part of a large bucket, with the texts that aren't of the bucket's largest class (CELL of them at a time)."""
    counts = large.groupBy("path", "class").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("path").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    rows = large.select("path", "id", "class").join(top.select("path", "size", F.col("top.class").alias("main"), F.ceil((F.col("size") - F.col("top.n")) / CELL).cast("int").alias("chunks")), "path")
    n = F.ceil(F.col("size") / CELL).cast("int")
    own = rows.select("path", "id", "class", part_of(F.col("size")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    stray = rows.where("class <> main").select("path", "id", "class", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"), F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks")).cast("int").alias("chunk"))
    return own.unionByName(stray).select(F.xxhash64("path", "part", "chunk").alias("cell"), "id", "class")


def sketch(sig: np.ndarray) -> np.ndarray:
    return (sig ^ (sig >> np.uint32(16))).astype(np.uint8)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows, some thousand rows each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        last = int(np.searchsorted(keys != keys[-1], False)) if keys[0] == keys[-1] else int(np.flatnonzero(keys != keys[-1])[-1]) + 1
        if last or (held and held[-1].column(key)[-1].as_py() != keys[0]):
            if last == 0:
                yield pa.Table.from_batches(held)
                held = [b]
                continue
            if held and held[-1].column(key)[-1].as_py() != keys[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(0, last))
            yield pa.Table.from_batches(held)
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many positions the sketches agree, row by row (eight bytes are summed at once)."""
    eight = np.equal(a, b).view(np.uint64).reshape(-1, POSITIONS // 8).sum(1)
    return (eight * np.uint64(0x0101010101010101)) >> np.uint64(56)


def plausible(t: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of a table sorted by cell) of different classes whose sketches agree in `least` positions or more and whose first common cell this is (in every cell, if keys are empty)."""
    cell, kind, n = t.column("cell").to_numpy(), t.column("class").to_numpy(), t.num_rows
    sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(n, POSITIONS)
    lists = t.column("keys").to_pylist()
    left, right = [], []
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    end = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
    at = np.arange(n)
    for d in range(1, n):
        at = at[at + d < end[at]]
        if not len(at):
            break
        i = at[kind[at] != kind[at + d]]
        for k in range(0, len(i), 20_000):
            j = i[k : k + 20_000]
            ok = j[agreement(sk[j], sk[j + d]) >= least]
            left.append(ok)
            right.append(ok + d)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = np.concatenate(left), np.concatenate(right)
    sets: dict[int, set] = {}

    def of(k: int) -> set:
        s = sets.get(k)
        if s is None:
            s = sets[k] = set(lists[k])
        return s

    mine = np.array([not lists[a] or min(of(a) & of(b)) == cell[a] for a, b in zip(left.tolist(), right.tolist())], bool)
    left, right = left[mine], right[mine]
    order = np.lexsort((right, left))
    return left[order], right[order]


LIGHT = "cell long, id long, class long, keys array<long>, sketch binary"


def exploded(per_id: DataFrame, keys_too: bool) -> DataFrame:
    """A row for each cell of an id, with its sketch, and all its cells if they are wanted."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                p = b.slice(i, 2000)
                keys = p.column("keys").to_pylist()
                row = np.repeat(np.arange(p.num_rows), [len(k) for k in keys])
                sk = pa.array([x.tobytes() for x in sketch(signs(p))], pa.binary())
                take = pa.array(row)
                all_keys = p.column("keys").take(take) if keys_too else pa.array([[]] * len(row), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([x for k in keys for x in k], pa.int64()), p.column("id").take(take), p.column("class").take(take), all_keys, sk.take(take)], ["cell", "id", "class", "keys", "sketch"])

    return per_id.select("id", "class", "keys", "sig").mapInArrow(run, LIGHT)


def needed(rows: DataFrame, least: int) -> DataFrame:
    """(cell, id, class, keys, sketch) of rows with a plausible pair."""

    def run(batches):
        for t in whole_groups(batches, "cell"):
            at = np.unique(np.concatenate(plausible(t, least)))
            if len(at):
                yield from t.take(pa.array(at)).combine_chunks().to_batches()

    return rows.mapInArrow(run, LIGHT)


def with_sets(docs: DataFrame, want: DataFrame, most: int, classes: DataFrame, size: int) -> DataFrame:
    """The rows of `want` (of `most` ids at most), with the sets made from the texts: a text is joined once, and its set goes to its cells from there."""
    ids = want.groupBy("id").agg(F.collect_list(F.struct("cell", "class", "sketch")).alias("at"), F.first("keys").alias("keys")).join(classes.select("id", "digest"), "id")
    only = cut(few(want.select("id").distinct(), most))
    if only.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(only), "id", "left_semi")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                p = b.slice(i, 200)
                out = ([], [], [], [], [], [])
                for id_, elements, digest, keys, at in zip(p.column("id").to_pylist(), shingles(text_bytes(p), size), p.column("digest").to_pylist(), p.column("keys").to_pylist(), p.column("at").to_pylist()):
                    s = elements.tobytes()
                    if hashlib.blake2b(s, digest_size=16).digest() == digest:  # else a row that shares its id and has another set
                        for x in at:
                            for column, v in zip(out, (x["cell"], id_, x["class"], keys, x["sketch"], s)):
                                column.append(v)
                        if sum(map(len, out[5])) > 32 << 20:
                            yield _full(out)
                            out = ([], [], [], [], [], [])
                yield _full(out)

    return docs.join(ids, "id").select("id", "text", "digest", "keys", "at").mapInArrow(run, LIGHT + ", elements binary")


def _full(out: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["cell", "id", "class", "keys", "sketch", "elements"])


def confirmed(rows: DataFrame, threshold: float, least: int) -> DataFrame:
    """(a, b) linked sets: in each cell a forest that joins the classes of its linked rows."""

    def run(batches):
        for t in whole_groups(batches, "cell"):
            t = t.combine_chunks()
            left, right = plausible(t, least)
            if not len(left):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in t.column("elements").to_pylist()]
            ids = t.column("id").to_numpy()
            # the rows of a class stand for one another from the start
            kinds, number = np.unique(t.column("class").to_numpy(), return_inverse=True)
            root, of, forest = list(range(len(kinds))), number.tolist(), []

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in zip(left.tolist(), right.tolist()):
                p, q = find(of[a]), find(of[b])
                if p == q:
                    continue
                x, y = sets[a], sets[b]
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= threshold * (len(x) + len(y) - common):
                    root[p] = q
                    forest.append((ids[a], ids[b]))
            if forest:
                f = np.array(forest, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f.max(1)), pa.array(f.min(1))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def compared(cells: DataFrame, docs: DataFrame, classes: DataFrame, size: int, threshold: float, least: int, once: bool = True) -> DataFrame:
    """The links (a, b) found in cells of (cell, id, class); once: a pair is compared in its first common cell only."""
    dealt = lambda rows: rows.repartition("cell").sortWithinPartitions("cell", "id")
    want = cut(needed(dealt(exploded(by_id(cells, "cell", classes), once)), least))
    return cut(confirmed(dealt(with_sets(docs, want, want.count(), classes, size)), threshold, least))


def commons(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of each set of the one list with each of the other."""
    n, m = len(left), len(right)
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((n, m), np.int64)
    if not len(both):
        return out

    def places(sets: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets that hold each element of `both`, one element after the other, and how many they are."""
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        k = np.minimum(np.searchsorted(both, x), len(both) - 1)
        same = both[k] == x
        k, at = k[same], at[same]
        return at[np.argsort(k, kind="stable")], np.bincount(k, minlength=len(both))

    (row, f), (col, g) = places(left, a), places(right, b)
    first_row, first_col = np.cumsum(f) - f, np.cumsum(g) - g
    # frequent elements as products of matrices of 0 and 1, rare ones by the pairs that they make
    frequent = f * g * 256 > n * m
    dense, rare = np.flatnonzero(frequent), np.flatnonzero(~frequent)

    def matrix(some: np.ndarray, first: np.ndarray, count: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        x = np.zeros((len(some), width), np.float32)
        x[np.repeat(np.arange(len(some)), count[some]), at[spans(first[some], count[some])]] = 1
        return x

    for i in range(0, len(dense), 1024):
        some = dense[i : i + 1024]
        out += (matrix(some, first_row, f, row, n).T @ matrix(some, first_col, g, col, m)).astype(np.int64)
    made = np.cumsum(f[rare] * g[rare]) // (1 << 22)
    for some in np.split(rare, np.flatnonzero(np.diff(made)) + 1) if len(rare) else []:
        x, times = row[spans(first_row[some], f[some])], np.repeat(g[some], f[some])
        y = col[spans(np.repeat(first_col[some], f[some]), times)]
        out += np.bincount(np.repeat(x, times) * m + y, minlength=n * m).reshape(n, m)
    return out


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those from first[1] on, and so on."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def all_links(docs: DataFrame, classes: DataFrame, found: DataFrame, size: int, threshold: float) -> DataFrame:
    """(id, links): every set linked to the set, of all pairs within the classes (id, least); ids without a link are left out."""
    whole = found.unionByName(found.select(F.col("least").alias("id"), "least").distinct())  # a class's smallest id has no row
    members = whole.join(classes.select("id", "n"), "id").select("id", "least", "n")
    n, e = F.count(F.lit(1)), F.sum("n")
    sizes = members.groupBy("least").agg(F.when((n > 2 * CELL) | (e > 2 * ELEMENTS), F.ceil(F.greatest(n / CELL, e / ELEMENTS))).otherwise(1).cast("int").alias("parts"))
    own = members.join(sizes, "least").select("id", "least", "parts", F.pmod(F.xxhash64("id", F.lit("part")), "parts").cast("int").alias("part"))
    met = own.select("id", "least", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cell = F.xxhash64("least", F.least("part", "other"), F.greatest("part", "other"))
    want = met.select("id", cell.alias("cell"), F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).cast("long").alias("class"), F.array().cast("array<long>").alias("keys"), F.lit(b"").alias("sketch"))

    def links_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Linked ids, both ways, of a cell: a part in itself (its number is -1) or the lesser part with the greater one."""
        ids, at = np.unique(t.column("id").to_numpy(), return_index=True)  # repeated rows are one document
        part = t.column("class").to_numpy()[at]
        sets = [np.frombuffer(x, np.uint64) for x in t.column("elements").take(pa.array(at)).to_pylist()]
        lengths = np.array([len(s) for s in sets])
        x = np.flatnonzero(part == part.min())
        y = x if part.max() < 0 else np.flatnonzero(part != part.min())
        if not len(y):
            return ids[:0], ids[:0]
        common = commons([sets[i] for i in x], [sets[i] for i in y])
        ok = common >= threshold * (lengths[x][:, None] + lengths[y][None, :] - common)
        if x is y:
            np.fill_diagonal(ok, False)
        i, j = np.nonzero(ok)
        a, b = ids[x[i]], ids[y[j]]
        return (a, b) if x is y else (np.concatenate([a, b]), np.concatenate([b, a]))

    def listed(some: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """A row for each id of a cell."""
        for a, b in some:
            order = np.argsort(a, kind="stable")
            ids, start = np.unique(a[order], return_index=True)
            offsets = np.append(start, len(a)).astype(np.int32)
            rows = pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(b[order]))], ["id", "to"])
            step = max(1, rows.num_rows * 500_000 // len(a))
            yield from (rows.slice(i, step) for i in range(0, rows.num_rows, step))

    def run(batches):
        for t in whole_groups(batches, "cell"):
            key = t.column("cell").to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist()
            few = []
            for i, j in zip(edge[:-1], edge[1:]):
                a, b = links_of(t.slice(i, j - i))
                if len(a):
                    few.append((a, b))
                    if sum(len(a) for a, _ in few) > 500_000:
                        yield from listed(few)
                        few = []
            yield from listed(few)

    rows = with_sets(docs, want, 2 * found.count(), classes, size).repartition("cell").sortWithinPartitions("cell", "id")
    return rows.mapInArrow(run, "id long, to array<long>").groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("to"))).alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(id, least): the smallest id of each connected component, for ids that have an edge.

    Stars are made large and small in turn until nothing moves; the rounds grow with the logarithm of a component. A
    round of few edges runs in few tasks (EDGES each at most), one of many in as many as the session has.
    """

    def settled(df: DataFrame, most: int) -> tuple[DataFrame, tuple]:
        df = cut(few(df, most))
        n, check = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return df.coalesce(max(1, n // EDGES)), (n, check)

    e, state = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), edges.count())
    for _ in range(60):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(max(1, 2 * state[0] // EDGES))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large: neighbours above a node go to its least neighbour
        big = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small: a node's lower neighbours, and itself, go to the least of them
        down = big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        e, now = settled(down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), 2 * state[0])
        if now == state:
            break
        state = now
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("least"))


def labelled(classes: DataFrame, found: DataFrame | None) -> DataFrame:
    """The sets with their class so far."""
    if found is None:
        return classes.withColumn("class", F.col("id"))
    return classes.join(found, "id", "left").withColumn("class", F.coalesce("least", "id")).drop("least")


def near_join(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", links: bool = True) -> DataFrame:
    """One row for each document (distinct id): doc_id, class_id, rep_id, n_copies, and with links also links, n_links.

    Documents with equal sets are represented by the smallest id among them, rep_id (membership); n_copies counts the
    others. class_id is the smallest id among all documents that chains of links join, so two documents have the same
    class_id if, and only if, such a chain joins them. links lists all other representatives, with smaller and larger
    ids, whose Jaccard similarity to this document's representative is at the threshold or above; n_links is their
    number. All pairs of a class are compared, so what the recall leaves open is only whether a class is whole. Null and empty texts have no shingles and no links, and are classes of their own (rep_id is their own id);
    texts of fewer words than a shingle are one shingle. Rows without an id are left out; repeated rows, and rows that
    share an id, are one document (that of the smallest set digest). An empty table gives an empty table; other columns
    are ignored.
    """
    runs, least = runs_for(MOST_DEPTH, threshold, recall), least_agreeing(threshold, recall)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null")
    one = cut(signatures(docs, size, "id", "text").groupBy("id").agg(F.min(F.struct("digest", "sig", "n")).alias("x")).select("id", "x.digest", "x.sig", "x.n"))
    # copies of a set are counted, and later found again, by digest and a part of the ids: no digest fills a task
    salt = F.pmod(F.xxhash64("id"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    salted = one.where("digest is not null").groupBy("digest", salt.alias("salt")).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    sizes = cut(salted.groupBy("digest").agg(F.min("rep").alias("rep"), F.sum("n").alias("n")))
    bare = cut(sizes.select(F.col("rep").alias("id"), "digest").join(one.select("id", "sig", "n"), "id"))
    n = sizes.count()
    edges, found = None, None
    for some in (range(0, min(FIRST_RUNS, runs)), range(min(FIRST_RUNS, runs), runs)):
        buckets = leaves(labelled(bare, found), n, some, threshold)
        more = compared(parts(buckets), docs, bare, size, threshold, least)
        edges = more if edges is None else edges.unionByName(more)
        found = components(edges)
        large = buckets.where(F.col("size") > 2 * CELL).select("path", "id")
        if not large.isEmpty():
            cells = cut(across(large.join(labelled(bare, found).select("id", "class"), "id")))
            if not cells.isEmpty():
                edges = edges.unionByName(compared(cells, docs, bare, size, threshold, least, once=False))
                found = components(edges)
    about = sizes.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    if links:
        about = about.join(all_links(docs, bare, found, size, threshold).withColumnRenamed("id", "rep"), "rep", "left")
    about = salted.select("digest", "salt").join(about, "digest")
    return one.select("id", "digest", salt.alias("salt")).join(about, ["digest", "salt"], "left").select(
        F.col("id").alias("doc_id"),
        F.coalesce("least", "rep", "id").alias("class_id"),
        F.coalesce("rep", "id").alias("rep_id"),
        F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_copies"),
        *([F.coalesce("links", F.array().cast("array<long>")).alias("links"), F.when(F.col("links").isNull(), 0).otherwise(F.size("links")).cast("long").alias("n_links")] if links else []),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document (the smallest id) of each class, with all their columns, whatever their names.

    Rows without an id stay as they are; so do null and empty texts, which are no copies of each other. Of rows that
    share an id one stays, that of the smallest digest of its text. An empty table gives an empty table.
    """
    gone, n = free_names(docs.columns, "gone", "n")
    key = F.col(f"`{id_col}`").cast("long")
    keep = near_join(docs, threshold, size, recall, id_col, text_col, links=False).where("doc_id <> class_id").select(F.col("doc_id").alias(gone))
    out = docs.join(keep, key == F.col(gone), "left_anti")
    again = cut(docs.select(key.alias(gone)).where(F.col(gone).isNotNull()).groupBy(gone).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select(gone))
    if again.isEmpty():
        return out
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = out.join(again, key == F.col(gone), "left_semi").groupBy(key.alias(gone)).agg(F.min_by(whole, F.sha2(F.col(f"`{text_col}`"), 256)).alias(n))
    return out.join(again, key == F.col(gone), "left_anti").unionByName(first.select(f"{n}.*"))
