"""Mixing sources to target weights by proportionate-fair scheduling.

A source's documents are shuffled by a hash and cut into blocks. With target weight w (a share of all slots), its j-th
block may not be released before slot floor(j / w) and is due by slot ceil((j + 1) / w). At each slot the released
block with the earliest deadline runs. While no source has run out, every source is then within one block of its share
at every slot.

Weights are taken exactly as they are (a float is a fraction), over all blocks of the input, so nothing is rounded that
could add up. The driver works the schedule out once, a step a block. Blocks have `LEAST_BLOCK` documents, or as many as
make `MOST_BLOCKS` blocks at most, so the schedule is bounded at every size: it is handed to all tasks, in pieces of
`period` blocks of a source. Documents keep to the DataFrame functions: a rank within a source is a row number within a
small bucket of hashes plus the counts of the buckets before it, so that one source with a third of all rows is ranked
by many tasks.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names

BUCKET_ROWS = 4_000
LEAST_BLOCK = 16
MOST_BLOCKS = 2_000_000
Source = str | None


def whole_weights(shares: dict[Source, float]) -> dict[Source, int]:
    """Whole numbers in exactly the proportions of the shares."""
    if any(not (x > 0 and math.isfinite(x)) for x in shares.values()):
        raise ValueError("weights must be above 0 and finite")
    exact = {s: Fraction(x) for s, x in shares.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * scale) for s, x in exact.items()}
    most = math.gcd(*out.values())
    return {s: x // most for s, x in out.items()}


def schedule(weights: dict[Source, int], blocks: dict[Source, int] | None = None) -> Iterator[tuple[Source, int, int, int, int]]:
    """(source, block, release, deadline, slot) by slot: earliest deadline first among the released. Without numbers of blocks, one period."""
    total = sum(weights.values())
    blocks = weights if blocks is None else blocks
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    waiting = [(0, i, 0) for i, s in enumerate(names) if blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[names[i]]), i, j, release))
        due, i, j, release = heapq.heappop(ready)
        yield names[i], j, release, due, slot
        if j + 1 < blocks[names[i]]:
            heapq.heappush(waiting, ((j + 1) * total // weights[names[i]], i, j + 1))
        slot += 1


def plan(weights: dict[Source, int], blocks: dict[Source, int], piece: int, names: list[str]) -> tuple[pa.Table, int]:
    """The schedule in rows of `piece` blocks of a source (columns: source, piece, releases, deadlines, slots), and the first slot that finds its source empty."""
    times = {s: (array("q"), array("q"), array("q")) for s in weights}
    end = None
    # a block more than there are: the one that would come next
    for s, j, release, due, slot in schedule(weights, {s: n + 1 for s, n in blocks.items()}):
        if j == blocks[s]:
            end = slot if end is None else end
            continue
        for to, x in zip(times[s], (release, due, slot)):
            to.append(x)
    at = [(s, k) for s in times for k in range(-(-blocks[s] // piece))]
    columns = [pa.array([s for s, _ in at], pa.string()), pa.array([k for _, k in at], pa.int64())]
    columns += [pa.array([times[s][i][k * piece : (k + 1) * piece] for s, k in at], pa.list_(pa.int64())) for i in range(3)]
    return pa.table(columns, names), end or 0


def mix(docs: DataFrame, weights: dict[Source, float] | None = None, smoothing: float = 0.5, block: int | None = None, period: int = 4096, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with mix_source, mix_block, mix_release, mix_deadline, mix_slot, mix_position and mix_on_target, one row each.

    mix_slot orders the blocks of all sources, mix_position the documents in a block. Without target weights, a source's
    weight is its number of rows to the power `smoothing`. Of given weights, 0 leaves a source out; sources without one
    get the smallest above 0. Every other row is scheduled, between its release and its deadline also when others have
    run out; a slot stays empty if no block is released, or if it would be that of a source's next block after its last.
    mix_on_target says whether the slot comes before the first one
    that finds its source empty. A null source is a source of its own (mix_source is null); null ids, null texts and
    repeated rows are scheduled like others; equal hashes are ordered by id and text; an empty table gives an empty
    table. Columns of docs whose names are those of the new ones are replaced, all others stay, whatever their names.
    Weights below 0 or not finite raise ValueError, and so do more sources than MOST_BLOCKS.
    """
    new = ("mix_source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position", "mix_on_target")
    key, tie = F.col(f"`{source_col}`").cast("string"), [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    spark, old = docs.sparkSession, docs.columns
    sizes = {r[0]: r[1] for r in docs.groupBy(key.alias("s")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_BLOCKS + 1).collect()}
    if len(sizes) > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} sources")
    if weights is not None:
        if any(not (x >= 0 and math.isfinite(x)) for x in weights.values()):
            raise ValueError("weights must be finite, and 0 at least")
        without = [s for s in sizes if weights.get(s, 1) == 0]
        for s in without:
            docs = docs.where(~key.eqNullSafe(F.lit(s)))
            del sizes[s]
        least = min((x for x in weights.values() if x), default=1.0)
    shares = {s: float(n) ** smoothing if weights is None else float(weights.get(s, least)) for s, n in sizes.items()}
    rows = sum(sizes.values())
    block = block or max(LEAST_BLOCK, -(-rows // MOST_BLOCKS))
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    h, src, bucket, n, own, rank, s, b, before, piece, place = free_names([*old, *new], "h", "src", "bucket", "n", "own", "rank", "s", "b", "before", "piece", "place")
    of, at, release, due, slot = free_names([*old, *new, src, s, piece], "of", "at", "release", "due", "slot")
    table, last = plan(whole_weights(shares) if shares else {}, blocks, period, [of, at, release, due, slot])
    slots = spark.createDataFrame(table, f"{of} string, {at} long, {release} array<long>, {due} array<long>, {slot} array<long>")
    # ranks: a shuffled number from 0 within the source; sources are joined by a key that is never null, as it deals out rows
    no_null = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    slots = slots.withColumn(of, no_null(F.col(of)))
    d = docs.withColumns({h: F.xxhash64(*tie), src: no_null(key)})
    d = d.withColumn(bucket, F.pmod(F.shiftrightunsigned(h, 17), F.lit(max(1, math.ceil(rows / BUCKET_ROWS)))))
    counts = d.groupBy(F.col(src).alias(s), F.col(bucket).alias(b)).agg(F.count(F.lit(1)).alias(n))
    sums = counts.withColumn(before, F.coalesce(F.sum(n).over(Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(n)
    out = (
        d.withColumn(own, F.row_number().over(Window.partitionBy(src, bucket).orderBy(h, *tie)) - 1)
        .join(sums, (F.col(src) == F.col(s)) & (F.col(bucket) == F.col(b)))
        .withColumn(rank, F.col(own) + F.col(before))
        .withColumn(piece, F.floor(F.floor(F.col(rank) / block) / period).cast("long"))
        .withColumn(place, (F.floor(F.col(rank) / block) % period).cast("int"))
        .join(F.broadcast(slots), (F.col(src) == F.col(of)) & (F.col(piece) == F.col(at)))
    )
    get = lambda c: F.get(F.col(c), F.col(place))
    return out.select(
        *[F.col(f"`{c}`") for c in old if c.lower() not in new],
        key.alias("mix_source"),
        F.floor(F.col(rank) / block).cast("long").alias("mix_block"),
        get(release).alias("mix_release"),
        get(due).alias("mix_deadline"),
        get(slot).alias("mix_slot"),
        (F.col(rank) % block).cast("int").alias("mix_position"),
        (get(slot) < last).alias("mix_on_target"),
    )
