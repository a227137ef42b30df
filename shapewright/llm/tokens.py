"""Token counts by a compiled finite-state tokenizer.

A byte-pair vocabulary is compiled into a deterministic transducer over characters. Its states are interned when
first met; each transition carries the number of tokens it adds to (or takes back from) the running count, so the
count of a text is the sum along its path. A state holds all that later characters can depend on: the longest suffix
that some piece still starts with, and, for each place in it, the last token of the text up to there.

A chunk of text is a map from the state at its start to the state at its end and the tokens it adds. Where no piece
contains the two characters at a place, no token can cross it, and the transducer is in one known state whatever came
before. So a map is stored as the characters up to its first such place, which are run from the entry state, and the
exit state and count of all that follows; a chunk without such a place is run whole. Maps compose associatively: the
tasks make those of the chunks of long texts side by side, and `prefix_scan` joins the maps of a text pairwise.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_row

SPACE = "▁"
START = ""
CHUNK = 1 << 16
# the longest suffix a piece starts with; the last token up to each place in it; the tokens up to each, against its end
State = tuple[str, tuple[str | None, ...], tuple[int, ...]]
FIRST: State = ("", (START,), (0,))  # nothing read, or a place that no token crosses


class Transducer:
    """Compiled from {piece: score}; cost(char) is what a character outside the vocabulary adds."""

    def __init__(self, pieces: dict[str, float], most_states: int = 200_000):
        self.pieces, self.most_states = pieces, most_states
        self.prefixes = {p[:i] for p in pieces for i in range(1, len(p) + 1)}
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.pair: dict[tuple[str, str], bool] = {}
        self.layouts: dict[str, tuple] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[State] = [FIRST]
        self.number = {self.states[0]: 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best pair again and again; the leftmost of equals first."""
        part = list(text)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(part) and (both := part[i] + part[j]) in self.pieces:
                heapq.heappush(heap, (-self.pieces[both], i, both))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if not part[i] or j >= len(part) or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, ""
            right[i] = right[j]
            if right[j] < len(part):
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [p for p in part if p]

    def adjoin(self, a: str, b: str) -> bool:
        """Whether tokens a and b can stand side by side: merging their characters gives them back."""
        ok = self.pair.get((a, b))
        if ok is None:
            if len(self.pair) > 500_000:
                self.pair.clear()
            ok = self.pair[a, b] = self.merged(a + b) == ([b] if a == START else [a, b])
        return ok

    def layout(self, text: str) -> tuple[tuple[int, ...], int, tuple[bool, ...]]:
        """Where tokens that end with the text can start; where the longest piece prefix starts; the places in it at which a piece may yet start."""
        found = self.layouts.get(text)
        if found is None:
            if len(self.layouts) > 300_000:
                self.layouts.clear()
            n = len(text)
            starts = tuple(i for i in range(n) if text[i:] in self.pieces or i == n - 1)
            open_ = tuple(text[i:] in self.prefixes for i in range(n))
            keep = next((i for i in range(n) if open_[i]), n)
            found = self.layouts[text] = (starts, keep, open_[keep:])
        return found

    def compile(self, state: int, ch: str) -> tuple[int, int]:
        """The transition from a state on a character, and what it adds to the count."""
        suffix, last, count = self.states[state]
        if suffix and suffix[-1] + ch not in self.inside:
            suffix, last, count = "", (START,), count[-1:]
        text = suffix + ch
        starts, keep, open_ = self.layout(text)
        for start in starts:
            if last[start] is not None and self.adjoin(last[start], token := text[start:]):
                break
        else:
            raise ValueError(f"no token ends at {text!r}")
        total = count[start] + (1 if token in self.pieces else len(ch.encode()))
        if keep == len(text):
            to = ("", (START,), (0,))
        else:
            # a place matters only if some piece starts with all that follows it
            to = (
                text[keep:],
                (*[t if o else None for t, o in zip(last[keep:], open_)], token),
                (*[c - total if o else 0 for c, o in zip(count[keep:], open_)], 0),
            )
        number = self.number.get(to)
        if number is None:
            number = self.number[to] = len(self.states)
            self.states.append(to)
            self.next.append({})
        self.next[state][ch] = out = (number, total - count[-1])
        return out

    def run(self, entry: State, text: str) -> tuple[State, int]:
        """The state after the text, and the tokens that it adds to the running count."""
        if len(self.states) > self.most_states:
            self.reset()
        state, total = self.number.get(entry), 0
        if state is None:
            state = self.number[entry] = len(self.states)
            self.states.append(entry)
            self.next.append({})
        arcs = self.next
        for ch in text:
            arc = arcs[state].get(ch)
            if arc is None:
                arc = self.compile(state, ch)
            state = arc[0]
            total += arc[1]
        return self.states[state], total


class UnitCounts(dict):
    """Unit of text -> tokens along its path from the first state: the arcs of a unit joined to one, kept for short units."""

    def __init__(self, transducer: Transducer, most: int = 600_000):
        self.transducer, self.most = transducer, most

    def __missing__(self, unit: str) -> int:
        n = self.transducer.run(FIRST, unit)[1]
        if len(self) >= self.most:
            self.clear()
        if len(unit) < 64:
            self[unit] = n
        return n


@dataclass(frozen=True)
class StateMap:
    """Entry state -> (exit state, tokens): `heads` are run from the entry state; what follows, if it is closed, ends in `exit` with `count` more tokens."""

    heads: tuple[str, ...]
    count: int = 0
    exit: State | None = None


UNIT = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
BOUNDARY = re.compile(f"(?<=[^{SPACE}])(?={SPACE})|\n")


class TokenCounter:
    """Counts what the library gives for `name`: sentencepiece with identity normalisation and a dummy prefix."""

    def __init__(self, path: str, chunk: int = CHUNK):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or not n.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only byte-pair models with byte fallback and identity normalisation are compiled")
        pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(len(p) > 1 and ("\n" in p or SPACE in p.lstrip(SPACE)) for p in pieces):
            raise ValueError("a piece crosses a word boundary")
        self.transducer = Transducer(pieces)
        self.units = UnitCounts(self.transducer)
        self.chunk = chunk

    def chunk_map(self, text: str) -> StateMap:
        first = BOUNDARY.search(text)
        if not first:
            return StateMap((text,))
        units = UNIT.findall(text[first.start() :])
        exit_, n = self.transducer.run(FIRST, units.pop())
        return StateMap((text[: first.start()],), n + sum(map(self.units.__getitem__, units)), exit_)

    def apply(self, m: StateMap, entry: State = FIRST) -> tuple[State, int]:
        total = 0
        for head in m.heads:
            entry, n = self.transducer.run(entry, head)
            total += n
        return (entry, total) if m.exit is None else (m.exit, total + m.count)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """b after a."""
        if a.exit is None:
            return StateMap(a.heads + b.heads, b.count, b.exit)
        exit_, n = self.apply(b, a.exit)
        return StateMap(a.heads, a.count + n, exit_)

    def prefix_scan(self, maps: list[StateMap]) -> list[StateMap]:
        """The maps of all prefixes: pairs are joined, the half as many scanned, and the odd ones filled in."""
        if len(maps) < 2:
            return maps
        half = self.prefix_scan([self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)])
        return [maps[0] if i == 0 else half[i // 2] if i % 2 else self.compose(half[i // 2 - 1], maps[i]) for i in range(len(maps))]

    def chunks(self, text: str) -> list[str]:
        """The text as the model sees it, in chunks; none of an empty text."""
        text = SPACE + text.replace(" ", SPACE) if text else ""
        return [text[i : i + self.chunk] for i in range(0, len(text), self.chunk)]

    def running(self, maps: list[StateMap]) -> list[int]:
        """Tokens up to the end of each chunk, if the text ended there."""
        return [self.apply(m)[1] for m in self.prefix_scan(maps)]

    def count(self, text: str) -> int:
        return self.running([self.chunk_map(c) for c in self.chunks(text)])[-1] if text else 0


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One a worker process: what it has compiled serves all its tasks."""
    return TokenCounter(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit, n_chunks.

    Null and empty texts have 0 bytes, tokens and chunks; repeated rows and null ids stay as they are; an empty table
    gives an empty table; other columns are ignored, whatever their names. `tokenizer` names a public tokenizer file,
    found by each worker. A text of one chunk is counted where it is read; the chunks of longer ones are dealt out.
    """
    kind = docs.schema[id_col].dataType
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    long = F.coalesce(F.char_length("text"), F.lit(0)) >= CHUNK  # a character more than the model sees in one chunk
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "n_chunks"))])

    def fn():
        count = counter(tokenizer_path(tokenizer)).count

        def work(batch):
            data = batch.column("text").to_pylist()
            return {"id": batch.column("id"), "n_bytes": [len(x.encode()) if x else 0 for x in data], "n_tokens": [count(x) if x else 0 for x in data], "n_chunks": [int(bool(x)) for x in data]}

        return work

    out = per_row(docs.where(~long), ["id", "text"], schema, fn).unionByName(in_chunks(docs.where(long), kind, tokenizer))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")


def in_chunks(docs: DataFrame, kind: T.DataType, tokenizer: str) -> DataFrame:
    """(id, n_bytes, n_tokens, n_chunks) of long texts (id, text); a row is known by a hash of its id and text, and equal rows are counted once."""
    fields = {"key": T.BinaryType(), "id": kind, "n_bytes": T.LongType(), "at": T.IntegerType(), "n_chunks": T.LongType()}
    schema = lambda **more: T.StructType([T.StructField(n, t) for n, t in {**fields, **more}.items()])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = counter(tokenizer_path(tokenizer)).chunks
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                parts, n = chunks(text), len(text.encode())
                id_ = b.column("id").slice(i, 1)
                key = hashlib.blake2b(repr(id_[0].as_py()).encode() + b"\0" + text.encode(), digest_size=16).digest()
                for k, part in enumerate(parts):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), id_, pa.array([n]), pa.array([k], pa.int32()), pa.array([len(parts)]), pa.array([part])], [*fields, "text"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_map = counter(tokenizer_path(tokenizer)).chunk_map
        for b in batches:
            maps = [chunk_map(t) for t in b.column("text").to_pylist()]
            columns = [*b.columns[: len(fields)], pa.array([m.heads[0] for m in maps], pa.string()), pa.array([m.count for m in maps], pa.int64()), pa.array([None if m.exit is None else json.dumps(m.exit) for m in maps], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*fields, "head", "count", "exit"])

    def joined(table: pa.Table) -> pa.Table:
        count = counter(tokenizer_path(tokenizer))
        table = table.sort_by("at")
        at = table.column("at").to_pylist()
        maps = {}
        for k, head, n, x in zip(at, *(table.column(c).to_pylist() for c in ("head", "count", "exit"))):
            suffix, last, counts = json.loads(x) if x else (None, (), ())
            maps[k] = StateMap((head,), n, None if x is None else (suffix, tuple(last), tuple(counts)))
        n = count.running([maps[k] for k in sorted(maps)])[-1]
        own = table.slice(0, at.count(0))  # a row for each equal row
        return pa.table([own.column("id"), own.column("n_bytes"), pa.array([n] * own.num_rows, pa.int64()), own.column("n_chunks")], ["id", "n_bytes", "n_tokens", "n_chunks"])

    parts = docs.select("id", "text").mapInArrow(cut_up, schema(text=T.StringType())).repartition("key", "at")
    maps = parts.mapInArrow(mapped, schema(head=T.StringType(), count=T.LongType(), exit=T.StringType()))
    out = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "n_chunks"))])
    return maps.groupBy("key").applyInArrow(joined, out)
