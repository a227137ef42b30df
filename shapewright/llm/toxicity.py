"""Toxicity by a counterfactually regularised classifier.

A sparse logistic regression scores a text by the words it has and by the starts of those words (inflected forms of one
stem share them). Words that say nothing by themselves, as those that name groups of people, can stand in for insults in
a training set. So in the sentences of each labelled text these terms are swapped for others of their kind, and training
penalises the squared change of the score: what differs between a text and its swapped copies gets no weight of its own.

Terms come from two sources: a fixed list of words for groups of people, and the training rows themselves, where words
that are frequent, tell neither label better than chance, and stand between the same neighbours are kinds of their own.

Executors count features and neighbours and turn texts into numbers of known features; the driver sees tables of
bounded size only (the labelled rows are at most about `most`, the features at most `most_features`).
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_row, text_str

# Terms for groups of people, by kind; a term is swapped within its kind.
IDENTITY = (
    "man woman men women boy girl boys girls male female transgender nonbinary",
    "gay lesbian bisexual straight queer heterosexual homosexual lgbt",
    "muslim muslims christian christians jewish jew jews hindu hindus buddhist atheist catholic protestant sikh",
    "black white asian african european american latino latina hispanic arab indian chinese mexican immigrant immigrants refugee refugees",
    "old young elderly teenage deaf blind disabled autistic paralyzed",
    "hombre mujer hombres mujeres negro negra blanco blanca judío judía musulmán musulmana cristiano cristiana inmigrante",
    "homme femme hommes femmes noir noire blanc blanche juif juive musulman musulmane chrétien chrétienne immigré",
    "mann frau männer frauen schwarzer weißer jude jüdin moslem muslima christ christin ausländer einwanderer",
)
IDENTITY_KINDS = tuple(tuple(line.split()) for line in IDENTITY)
STARTS = (4, 5, 6)
LONGEST = 32  # characters of a word; a longer run of letters (scripts without spaces) is seen by all its parts of four
PART = 4
WORD = regex.compile(r"[\p{L}\p{M}]+")
SENTENCE = regex.compile(r"[^.!?\n]+")
TELLING = 14.0  # twice the log likelihood a feature gains about the label; chance exceeds it once in 5,000 features
NEUTRAL, COMMON, MOST_TERMS, KIND_SIZE = 1.0, 0.02, 64, 4
NEIGHBOURS = 200


@lru_cache(maxsize=200_000)
def features_of(word: str) -> tuple[str, ...]:
    """The word and its starts, each marked as one; of a long run, its parts at all places."""
    if len(word) > LONGEST:
        return tuple(sorted({"~" + word[i : i + PART] for i in range(len(word) - PART + 1)}))
    return (word, *("^" + word[:k] for k in STARTS if len(word) >= k))


def features(words: list[str] | set[str]) -> set[str]:
    return {f for w in set(words) for f in (features_of(w) if len(w) <= LONGEST else features_of.__wrapped__(w))}


def sentences(text: str) -> list[list[str]]:
    """The lower-case words of each sentence."""
    return [w for s in SENTENCE.findall(text.lower()) if (w := WORD.findall(s))]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    terms: tuple[tuple[str, ...], ...] = ()
    pairs: int = 0  # texts with their swapped copies that training compared
    change: float = 0.0  # root of their mean squared change of the logit
    cache: dict[str, tuple[tuple[str, float], ...]] = field(default_factory=dict)

    def score(self, text: str) -> float:
        cache, found = self.cache, {}
        for w in set(WORD.findall(text.lower())):
            hit = cache.get(w)
            if hit is None:
                hit = tuple((f, x) for f in features([w]) if (x := self.weights.get(f)))
                if len(w) <= LONGEST:
                    if len(cache) > 400_000:
                        cache.clear()
                    cache[w] = hit
            if hit:
                found.update(hit)
        z = self.bias + sum(found[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))


def held_out(doc_id) -> bool:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is never learned from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, label, text) of at most about `most` labelled texts that aren't held out, drawn by a hash of the id."""
    i, y = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    lab = labels.where(i.isNotNull() & y.isNotNull() & (F.crc32(i.cast("string").cast("binary")) % 4 != 2)).groupBy(i.alias("id")).agg(F.max(y).cast("int").alias("label"))
    n = lab.count()
    lab = lab.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, n))))
    texts = docs.select(i.alias("id"), F.col(f"`{text_col}`").alias("text"))
    return cut(texts.join(F.broadcast(lab), "id").select(F.col("id").cast("string").alias("id"), (F.col("label") > 0).cast("int").alias("label"), "text"))


def counted(rows: DataFrame) -> DataFrame:
    """(feature, neg, pos): in how many texts of each label each feature is found; words have no mark."""

    def run(batches):
        total: Counter = Counter()

        def flush():
            keys = list(total)
            out = pa.RecordBatch.from_pydict({"feature": pa.array([f for f, _ in keys], pa.string()), "label": pa.array([y for _, y in keys], pa.int32()), "n": pa.array([total[k] for k in keys], pa.int64())})
            total.clear()
            return out

        for b in batches:
            for text, y in zip(text_str(b), b.column("label").to_pylist()):
                total.update((f, y) for f in features(WORD.findall(text.lower())))
                if len(total) > 500_000:
                    yield flush()
        yield flush()

    n = rows.select("label", "text").mapInArrow(run, "feature string, label int, n long")
    return n.groupBy("feature").agg(*(F.coalesce(F.sum(F.when(F.col("label") == y, F.col("n"))), F.lit(0)).alias(c) for y, c in ((0, "neg"), (1, "pos"))))


def with_ratio(counts: DataFrame, neg: int, pos: int) -> DataFrame:
    """counts with `ratio`, twice the log likelihood that having the feature gains about the label, and `share` of all texts."""
    a, b, n = F.col("neg"), F.col("pos"), neg + pos
    cell = lambda k, row, col: F.when(k > 0, k * F.log(k * n / (row * col))).otherwise(0.0)
    have = a + b
    ratio = 2 * (cell(a, have, F.lit(neg)) + cell(b, have, F.lit(pos)) + cell(neg - a, n - have, F.lit(neg)) + cell(pos - b, n - have, F.lit(pos)))
    return counts.withColumn("ratio", ratio).withColumn("share", have / n)


def neighbours(rows: DataFrame, terms: list[str], known: list[str]) -> dict[str, Counter]:
    """How often each known word stands before and after each term: terms x known x 2 counts at most."""

    def run(batches):
        want, seen, total = set(terms), set(known), Counter()
        for b in batches:
            for text in text_str(b):
                for words in sentences(text):
                    for x, y in zip(words, words[1:]):
                        if x in want and y in seen:
                            total[x, ">" + y] += 1
                        if y in want and x in seen:
                            total[y, "<" + x] += 1
        keys = list(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array([k for k, _ in keys], pa.string()), "by": pa.array([k for _, k in keys], pa.string()), "n": pa.array([total[k] for k in keys], pa.int64())})

    out: dict[str, Counter] = {t: Counter() for t in terms}
    for t, by, n in rows.select("text").mapInArrow(run, "term string, by string, n long").groupBy("term", "by").agg(F.sum("n")).collect():
        out[t][by] = n
    return out


def kinds(around: dict[str, Counter], least: float = 0.5) -> list[tuple[str, ...]]:
    """Groups of up to KIND_SIZE terms whose neighbours are much the same (cosine)."""
    terms = [t for t in sorted(around) if around[t]]
    if not terms:
        return []
    number: dict[str, int] = {}
    for t in terms:
        for by in around[t]:
            number.setdefault(by, len(number))
    m = np.zeros((len(terms), len(number)))
    for i, t in enumerate(terms):
        for by, n in around[t].items():
            m[i, number[by]] = n
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    like, free, out = m @ m.T, set(range(len(terms))), []
    for i in range(len(terms)):
        if i in free:
            near = sorted((j for j in free if j != i and like[i, j] >= least), key=lambda j: (-round(like[i, j], 9), j))[: KIND_SIZE - 1]
            if near:
                out.append(tuple(terms[j] for j in [i, *near]))
                free -= {i, *near}
    return out


def swapped(text: list[list[str]], kind_of: dict[str, tuple[str, ...]], rng: random.Random) -> list[list[str]] | None:
    """The sentences with every term replaced by another of its kind, the same one throughout; None if there is none."""
    if not any(w in kind_of for s in text for w in s):
        return None
    to: dict[str, str] = {}
    for s in text:
        for w in s:
            if w in kind_of and w not in to:
                to[w] = rng.choice([x for x in kind_of[w] if x != w])
    return [[to.get(w, w) for w in s] for s in text]


def numbered(rows: DataFrame, chosen: list[str], terms: list[tuple[str, ...]], swaps: int) -> list[tuple[int, list[int], list[list[int]]]]:
    """(label, known features, known features of each swapped copy) of each text, in a fixed order."""
    shared = rows.sparkSession.sparkContext.broadcast((chosen, terms))

    def run(batches):
        number = {f: i for i, f in enumerate(shared.value[0])}
        kind_of = {w: kind for kind in shared.value[1] for w in kind}

        def known(words) -> list[int]:
            return sorted(i for f in features(words) if (i := number.get(f)) is not None)

        for b in batches:
            own, copies = [], []
            for i, text in zip(b.column("id").to_pylist(), text_str(b)):
                rng = random.Random(zlib.crc32(i.encode()))
                parts = sentences(text)
                own.append(known([w for s in parts for w in s]))
                copies.append([known([w for s in c for w in s]) for c in (swapped(parts, kind_of, rng) for _ in range(swaps)) if c is not None])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(own, pa.list_(pa.int32())), pa.array(copies, pa.list_(pa.list_(pa.int32())))], ["id", "label", "own", "copies"])

    got = rows.select("id", "label", "text").mapInArrow(run, "id string, label int, own array<int>, copies array<array<int>>").collect()  # about `most` rows of known features
    return [(r[1], list(r[2]), [list(c) for c in r[3]]) for r in sorted(got, key=lambda r: (r[0], r[1], r[2]))]


def fit(data: list[tuple[int, list[int], list[list[int]]]], chosen: list[str], fairness: float = 2.0, ridge: float = 1e-4, steps: int = 300) -> Model:
    """Logistic regression by full-batch Adam on label loss + ridge + fairness * mean squared change of the logit by swaps."""
    y = np.array([x for x, _, _ in data], float)
    cols = np.array([f for _, own, _ in data for f in own], np.int64)
    row = np.repeat(np.arange(len(data)), [len(own) for _, own, _ in data])
    pairs = [(i, c) for i, (_, _, copies) in enumerate(data) for c in copies]
    origin = np.array([i for i, _ in pairs], np.int64)
    scols = np.array([f for _, c in pairs for f in c], np.int64)
    srow = np.repeat(np.arange(len(pairs)), [len(c) for _, c in pairs])
    k = len(chosen)
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    change = np.zeros(len(pairs))
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[cols], len(data))
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = np.bincount(cols, err[row], k)
        if len(pairs):
            change = z[origin] - (b + np.bincount(srow, w[scols], len(pairs)))
            pull = 2 * fairness * change / len(pairs)
            g += np.bincount(cols, np.bincount(origin, pull, len(data))[row], k) - np.bincount(scols, pull[srow], k)
        g += ridge * w
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model(float(b), {f: float(x) for f, x in zip(chosen, w) if abs(x) > 1e-3}, (), len(pairs), float(np.sqrt(np.mean(change**2))) if len(pairs) else 0.0)


def train(rows: DataFrame, most_features: int = 20_000, swaps: int = 2, fairness: float = 2.0) -> Model:
    """A model of the rows (id, label, text). Without both labels, the score is the share of label 1 for every text."""
    neg, pos = (rows.where(F.col("label") == y).count() for y in (0, 1))
    if not neg or not pos:
        share = (pos + 0.5) / (neg + pos + 1)
        return Model(float(np.log(share / (1 - share))), {})
    counts = cut(with_ratio(counted(rows), neg, pos))
    telling = counts.where(F.col("ratio") >= TELLING).orderBy(F.desc("ratio"), "feature").limit(most_features)
    word = ~F.col("feature").rlike("^[\\^~]")
    frequent = [r[0] for r in counts.where(word).orderBy(F.desc("share"), "feature").limit(NEIGHBOURS).collect()]
    neutral = [r[0] for r in counts.where(word & (F.col("ratio") < NEUTRAL) & (F.col("share") >= COMMON)).orderBy(F.desc("share"), "feature").limit(MOST_TERMS).collect()]
    terms = [*IDENTITY_KINDS, *kinds(neighbours(rows, neutral, frequent))]
    # the terms are features themselves: what the penalty is about
    chosen = sorted({r[0] for r in telling.collect()} | {f for kind in terms for w in kind for f in features_of(w)})
    model = fit(numbered(rows, chosen, terms, swaps), chosen, fairness)
    model.terms = tuple(terms)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 12_000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted.

    The model learns from at most about `most` labelled rows that aren't held out (a bounded sample, by a hash of the
    id); its weights are bounded by their number. Null and empty texts get the score of a text without known words. Null
    ids are scored but not learned from (held_out is false); of repeated labels the highest counts; repeated rows stay
    as they are; an empty table gives an empty table; without labels of both kinds all scores are equal; other columns
    are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    model = train(sample(docs, labels, most, id_col, text_col, label_col))
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def fn():
        score = Model(*shared.value).score

        def work(batch):
            s = [score(x) for x in text_str(batch, text_col)]
            return {id_col: batch.column(id_col), "held_out": [held_out(x) for x in batch.column(id_col).to_pylist()], "score": s, "predicted": [int(x >= threshold) for x in s]}

        return work

    return per_row(docs, [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")], f"`{id_col}` {kind}, held_out boolean, score double, predicted int", fn)
