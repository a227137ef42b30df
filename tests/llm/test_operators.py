"""Operators against brute force, and on odd inputs: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shapewright.llm import decontam, licences, mixing, nearjoin, pii, quality, substrings, tokens, toxicity
from shapewright.llm.html import extract, main_text

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n: int, seed: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    a, b = prose(120, 1), prose(90, 2)
    near = a.split()
    near[60] = "changed"
    rows = [
        (0, a, "s", "x"), (1, a, "s", "x"), (2, " ".join(near), "t", None), (3, b + "\n" + a, None, "y"), (4, None, "s", "z"), (5, "", "s", ""), (6, "one two", "t", "w"), (7, "one two", "t", "w"),
        (None, b, "s", "q"), (8, b, "u", "q"), (8, b, "u", "q"), (9, "word " * 30_000, "u", "q"), (10, "Ünï\tcode x \u0085 ça", "u", "q"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, hit_words string")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return (t or "").encode().split()


def brute_repeats(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = Counter()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    gone[k : k + 13] = [True] * 13
        out[(i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("which", ["odd", "real"])
def test_op2_substrings(which, request, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(substrings, "SHARD_CELLS", 20_000)
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, substrings.drop_repeats(docs).collect())) == brute_repeats(rows)


def test_op2_texts(odd):
    got = {r.doc_id: r.text for r in substrings.drop_repeats(odd, texts=True).collect() if r.doc_id is not None}
    assert got[1] == "" and got[6] == "one two"


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(a, b, t=0.8):
    both = len(a & b)
    return both >= t * (len(a) + len(b) - both)


def brute_near(rows, t=0.8):
    """id -> smallest id that chains of links reach"""
    sets = {i: shingle_set(text) for i, text in rows}
    inv = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inv[x].append(i)
    links = {i: {j for j in {j for x in s for j in inv[x]} if j != i and near(s, sets[j], t)} for i, s in sets.items()}
    label = {}
    for i in sorted(sets):
        if i not in label:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = i
                    todo += links[x]
    return label


def check_near(rows, out):
    """Classes as by brute force; pairs only of near texts, and those with membership hold the classes together."""
    sets = {i: shingle_set(text) for i, text in rows}
    label = brute_near(rows)
    assert {r.doc_id: r.class_id for r in out} == label
    joined = {i: {i} for i in sets}
    for r in out:
        assert r.rep_id == min((i for i, s in sets.items() if s and s == sets[r.doc_id]), default=r.doc_id)
        assert r.n_copies == max(0, sum(s == sets[r.doc_id] for s in sets.values() if s) - 1) and r.n_links == len(r.links)
        for j in [r.rep_id, *r.links]:
            assert j == r.doc_id or near(sets[r.doc_id], sets[j])
            if joined[j] is not joined[r.doc_id]:
                joined[j] |= joined[r.doc_id]
                for k in joined[r.doc_id]:
                    joined[k] = joined[j]
    assert all(min(x) == label[i] for i, x in joined.items())


@pytest.mark.parametrize("bucket", [512, 3])
def test_op4_near_join(real, odd, bucket, monkeypatch):
    monkeypatch.setattr(nearjoin, "BUCKET", bucket)
    monkeypatch.setattr(nearjoin, "CELL", 2 if bucket == 3 else 1024)
    for docs in [real, odd.where("doc_id is not null")] if bucket > 3 else [real]:
        check_near([(r.doc_id, r.text) for r in docs.collect()], nearjoin.near_join(docs).collect())


def test_op4_parts_of_large_buckets(spark, monkeypatch):
    """Chains in which most pairs are no links, and a crowd of near copies, in buckets that are dealt into parts."""
    monkeypatch.setattr(nearjoin, "BUCKET", 8)
    monkeypatch.setattr(nearjoin, "CELL", 4)
    base = prose(120, 40).split()
    rows = []
    for i in range(40):  # each a few words further from the first
        w = list(base)
        w[: 2 * i] = [f"x{k}" for k in range(2 * i)]
        rows.append((i, " ".join(w)))
    for i in range(60):
        w = list(base)
        w[(7 * i) % 110] = f"y{i}"
        rows.append((100 + i, " ".join(w)))
    check_near(rows, nearjoin.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_op4_rows_of_a_large_group(spark, monkeypatch):
    """5,000 near copies: what is exchanged grows with their number, not with its square."""
    base = prose(150, 41).split()
    seen = []
    keep = nearjoin.cut
    monkeypatch.setattr(nearjoin, "cut", lambda df: seen.append((out := keep(df)).count()) or out)
    most = []
    for n in (1250, 5000):
        rows = [(i, " ".join([*base[: i % 140], f"z{i}", *base[i % 140 + 1 :]])) for i in range(n)]
        seen.clear()
        out = nearjoin.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.class_id for r in out} == {0} and sum(r.n_links for r in out) >= n - 1
        most.append(max(seen))
    assert most[1] <= 6 * most[0] and most[1] <= 45 * 5000  # the branches of all runs


@pytest.mark.parametrize("cell", [1024, 4])
def test_op4_all_links(spark, real, odd, cell, monkeypatch):
    """Every link between different sets, also where other links join the two already; repeated rows count once."""
    monkeypatch.setattr(nearjoin, "CELL", cell)
    base = prose(120, 42).split()
    crowd = [(i, " ".join([*base[: 3 * i], f"q{i}", *base[3 * i + 1 :]])) for i in range(30)]
    crowd += [(100 + i, " ".join([*(f"x{k}" for k in range(2 * i)), *base[2 * i :]])) for i in range(20)]
    for docs in (spark.createDataFrame([*crowd, *crowd[:5]], "doc_id long, text string"), real, odd.where("doc_id is not null")):
        sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
        rep = {}
        for i in sorted(sets):
            rep.setdefault(sets[i] or i, i)
        inv = defaultdict(set)
        for s, i in rep.items():
            for x in s if isinstance(s, frozenset) else ():
                inv[x].add(i)
        want = {i: sorted(j for j in set().union(*(inv[x] for x in sets[i])) if j != rep[sets[i]] and near(sets[i], sets[j])) if sets[i] else [] for i in sets}
        out = nearjoin.near_join(docs).collect()
        assert {r.doc_id: r.links for r in out} == want and all(r.n_links == len(want[r.doc_id]) for r in out)


def test_op4_common_elements():
    import numpy as np

    r = np.random.default_rng(3)
    a, b = ([np.unique(r.zipf(1.3, k).astype(np.uint64)) for k in r.integers(0, 400, n)] for n in (70, 90))
    assert np.array_equal(nearjoin.commons(a, b), [[len(np.intersect1d(x, y)) for y in b] for x in a])
    assert not nearjoin.commons(a[:1], [a[0] + np.uint64(1 << 60)]).any()


def test_op4_files_of_small_tables(spark, monkeypatch):
    """A table of few ids is written by one task, however many partitions a shuffle has; the rounds of components among them."""
    seen = []
    keep = nearjoin.cut
    monkeypatch.setattr(nearjoin, "cut", lambda df: seen.append((out := keep(df)).rdd.getNumPartitions()) or out)
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        chains = spark.createDataFrame([(i, i + 1) for i in range(50) if i % 10 != 9], "a long, b long")
        assert {r.id: r.least for r in nearjoin.components(chains).collect()} == {i: i // 10 * 10 for i in range(50) if i % 10}
        assert len(seen) > 1 and set(seen) == {1}
        seen.clear()
        base = prose(120, 43).split()
        rows = [(i, " ".join([*base[:i], f"q{i}", *base[i + 1 :]])) for i in range(20)]
        check_near(rows, nearjoin.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert sum(x > 1 for x in seen) <= 7  # signatures, copies, representatives; of each of the two turns the cells and the links
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_op4_recall_of_paths():
    assert 1 - (1 - nearjoin.meets(4, 0.8)) ** nearjoin.runs_for(4, 0.8, 0.999) >= 0.999


def test_op4_pairs_at_threshold_in_split_buckets(spark, monkeypatch):
    """All buckets are split to the last depth; every pair is at exactly 0.8 (80 of 100 shingles)."""
    monkeypatch.setattr(nearjoin, "BUCKET", 1)
    rows = []
    for i in range(3000):
        common = [f"w{i}x{k}" for k in range(84)]
        rows += [(2 * i + side, " ".join(common + [f"v{i}y{side}z{k}" for k in range(10)])) for side in (0, 1)]
    out = nearjoin.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 6000 and sum(r.class_id != r.doc_id // 2 * 2 for r in out) == 0
    assert nearjoin.missed(nearjoin.MOST_DEPTH, 0.8, nearjoin.runs_for(nearjoin.MOST_DEPTH, 0.8, nearjoin.RECALL), nearjoin.least_agreeing(0.8, nearjoin.RECALL)) <= 1 - nearjoin.RECALL


def test_op4_odd_rows(spark, odd):
    out = {r.doc_id: r for r in nearjoin.near_join(odd).collect()}
    assert set(out) == {r.doc_id for r in odd.collect() if r.doc_id is not None}
    assert all(out[i].class_id == i and out[i].n_links == 0 and out[i].n_copies == 0 for i in (4, 5))
    docs = odd.withColumn("gone", F.lit(1)).withColumn("n", F.lit(2)).withColumn("_gone", F.lit(3))
    kept = nearjoin.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, r in out.items() if r.class_id == i) and ids.count(None) == 1
    assert nearjoin.one_of_each(docs.limit(0)).count() == 0


def test_op3_tokens(real, odd):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for docs in (real, odd):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or "")), len(sp.encode(r.text or "")) > 4096) for r in docs.collect())
        assert Counter(tuple(r)[:4] for r in tokens.count_tokens(docs).collect()) == want


ODD_TEXTS = ("", " ", "a", "   lead and  trail   ", "no_boundary_at_all_in_a_long_word" * 9, "x\n\ny \n z", "▁▁ a▁b", "<s>é漢😀", "internationalisation" * 20, "1234567890" * 30)


def test_op3_chunks_compose():
    """Maps of chunks of any size compose, in any order, to the count of the whole."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    count = tokens.TokenCounter(path)
    for s in ODD_TEXTS:
        for count.chunk in (1, 2, 3, 7, 50):
            assert count.count(s) == len(sp.encode(s))
            maps = [count.chunk_map(c) for c in count.chunks(s)]
            if len(maps) > 2:
                left = count.compose(count.compose(maps[0], maps[1]), maps[2])
                right = count.compose(maps[0], count.compose(maps[1], maps[2]))
                assert count.apply(left) == count.apply(right)


def test_op3_long_texts_in_many_tasks(spark, monkeypatch):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["word and other " * 20_000, "z" * 70_000, "x" * 65_536, " " * 70_000, None, "x" * 65_535]
    rows = [(i % 3 or None, t, "c") for i, t in enumerate([*texts, texts[0], texts[0]])]
    got = Counter(tuple(r)[:4] for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect())
    assert got == Counter((i, len(t or ""), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, _ in rows)


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(w, w[1:], w[2:]))
    rep = [False] * len(w)
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if grams[g] > 1:
            rep[i : i + 3] = [True] * 3
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(rep), len(w) < 50 or 100 * sum(rep) > 50 * len(w)


def test_op5_quality(real, odd):
    for docs in (real, odd):
        got = quality.quality(docs).collect()
        want = Counter((r.doc_id, *brute_quality(r.text)) for r in docs.collect())
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
        assert not any(r.kept for r in got if r.base_failed)
    import base64
    import os

    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    assert not quality.compression(base64.b64encode(os.urandom(3000)), z, quality.BANDS)[3]
    assert not quality.compression(b"again and again " * 600, z, quality.BANDS)[3]
    assert quality.compression(prose(400, 3).encode(), z, quality.BANDS)[3]


def test_op5_chunks_of_all_sizes():
    import base64
    import random

    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    good, junk = prose(4000, 5).encode(), base64.b64encode(random.Random(6).randbytes(9000))
    assert quality.compression(good[:8192], z, quality.BANDS)[3]
    for text in (good[:4050] + junk[:4050], good[:8192] + junk[:4095], junk[:4095] + good[:4096]):
        assert not quality.compression(text, z, quality.BANDS)[3]


def test_op6_pii(odd, spark):
    text = "mail me: a.b@x.org, card 4111 1111 1111 1111, host 10.0.0.300 10.0.0.30, call +1 (521) 555-6210. IBAN GB82 WEST 1234 5698 7654 32 x@y @z.com 1.2.3.4.5.6.7.8"
    spans = pii.find(text)
    assert [text[x.start : x.end] for x in spans] == ["a.b@x.org", "4111 1111 1111 1111", "10.0.0.30", "+1 (521) 555-6210", "GB82 WEST 1234 5698 7654 32", "1.2.3.4", "5.6.7.8"]
    assert "[EMAIL]" in pii.redact(text, spans) and "4111" not in pii.redact(text, spans)
    for pattern, kind in ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "email"), (r"\+[0-9][\x20().0-9-]+[0-9]", "phone")):
        ok = [m.span() for m in re.finditer(pattern, text) if kind == "email" or 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert ok == [(x.start, x.end) for x in spans if x.kind == kind]
    assert pii.find_pii(odd).count() == odd.count()
    assert pii.find("9" * 200_000) == [] and pii.find("a" * 200_000 + "@") == [] and pii.find("+1" + "-" * 100_000) == []


def brute_pii(text):
    """The base spans by the plain patterns of the contract."""
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(digits(x)) <= 15),
    )
    out = [(m.start(), n, kind, m.end()) for n, (kind, pattern, ok) in enumerate(rules) for m in re.finditer(pattern, text or "") if ok(m[0])]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out)]


def test_op6_table(real, odd):
    for docs in (real, odd):
        want = Counter()
        for r in docs.collect():
            spans = brute_pii(r.text)
            want[(r.doc_id, *(sum(x.startswith(k + ":") for x in spans) for k in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
        got = pii.find_pii(docs).collect()
        assert Counter(tuple(r)[:6] for r in got) == want
        for r in got:
            assert set(x for x in r.spans.split(",") if x.split(":")[0] in pii.BASE) <= set(r.spans.split(","))


def test_stages_keep_columns_of_any_name(spark, odd):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    docs = odd.select("*", F.lit(1).alias("n"), F.lit(2).alias("hit_hit"), F.lit(3).alias("c0"), F.lit(4).alias("_x"), F.lit(5).alias("a.b"), F.lit(6).alias("n"))
    for out in (quality.keep_good(docs), pii.redacted(docs)):
        assert out.columns == docs.columns
        out.collect()
    docs = docs.toDF(*docs.columns[:-1], "p_slot")
    assert decontam.without_leaks(docs, bench).columns == docs.columns and set(docs.columns) <= set(mixing.mix(docs).columns)
    assert {r.doc_id for r in decontam.without_leaks(docs, bench).collect()} == {r.doc_id for r in docs.collect()} - {6, 7}
    for stage in (quality.keep_good, pii.redacted, mixing.mix, lambda d: decontam.without_leaks(d, bench)):
        assert stage(docs.limit(0)).count() == 0
    for stage in (pii.redacted, mixing.mix):
        assert stage(docs).count() == docs.count()
    assert pii.redacted(docs).where("doc_id = 4").first().text is None


def test_op7_mixing(real, odd):
    for docs in (real, odd):
        out = mixing.mix(docs, block=4)
        rows = out.collect()
        assert len(rows) == docs.count()
        assert len({(r.mix_slot, r.mix_position) for r in rows}) == len(rows)
        assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in rows)
    weights = {"a": 5, "b": 3, "c": 1, "d": 1}
    done = Counter()
    for s, j, release, due, slot in mixing.schedule(weights):
        assert release <= slot < due
        done[s] += 1
        assert all(abs(done[x] - (slot + 1) * w / 10) < 1 for x, w in weights.items())


def brute_schedule(weights, blocks):
    """Slot by slot, all released blocks looked through; the block after a source's last one takes its slot as well."""
    from fractions import Fraction

    blocks = {s: n + 1 for s, n in blocks.items()}
    total, done, out, slot = sum(weights.values()), Counter(), {}, 0
    share = {s: Fraction(w, total) for s, w in weights.items()}
    while sum(done.values()) < sum(blocks.values()):
        free = [(math.ceil((done[s] + 1) / share[s]), s is None, s or "") for s in weights if done[s] < blocks[s] and math.floor(done[s] / share[s]) <= slot]
        if free:
            due, none, s = min(free)
            s = None if none else s
            out[s, done[s]] = (math.floor(done[s] / share[s]), due, slot)
            done[s] += 1
        slot += 1
    return {(s, j): x for (s, j), x in out.items() if j + 1 < blocks[s]}


def test_op7_against_brute_force(real, odd):
    for docs, weights in ((real, None), (odd, None), (odd, {"s": 0.7, None: 0.1, "t": 0.2}), (odd, {"u": 0, "s": 1e-6, "t": 1})):
        sizes = Counter(r.source for r in docs.collect())
        share = {s: float(n) ** 0.5 if weights is None else weights.get(s, min(x for x in weights.values() if x)) for s, n in sizes.items()}
        share = {s: x for s, x in share.items() if x}
        want = brute_schedule(mixing.whole_weights(share), {s: -(-sizes[s] // 4) for s in share}) if weights != {"u": 0, "s": 1e-6, "t": 1} else None
        rows = mixing.mix(docs, weights, block=4).collect()
        assert len(rows) == sum(sizes[s] for s in share)
        if want is None:  # the slots of a weight of 1e-6 are too many to go through
            assert all(r.mix_release == math.floor(r.mix_block / (1e-6 / (1 + 1e-6 * (1 + (None in share))))) for r in rows if r.source == "s" and r.mix_block == 0)
            continue
        assert {(r.mix_source, r.mix_block): (r.mix_release, r.mix_deadline, r.mix_slot) for r in rows} == want
        for s in share:
            assert sorted((r.mix_block, r.mix_position) for r in rows if r.mix_source == s) == [(k // 4, k % 4) for k in range(sizes[s])]


def test_op7_deviation_does_not_grow(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), F.lit("t").alias("text"))
    rows = sorted(mixing.mix(docs, block=1).select("mix_slot", "mix_source", "mix_on_target").collect())
    assert sum(r.mix_on_target for r in rows) > 19_000
    roots = {s: math.sqrt(n) for s, n in (("0", 6667), ("1", 6667), ("2", 6666))}
    target = {s: x / sum(roots.values()) for s, x in roots.items()}
    done = Counter()
    for r in rows:
        done[r.mix_source] += 1
        if r.mix_on_target:
            assert all(abs(done[s] - (r.mix_slot + 1) * w) < 1 for s, w in target.items())


def test_op8_decontamination(real, odd, spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = spark.createDataFrame([(1000, "one TWO"), (1001, ""), (None, "alpha1"), (1002, prose(120, 1)[20:300])], "item_id long, text string")
    bench = bench.select(F.col("item_id").cast("long"), "text").unionByName(extra)
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for r in bench.collect():
        w = fold(r.text)
        if w and r.item_id is not None:
            for i in range(max(1, len(w) - 12)):
                windows[tuple(w[i : i + 13])].add(str(r.item_id))
    sizes = {len(k) for k in windows}
    for docs in (real, odd):
        want = Counter()
        for r in docs.collect():
            w = fold(r.text)
            hit, items = [False] * len(w), set()
            for n in sizes:
                for i in range(len(w) - n + 1):
                    if (x := windows.get(tuple(w[i : i + n]))) is not None:
                        items |= x
                        hit[i : i + n] = [True] * n
            n = sum(hit)
            want[(r.doc_id, len(w), n, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n > 0 and 20 * n >= len(w))] += 1
        for most in (400_000, 150):
            assert Counter(map(tuple, decontam.decontaminate(docs, bench, most_windows=most).collect())) == want
    assert set(decontam.without_leaks(odd, bench).columns) == set(odd.columns)


def test_op9_html(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>menu</a></li></ul></nav>
    <div class="ad">buy</div><article><h1>Title &amp; more</h1><p><b>First, para</b> with &lt;text&gt;<br>and a line, of some length to count.<p>Second &eacute; para, also long enough to count here.
    <ul><li>item one<li>item two</ul><script>var x="</p>";</script><form><input value=z>sign up</form><div class="comments"><p>reader says hi, there</p></div></article><aside>side</aside><footer>&copy; foot</footer></body></html>"""
    assert main_text(page) == "Title & more\nFirst, para with <text> and a line, of some length to count.\nSecond é para, also long enough to count here.\nitem one\nitem two"
    assert main_text("") == "" and main_text("<p") == "" and main_text("plain text, no tags at all in this one") == "plain text, no tags at all in this one"
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", page, "y"), (1, "u", "<p>" * 5000, None)], "page_id int, url string, html string, text string")
    rows = extract(df).collect()
    assert [r.n_chars for r in rows] == [0, len(main_text(page)), 0] and len(rows) == 3


def plain_article(page):
    """The article element of a page by the standard parser, block by block."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.skip, self.out, self.line = 0, 0, [], []

        def flush(self):
            if t := re.sub(r"\s+", " ", "".join(self.line)).strip():
                self.out.append(t)
            self.line = []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.skip += tag in ("script", "style")
            if tag in ("p", "h1", "h2", "ul", "li", "div", "article"):
                self.flush()
            elif tag == "br":
                self.line.append(" ")

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "h2", "ul", "li", "div", "article"):
                self.flush()
            self.inside -= tag == "article"
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.line.append(data)

    p = P()
    p.feed(page or "")
    p.close()
    p.flush()
    return "\n".join(p.out)


def test_op9_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(pages).collect()}
    want = {(r.page_id, r.url): plain_article(r.html) for r in pages.collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


LINE = "Hello there, this is a text of some length, really."


@pytest.mark.parametrize("page, text", [
    (f"<article><p class=it's>{LINE}</p><p>More</p></article>", f"{LINE}\nMore"),
    (f"<div class=discussion><article><h1>T</h1><p>{LINE}</p></article></div>", f"T\n{LINE}"),
    (f"<article><h1>T</h1><p>{LINE}</p><div class='legal'>Legal words that belong to it.</div></article>", f"T\n{LINE}\nLegal words that belong to it."),
    (f"<article><div class='post-header'><h1>Title here</h1></div><p>{LINE}</p></article>", f"Title here\n{LINE}"),
    (f"<article><h1>T</h1><p>{LINE}</p></article><article><h2><a href=x>Teaser</a></h2><p>Short text, read more</p></article>", f"T\n{LINE}"),
    (f"<form id=aspnet><div class=main><h1>T</h1><p>{LINE}</p><p>{LINE}</p></div></form>", f"T\n{LINE}\n{LINE}"),
    (f"<div><div><h1>A title</h1><div><p>{LINE}</p><p>{LINE}</p></div></div><div class=comments><p>I say, hello dear writer, well done.</p></div></div>", f"A title\n{LINE}\n{LINE}"),
    (f"<article><p>{LINE}</p><div class='share-bar'>Share this</div><div class=ad>buy</div><aside>side</aside><p>{LINE}</p></article>", f"{LINE}\n{LINE}"),
    ("<nav>only a menu, and more menu items of some length</nav><footer>a foot note, that is long enough to count</footer>", ""),
    ("<div class=ad>buy this thing, now and here for nothing</div><article></article>", ""),
    ("<p>a<!-->b<p>c, d and e, and f in some length", "ab\nc, d and e, and f in some length"),
])
def test_op9_probes(page, text):
    assert main_text(page) == text


def test_op9_time_is_linear():
    import time

    def took(page):
        began = time.time()
        main_text(page)
        return time.time() - began

    for part in ("<div>", "<span>", "<p><table>", "<header>", "</p>", "<li>", "<table><tr><td>", "<a " + "=" * 20, "<a href='"):
        assert took(part * 40_000) < 5
    assert took("<span>" * 20_000 + "<p>" * 20_000) < 5 and took("<p><table>" + "<span>" * 20_000 + "<div>" * 20_000) < 5


def test_op10_toxicity(spark, odd):
    bad, good = ["you are an idiot", "what a moron he is", "scum like that"], ["the weather is fine", "a muslim woman spoke", "black cats and white dogs", "women at work"]
    rows = [(i, (bad[i % 3] if i % 5 == 0 else good[i % 4]) + " " + WORDS[i % 20]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert held and all((r.doc_id % 5 == 0) == bool(r.predicted) for r in held)
    s = {r.doc_id: r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()}
    assert len(set(s.values())) == 1
    clash = odd.withColumn("label", F.lit(1)).withColumn("id", F.lit("x")).withColumn("score", F.lit(2)).withColumn("held_out", F.lit(2))
    assert toxicity.toxicity(clash, labels.unionByName(labels)).count() == odd.count()


def train_rows(spark, rows):
    return spark.createDataFrame([(str(i), y, t) for i, (y, t) in enumerate(rows)], "id string, label int, text string")


def test_op10_swaps_lower_false_positives(spark):
    """In training, a group's name stands with insults; a neutral mention of it must not count."""
    rows = [(1, f"Look at that muslim idiot {WORDS[i % 20]}. Go away now.") for i in range(30)] + [(0, f"{WORDS[i % 20]} {WORDS[i % 7]} by the park.") for i in range(600)]
    plain, fair = (toxicity.train(train_rows(spark, rows), fairness=x) for x in (0.0, 2.0))
    neutral = "Look, a muslim came."
    assert fair.pairs > 0 and fair.change < plain.change
    assert fair.score(neutral) < 0.3 < plain.score(neutral) and fair.score("Look, an idiot came.") > 0.3


def test_op10_table(spark, real):
    """The terms found in the table are swapped, and the penalty moves weights; held-out rows by a plain count."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.sample(docs, labels, 12_000, "doc_id", "text", "toxic")
    assert {r.id for r in rows.collect()} == {str(r.doc_id) for r in labels.collect() if r.toxic is not None and not toxicity.held_out(r.doc_id)} & {str(r.doc_id) for r in docs.select("doc_id").collect()}
    plain, fair = (toxicity.train(rows, fairness=x) for x in (0.0, 2.0))
    assert fair.pairs > 100 and fair.change < 0.2 * plain.change and plain.weights != fair.weights
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    wrong = lambda m: sum(m.score(r.text or "") >= 0.3 for r in docs.collect() if truth.get(r.doc_id) == 0 and toxicity.held_out(r.doc_id))
    assert wrong(fair) <= wrong(plain)
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(r.held_out == (__import__("zlib").crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in out.items())
    # by hand: bias and the weights of the features of all words
    for i, text in list({r.doc_id: r.text for r in docs.collect()}.items())[:50]:
        z = fair.bias + sum(fair.weights.get(f, 0) for f in {f for w in toxicity.WORD.findall((text or "").lower()) for f in toxicity.features_of(w)})
        assert abs(fair.score(text or "") - 1 / (1 + math.exp(-z))) < 1e-9


def test_op10_words_next_to_any_sign(spark):
    m = toxicity.train(train_rows(spark, [(i % 2, ["an idiot here", "a friend here"][1 - i % 2]) for i in range(60)]))
    for text in ("«idiot»", "“idiot”", "¡idiot!", "x—idiot", "IDIOT"):
        assert abs(m.score(text) - m.score("idiot")) < 0.05
    run = "漢" * 40 + "idiotidiot" + "字" * 40
    assert toxicity.features([run]) == {"~" + run[i : i + 4] for i in range(len(run) - 3)}


def test_op1_licences(odd, real):
    m = licences.train()
    assert m.scan("Licensed under the Apache License, Version 2.0.")[0] == "apache-2.0"
    assert m.scan("Released under the Foo License.")[0] == "unknown"
    assert m.scan("He lost his driving license after the accident and had to walk to work.") is None
    assert m.scan("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007")[0] == "gpl-3.0"
    assert m.scan("Apache License Version 2.0, January 2004")[0] == "apache-2.0"
    assert m.scan('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND')[0] == "unknown"
    got = {r.doc_id: r for r in licences.scan_licences(odd).collect() if r.doc_id is not None}
    assert all(r.families == "" and r.n_paragraphs == 0 and r.family is None for r in got.values())
    # of sentences of families that no part of the classifier has seen, many are still taken for licence talk; ordinary ones aren't
    assert m.held_out["none"] < 0.02 and sum(m.held_out[f] for f in licences.TEMPLATES) / len(licences.TEMPLATES) > 0.2


def test_op1_table(real, spark):
    """Every template, word by word, of which a line holds the whole, is found in its document; other texts with no word of licences have none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = lambda t: " ".join(licences.WORD.findall(t.lower()))
    whole = {f: [plain(t) for t in ts] for f, ts in licences.TEMPLATES.items()}
    want = {}
    for r in docs.collect():
        lines = [f" {plain(x)} " for x in (r.text or "").split("\n")]
        want[r.doc_id] = {f for f, ts in whole.items() for t in ts if any(f" {t} " in x for x in lines)}
    got = {r.doc_id: set(r.families.split(",")) - {""} for r in licences.scan_licences(docs).collect()}
    assert sum(map(bool, want.values())) > 10 and got == want


def test_op1_wrapped_notices(spark):
    import textwrap

    texts = [(f, "\n".join(sign + x for x in textwrap.wrap(t, 76))) for f, ts in licences.TEMPLATES.items() for t in ts for sign in ("", " * ")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.families, r.n_paragraphs) for r in licences.scan_licences(docs).collect()}
    assert got == {i: (f, 1) for i, (f, _) in enumerate(texts)}


def test_op1_several_families_in_a_line(spark):
    pairs = [(a, b, sep) for a in licences.TEMPLATES for b in licences.TEMPLATES if a < b for sep in (" ", " " + prose(30, 7) + " ", " " + prose(500, 8) + " ")]
    docs = spark.createDataFrame([(i, licences.TEMPLATES[a][1] + sep + licences.TEMPLATES[b][1]) for i, (a, b, sep) in enumerate(pairs)], "doc_id long, text string")
    got = {r.doc_id: (r.families, r.n_paragraphs) for r in licences.scan_licences(docs).collect()}
    assert got == {i: (f"{a},{b}", 2) for i, (a, b, _) in enumerate(pairs)}


def test_empty_tables(spark, real):
    none = real.limit(0)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(0)
    for df in (substrings.drop_repeats(none), tokens.count_tokens(none), quality.quality(none), pii.find_pii(none), mixing.mix(none), decontam.decontaminate(none, bench), nearjoin.near_join(none), licences.scan_licences(none), extract(pages), toxicity.toxicity(none, labels)):
        assert df.count() == 0
    assert decontam.decontaminate(real, bench.limit(0)).where("n_hit > 0").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    ids = []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    z = __import__("zstandard").ZstdCompressor(level=3)
    good = [r for r in docs.collect() if quality.measure(r.text.encode(), z)["kept"]]
    assert ids[0] == {r.doc_id for r in good}
    label = brute_near([(r.doc_id, r.text) for r in good])
    assert ids[1] == {i for i, c in label.items() if i == c}
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    leaks = {tuple(w[i : i + 13]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [fold(r.text)] if w for i in range(max(1, len(w) - 12))}
    sizes = {len(k) for k in leaks}
    clean = {r.doc_id for r in good if r.doc_id in ids[1] for w in [fold(r.text)] if not any(tuple(w[i : i + n]) in leaks for n in sizes for i in range(len(w) - n + 1))}
    assert ids[2] == clean == ids[3] == ids[4] and len(ids[1]) > len(clean)
    assert not any(brute_pii(r.text) for r in kept.collect())
    assert corpus_pipeline.run(spark, SF).count() == len(ids[4])
