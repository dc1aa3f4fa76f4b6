"""Text operators against brute force, on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import bpe_count, common, hmm, minhash, mixing, packing, toxicity, words

from .conftest import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = split(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


# --- words ----------------------------------------------------------------------------------------------


def test_word_kernel():
    texts = [r[1] for r in odd_rows()] + ["a" * 100 + " " + "a" * 101, "\x1c\x85  b"]
    raw, offsets = words.utf8(pa.array(texts))
    starts, lengths, first = words.word_spans(raw, offsets)
    h = words.hash_words(raw, starts, lengths)
    seen: dict = {}
    for i, t in enumerate(texts):
        got = h[first[i] : first[i + 1]].tolist()
        want = [w.encode() for w in split(t)]
        assert len(got) == len(want)
        for x, w in zip(got, want):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_word_kernel_on_a_slice():
    a = pa.array(["zz", "one two", None, "three"])[1:]
    raw, offsets = words.utf8(a)
    assert np.diff(words.word_spans(raw, offsets)[2]).tolist() == [2, 0, 1]


# --- near duplicates ------------------------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t, *_ in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in sets:
        for j, b in sets:
            if a and b and i != j and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(odd, k, percent):
    got = minhash.near_duplicates(odd, k=k, percent=percent).collect()
    rows = odd_rows()
    assert len(got) == len(rows)
    want = brute_components(rows, k, percent)
    size = {i: len(shingles(t, k)) for i, t, *_ in rows if i is not None}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (size[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_crowded_bucket(spark, monkeypatch):
    """A group far larger than what a class asks for, in which some belong together only through others."""
    monkeypatch.setattr(minhash, "CROWD", 4)
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        v = list(base)
        for _ in range(int(rng.integers(0, 8))):
            v[int(rng.integers(120))] = f"e{rng.integers(10**6)}"
        rows.append((i, " ".join(v)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)


@pytest.mark.parametrize("wide,side", [(24, 200_000), (1, 0)])
def test_hot_buckets(spark, monkeypatch, wide, side):
    """Buckets over BLOCK classes, of several components, by blocks and by second bands, with broadcast and with salted sides."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    monkeypatch.setattr(minhash, "CROWD", 4)
    monkeypatch.setattr(minhash, "CLOSE_ROWS", 8)
    monkeypatch.setattr(minhash, "MANY", 2)
    monkeypatch.setattr(minhash, "WIDE", wide)
    monkeypatch.setattr(common, "SIDE", side)
    rng = np.random.default_rng(1)
    rows = []
    for g in range(4):  # four groups that share half of their words, so that they meet in buckets but do not link
        base = [f"w{i}" if i < 70 else f"g{g}w{i}" for i in range(120)]
        for i in range(25):
            v = list(base)
            for _ in range(int(rng.integers(0, 6))):
                v[int(rng.integers(120))] = f"e{rng.integers(10**6)}"
            rows.append((g * 100 + i, " ".join(v)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_many_repeats_of_two_near_copies(spark):
    """Ten thousand rows of two near copies are two sets, whatever the number of rows."""
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(["new", *base[1:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").crossJoin(spark.range(5000).select()).repartition(4)
    got = minhash.near_duplicates(df).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, True, 5000), (2, 1, False, 5000)]


def test_texts_that_share_an_id(spark):
    """Two texts of one id are classed by their own text, wherever their links lead."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (3, a + " more"), (7, b + " more"), (9, "something else altogether")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 5), (7, 5), (9, 9)]


def test_near_duplicates_of_nothing(none):
    assert minhash.near_duplicates(none).count() == 0


def test_similarity_estimate():
    a, b = list(range(900)), list(range(100, 1000))
    texts = pa.array([" ".join(map(str, a)), " ".join(map(str, b))])
    _, _, _, packed, _ = minhash.signatures(texts, 1)
    x, y = (np.frombuffer(p, np.uint64) for p in packed)
    assert abs(float(minhash.similarity(x[None], y[None])[0]) - 0.8) < 0.2 and float(minhash.similarity(x[None], x[None])[0]) == 1


def test_exact_joins():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3, 4, 5], [9])]
    assert minhash.joins(np.arange(4), np.arange(4), sets, 80) == [(0, 2), (1, 2)]


# --- token counts and packing ---------------------------------------------------------------------------


def test_token_counts(odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = collections.Counter(tuple(r) for r in bpe_count.token_counts(odd, limit=50).collect())
    want = collections.Counter()
    for i, text, *_ in odd_rows():
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want[i, len((text or "").encode()), n, n > 50] += 1
    assert got == want


def test_merge_counter_on_odd_characters():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib, r = bpe_count.MergeCounter(path), Tokenizer.from_file(path), random.Random(1)
    parts = ["a", "The", "'s", "'S", " ", "\n", "\x1c", "\x85", " ", "é", "İ", "Σ", "ς", "ſ", "K", "ﬁ", "中文", "🙂", "1", "²", "_", "<|endoftext|>", "<|EndOfText|>", "ŉ", "ẞ", "µ", "\x00", "​"]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert own.count(x) == len(lib.encode(x, add_special_tokens=False).ids), repr(x)
    long = "a" * 30_000 + "ab" * 20_000
    assert own.count(long) == len(lib.encode(long, add_special_tokens=False).ids)


def test_packing(odd):
    import public_tokenizers

    enc = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(odd, with_ids=True).collect()
    by_seq = collections.defaultdict(list)
    docs = collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_seq[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id, r.doc_tokens].append((r.start, ids))
    for pieces in by_seq.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 2048
    total = sum(r.length for r in got)
    padded = sum(t if t & (t - 1) == 0 else 2048 for t in (sum(n for _, n in p) for p in by_seq.values()))
    assert padded == total
    want = collections.Counter()
    for i, text, *_ in odd_rows():
        ids = enc.library.encode(text or "", add_special_tokens=False).ids + [1]
        want[i, len(ids), tuple(ids)] += 1
    for (i, n), parts in docs.items():
        flat = [x for _, ids in sorted(parts, key=lambda p: p[0]) for x in ids.tolist()]
        copies = sum(c for (d, m, _), c in want.items() if d == i and m == n)
        assert len(flat) == n * copies
        if copies == 1:
            assert (i, n, tuple(flat)) in want
    assert sum(n * c for (_, n, _), c in want.items()) == total


def test_packing_of_nothing(none):
    assert packing.pack(none).count() == 0


def test_encoder_on_odd_characters():
    import random

    import public_tokenizers

    enc, r = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    parts = ["a", "The", "'s", "'S", " ll", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", " ", "é", "İ", "Σ", "ſ", "中文", "🙂", "1", "²", "_", "<|endoftext|>", "ŉ", "×", "·", "“"]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert enc(x).tolist() == enc.library.encode(x, add_special_tokens=False).ids, repr(x)


def test_pack_lengths_balances_cost():
    rng = np.random.default_rng(0)
    lengths = rng.lognormal(6, 1, 3000).astype(int) + 1
    doc, start, length, seq = packing.pack_lengths(lengths, 2048)
    assert np.bincount(doc, length, len(lengths)).astype(int).tolist() == lengths.tolist()
    tokens = np.bincount(seq, length)
    assert tokens.max() <= 2048
    cost = np.bincount(seq, length + length * length / 1024)
    share = np.searchsorted(np.sort(cost[tokens == 2048]), 2048 + 2048 * 2048 / 1024 - 1)
    assert share > 0


def test_only_what_fits_nowhere_is_cut():
    """Every remainder stands whole in the sequence a scan over all of them picks; the others are cut."""
    lengths = np.random.default_rng(0).lognormal(6, 1, 3000).astype(int) + 1
    doc, start, length, seq = packing.pack_lengths(lengths, 2048)
    rest = lengths % 2048
    base, bins = int((lengths // 2048).sum()), int(rest.sum()) // 2048
    room, cost, want = np.full(bins, 2048), np.zeros(bins), {}
    for d in np.argsort(-rest, kind="stable"):
        if rest[d] and (room >= rest[d]).any():
            b = int(np.where(room >= rest[d], cost, np.inf).argmin())
            want[int(d)] = base + b
            room[b] -= rest[d]
            cost[b] += rest[d] + rest[d] ** 2 / 1024
    whole = (start == lengths[doc] - rest[doc]) & (length == rest[doc]) & (seq < base + bins)
    got = dict(zip(doc[whole].tolist(), seq[whole].tolist()))
    assert {d: got.get(d) for d in want} == want
    parts = np.bincount(doc[seq >= base], minlength=len(lengths))
    assert set(np.flatnonzero(parts > 1).tolist()) <= set(np.flatnonzero(rest).tolist()) - set(want)


# --- mixing ---------------------------------------------------------------------------------------------


def test_targets_by_hand(spark):
    """30 words in four sources: 45 to share; one fills and its excess is shared again."""
    d = spark.createDataFrame([("a", 3), ("b", 10), ("c", 12), (None, 5)], "source string, size long")
    got = {r.source: (r.weight, r.target) for r in mixing.source_targets(d).collect()}
    assert got["a"] == (3.0, 6.0) and got[None][0] == 3.0
    assert abs(sum(t for _, t in got.values()) - 45) < 1e-9
    assert got[None][1] == 10.0 and abs(got["b"][1] - 29 / 3) < 1e-9 and abs(got["c"][1] - 58 / 3) < 1e-9


def test_mix(odd):
    rows = odd_rows()
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(rows)
    per = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        p = per[r.source]
        p[0] += r.size
        p[1] = r.target
        p[2] += r.size * len(r.positions)
        assert len(r.positions) <= 2 and all(0 <= x <= 1 for x in r.positions) and list(r.positions) == sorted(r.positions)
    own = collections.Counter()
    for _, t, _, s, *_ in rows:
        own[s] += len(WORD.findall(t or ""))
    smallest = {s: max((len(WORD.findall(t or "")) for _, t, _, x, *_ in rows if x == s), default=0) for s in own}
    for s, (size, target, taken) in per.items():
        assert size == own[s] and abs(target - taken) <= smallest[s] / 2
    again = mixing.mix_sources(odd.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.positions)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_salted_join_gives_the_same(odd, monkeypatch):
    one = sorted(str(tuple(r)) for r in mixing.mix_sources(odd).collect())
    monkeypatch.setattr(common, "SIDE", 0)
    assert one == sorted(str(tuple(r)) for r in mixing.mix_sources(odd).collect())


def brute_mix(rows, tie, weights=(3, 1, 2)):
    """Copies and positions of each (doc_id, text, source) row, source by source in its order, without windows."""
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, open_, left = {}, list(sources), 1.5 * sum(own.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * own[s] <= level * weight[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * own[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    out = []
    for i, s in enumerate(sources):
        copies = collections.Counter()
        mine = []
        for d, t, x in rows:
            if x == s:
                mine.append([hashlib.md5(f"{'' if d is None else d}|{size(t)}|{tie[t]}|{copies[d, t]}".encode()).hexdigest(), d, size(t), 0])
                copies[d, t] += 1
        mine.sort()
        passes = int(target[s] // own[s]) if own[s] else 0
        gap = target[s] - passes * own[s]
        for _ in range(mixing.FILLS):
            at, had = 0, gap
            for m in mine:
                if not m[3] and 0 < m[2] <= had:
                    at += m[2]
                    if at <= had:
                        m[3], gap = 1, gap - m[2]
        for _ in range(mixing.TOPS):
            best = min(((abs(m[2] - gap), m[0]) for m in mine if not m[3] and m[2] and abs(m[2] - gap) < gap), default=None)
            if best:
                m = next(m for m in mine if m[0] == best[1])
                m[3], gap = 1, gap - m[2]
        schedule = mixing.SCHEDULES[i % len(weights)]
        t = np.linspace(0, 1, 200_001)
        w = np.interp(t, *zip(*schedule))
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        supplied = passes * own[s] + sum(m[2] for m in mine if m[3])
        for c in range(passes + 1):
            done = 0
            for m in mine:
                if c < passes or m[3]:
                    share = (c * own[s] + done) / supplied if supplied else 0.0
                    out.append((str(m[1]), m[2], s, round(float(np.interp(share * area[-1], area, t)), 4)))
                    done += m[2]
    return out


def test_mix_against_brute_force(odd, spark):
    """Which documents are taken, how often and at which positions, equals a plain reading of the rules."""
    rows = [(r[0], r[1], r[3]) for r in odd_rows()]
    rows += [(None, "rows without an id", "s2")] * 6 + [(500, "one row many times over", "s3")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    tie = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    got = [(str(r.doc_id), r["size"], r.source, p) for r in mixing.mix_sources(df).collect() for p in r.positions]
    want = sorted(brute_mix(rows, tie), key=lambda x: (x[0], x[1], str(x[2]), x[3]))
    got = sorted(got, key=lambda x: (x[0], x[1], str(x[2]), x[3]))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want)) < 2e-4


def test_many_sources_number_by_code_point(spark):
    rows = [(f"s{i}", 1 + i % 3) for i in range(300)] + [(None, 4), ("Z", 2), ("é", 2)]
    got = {r.source: r.weight for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long").repartition(7)).collect()}
    order = sorted((s for s, _ in rows if s), key=str.encode) + [None]
    assert got == {s: float((3, 1, 2)[i % 3]) for i, s in enumerate(order)}


def test_position_inverts_the_schedule(spark):
    schedule = [(0.0, 0.5), (0.5, 1.0), (1.0, 2.0)]
    total = 0.375 + 0.75
    got = spark.createDataFrame([(x / 10,) for x in range(11)], "s double").select("s", mixing.position(F.col("s"), schedule).alias("t")).collect()
    for r in got:
        t = r.t
        area = 0.5 * t + 0.5 * t * t if t <= 0.5 else 0.375 + (t - 0.5) + (t - 0.5) ** 2
        assert abs(area / total - r.s) < 1e-9


def test_mix_of_nothing(none):
    assert mixing.mix_sources(none).count() == 0


# --- language model -------------------------------------------------------------------------------------


def test_forward_against_enumeration():
    rng = np.random.default_rng(0)
    m = hmm.Model(*(x / x.sum(-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)))), emit=rng.random((6, 3)))
    m.emit /= m.emit.sum(axis=0)
    docs = [np.array([0, 3, 5]), np.array([2]), np.array([1, 1, 4, 5, 0])]
    for d, got in zip(docs, hmm.log10_likelihood(m, docs)):
        p = 0.0
        for path in np.ndindex(*[3] * len(d)):
            q = m.start[path[0]] * m.emit[d[0], path[0]]
            for a, b, x in zip(path, path[1:], d[1:]):
                q *= m.move[a, b] * m.emit[x, b]
            p += q
        assert abs(math.log10(p) - got) < 1e-9


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 20, rng.integers(5, 40)) + (200 if i % 2 else 0) for i in range(40)]
    m = hmm.start_model(docs, 2)
    last = hmm.log10_likelihood(m, docs).sum()
    for _ in range(3):
        start, move, emit = hmm.expected_counts(m, docs)
        assert abs(emit.sum() - sum(map(len, docs))) < 1e-6 and abs(move.sum() - sum(len(d) - 1 for d in docs)) < 1e-6 and abs(start.sum() - 40) < 1e-6
        m = hmm.Model.from_counts(start, move, emit)
        now = hmm.log10_likelihood(m, docs).sum()
        assert now > last - 1e-6 * abs(last)
        last = now


def test_training_ends_when_it_gains_no_more(spark, monkeypatch):
    """One more round over the training texts gains next to nothing, however poor the start."""
    monkeypatch.setattr(hmm, "START_DOCS", 4)
    rng = np.random.default_rng(0)
    docs = []
    for _ in range(200):
        state, d = int(rng.integers(3)), []
        for _ in range(40):
            state = state if rng.random() < 0.9 else int(rng.integers(3))
            d.append(int(rng.integers(10 * state, 10 * state + 15)))
        docs.append(np.array(d))
    rows = [(i, bytearray(d.astype("<u2").tobytes())) for i, d in enumerate(docs)]
    model = hmm._trained(spark.createDataFrame(rows, "doc_id long, cls binary"), 3)
    per = lambda m: hmm.log10_likelihood(m, docs).sum() / 8000
    assert per(hmm.Model.from_counts(*hmm.expected_counts(model, docs))) - per(model) < 0.001


def test_score_corpus(odd):
    rows = odd_rows()
    got = hmm.score_corpus(odd).collect()
    assert len(got) == len(rows)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    count: collections.Counter = collections.Counter()
    for i, t, *_ in rows:
        if not held(i):
            count.update([*split(t), None])
    n, v = sum(count.values()), len(count)
    by_id = {}
    for i, t, *_ in rows:
        toks = [*split(t), None]
        by_id[i, len(toks)] = (sum(count[w] > 0 for w in toks), sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks))
    for r in got:
        known, base = by_id[r.doc_id, r.n_tokens]
        assert (r.held_out, r.n_known, r.train_tokens) == (held(r.doc_id), known, n) and abs(r.base_score - base) < 1e-6
        assert r.score < 0 and math.isfinite(r.score)


def test_expected_counts_against_enumeration():
    """Baum-Welch counts are the sums over all state paths, each weighed by its share of the text's probability."""
    rng = np.random.default_rng(4)
    m = hmm.Model(*(x / x.sum(-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)))), emit=rng.random((6, 3)))
    m.emit /= m.emit.sum(axis=0)
    docs = [np.array([0, 3, 5, 1]), np.array([2]), np.array([1, 1, 4, 5, 0])]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.CLASSES, 3))
    for d in docs:
        paths = list(np.ndindex(*[3] * len(d)))
        weight = np.array([m.start[p[0]] * np.prod([m.emit[x, z] for x, z in zip(d, p)]) * np.prod([m.move[y, z] for y, z in zip(p, p[1:])]) for p in paths])
        for p, w in zip(paths, weight / weight.sum()):
            start[p[0]] += w
            for y, z in zip(p, p[1:]):
                move[y, z] += w
            for x, z in zip(d, p):
                emit[x, z] += w
    for got, want in zip(hmm.expected_counts(m, docs), (start, move, emit)):
        assert np.abs(got - want).max() < 1e-9


def test_scores_against_a_plain_forward_pass(spark, monkeypatch):
    """Scores of whole texts, words of their own class, rare and unseen ones, equal a token by token reading of the rules."""
    made = []
    monkeypatch.setattr(hmm, "_trained", lambda *a, train=hmm._trained: made.append(train(*a)) or made[0])
    monkeypatch.setattr(hmm, "ROUNDS", 2)
    r = np.random.default_rng(6)
    word = lambda k: f"W{k}x{k * 7 % 97}"
    rows = [(i, " ".join(word(k) for k in r.integers(0, 60, r.integers(1, 50)))) for i in range(40)]
    rows += [(100, " ".join(word(k) for k in range(36_000))), (101, None), (102, "never seen words W5x35"), (103, " ".join(word(k) for k in range(30_000, 40_000, 7)))]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    assert not held(100)
    got = {x.doc_id: x.score for x in hmm.score_corpus(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    count: collections.Counter = collections.Counter(w for i, t in rows if not held(i) for w in split(t))
    every = sorted({w for _, t in rows for w in split(t)})
    size = np.array([len(w) for w in every])
    hashes = hmm.hash_words(np.frombuffer("".join(every).encode(), np.uint8), np.cumsum(size) - size, size).view(np.int64)
    rank = {w: k for k, (w, _) in enumerate(sorted(zip(every, hashes), key=lambda x: (-count[x[0]], x[1])))}
    own = lambda w: count[w] > 0 and rank[w] < hmm.TOP

    def shape(w):
        b, h = w.encode(), min(len(w.encode()), 3)
        for j in range(3):
            h = h * 257 + b[max(len(b) - 1 - j, 0)]
        return int(hmm.mix(np.array([h], np.uint64), 11)[0]) % hmm.SHAPES

    total, types = collections.Counter(), collections.Counter()
    for w, c in count.items():
        if not own(w):
            total[shape(w)] += c
            types[shape(w)] += 1
    assert sum(types.values()) > 3000
    m = made[0]
    for i, text in rows:
        want, alpha = 0.0, None
        for w in [*split(text), None]:
            cls = hmm.END if w is None else rank[w] if own(w) else hmm.TOP + shape(w)
            if w is not None and not own(w):
                want += math.log10((count[w] + 0.1) / (total[shape(w)] + 0.1 * (types[shape(w)] + 1)))
            alpha = (m.start if alpha is None else alpha @ m.move) * m.emit[cls]
            want += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert abs(got[i] - want) < 1e-6 * max(1, -want), i


def test_rare_words_come_by_the_join(odd, monkeypatch):
    """With no word sent along, every count comes from the shuffle, and base scores are the same."""
    one = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in hmm.score_corpus(odd).collect())
    monkeypatch.setattr(hmm, "KNOWN", 5)
    assert one == sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in hmm.score_corpus(odd).collect())


def test_scores_of_nothing(none):
    assert hmm.score_corpus(none).count() == 0


# --- toxicity -------------------------------------------------------------------------------------------


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 2.0, "vequ*": 3.0})
    f = lambda t: dict(zip(toxicity.CLASSES, g.features(t)))
    assert f("An idiot here.")["plain"] == 2.0
    assert f("You absolute IDIOT!")["targeted"] == 2.0 and f("that idiot over there is you")["targeted"] == 2.0
    assert f("He is gone. an idiot")["plain"] == 2.0  # the clause end forgets the target
    assert f("This is not an idiot")["negated"] == 2.0
    assert f("Someone said idiot twice")["reported"] == 2.0
    assert f("a vequmo")["plain"] == 3.0 and f("veq idiotic")["plain"] == 0
    assert f("I will kill you")["threat"] > 0 and f("I will not kill you")["threat"] == 0 and f("kill the lights")["threat"] == 0
    assert not any(f("not you, said they").values()) and not any(f("").values())
    assert not any(f("idiot").values()) and not any(f("Idiot! idiot idiot.\nvequmo").values())  # isolated words are no clauses


def clause_features(text, lexicon, reach=3):
    """The grammar's rules read clause by clause, without machines."""
    total = dict.fromkeys(toxicity.CLASSES, 0.0)
    kinds = {w: k for k, names in (("threat", toxicity.THREATS), ("target", toxicity.TARGETS), ("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTS)) for w in names.split()}
    for clause in re.split(r"[.!?;\n]", text.lower()):
        said = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*", clause)
        kind = [kinds.get(w) or ("insult" if w in lexicon else None) for w in said]
        marks = []
        for i, k in enumerate(kind):
            if k in ("insult", "threat"):
                how = "reported" if "report" in kind[:i] else "negated" if "negation" in kind[max(0, i - reach) : i] else "plain"
                marks.append((k, how))
        you, insults = "target" in kind, [how for k, how in marks if k == "insult"]
        if insults and len(insults) < len(said):
            best = next(how for how in ("plain", "negated", "reported") if how in insults)
            total["targeted" if best == "plain" and you else best] += max(lexicon[w] for w, k in zip(said, kind) if k == "insult")
        if you and ("threat", "plain") in marks:
            total["threat"] += toxicity.SEED_WEIGHT
    return tuple(total.values())


def test_composed_machine_against_clause_rules():
    """Whole texts read by the composed machine and by the rules directly give the same features."""
    import random

    r = random.Random(4)
    lexicon = {"idiot": 2.0, "moron": 3.5, "vaurien": 1.25}
    vocabulary = [*lexicon, "you", "they", "not", "never", "kill", "hurt", "said", "selon", "tree", "stone", "is", "été", "42", "Idiot,"]
    ends = ["", "", "", "", ".", "!", ";", "\n", " ? "]
    g = toxicity.Grammar(lexicon)
    seen = set()
    for n in range(3000):
        text = " ".join(r.choice(vocabulary) + r.choice(ends) for _ in range(r.randint(0, 40)))
        want = clause_features(text, lexicon)
        assert np.allclose(g.features(text), want), text
        seen |= {c for c, x in zip(toxicity.CLASSES, want) if x}
    assert seen == set(toxicity.CLASSES)


def test_composition_is_the_cascade():
    """One step of the composed table is one step of each rule in turn."""
    import random

    rules = (toxicity.negation(), toxicity.reported, toxicity.target, toxicity.threat, toxicity.insult)
    after, out = toxicity.compose(*rules)
    r = random.Random(1)
    for _ in range(200):
        state, own = 0, [None] * len(rules)
        for _ in range(30):
            i = r.randrange(len(toxicity.SYMBOLS))
            symbol = toxicity.SYMBOLS[i]
            for j, rule in enumerate(rules):
                own[j], symbol = rule(own[j], symbol)
            assert out[state][i] == symbol
            state = after[state][i]


def test_fit_does_not_depend_on_partitions(odd, spark):
    lab = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    score = lambda df: sorted((str(r.doc_id), r.score) for r in toxicity.toxicity(df, lab).collect())
    assert score(odd) == score(odd.repartition(7, "text")) == score(odd.coalesce(1))


def test_learned_stems(spark):
    import random

    r = random.Random(0)
    fill = lambda: " ".join(r.choice("abcdefgh") * r.randint(3, 6) + r.choice("xyz") for _ in range(20))
    docs, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        docs.append((i, fill() + (f" zorg{r.choice('abcdef')}{r.choice('lmno')} " if bad else " zora ") + fill()))
        labels.append((i, 1, int(bad)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    assert all(r_.predicted == (r_.doc_id % 5 == 0) for r_ in got)
    assert all(r_.held_out == (zlib.crc32(str(r_.doc_id).encode()) % 5 == 0) for r_ in got)


def test_toxicity_of_odd_rows(odd, none, spark):
    lab = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd, lab).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.toxicity(none, lab).count() == 0
    assert toxicity.toxicity(odd, lab.limit(0)).count() == len(odd_rows())


def test_wide_buckets_keep_pairs_of_one_band(spark, monkeypatch):
    """Two similar signatures that share one band only still meet when their hot bucket is split."""
    monkeypatch.setattr(minhash, "BLOCK", 1)
    monkeypatch.setattr(minhash, "WIDE", 0)
    rng = np.random.default_rng(6)
    least = 0.67
    shifts = np.arange(0, 64, minhash.BITS, dtype=np.uint64)
    pairs = []
    for b in range(24):
        one = rng.integers(0, 16, minhash.PERMS)
        two = one.copy()
        two[[4 * o + int(rng.integers(4)) for o in range(24) if o != b]] ^= 5  # every other band differs
        sig = [np.bitwise_or.reduce(v.astype(np.uint64).reshape(-1, 16) << shifts, axis=1) for v in (one, two)]
        assert minhash.similarity(sig[0], sig[1]) >= least
        bands = [[1000 * b + 100 * side + i for i in range(24)] for side in (1, 2)]
        bands[1][b] = bands[0][b]
        pairs.append((bands[0][b], sig, bands))
    classes = spark.createDataFrame([(2 * i + s, bytearray(p[1][s].tobytes()), p[2][s]) for i, p in enumerate(pairs) for s in (0, 1)], "cls long, sig binary, bands array<long>")
    crowd = spark.createDataFrame([(p[0], 2 * i + s, 2) for i, p in enumerate(pairs) for s in (0, 1)], "bkey long, cls long, n long")
    comp = spark.createDataFrame([], "cls long, component long")
    met = minhash._crossing(crowd, comp, classes, least).groupBy("bkey", "bi", "bj").agg({"cls": "collect_set"}).collect()
    assert {i for i in range(24)} == {c // 2 for r in met for c in r[3] if {c, c ^ 1} <= set(r[3])}
