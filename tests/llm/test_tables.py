"""Vector, archive, URL and pipeline operators against brute force, on awkward rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import hashing_search, merkle, multi_index, url_lists

from .conftest import odd_rows

VECTORS = "vec_id long, embedding array<float>, label int, cell int, raw string"


def vector_rows(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((60, 8))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    for k in range(12):  # near and equal copies
        rows.append((100 + k, [float(np.float32(x)) for x in base[k % 4] + rng.normal(0, 0.05, 8)]))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [2 * x for x in rows[1][1]])]
    rows += [(300, None), (301, [0.0] * 8), (302, [1.0, None, *[0.0] * 6]), (303, [float("nan"), *[1.0] * 7]), (304, [float("inf"), *[1.0] * 7]), (305, []), (None, rows[0][1])]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in vector_rows()], VECTORS).repartition(3)


def usable():
    return [(i, np.array(v)) for i, v in vector_rows() if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]


@pytest.mark.parametrize("block", [1024, 3])
def test_near_vectors(vectors, monkeypatch, block):
    monkeypatch.setattr(multi_index, "BLOCK", block)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multi_index.near_vectors(vectors).collect()}
    ok = usable()
    root = {i: i for i, _ in vector_rows()}
    links = dict.fromkeys(root, 0)

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in ok:
        for j, b in ok:
            if i != j and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                links[i] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    for i in root:
        assert got[i] == ((links[i], find(i), find(i) == i) if i is not None else (0, None, True))


def test_no_vectors(vectors, spark):
    assert multi_index.near_vectors(vectors.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in multi_index.near_vectors(bad).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_odd_lengths_harm_no_other_row(spark):
    """A longer, a shorter and a zero row stand first in one batch; proper rows answer as they do without them."""
    good = [(i, v) for i, v in vector_rows() if i is not None and i < 300]
    odd = [(400, [0.0] * 3), (401, [1.0, None]), (402, [1.0] * 9), (403, [1.0] * 7), (404, [1.0] * 7), (405, [float("nan")] * 5)]
    kind = "vec_id long, embedding array<float>"
    alone, mixed = (spark.createDataFrame(rows, kind).coalesce(1) for rows in (good, odd + good))
    links = lambda df: {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multi_index.near_vectors(df).collect()}
    want = links(alone)
    assert any(n for n, _, _ in want.values())
    assert links(mixed) == want | {i: (0, i, True) for i, _ in odd}
    found = lambda df: sorted(map(tuple, hashing_search.nearest(df, lambda i: (i % 20 == 0) | (i > 400), k=5, recall=1.0).collect()))
    assert found(alone) and found(mixed) == found(alone)


def test_visits_are_all_cells_in_reach_nearest_first():
    rng = np.random.default_rng(0)
    x = multi_index.unit(rng.standard_normal((50, 8)))
    index = multi_index.MultiIndex(multi_index.kmeans(x[:, :4], 5, rng), multi_index.kmeans(x[:, 4:], 5, rng), 0.05)
    cells, first = index.visit(x)
    c1, c2 = index.costs(x)
    assert len(cells) > 100
    for i in range(50):
        own = c1[i].argmin() * 5 + c2[i].argmin()
        cost = (np.maximum(c1[i], 0)[:, None] + np.maximum(c2[i], 0)[None, :]).reshape(-1)
        mine = cells[first[i] : first[i + 1]]
        assert mine[0] == own and set(mine.tolist()) == set(np.flatnonzero(cost <= 0.05).tolist())
        assert (np.diff(cost[mine]) >= 0).all()


def test_border_is_the_distance_to_the_plane_between():
    centre = np.array([[0.0, 0.0], [4.0, 0.0], [0.0, 0.0]])
    got = multi_index.border(np.array([[0.5, 3.0]]), centre)
    assert got.tolist() == [[-1.0, 2.25, 0.0]]


def test_recall_at_the_threshold():
    """Pairs at exactly the threshold angle meet as often as asked, on vectors that the fit has not seen."""
    rng = np.random.default_rng(1)
    x = multi_index.unit(rng.standard_normal((9000, 16)))
    index = multi_index.fit(x[:5000], 100_000, 0.95, 0.99)
    assert len(index.first) > 4
    a = x[5000:]
    t = rng.standard_normal(a.shape)
    t -= (t * a).sum(1)[:, None] * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * multi_index.unit(t)
    (va, fa), (vb, fb) = index.visit(a), index.visit(b)
    met = [vb[fb[i]] in va[fa[i] : fa[i + 1]] or va[fa[i]] in vb[fb[i] : fb[i + 1]] for i in range(len(a))]
    assert np.mean(met) >= 0.98


@pytest.mark.parametrize("block, slice_", [(64, 16384), (64, 40), (2048, 40), (16, 7)])
def test_links_across_many_cells(spark, monkeypatch, block, slice_):
    """Links, counts and components of 3000 vectors in a grid of many cells, some crowded, equal brute force, however cells are dealt out."""
    monkeypatch.setattr(multi_index, "CELL", 40)
    monkeypatch.setattr(multi_index, "BLOCK", block)
    monkeypatch.setattr(multi_index, "SLICE", slice_)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 16))
    x = np.concatenate([x, x[rng.integers(0, 400, 800)] + rng.normal(0, 0.3, (800, 16)), x[7] + rng.normal(0, 0.2, (200, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_vectors(df, recall=1.0).collect()}
    u = multi_index.unit(x.astype(float))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (low == label).all():
            break
        label = low
    links = near.sum(axis=1)
    assert links.sum() > 10_000
    assert sum(got[i][0] for i in got) >= 0.999 * links.sum() and all(got[i][0] <= links[i] for i in got)
    assert np.mean([got[i] == (links[i], label[i]) for i in range(len(x))]) >= 0.999


def test_rows_that_share_an_id(spark):
    """Two vectors of one id are vectors of their own: each links by itself, and each is searched by itself."""
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (3, [1.0, 0.01, 0.0]), (7, [0.01, 1.0, 0.0]), (9, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in multi_index.near_vectors(df).collect())
    assert got == [(3, 1, 3), (5, 1, 3), (5, 1, 5), (7, 1, 5), (9, 0, 9)]
    found = hashing_search.nearest(df, lambda i: i == 5, k=3, recall=1.0).collect()
    assert sorted((r["rank"], r.vec_id) for r in found) == [(1, 3), (1, 7), (2, 3), (2, 7), (3, 5), (3, 5)]


def test_search(vectors, monkeypatch):
    monkeypatch.setattr(hashing_search, "SHARD", 20)
    got = hashing_search.nearest(vectors, lambda i: i % 20 == 0, k=5, recall=1.0).collect()
    ok = usable()
    hits = total = 0
    for i, q in ok:
        if i % 20:
            continue
        want = sorted((math.sqrt(((q - v) ** 2).sum()), j) for j, v in ok if j != i)[:5]
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == i)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and [m[1] for m in mine] == sorted(m[1] for m in mine)
        for _, s, j in mine:
            v = dict(ok)[j]
            assert abs(s - math.sqrt(((q - v) ** 2).sum())) < 1e-9
        hits += len({j for _, j in want} & {m[2] for m in mine})
        total += 5
    assert hits / total >= 0.9


def test_search_with_few_rows(spark, vectors):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<float>")
    got = hashing_search.nearest(few, lambda i: i % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2)]
    assert hashing_search.nearest(few.limit(0), lambda i: i % 100 == 0).count() == 0
    assert hashing_search.nearest(vectors, lambda i: i == -5).count() == 0


@pytest.mark.parametrize("noise", [0.0, 0.02])
def test_copies_do_not_narrow_the_search(noise):
    """Queries that are not copies reach the recall among 98 % (near) copies."""
    rng = np.random.default_rng(0)
    groups = multi_index.unit(rng.standard_normal((5, 64)))
    x = np.concatenate([multi_index.unit(rng.standard_normal((100, 64))), groups[np.arange(4900) % 5] + noise * rng.standard_normal((4900, 64))])
    codes = hashing_search.fit(x, 5, 0.97)
    shard = hashing_search.Shard(np.arange(len(x)), x, codes)
    hits = 0
    for i in range(100):
        score = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        score[i] = np.inf
        _, mine = shard.search(i, x[i], shard.code[i], 5)
        hits += int((mine <= np.sort(score)[4] + 1e-9).sum())
    assert hits / 500 >= 0.9


def test_sample_is_of_distinct_vectors(spark):
    rows = [(i, b"same") for i in range(500)] + [(1000 + i, b"v%d" % i) for i in range(100)]
    good = spark.createDataFrame(rows, "vec_id long, raw binary")
    assert sorted(bytes(r.raw) for r in hashing_search.distinct_sample(good, 500).collect()) == sorted({bytes(v) for _, v in rows})
    some = [bytes(r.raw) for r in hashing_search.distinct_sample(good, 50).collect()]
    assert 20 <= len(some) <= 50 and len(set(some)) == len(some)


def test_pigeonhole_finds_every_code():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 16))
    codes = hashing_search.fit(x, 5, 0.9)
    shard = hashing_search.Shard(np.arange(500), x, codes)
    for radius in (0, 3, 7, codes.radius):
        for i in range(0, 500, 50):
            want = np.flatnonzero(hashing_search.hamming(shard.code, shard.code[i]) <= radius)
            assert shard.within(shard.code[i], radius).tolist() == want.tolist()


# --- archives -------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, n int"


def page_rows():
    rows = [(i, f"http://h{i % 3}/p{i}", "x" * (i % 7) + "é") for i in range(-5, 300)]
    rows += [(3, "http://h0/p3", None), (9, None, ""), (10_000, "u", "v"), (None, "u", "v")]
    return rows


def test_audit(spark):
    a = spark.createDataFrame([(*r, "d", 1) for r in page_rows()], PAGES)
    rows = page_rows()
    rows = [r for r in rows if r[0] != 77]
    rows = [(r[0], r[1], "changed") if r[0] in (5, 200, -4) else r for r in rows]
    rows = [(i, u, "" if (i == 3 and h is None) else h) for i, u, h in rows]  # null became empty
    rows += [(5000, "new", "new"), (12, "http://h0/p12", "x" * 5 + "é")]  # one extra record, one repeat
    b = spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES).repartition(4)
    got = {r.id: (r.status, r.n_primary, r.n_replica) for r in merkle.audit(a, b).collect()}
    assert got == {77: ("missing", 1, 0), 5: ("changed", 1, 1), 200: ("changed", 1, 1), -4: ("changed", 1, 1), 3: ("changed", 2, 2), 5000: ("extra", 0, 1), 12: ("changed", 1, 2)}


def test_audit_offsets(spark):
    a = spark.createDataFrame([(i, "ab", "é" * i) for i in range(6)], "page_id long, url string, html string")
    b = a.filter("page_id <> 4")
    lengths = [len(r.record.encode()) for r in merkle._records_of(a, "page_id", "url", "html", None).orderBy("id").collect()]
    assert [(r.id, r.record_offset) for r in merkle.audit(a, b).collect()] == [(4, sum(lengths[:4]))]


def test_offsets_are_part_of_the_tree(spark):
    """A leaf's hash covers where its records lie: equal records at other offsets are another leaf; siblings don't change."""
    rows = lambda sizes: spark.createDataFrame([(i, f"d{i}", n) for i, n in enumerate(sizes)], "node long, digest string, bytes long")
    up = lambda sizes, width: {r.node: (r.digest, r.bytes) for r in merkle._up(rows(sizes), width).collect()}
    one, two = up([10, 20, 30, 40], 2), up([11, 20, 30, 40], 2)
    assert one[0] != two[0] and one[1] == two[1] and one[1][1] == 70
    assert up([10, 20], 2)[0][0] != up([20, 10], 2)[0][0]


def test_equal_and_empty_replicas(spark):
    a = spark.createDataFrame([(*r, "d", 1) for r in page_rows()], PAGES)
    assert merkle.audit(a, a.repartition(5)).count() == 0
    assert merkle.audit(a.limit(0), a.limit(0)).count() == 0
    ids = {r[0] for r in page_rows()}
    gone = merkle.audit(a, a.limit(0)).collect()
    assert {r.id for r in gone} == ids and {r.status for r in gone} == {"missing"}
    null = merkle.audit(a, a.filter("page_id is not null")).collect()
    assert [(r.id, r.status, r.leaf) for r in null] == [(None, "missing", None)]


def test_archive_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "PART", 2000)  # inherited by workers that start now
    rows = [*page_rows(), (8, None, "no url"), (11, "http://a/\r\nb", "x"), (13, "urn:null", ""), (None, None, None)]
    a = spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES)
    merkle.write_archive(a, str(tmp_path / "a"))
    back = merkle.read_archive(spark, str(tmp_path / "a"))
    assert merkle.audit(a, back).count() == 0
    assert sorted(map(str, back.select("page_id", "url", "html").collect())) == sorted(map(str, a.select("page_id", "url", "html").collect()))
    got = back.collect()
    ends = {}
    for r in sorted(got, key=lambda r: (r.segment, r.record_offset)):
        assert r.record_offset == ends.get(r.segment, 0)
        ends[r.segment] = r.record_offset + r.record_bytes
    # the audit's offsets are the archive's
    first = {}
    for r in got:
        if r.page_id is not None:
            first[r.page_id] = min(r.record_offset, first.get(r.page_id, 1 << 60))
    found = merkle.audit(a, a.limit(0)).filter("id is not null").collect()
    assert {r.id: r.record_offset for r in found} == first


def test_records_are_valid_warc(spark):
    row = spark.createDataFrame([(7, "http://a/é", "<p>é</p>", 0)], "page_id long, url string, html string, at long")
    text = row.select(merkle.warc_record(F.col("page_id"), F.col("url"), F.col("html"), F.timestamp_seconds(F.col("at") + 86400)).alias("r")).first().r
    data = text.encode()
    head, block = data.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
    assert fields["WARC-Type"] == "response" and fields["WARC-Date"] == "1970-01-02T00:00:00Z" and fields["WARC-Target-URI"] == "http://a/é"
    assert fields["Content-Type"].startswith("application/http") and int(fields["Content-Length"]) == len(block) - 4
    assert block[:-4].split(b"\r\n\r\n", 1)[1] == "<p>é</p>".encode()
    with pytest.raises(ValueError):
        list(merkle.parse_segment(data[:-2]))


# --- URL lists ------------------------------------------------------------------------------------------


def judge(host, path, domain, day, entries):
    for kind, key in (("path", path), ("host", host), ("domain", domain)):
        rank = {"block": 2, "allow": 1, "remove": 0}
        mine = sorted((d, rank[a]) for k, x, a, d in entries if (k, x) == (kind, key) and a in rank and d is not None)
        now = [x for x in mine if x[0] <= day] if key and day is not None else []
        if now and now[-1][1]:
            return ("block" if now[-1][1] == 2 else "allow", kind, key, now[-1][0])
    return ("none", None, None, None)


@pytest.mark.parametrize("bound", [url_lists.BOUND, 0])
def test_url_lists(spark, bound):
    captures = [(1, "http://a.b.com/x/y", 5), (2, "https://u:p@A.B.com:80/x?q", 15), (3, "http://c.com", 5), (4, "nonsense", 5), (5, None, 5), (6, "http://a.b.com/z", None), (7, "http://d.b.com/#f", 30), (1, "http://a.b.com/x/y", 5), (None, "http://c.com/", 5)]
    entries = [("host", "a.b.com", "block", 3), ("host", "a.b.com", "remove", 10), ("path", "a.b.com/x", "allow", 4), ("path", "a.b.com/x", "remove", 12), ("domain", "b.com", "block", 14), ("domain", "b.com", "allow", 14), ("host", "c.com", "block", 5), ("host", "c.com", "odd", 1), (None, "c.com", "block", 0), ("host", "c.com", "block", None)]
    c = spark.createDataFrame([(*x, "k", 1) for x in captures], "page_id long, url string, day int, key string, verdict int")
    e = spark.createDataFrame(entries, "kind string, key string, action string, day int")
    parts = {1: ("a.b.com", "a.b.com/x", "b.com"), 2: ("a.b.com", "a.b.com/x", "b.com"), 3: ("c.com", None, "c.com"), 4: (None, None, None), 5: (None, None, None), 6: ("a.b.com", "a.b.com/z", "b.com"), 7: ("d.b.com", "d.b.com/", "b.com"), None: ("c.com", "c.com/", "c.com")}
    got = sorted(str((r.id, r.host, r.verdict, r.kind, r.key, r.since)) for r in url_lists.filter_urls(c, e, bound=bound).collect())
    want = sorted(str((i, parts[i][0], *judge(*parts[i], day, entries))) for i, _, day in captures)
    assert got == want


def test_keys_of_odd_hosts(spark):
    urls = ["http://[::1]:80/a", "http://1.2.3.4/x", "https://a.co.uk/", "https://www.a.co.uk", "http://co.uk/", "http://Ex.com./p", "http://u@v:w@h.a.b.org/", "http://localhost", "x://..", "ftp:/no"]
    keys = url_lists.url_keys(F.col("u"))
    got = [tuple(r) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(*keys.values()).collect()]
    assert got == [
        ("[::1]/a", "[::1]", None),
        ("1.2.3.4/x", "1.2.3.4", None),
        ("a.co.uk/", "a.co.uk", "a.co.uk"),
        (None, "www.a.co.uk", "a.co.uk"),
        ("co.uk/", "co.uk", None),
        ("ex.com/p", "ex.com", "ex.com"),
        ("h.a.b.org/", "h.a.b.org", "b.org"),
        (None, "localhost", None),
        (None, None, None),
        (None, None, None),
    ]


def test_no_entries_or_captures(spark):
    c = spark.createDataFrame([(1, "http://a.com/", 1)], "page_id long, url string, day int")
    e = spark.createDataFrame([], "kind string, key string, action string, day int")
    assert [r.verdict for r in url_lists.filter_urls(c, e).collect()] == ["none"]
    assert url_lists.filter_urls(c.limit(0), e).count() == 0


# --- pipeline -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark, odd, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    odd.write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_stages(spark, odd, none, tables):
    texts = lambda df: sorted(str((r.doc_id, r.text)) for r in df.collect())
    clean = corpus_pipeline.drop_toxic(spark, odd, tables)
    assert clean.columns == odd.columns
    insult = [r for r in odd_rows() if r[1] and "idiot" in r[1].lower().split()]
    assert set(texts(odd)) - set(texts(clean)) <= {str(r[:2]) for r in insult}
    kept = corpus_pipeline.drop_copies(spark, odd, tables)
    assert kept.columns == odd.columns
    from .test_texts import brute_components

    comp = brute_components(odd_rows(), 5, 80)
    want = sorted({str(r[:2]) for r in odd_rows() if r[0] is not None and comp[r[0]] == r[0]} | set()) + sorted(str(r[:2]) for r in odd_rows() if r[0] is None)
    assert texts(kept) == sorted(want)
    mixed = corpus_pipeline.mix(spark, kept, tables)
    assert mixed.columns == odd.columns
    count = {}
    for t in texts(mixed):
        count[t] = count.get(t, 0) + 1
    assert set(count) <= set(texts(kept)) and max(count.values()) <= 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tables).count() == 0


def test_clashing_names(spark, tables):
    """Columns named like any that the stages add come through every stage untouched."""
    names = ["_n", "_id", "_digest", "_position", "row", "id", "digest", "n", "position", "positions", "size", "score", "_rid", "skey", "ord", "kept", "cls"]
    rows = [(i, f"text number {i} of its own kind", "s1", *[f"{c}{i}" for c in names]) for i in [*range(12), 3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, tables)
        assert got.columns == df.columns, name
        assert {tuple(r) for r in got.collect()} <= set(rows), name
    assert corpus_pipeline.pack_sequences(spark, df, tables).count() == 13


def test_run_against_brute_force(spark, odd, tmp_path):
    """Kept documents, copies and tokens of the whole chain equal a plain reading of its rules."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from lumenfold.llm import toxicity

    from .test_texts import brute_components, brute_mix, clause_features

    rows = odd_rows()
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    lexicon = dict.fromkeys(toxicity.INSULTS.split(), toxicity.SEED_WEIGHT)
    toxic = lambda t: np.log1p(clause_features(t or "", lexicon)) @ toxicity._PRIOR[:-1] + toxicity._PRIOR[-1] >= 0
    clean = [r for r in rows if not toxic(r[1])]
    assert 0 < len(clean) < len(rows)
    comp = brute_components(clean, 5, 80)
    kept = {(r[0], r[1], r[3]) for r in clean if r[0] is not None and comp[r[0]] == r[0]} | {(r[0], r[1], r[3]) for r in clean if r[0] is None}
    tie = {r.text: r.h for r in odd.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    taken = {}
    for d, n, s, _ in brute_mix(sorted(kept, key=str), tie):
        taken[d, n, s] = taken.get((d, n, s), 0) + 1
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t, s in kept:
        n = len((t or "").split())
        copies = taken.get((str(d), n, s), 0)
        if copies:
            want[d] = want.get(d, 0) + copies * (1 + len(library.encode(t or "", add_special_tokens=False).ids))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    mine = {}
    for r in got:
        assert 0 < r.length <= 2048
        mine[r.doc_id] = mine.get(r.doc_id, 0) + r.length
    assert mine == want
