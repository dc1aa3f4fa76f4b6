"""Near-duplicate documents by b-bit MinHash.

1. One Arrow pass turns each text into its shingle set, a 128-bit digest of that set, ``PERMS``
   minima, of which ``BITS`` low bits each are packed into a signature, and ``PERMS / ROWS`` band keys.
2. Texts with the same set become one class (a partial aggregate, so a huge group of copies costs
   one row a task). Only classes go on.
3. Bands give candidate buckets. Inside a bucket, packed signatures are compared by bit counts and the
   share of equal fields is corrected for chance collisions (an equal field says little at 4 bits).
   A class asks for its smallest similar partner and for its two most similar ones, never for all pairs;
   asked pairs are confirmed on full sets.
4. A hot bucket (over ``BLOCK`` classes) is first compared in chunks, each with the same few pivots, so most
   of its classes join one component. Only classes of different components are compared further: the largest
   component's with the others', and those with each other, in pairs of blocks. Where even that would copy a
   class over ``WIDE`` times, the bucket is split by groups of fields first: similar signatures differ in at
   most so many fields, so of one group more, outside the bucket's own band, one is equal. No similar pair is
   lost by it. Nothing is asked for here: classes that have a similar one of another component go to step 5.
5. Buckets in which a class had more similar partners than it asked for are closed exactly: the classes
   they hold are grouped, groups are dealt out in pairs of blocks of their full sets (the largest
   component found so far isn't compared with itself), intersections of a pair of blocks are one matrix
   product, and only the links that join components leave the task. So no link is lost to the limit in 3.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, small_batches, spread, table
from .words import hash_words, mix, pieces, shingle_hashes, tidy, utf8, word_spans

PERMS, ROWS, BITS = 96, 4, 4
#: Classes of one bucket that are compared in one piece; larger buckets are hot. Pivots of a hot bucket, about.
BLOCK, PIVOTS = 1024, 32
#: Blocks of a hot bucket outside its largest component; with more, it is split by groups of fields.
WIDE = 24
#: Documents of one class beyond which they are not brought together to learn their component.
MANY = 4096
#: In buckets of more classes a class asks for one most similar partner, not k.
CROWD = 64
#: Rows and shingles of a block whose full sets are compared.
CLOSE_ROWS, CLOSE_SHINGLES = 512, 250_000
_A = mix(np.arange(PERMS, dtype=np.uint64), 101) | np.uint64(1)
_B = mix(np.arange(PERMS, dtype=np.uint64), 102)


def shingle_sets(column, k: int):
    """For each row of a string column: its sorted distinct shingle hashes."""
    raw, offsets = utf8(column)
    for a, b in pieces(offsets):
        part = raw[offsets[a] : offsets[b]]
        starts, lengths, first = word_spans(part, offsets[a : b + 1] - offsets[a])
        h, bounds = shingle_hashes(hash_words(part, starts, lengths), first, k)
        for i in range(b - a):
            yield np.unique(h[bounds[i] : bounds[i + 1]])


def signatures(column, k: int):
    """n_shingles, two digests, packed signature and band keys of each row, as lists."""
    n, d1, d2, packed, bands = [], [], [], [], []
    group: list[np.ndarray] = []

    def flush():
        sizes = np.array([len(x) for x in group])
        full = np.flatnonzero(sizes)
        low = np.full((len(group), PERMS), 0, np.uint64)
        s1 = np.zeros(len(group), np.uint64)
        s2 = np.zeros(len(group), np.uint64)
        if len(full):
            h = np.concatenate(group)
            cut_at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            with np.errstate(over="ignore"):
                for j in range(PERMS):
                    low[full, j] = np.minimum.reduceat(h * _A[j] + _B[j], cut_at)
                s1[full], s2[full] = np.add.reduceat(mix(h, 201), cut_at), np.add.reduceat(mix(h, 202), cut_at)
        fields = (mix(low, 203) & np.uint64((1 << BITS) - 1)).reshape(len(group), -1, 64 // BITS)
        words = np.bitwise_or.reduce(fields << np.arange(0, 64, BITS, dtype=np.uint64), axis=2)
        keys = np.zeros((len(group), PERMS // ROWS), np.uint64)
        for b in range(PERMS // ROWS):
            keys[:, b] = b + 1
            for r in range(ROWS):
                keys[:, b] = mix(keys[:, b] ^ low[:, b * ROWS + r], 300 + b)
        n.append(sizes.astype(np.int64))
        d1.append(s1.view(np.int64))
        d2.append(s2.view(np.int64))
        packed.extend(x.tobytes() for x in words)
        bands.append(keys.view(np.int64))
        group.clear()

    held = 0
    for s in shingle_sets(column, k):
        group.append(s)
        held += len(s) + 1
        if held > 200_000:
            flush()
            held = 0
    if group:
        flush()
    whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return whole(n, np.int64), whole(d1, np.int64), whole(d2, np.int64), packed, (np.concatenate(bands) if bands else np.zeros((0, PERMS // ROWS), np.int64))


@tidy
def _sign(batches, k: int):
    """Rows (doc_id, text, digest) signed."""
    for batch in batches:
        n, d1, d2, packed, bands = signatures(batch.column(1), k)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n), pa.array(d1), pa.array(d2), pa.array(packed, pa.binary()), flat], ["doc_id", "digest", "n_shingles", "d1", "d2", "sig", "bands"])


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of packed signatures (last axis: 64-bit words)."""
    x = a ^ b
    step = 1
    while step < BITS:
        x = x | (x >> np.uint64(step))
        step *= 2
    ones = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    same = 1 - np.bitwise_count(x & ones).sum(axis=-1) / PERMS
    chance = 1 / (1 << BITS)
    return (same - chance) / (1 - chance)


def _similar(run: dict, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates between two sets of rows of a bucket piece, and which pairs are similar and of different components."""
    est = np.concatenate([similarity(run["sig"][left[s : s + 128]][:, None, :], run["sig"][right][None, :, :]) for s in range(0, len(left), 128)])
    return est, (est >= least) & (run["comp"][left][:, None] != run["comp"][right][None, :])


def _sides(run: dict) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of a piece to compare with each other: all with all, or those of one block with the other's."""
    side, rows = run["side"], np.arange(len(run["cls"]))
    if side.max() == side.min():
        return rows, rows, False
    return rows[side == side.min()], rows[side == side.max()], True


def _touching(run: dict, least: float) -> np.ndarray:
    """Rows of a piece that are similar to one of another component."""
    left, right, _ = _sides(run)
    ok = _similar(run, left, right, least)[1]
    out = np.zeros(len(run["cls"]), bool)
    out[left] = ok.any(axis=1)
    out[right] |= ok.any(axis=0)
    return out


def _ask_pivots(run: dict, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs asked for in a chunk: with the smallest similar pivot and the most similar one, or, where none is similar, as in any bucket."""
    rows, pivots = np.flatnonzero(run["side"] == 0), np.flatnonzero(run["side"])
    if not len(pivots) or not len(rows):
        a, b, _ = _ask(run | {"side": np.zeros_like(run["side"])}, least, 1)
        return a, b
    est, ok = _similar(run, rows, pivots, least)
    some = ok.any(axis=1)
    first = np.where(ok, run["cls"][pivots][None, :], np.iinfo(np.int64).max).argmin(axis=1)
    best = np.where(ok, est, -2.0).argmax(axis=1)
    a, b = [rows[some]] * 2, [pivots[first[some]], pivots[best[some]]]
    for part in (rows[~some], pivots):
        if len(part) > 1:
            x, y, _ = _ask({c: v[part] for c, v in run.items()} | {"side": np.zeros(len(part), int)}, least, 1)
            a.append(part[x])
            b.append(part[y])
    return np.concatenate(a), np.concatenate(b)


def _ask(run: dict, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (index, index) that the rows of one bucket piece ask for, and per row whether it held any back."""
    cls = run["cls"]
    left, right, cross = _sides(run)
    est, ok = _similar(run, left, right, least)
    a_out, b_out, held = [], [], np.zeros(len(cls), bool)
    for x, y, ok_, est_ in ((left, right, ok, est), (right, left, ok.T, est.T)) if cross else ((left, right, ok, est),):
        count = ok_.sum(axis=1)
        some = np.flatnonzero(count)
        if not len(some):
            continue
        ok_, est_ = ok_[some], est_[some]
        hub = np.where(ok_, cls[y][None, :], np.iinfo(np.int64).max).argmin(axis=1)
        a_out.append(x[some])
        b_out.append(y[hub])
        take = min(k if len(cls) <= CROWD else 1, len(y))
        score = np.where(ok_, est_, -2.0)
        best = np.argpartition(-score, take - 1, axis=1)[:, :take] if take < len(y) else np.broadcast_to(np.arange(len(y)), score.shape)
        r, c = np.nonzero(np.take_along_axis(ok_, best, 1))
        asked = np.bincount(r, minlength=len(some)) + ~(best == hub[:, None]).any(axis=1)
        held[x[some][count[some] > asked]] = True
        a_out.append(x[some][r])
        b_out.append(y[best[r, c]])
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a_out, b_out))
    return a, b, held


@tidy
def _compare(batches, least: float, k: int):
    """Streams rows sorted by (bkey, bi, bj); a bucket piece is at most two blocks of rows.

    ``k`` 0 asks for nothing and gives (bkey, cls) of the classes that are similar to one of another component.
    """
    names = ["bkey", "bi", "bj", "blk", "cls", "comp"]
    rest = None

    def work(t: dict, final: bool):
        n = len(t["cls"])
        new = np.ones(n, bool)
        new[1:] = (t["bkey"][1:] != t["bkey"][:-1]) | (t["bi"][1:] != t["bi"][:-1]) | (t["bj"][1:] != t["bj"][:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        if not final:
            starts, ends = starts[:-1], ends[:-1]
        done = ends[-1] if len(ends) else 0
        a_all, b_all, h_all = [], [], []
        size = ends - starts
        two = starts[size == 2]  # most buckets: no need for a matrix
        if len(two):
            est = similarity(t["sig"][two], t["sig"][two + 1])
            ok = two[(est >= least) & (t["comp"][two] != t["comp"][two + 1])]
            a_all.append(ok)
            b_all.append(ok + 1)
            if not k:
                h_all += [ok, ok + 1]
        for s, e in zip(starts[size > 2], ends[size > 2]):
            run = {"sig": t["sig"][s:e], "comp": t["comp"][s:e], "cls": t["cls"][s:e], "side": t["blk"][s:e]}
            if not k:
                h_all.append(np.flatnonzero(_touching(run, least)) + s)
                continue
            if t["bj"][s] < 0:
                a, b = _ask_pivots(run, least)
                held = np.zeros(0, bool)
            else:
                a, b, held = _ask(run, least, k)
            a_all.append(a + s)
            b_all.append(b + s)
            if held.any():
                h_all.append(np.flatnonzero(held) + s)
        a, b, h = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a_all, b_all, h_all))
        if not k:
            out = np.unique(np.stack([t["bkey"][h], t["cls"][h]]), axis=1)
            return out, h[:0], {c: v[done:] for c, v in t.items()}
        ra, rb = t["cls"][a], t["cls"][b]
        out = np.unique(np.stack([np.minimum(ra, rb), np.maximum(ra, rb)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        keys = np.unique(t["bkey"][h])
        return out, keys, {c: v[done:] for c, v in t.items()}

    def batch_out(out, keys):
        a = pa.array(np.concatenate([out[0], keys]))
        b = pa.array(np.concatenate([out[1], np.zeros(len(keys), np.int64)]), mask=np.arange(out.shape[1] + len(keys)) >= out.shape[1])
        return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    for batch in batches:
        t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        t["sig"] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        if rest is not None:
            t = {c: np.concatenate([rest[c], t[c]]) for c in t}
        if len(t["cls"]):
            out, keys, rest = work(t, False)
            if out.shape[1] or len(keys):
                yield batch_out(out, keys)
    if rest is not None and len(rest["cls"]):
        out, keys, _ = work(rest, True)
        yield batch_out(out, keys)


def digests(shingles: np.ndarray) -> tuple[int, int]:
    """The two digests of one set, as ``signatures`` has them."""
    with np.errstate(over="ignore"):
        return tuple(int(np.add.reduce(mix(shingles, salt)).view(np.int64)) for salt in (201, 202))


@tidy
def _sets(batches, k: int):
    """The shingles of rows (cls, d1, d2, text) whose text has these digests, each class once a task."""
    seen: set[int] = set()
    for batch in batches:
        keep, sets = [], []
        for cls, d1, d2, s in zip(*(batch.column(c).to_pylist() for c in ("cls", "d1", "d2")), shingle_sets(batch.column("text"), k)):
            if cls not in seen and digests(s) == (d1, d2):
                seen.add(cls)
                keep.append(cls)
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["cls", "shingles"])


@tidy
def _confirm(batches, percent: int):
    """Rows sorted by (a, salt), the set of ``a`` first (null b): the pairs that have 100 * intersection >= percent * union."""
    key, mine = None, None
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for a, salt, b, x in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")), batch.column("shingles")):
            x = np.frombuffer(x.as_buffer(), np.uint64)
            if (a, salt) != key:
                key, mine = (a, salt), None
            if b is None:
                mine = x.copy()
            elif mine is not None and min(len(x), len(mine)) * 100 >= percent * max(len(x), len(mine)):
                both = len(x) + len(mine) - len(np.union1d(x, mine))
                if 100 * both >= percent * (len(x) + len(mine) - both):
                    out[0].append(a)
                    out[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, slack: float = 0.18) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, digest) for each row of ``docs``; ``digest`` is xxhash64 of its text.

    Two documents link when 100 * |intersection| >= ``percent`` * |union| of their ``k``-word shingle
    sets. ``slack`` is how far the estimate may fall below that before a pair is not even confirmed
    (almost five standard deviations at ``PERMS`` minima).

    Null, empty and wordless texts have no shingles and link with nothing. Texts of fewer than ``k``
    words are one shingle. A row with a null id is kept, has a null component and links with nothing.
    Rows that repeat a document are each returned and share its component; rows that share an id but
    not a text are classed by their own text. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(docs.withColumn("digest", F.xxhash64("text")).mapInArrow(functools.partial(_sign, k=k), "doc_id long, digest long, n_shingles long, d1 long, d2 long, sig binary, bands array<long>"))
    live = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = live.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("times"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    comp = _components(docs, live, classes, k, percent, percent / 100 - slack)
    named = classes.select("cls", "rep", "times", "d1", "d2").join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component")
    many = F.col("times") > MANY
    out = spread(signed.select("doc_id", "digest", "n_shingles", "d1", "d2"), named.filter(many).select("d1", "d2", F.col("component_id").alias("theirs")), ["d1", "d2"], "doc_id")
    few = out.filter("theirs is null").join(named.filter(~many).select("d1", "d2", "component_id"), ["d1", "d2"], "left")
    out = few.select("doc_id", "digest", "n_shingles", "component_id").union(out.filter("theirs is not null").select("doc_id", "digest", "n_shingles", "theirs"))
    own = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "digest").select("doc_id", "n_shingles", "component_id", kept, "digest")


def _components(docs: DataFrame, live: DataFrame, classes: DataFrame, k: int, percent: int, least: float) -> DataFrame:
    """(cls, component) of the classes that link with another."""
    member = classes.select(F.explode("bands").alias("bkey"), "cls")
    sizes = member.groupBy("bkey").agg(F.count("*").alias("n"), F.min("cls").alias("m"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("fp")).filter("n > 1")
    same = sizes.groupBy("n", "m", "fp").agg(F.min("bkey").alias("one"), F.collect_set("bkey").alias("all"))  # bands that hold the same classes: one is enough
    sizes = cut(same.select("n", "one", F.explode("all").alias("bkey")).select("bkey", "n", (F.col("one") == F.col("bkey")).alias("taken")))
    hot = sizes.filter(F.col("n") > BLOCK).select("bkey", "taken", "n")
    crowd = None
    if hot.limit(1).count():
        member = spread(member, hot, "bkey", "cls")
        crowd = cut(member.filter("taken").select("bkey", "cls", "n"))
        member = member.filter("taken is null").select("bkey", "cls")
    small = cut(member.join(sizes.filter(F.col("taken") & (F.col("n") <= BLOCK)).select("bkey"), "bkey"))
    runs = small.select("bkey", *[F.lit(0).alias(c) for c in ("bi", "bj", "blk")], "cls")
    if crowd is not None:
        runs = runs.union(_chunks(crowd))
    found = _compared(runs.withColumn("comp", F.col("cls")), classes, least)
    asked = found.filter("b is not null").distinct()
    held = small.join(found.filter("b is null").select(F.col("a").alias("bkey")).distinct(), "bkey", "left_semi")
    need = asked.select("a").union(asked.select("b")).union(held.select("cls"))
    if crowd is not None:
        need = need.union(crowd.select("cls"))
    sets = _sets_of(docs, live, classes.join(need.toDF("cls").distinct(), "cls", "left_semi").select("cls", "rep", "d1", "d2"), k)
    comp = connected_components(_confirmed(asked, sets, percent), "a", "b").withColumnRenamed("node", "cls")
    if crowd is not None:
        held = held.union(_compared(_crossing(crowd, comp, classes, least), classes, least, 0).distinct())
    held = cut(held)
    if not held.limit(1).count():
        return comp
    joined = _close(held, sets, comp, percent)
    if not joined.limit(1).count():
        return comp
    # components that are joined, by their smallest; classes that had no link are components of their own
    ends = joined.select(F.col("a").alias("cls")).union(joined.select("b")).distinct().join(comp, "cls", "left").select("cls", F.coalesce("component", "cls").alias("of"))
    edges = joined.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select("x", "y")
    over = connected_components(edges, "x", "y").withColumnRenamed("component", "last")
    comp = comp.union(ends.join(comp, "cls", "left_anti").select("cls", F.col("of").alias("component")))
    return spread(comp, over.withColumnRenamed("node", "component"), "component", "cls").select("cls", F.coalesce("last", "component").alias("component"))


def _chunks(crowd: DataFrame) -> DataFrame:
    """Hot buckets in chunks of about ``BLOCK`` classes, each with the bucket's pivots."""
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), chunks).cast("int")
    pivot = F.pmod(F.xxhash64("cls", F.lit(7)), F.col("n")) < PIVOTS
    at = F.explode(F.when(pivot, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(own))).alias("bi")
    return crowd.select("bkey", at, F.lit(-1).alias("bj"), pivot.cast("int").alias("blk"), "cls")


def _crossing(crowd: DataFrame, comp: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(bkey, bi, bj, blk, cls, comp): hot buckets in pairs of blocks that bring classes of different components
    together, all that are similar by ``least``."""
    m = crowd.join(comp, "cls", "left").select("bkey", "cls", F.coalesce("component", "cls").alias("comp"))
    m = cut(m)
    sized = cut(spread(m, _shape(m, F.lit(1), BLOCK), "bkey", "cls").filter("main is not null"))
    runs = _in_blocks(sized.filter(F.col("others") <= WIDE))
    wide = sized.filter(F.col("others") > WIDE)
    if not wide.limit(1).count():
        return runs
    signed = wide.select("bkey", "cls", "comp").join(classes.select("cls", "sig", "bands"), "cls")
    sub = cut(signed.mapInArrow(functools.partial(_split, least=least), "bkey long, cls long, comp long"))
    return runs.union(_in_blocks(spread(sub, _shape(sub, F.lit(1), BLOCK), "bkey", "cls").filter("main is not null")))


def field_groups(least: float) -> list[list[np.ndarray]]:
    """For each band: groups of the other bands' fields, so many that signatures with a similarity of at least
    ``least`` that share the band are equal in one of them."""
    chance = 1 / (1 << BITS)
    differ = int(np.floor((1 - least) * (1 - chance) * PERMS + 1e-6))
    others = [np.delete(np.arange(PERMS), np.arange(b * ROWS, (b + 1) * ROWS)) for b in range(PERMS // ROWS)]
    return [np.array_split(o, min(differ + 1, len(o))) if differ < len(o) else [o[:0]] for o in others]


def split_keys(bkey: np.ndarray, sig: np.ndarray, bands: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the parts of its bucket ``bkey`` that each row falls in, one for each group of fields."""
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    fields = ((sig[:, :, None] >> shifts) & np.uint64((1 << BITS) - 1)).reshape(len(sig), -1)
    band = (bands == bkey[:, None]).argmax(axis=1)
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b, groups in enumerate(field_groups(least)):
        at = np.flatnonzero(band == b)
        for g, group in enumerate(groups if len(at) else []):
            key = mix(bkey[at].view(np.uint64), 400 + g)
            for f in group:
                key = mix(key ^ fields[at, f], 500)
            rows.append(at)
            keys.append(key.view(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


@tidy
def _split(batches, least: float):
    """Rows (bkey, cls, comp, sig, bands) of wide buckets dealt to the parts that ``split_keys`` names."""
    for batch in batches:
        if not batch.num_rows:
            continue
        t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("bkey", "cls", "comp")}
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        bands = batch.column("bands").flatten().to_numpy().reshape(batch.num_rows, -1)
        at, keys = split_keys(t["bkey"], sig, bands, least)
        for s in range(0, len(at), 200_000):
            part = slice(s, s + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(t["cls"][at[part]]), pa.array(t["comp"][at[part]])], ["bkey", "cls", "comp"])


def _shape(m: DataFrame, weight, most, key: str = "bkey", heavy: int | None = None) -> DataFrame:
    """(key, main, mains, others) of keys with classes of several components: the largest one, and the number of
    blocks of it and of the others, of at most ``most`` rows, and ``heavy`` weight, on average."""
    by = m.groupBy(key, "comp").agg(F.count("*").alias("c"), F.sum(weight).alias("w"))
    top = F.max(F.struct(F.col("c"), (-F.col("comp")).alias("first"), F.col("w")))
    by = by.groupBy(key).agg(top.alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("comps")).filter("comps > 1")
    blocks = lambda c, w: F.ceil(F.greatest(c / most, w / heavy) if heavy else c / most).cast("int")
    return by.select(key, (-F.col("top.first")).alias("main"), blocks(F.col("top.c"), F.col("top.w")).alias("mains"), blocks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("others"))


def _in_blocks(m: DataFrame, key: str = "bkey") -> DataFrame:
    """Pairs of blocks: 0 .. mains - 1 hold the main component, the next ``others`` the rest; no main block meets a main block."""
    main = F.col("comp") == F.col("main")
    blk = F.when(main, F.pmod(F.xxhash64("cls"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("cls"), F.col("others"))).cast("int")
    m = m.withColumn("blk", blk).withColumn("other", F.explode(F.sequence(F.when(main, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)))
    return m.select(key, F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "cls", "comp")


def _compared(runs: DataFrame, classes: DataFrame, least: float, k: int = 2) -> DataFrame:
    """(a, b) pairs asked for, and (bkey, null) for buckets in which some class had more similar partners."""
    m = runs.join(classes.select("cls", "sig"), "cls").select("bkey", "bi", "bj", "blk", "cls", "comp", "sig")
    dealt = m.repartition("bkey", "bi", "bj").sortWithinPartitions("bkey", "bi", "bj")
    return cut(dealt.mapInArrow(functools.partial(_compare, least=least, k=k), "a long, b long"))


def _sets_of(docs: DataFrame, live: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """(cls, shingles): one row a class of ``need`` (cls, rep, d1, d2), from any document that has its id and its set."""
    twice = cut(live.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("rep"), F.lit(True).alias("again")))
    need = need.join(twice, "rep", "left").hint("shuffle_hash")
    texts = docs.join(need, docs["doc_id"] == need["rep"]).select("cls", "d1", "d2", "text", "again")
    every = texts.filter("again is null").mapInArrow(functools.partial(_sets, k=k), "cls long, shingles binary")
    if twice.limit(1).count():
        # ids that repeat: tasks have dropped what they had already, this drops the rest
        every = every.union(texts.filter("again").mapInArrow(functools.partial(_sets, k=k), "cls long, shingles binary").dropDuplicates(["cls"]))
    return cut(every)


def _confirmed(asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``asked`` that link. A set that many ask for goes once to every ``CLOSE_ROWS`` of them."""
    ends = asked.select("a").union(asked.select("b")).groupBy("a").agg(F.ceil(F.count("*") / CLOSE_ROWS).cast("int").alias("salts"))
    busy = cut(ends.filter("salts > 1"))
    salted = spread(spread(asked, busy, "a", "b"), busy.toDF("b", "others"), "b", "a")
    salts, others = F.coalesce("salts", F.lit(1)), F.coalesce("others", F.lit(1))
    # ``a`` becomes the end that more ask for
    salted = salted.select(F.when(salts >= others, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(salts >= others, F.col("b")).otherwise(F.col("a")).alias("b"), F.greatest(salts, others).alias("salts"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    theirs = salted.select("a", "salt", "b").join(sets.select(F.col("cls").alias("b"), "shingles"), "b").select("a", "salt", "b", "shingles")
    own = salted.select("a", "salt").distinct().join(sets.select(F.col("cls").alias("a"), "shingles"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    dealt = own.union(theirs).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return cut(dealt.mapInArrow(functools.partial(_confirm, percent=percent), "a long, b long"))


def _close(held: DataFrame, sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Links that join components among the classes of ``held`` (bkey, cls) buckets."""
    hub = held.groupBy("bkey").agg(F.min("cls").alias("hub"))
    group = connected_components(spread(held, hub, "bkey", "cls").select("cls", "hub").distinct(), "cls", "hub").toDF("cls", "grp")
    m = group.join(comp, "cls", "left").select("grp", "cls", F.coalesce("component", "cls").alias("comp"))
    m = cut(m.join(sets.select("cls", (F.octet_length("shingles") / 8).alias("size")), "cls"))
    m = spread(m, _shape(m, F.col("size"), CLOSE_ROWS, "grp", CLOSE_SHINGLES), "grp", "cls").filter("main is not null")
    m = _in_blocks(m, "grp").join(sets, "cls")
    dealt = m.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj").select("grp", "bi", "bj", "cls", "comp", "shingles")
    return cut(dealt.mapInArrow(functools.partial(_closed, percent=percent), "a long, b long"))


def joins(rep: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the sets, by exact intersections, that join their components (a forest)."""
    size = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    row, at = row[shared[at]], column[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(at, [c, c + 4096])
        held = np.zeros((len(sets), 4096), np.float32)
        held[row[lo:hi], at[lo:hi] - c] = 1
        both += held @ held.T
    both = both.astype(np.int64)
    x, y = np.nonzero((100 * both >= percent * (size[:, None] + size[None, :] - both)) & (comp[:, None] < comp[None, :]))
    if not len(x):
        return []
    pairs, first = np.unique(np.stack([comp[x], comp[y]], 1), axis=0, return_index=True)
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    out = []
    for (p, q), i in zip(pairs.tolist(), first):
        p, q = find(p), find(q)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(rep[x[i]]), int(rep[y[i]])))
    return out


@tidy
def _closed(batches, percent: int):
    """Runs ``joins`` on each (grp, bi, bj) of rows sorted by these."""
    rows: list = []
    key = None

    def done():
        if len({r[1] for r in rows}) < 2:
            return []
        return joins(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], percent)

    for batch in batches:
        out = []
        keys = list(zip(*[batch.column(c).to_pylist() for c in ("grp", "bi", "bj")]))
        for k, rep, comp, s in zip(keys, batch.column("cls").to_pylist(), batch.column("comp").to_pylist(), batch.column("shingles").to_pylist()):
            if k != key:
                out += done()
                rows, key = [], k
            rows.append((rep, comp, np.frombuffer(s, np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
    out = done()
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).drop("digest")
