"""Merkle fixity audit of WARC archives.

A record is hashed as the bytes that the archive holds for it: WARC/1.1 head, HTTP head and body. The records
of ``LEAF`` consecutive ids are one leaf, an ordered range of the archive's offsets; ``FANOUT`` nodes have one
parent. A node's hash covers, for each child in order, where it begins inside the node, how many bytes it
holds and its hash; so a record that moves, grows or vanishes changes the nodes above it and no others. An id's
records are summarised by fixed-size aggregates first, so one id with any number of records costs one row a
task. Replicas compare their roots and go down only into children of nodes that differ; records are compared
only in differing leaves.

``write_archive`` and ``read_archive`` keep the records in segments, one a range of ids, and give each
record's byte offset and length. The tests hold their bytes and offsets against those that the audit hashes.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

LEAF, FANOUT, SEGMENT = 64, 16, 1024


NO_DATE = "1970-01-01T00:00:00Z"
_CRLF = "\r\n"
#: The fixed text of a record, between its values.
HEAD = (f"WARC/1.1{_CRLF}WARC-Type: response{_CRLF}WARC-Record-ID: <urn:record:", f">{_CRLF}WARC-Date: ", f"{_CRLF}WARC-Target-URI: ")
NO_URL, RAW_URL, NO_BODY = f"urn:null{_CRLF}X-No-URI: 1", f"{_CRLF}X-Raw-URI-Hex: ", f"{_CRLF}WARC-Truncated: unspecified"
BLOCK_HEAD = f"{_CRLF}Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "
HTTP = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "
_GAP = _CRLF * 2


def warc_record(record_id: Column, url: Column, body: Column, date: Column | None = None) -> Column:
    """A WARC/1.1 response record as text. Null ids, URLs and bodies are told apart from any value by their heads."""
    lines = url.rlike("[\\r\\n]")
    safe = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    uri = F.when(url.isNull(), F.lit(NO_URL)).when(lines, F.concat(safe, F.lit(RAW_URL), F.hex(url.cast("binary")))).otherwise(url)
    text = F.coalesce(body, F.lit(""))
    size = F.octet_length(text).cast("string")
    block = F.octet_length(text) + F.octet_length(size) + len(HTTP + _GAP)
    values = (record_id.cast("string"), F.lit("none")), (F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'") if date is not None else F.lit(NO_DATE), F.lit(NO_DATE)), (uri, F.lit(""))
    head = [x for fixed, (value, other) in zip(HEAD, values) for x in (F.lit(fixed), F.coalesce(value, other))]
    return F.concat(*head, F.when(body.isNull(), F.lit(NO_BODY)).otherwise(F.lit("")), F.lit(BLOCK_HEAD), block.cast("string"), F.lit(_GAP + HTTP), size, F.lit(_GAP), text, F.lit(_GAP))


def _records_of(rows: DataFrame, id_col: str, url_col: str, body_col: str, date_col: str | None) -> DataFrame:
    """(id, record) of each row."""
    record_id = F.col(id_col).cast("long")
    date = F.col(date_col).cast("timestamp") if date_col else None
    return rows.select(record_id.alias("id"), warc_record(record_id, F.col(url_col).cast("string"), F.col(body_col).cast("string"), date).alias("record"))


def manifest(records: DataFrame) -> DataFrame:
    """(id, digest, n, bytes) from (id, record): one row an id. ``digest`` sums up all records of the id, in no order."""
    r = records.select("id", F.sha2(F.col("record").cast("binary"), 256).alias("d"), F.octet_length("record").cast("long").alias("b"))
    both = r.groupBy("id").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.bit_xor(F.xxhash64("d", F.lit(1))).alias("x"), F.sum(F.xxhash64("d", F.lit(2)).cast("decimal(20,0)")).alias("s"), F.sum("b").alias("bytes"))
    many = F.sha2(F.concat_ws("|", "n", "lo", "hi", "x", "s", "bytes").cast("binary"), 256)
    return both.select("id", F.when(F.col("n") == 1, F.col("lo")).otherwise(many).alias("digest"), "n", "bytes")


def _up(nodes: DataFrame, width: int) -> DataFrame:
    """Parents of (node, digest, bytes) rows: the hash of their children in order, each with its range of offsets."""
    kids = F.array_sort(F.collect_list(F.struct("node", "digest", "bytes")))  # at most ``width`` of them
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, k: F.struct(F.concat_ws(",", acc["text"], F.concat_ws(":", k["node"], acc["at"], k["bytes"], k["digest"])).alias("text"), (acc["at"] + k["bytes"]).alias("at"))
    up = nodes.groupBy(F.floor(F.col("node") / width).cast("long").alias("node")).agg(F.aggregate(kids, start, step).alias("all"))
    return up.select("node", F.sha2(F.col("all.text").cast("binary"), 256).alias("digest"), F.col("all.at").alias("bytes"))


def tree(rows: DataFrame, height: int) -> list[DataFrame]:
    """Levels from the leaves up to ``height`` parents above; the last one holds the root."""
    levels = [cut(_up(rows.filter("id is not null").select(F.col("id").alias("node"), "digest", "bytes"), LEAF))]
    for _ in range(height):
        levels.append(cut(_up(levels[-1], FANOUT)))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = a.select("node", F.col("digest").alias("da")), b.select("node", F.col("digest").alias("db"))
    return a.join(b, "node", "full_outer").filter(~F.col("da").eqNullSafe(F.col("db"))).select("node")


def audit(primary: DataFrame, replica: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date_col: str | None = None) -> DataFrame:
    """(id, leaf, status, record_offset, n_primary, n_replica) of every id whose records differ.

    ``status`` is changed, missing (from the replica) or extra (in the replica). ``record_offset`` is the
    byte offset of the id's first record inside its segment of ``SEGMENT`` ids in the primary's archive;
    null for extra ids. Null values differ from empty ones. Rows that repeat a record
    count: dropping one of two is a change. Rows with a null id have no place in the tree; they are
    compared as one group, with a null leaf and offset. Other columns are ignored. Two empty tables give
    no rows.
    """
    a, b = (cut(manifest(_records_of(x, id_col, url_col, body_col, date_col))) for x in (primary, replica))
    ends = a.select("id").union(b.select("id")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    nowhere = [x.filter("id is null") for x in (a, b)]
    if ends["lo"] is None:
        suspects = [a.limit(0), b.limit(0)]
    else:
        low, high, height = ends["lo"] // LEAF, ends["hi"] // LEAF, 0
        while low != high and (low, high) != (-1, 0):  # the sign stays apart: two roots at most
            low, high, height = low // FANOUT, high // FANOUT, height + 1
        ta, tb = tree(a, height), tree(b, height)
        front = _differing(ta[-1], tb[-1])
        for level in range(height - 1, -1, -1):
            parent = front.withColumnRenamed("node", "parent")
            below = [t[level].withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long")).join(parent, "parent", "left_semi") for t in (ta, tb)]
            front = _differing(*below)
        front = cut(front.withColumnRenamed("node", "leaf"))
        suspects = [x.withColumn("leaf", F.floor(F.col("id") / LEAF).cast("long")).join(front, "leaf", "left_semi").drop("leaf") for x in (a, b)]
    x, y = (s.union(n).select("id", "digest", "n") for s, n in zip(suspects, nowhere))
    x, y = x.toDF("id", "dx", "nx"), y.toDF("id2", "dy", "ny")
    both = x.join(y, F.col("id").eqNullSafe(F.col("id2")) & F.col("dx").isNotNull(), "full_outer").filter(~F.col("dx").eqNullSafe(F.col("dy")))
    status = F.when(F.col("dy").isNull(), "missing").when(F.col("dx").isNull(), "extra").otherwise("changed")
    both = both.select(F.coalesce("id", "id2").alias("id"), status.alias("status"), F.coalesce("nx", F.lit(0)).cast("long").alias("n_primary"), F.coalesce("ny", F.lit(0)).cast("long").alias("n_replica"))
    place = Window.partitionBy("seg").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)  # at most SEGMENT ids
    seg = F.floor(F.col("id") / SEGMENT).cast("long")
    touched = both.filter("status <> 'extra' and id is not null").select(seg.alias("seg")).distinct()
    at = a.filter("id is not null").withColumn("seg", seg).join(touched, "seg", "left_semi").select("id", F.coalesce(F.sum("bytes").over(place), F.lit(0)).cast("long").alias("record_offset"))
    return both.join(at, "id", "left").select("id", F.floor(F.col("id") / LEAF).cast("long").alias("leaf"), "status", "record_offset", "n_primary", "n_replica")


# --- archives -------------------------------------------------------------------------------------------


PART = 64 << 20
_HEAD = re.compile(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", re.S)
_HTTP = re.compile(rb"HTTP/1\.1 200 OK\r\n(.*?)\r\n\r\n", re.S)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode("utf-8").split(_CRLF))


def parse_segment(data: bytes):
    """(record id, url, body, offset, length) of each record; a damaged head or length raises ValueError."""
    at = 0
    while at < len(data):
        m = _HEAD.match(data, at)
        if not m:
            raise ValueError(f"no record at byte {at}")
        head = _fields(m[1])
        end = m.end() + int(head["Content-Length"])
        http = _HTTP.match(data, m.end(), end)
        if data[end : end + 4] != b"\r\n\r\n" or not http or http.end() + int(_fields(http[1])["Content-Length"]) != end:
            raise ValueError(f"record at byte {at} does not end at byte {end}")
        own = head["WARC-Record-ID"][len("<urn:record:") : -1]
        url = None if "X-No-URI" in head else bytes.fromhex(head["X-Raw-URI-Hex"]).decode("utf-8") if "X-Raw-URI-Hex" in head else head["WARC-Target-URI"]
        body = None if "WARC-Truncated" in head else data[http.end() : end].decode("utf-8")
        yield None if own == "none" else int(own), url, body, at, end + 4 - at
        at = end + 4


def _segments(batches):
    """Parts of segments from (segment, record) rows sorted by segment; a part ends with the record that fills ``PART`` bytes."""
    import pyarrow as pa

    seg, base, data, held = None, 0, [], 0

    def done():
        return pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), pa.array([base], pa.int64()), pa.array([b"".join(data)], pa.binary())], ["segment", "base", "content"])

    for batch in batches:
        for s, record in zip(batch.column("segment").to_pylist(), batch.column("record").to_pylist()):
            if data and (s != seg or held >= PART):
                yield done()
                base = base + held if s == seg else 0
                data, held = [], 0
            seg = s
            data.append(record.encode("utf-8"))
            held += len(data[-1])
    if data:
        yield done()


def write_archive(rows: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date_col: str | None = None) -> None:
    """Parts of segments (segment, base, content) as Parquet at ``path``; ``base`` is a part's offset in its segment.

    Every row is stored. Rows with a null id have segments of their own, below all others, by a hash of their record.
    """
    r = _records_of(rows, id_col, url_col, body_col, date_col)
    spare = max(1, -(-r.filter("id is null").count() // SEGMENT))
    alone = F.lit(-(1 << 62)) + F.pmod(F.xxhash64("record"), F.lit(spare))
    r = r.withColumn("segment", F.coalesce(F.floor(F.col("id") / SEGMENT).cast("long"), alone))
    r = r.repartition("segment").sortWithinPartitions("segment", "id", F.sha2(F.col("record").cast("binary"), 256))
    r.select("segment", "record").mapInArrow(_segments, "segment long, base long, content binary").write.parquet(path)


def _records(batches):
    import pyarrow as pa

    kinds = {"segment": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "html": pa.string(), "record_offset": pa.int64(), "record_bytes": pa.int64()}
    for batch in batches:
        for s, base, content in zip(*(batch.column(c).to_pylist() for c in ("segment", "base", "content"))):
            rows = [(s, i, url, body, base + at, n) for i, url, body, at, n in parse_segment(content)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).mapInArrow(_records, "segment long, page_id long, url string, html string, record_offset long, record_bytes long")


# --- query ----------------------------------------------------------------------------------------------


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known faults: some bodies altered, some records gone, some that the primary lacks."""
    p = pages.select("page_id", "url", "html")
    kept = p.filter(F.coalesce(F.pmod("page_id", F.lit(499)) != 17, F.lit(True)))
    bad = F.pmod("page_id", F.lit(97)) == 5
    changed = kept.withColumn("html", F.when(bad, F.concat(F.lit(" "), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))
    extra = p.filter(F.pmod("page_id", F.lit(997)) == 3).withColumn("page_id", -F.col("page_id") - 1)
    return changed.union(extra)


def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audit(pages, damaged(pages)).withColumnRenamed("id", "page_id")


_SIZE = "strlen(coalesce(html, ''))"
_BLOCK = f"({_SIZE} + strlen(CAST({_SIZE} AS VARCHAR)) + {len(HTTP + _GAP)})"
OP1_SQL = f"""
WITH p AS (
  SELECT page_id, url, html, CAST(floor(page_id / 1024) AS BIGINT) AS seg,
         {len("".join(HEAD) + NO_DATE + BLOCK_HEAD + _GAP * 2)} + strlen(CAST(page_id AS VARCHAR))
         + CASE WHEN url IS NULL THEN {len(NO_URL)} ELSE strlen(url) END + CASE WHEN html IS NULL THEN {len(NO_BODY)} ELSE 0 END
         + strlen(CAST({_BLOCK} AS VARCHAR)) + {_BLOCK} AS bytes FROM pages),
placed AS (
  SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY seg ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset FROM p),
gone AS (SELECT page_id, 'missing' AS status, record_offset, 1 AS n_primary, 0 AS n_replica FROM placed WHERE page_id % 499 = 17),
bad AS (SELECT page_id, 'changed' AS status, record_offset, 1 AS n_primary, 1 AS n_replica FROM placed
        WHERE page_id % 97 = 5 AND page_id % 499 <> 17 AND html IS DISTINCT FROM ' ' || substr(html, 2)),
more AS (SELECT -page_id - 1 AS page_id, 'extra' AS status, NULL AS record_offset, 0 AS n_primary, 1 AS n_replica FROM p WHERE page_id % 997 = 3)
SELECT page_id, CAST(floor(page_id / 64) AS BIGINT) AS leaf, status, CAST(record_offset AS BIGINT) AS record_offset,
       CAST(n_primary AS BIGINT) AS n_primary, CAST(n_replica AS BIGINT) AS n_replica
FROM (SELECT * FROM gone UNION ALL SELECT * FROM bad UNION ALL SELECT * FROM more)
"""
