"""Text, concept, search and report queries: a document is a transcript, its source a slide."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import magnification as mag
from lumenfold.functions import text as t
from lumenfold.operators import spans

from .registry import query, table


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


_NORM = "trim(lower(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(f"SELECT doc_id, md5({_NORM}) AS digest, length({_NORM}) AS n FROM documents")
def normalize_text(spark, sf_dir):
    n = t.normalize(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("n"))


@query(f"SELECT doc_id, (length(substr({_NORM}, 1, 100)) - length(replace(substr({_NORM}, 1, 100), ' ', '')))::BIGINT AS word, len(string_split({_NORM}, ' ')) - CASE WHEN {_NORM} LIKE '% ' OR {_NORM} = '' THEN 1 ELSE 0 END AS words FROM documents")
def word_index(spark, sf_dir):
    n = t.normalize(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", t.word_index(n, F.lit(100)).cast("long").alias("word"), F.size(t.split_words(n)).cast("long").alias("words"))




def _bare(x: str) -> str:
    return f"regexp_replace({x}, '[!-/:-@\\[-`{{-~]', '', 'g')"


def _tokens(n: str) -> str:
    return f"chr(10) || array_to_string(list_transform(string_split({n}, ' '), lambda w: {_bare('w')}), chr(10)) || chr(10)"


@query(f"SELECT doc_id, md5(lower({_bare('text')})) AS digest FROM documents")
def strip_punctuation(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(t.strip_punctuation(F.col("text"))).alias("digest"))


_DN = f"d AS (SELECT doc_id, {_NORM} AS t FROM documents), p AS (SELECT item_id, {_NORM} AS n FROM benchmark)"


@query(f"""WITH {_DN}, h AS (SELECT doc_id, item_id, substr(t, 1, strpos(t, n) - 1) AS head, n FROM d JOIN p ON n <> '' AND contains(t, n))
SELECT doc_id, item_id, (length(head) - length(replace(head, ' ', '')))::BIGINT AS first_word, (length(head) - length(replace(head, ' ', '')) + length(n) - length(replace(n, ' ', '')))::BIGINT AS last_word FROM h""")
def evidence_exact(spark, sf_dir):
    e = spans.evidence_exact(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return e.select("doc_id", "item_id", F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"))


@query(f"""WITH {_DN}, dt AS (SELECT doc_id, {_tokens('t')} AS t FROM d), pt AS (SELECT item_id, {_tokens('n')} AS n FROM p WHERE n <> ''),
h AS (SELECT doc_id, item_id, substr(t, 1, strpos(t, n)) AS head, n FROM dt JOIN pt ON contains(t, n))
SELECT doc_id, item_id, (length(head) - length(replace(head, chr(10), '')) - 1)::BIGINT AS first_word, (length(head) - length(replace(head, chr(10), '')) - 1 + length(n) - length(replace(n, chr(10), '')) - 2)::BIGINT AS last_word FROM h""")
def evidence_token(spark, sf_dir):
    e = spans.evidence_tokens(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return e.select("doc_id", "item_id", F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"))


@query()
def evidence_ordered(spark, sf_dir):
    """Two pieces of each document's text, looked for in order in the document."""
    d = documents(spark, sf_dir)
    piece = lambda a, n: F.substring("text", a, n)
    c = d.select("doc_id", F.posexplode(F.array(piece(30, 25), piece(5, 25), F.lit("no such text"))).alias("ord", "evidence"))
    return spans.evidence_ordered(d, c)


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'negative') OR contains(lower(text), 'no ') THEN 'absent' WHEN contains(lower(text), 'positive') OR contains(lower(text), 'present') THEN 'present' END AS assertion, CASE WHEN contains(lower(text), 'gleason') THEN 'gleason_grade' ELSE source END AS kind FROM documents")
def assertion_rule(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", t.assertion(F.col("text")).alias("assertion"), t.concept_type(F.col("text"), F.col("source")).alias("kind"))


def concepts(spark, sf_dir):
    """Conversation turns as concepts, attributes derived from the turn."""
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    return c.select(
        F.col("conv_id").alias("slide"),
        F.col("turn").alias("ord"),
        F.col("text").alias("evidence"),
        F.when(n % 3 == 0, "gleason_grade").otherwise("tumor_presence").alias("kind"),
        F.when(n % 4 == 0, "absent").otherwise("present").alias("assertion"),
        F.when(n % 3 == 0, (n % 3 + 3).cast("double")).alias("gleason_primary"),
        F.when(n % 3 == 0, (n % 2 + 3).cast("double")).alias("gleason_secondary"),
        F.when(n % 3 != 0, (n % 5 * 10).cast("double")).alias("percent_involvement"),
        (n % 50).cast("int").alias("first_word"),
        (n % 50 + 3).cast("int").alias("last_word"),
        (n % 7 == 0).alias("is_global"),
    )


@query()
def concept_merge(spark, sf_dir):
    return spans.concept_merge(concepts(spark, sf_dir))


@query("""WITH w AS (SELECT user_id AS slide, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS word_idx, event_id * 10 AS s, event_id * 10 + 7 AS e FROM events),
c AS (SELECT user_id AS slide, event_id AS c, event_id % 30 AS first_word, event_id % 30 + event_id % 4 AS last_word FROM events)
SELECT c.slide, c, a.s AS t0, b.e AS t1 FROM c LEFT JOIN w a ON a.slide = c.slide AND a.word_idx = first_word LEFT JOIN w b ON b.slide = c.slide AND b.word_idx = last_word""")
def spans_to_time(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = e.select(F.col("user_id").alias("slide"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("word_idx"), (F.col("event_id") * 10).alias("start_ms"), (F.col("event_id") * 10 + 7).alias("end_ms"))
    c = e.select(F.col("user_id").alias("slide"), F.col("event_id").alias("c"), (F.col("event_id") % 30).alias("first_word"), (F.col("event_id") % 30 + F.col("event_id") % 4).alias("last_word"))
    return spans.spans_to_time(c, w).select("slide", "c", "t0", "t1")


def annotations(spark, sf_dir):
    d, lab = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(F.col("source").alias("slide"), F.concat(F.when(F.col("toxic") == 1, "Toxic ").otherwise("Clean "), F.col("lang")).alias("name"), "doc_id", "toxic", "quality")


@query("""WITH s AS (SELECT DISTINCT source AS slide, 'Slide ' || source AS label FROM documents), a AS (SELECT source AS slide, CASE WHEN toxic = 1 THEN 'Toxic ' ELSE 'Clean ' END || lang AS name FROM documents JOIN labels USING (doc_id))
SELECT slide, label, NOT contains(lower(label), 'c1') AS only_annotation FROM s WHERE contains(lower(label), 'c1') OR slide IN (SELECT slide FROM a WHERE contains(lower(name), 'c1'))
UNION ALL SELECT slide, label || '/fr', NOT contains(lower(label), 'xic fr') FROM s WHERE contains(lower(label), 'xic fr') OR slide IN (SELECT slide FROM a WHERE contains(lower(name), 'xic fr'))""")
def slide_search(spark, sf_dir):
    s = documents(spark, sf_dir).select(F.col("source").alias("slide")).distinct().withColumn("label", F.concat(F.lit("Slide "), F.col("slide")))
    a = annotations(spark, sf_dir)
    return spans.slide_search(s, a, "C1").union(spans.slide_search(s, a, "xic FR").withColumn("label", F.concat("label", F.lit("/fr"))))


@query("SELECT doc_id FROM documents WHERE contains(lower(source), 'c1')")
def substring_search(spark, sf_dir):
    return spans.search(documents(spark, sf_dir), "source", "C1").select("doc_id")


@query("""WITH a AS (SELECT d.doc_id, source, toxic FROM documents d JOIN labels USING (doc_id))
SELECT source, CASE WHEN max(toxic) = 1 THEN 'Present' ELSE 'Not identified' END AS answer, coalesce(array_to_string(list_sort(list(DISTINCT doc_id) FILTER (toxic = 1)), ','), '') AS cited FROM a GROUP BY source""")
def report_exists(spark, sf_dir):
    a = annotations(spark, sf_dir).select(F.col("slide").alias("source"), F.col("doc_id").alias("slide"), F.lit("toxic").alias("kind"), F.when(F.col("toxic") == 1, "present").otherwise("absent").alias("assertion"))
    return spans.report_exists(a, "source", "toxic").withColumn("cited", F.array_join(F.col("cited").cast("array<string>"), ","))


@query("""WITH a AS (SELECT o_custkey, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'Nonfocal' WHEN o_orderpriority LIKE '%HIGH%' THEN 'Focal' END AS a FROM orders)
SELECT o_custkey, CASE WHEN count(DISTINCT a) = 0 THEN 'Not specified' WHEN count(DISTINCT a) = 1 THEN min(a) ELSE 'Cannot be determined' END AS answer FROM a GROUP BY 1""")
def report_classify(spark, sf_dir):
    return spans.report_classify(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", [("urgent", "Nonfocal"), ("high", "Focal")])


@query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS given FROM customer) SELECT k, 'size' AS question FROM a UNION ALL SELECT k, 'engine' FROM a WHERE given = 'MACHINERY' UNION ALL SELECT k, 'house' FROM a WHERE given = 'HOUSEHOLD'""")
def report_applicable(spark, sf_dir):
    q = spark.createDataFrame([("size", None, None), ("engine", "segment", "MACHINERY"), ("house", "segment", "HOUSEHOLD")], "question string, parent string, needs string")
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("segment").alias("question"), F.col("c_mktsegment").alias("answer"))
    return spans.report_applicable(q, a, "k")


@query("""WITH a AS (SELECT user_id AS slide, event_id AS anno_id FROM events), d AS (SELECT user_id AS slide, event_id AS anno_id FROM events WHERE event_type = 'error') SELECT slide, anno_id FROM a WHERE (slide, anno_id) NOT IN (SELECT slide, anno_id FROM d)""")
def annotation_delete(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.select(F.col("user_id").alias("slide"), F.col("event_id").alias("anno_id"))
    doomed = e.filter("event_type = 'error'").select(F.col("user_id").alias("slide"), F.col("event_id").alias("anno_id"))
    return spans.delete_annotation(a, a, doomed)[0]


@query("""WITH e AS (SELECT s_nationkey AS slide, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS anno_id, s_name AS name FROM supplier),
n AS (SELECT c_nationkey AS slide, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r, c_name AS name FROM customer)
SELECT slide, anno_id, name FROM e UNION ALL SELECT n.slide, r + coalesce(m + 1, 0), name FROM n LEFT JOIN (SELECT slide, max(anno_id) AS m FROM e GROUP BY 1) USING (slide)""")
def annotation_append(spark, sf_dir):
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier")
    e = s.select(F.col("s_nationkey").alias("slide"), (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).cast("long").alias("anno_id"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("slide"), F.col("c_custkey").alias("order"), F.col("c_name").alias("name"))
    return spans.append_annotations(e, c.withColumn("anno_id", F.lit(None).cast("long")).drop("anno_id"))


@query("""SELECT p_partkey, (p_partkey // 26 + 1)::VARCHAR || chr((65 + p_partkey % 26)::INT) AS name, CASE p_partkey % 6 WHEN 0 THEN '2x' WHEN 1 THEN '4x' WHEN 2 THEN '10x' WHEN 3 THEN '20x' WHEN 4 THEN '40x' END AS label,
 CASE WHEN p_size < 5 THEN 'bad_file' WHEN p_size < 10 THEN 'underexposed' WHEN p_size < 30 THEN 'low_features' ELSE 'good' END AS quality FROM part""")
def labels_and_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    codes = F.array(*[F.lit(c) for c in ("02", "04", "10", "20", "40", "99")])
    name = F.concat(F.lit("frame"), F.col("p_partkey").cast("string"), F.lit("_"), F.get(codes, (F.col("p_partkey") % 6).cast("int")), F.lit(".Raw"))
    return p.select("p_partkey", mag.slide_name(F.col("p_partkey")).alias("name"), mag.label_from_name(name).alias("label"), mag.quality(F.col("p_size") >= 5, F.col("p_size") < 10, F.col("p_size") * 9, 270).alias("quality"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '2x' ELSE '4x' END AS a, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN '2x' ELSE '4x' END AS b FROM part)
SELECT p_partkey, coalesce(a, b) AS effective, a IS NULL OR a IS NOT DISTINCT FROM b AS strict, a IS NULL OR b IS NULL OR a = b AS loose FROM p""")
def label_rules(spark, sf_dir):
    of = lambda c: F.when(F.col(c) % 3 == 1, "2x").when(F.col(c) % 3 == 2, "4x")
    a, b = of("p_partkey"), of("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", mag.effective_label(a, b).alias("effective"), mag.compatible_strict(a, b).alias("strict"), mag.compatible(a, b).alias("loose"))
