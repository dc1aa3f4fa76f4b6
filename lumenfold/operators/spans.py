"""Text spans, concepts, search and report rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as t


#: Passages of one or two words that are broadcast and sought in every text; more are joined by pairs of characters.
SHORT = 10_000


def evidence_exact(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, last_word): passages that occur in documents, after normalising both.

    Inside a text the words of a match are whole but for the first and last, so a passage is found by the
    words after its first, up to four of them, and texts are not paired with every passage.
    """
    d = documents.select("doc_id", t.normalize(F.col("text")).alias("text")).filter("text <> ''")
    p = passages.select("item_id", t.normalize(F.col("text")).alias("needle")).filter("needle <> ''").withColumn("w", F.split("needle", " "))
    p = p.withColumn("n", F.least(F.size("w") - 2, F.lit(4)))
    both = d.select("doc_id", F.lit(None).cast(p.schema["item_id"].dataType).alias("item_id"), F.col("text").alias("needle"), "text").limit(0)
    sizes = sorted(r["n"] for r in p.select(F.greatest("n", F.lit(0)).alias("n")).distinct().collect())  # 0 to 4
    for n in [n for n in sizes if n]:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
        keys = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, n))))
        words = d.withColumn("w", F.split("text", " ")).select("doc_id", F.explode(keys).alias("key"))
        keyed = p.filter(F.col("n") == n).select("item_id", "needle", F.xxhash64(F.slice("w", 2, n)).alias("key"))
        hits = words.join(keyed, "key").select("doc_id", "item_id", "needle").distinct()
        both = both.union(hits.join(d, "doc_id").select("doc_id", "item_id", "needle", "text"))
    if 0 in sizes:
        both = both.union(_short_hits(d, p.filter("n <= 0").select("item_id", "needle", "w")))
    both = both.withColumn("at", F.instr("text", F.col("needle"))).filter("at > 0")
    first = t.word_index(F.col("text"), F.col("at") - 1)
    return both.select("doc_id", "item_id", first.alias("first_word"), (first + F.length("needle") - F.length(F.replace("needle", F.lit(" "), F.lit("")))).alias("last_word"))


def _short_hits(d: DataFrame, short: DataFrame) -> DataFrame:
    """Texts that may hold passages of one or two words, which can be parts of words."""
    if short.count() <= SHORT:
        return d.join(F.broadcast(short.drop("w")), F.expr("instr(text, needle) > 0")).select("doc_id", "item_id", "needle", "text")
    longest = F.when(F.length(F.get("w", F.lit(1))) > F.length(F.get("w", F.lit(0))), F.get("w", F.lit(1))).otherwise(F.get("w", F.lit(0)))
    keyed = short.select("item_id", "needle", F.substring(longest, 1, 2).alias("key"))
    pairs = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.array(F.substring(w, i, F.lit(1)), F.substring(w, i, F.lit(2)))))
    grams = d.select("doc_id", F.explode(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.split("text", " ")), pairs)))).alias("key"))
    hits = grams.join(keyed, "key").select("doc_id", "item_id", "needle").distinct()
    return hits.join(d, "doc_id").select("doc_id", "item_id", "needle", "text")


def _window_hash(n: int):
    return lambda i: F.xxhash64(F.slice("words", i, F.lit(n)))


def evidence_tokens(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """As ``evidence_exact`` on whole words without punctuation and case: the first window that equals the passage."""
    p = passages.select("item_id", t.tokens(F.col("text")).alias("needle")).filter(F.size("needle") > 0)
    p = p.withColumn("n", F.least(F.size("needle"), F.lit(4))).withColumn("key", F.xxhash64(F.slice("needle", F.lit(1), F.col("n"))))
    d = documents.select("doc_id", t.tokens(F.col("text")).alias("words"))
    grams = None
    for n in sorted(r["n"] for r in p.select("n").distinct().collect()):  # 1 to 4
        starts = F.sequence(F.lit(1), F.size("words") - (n - 1))
        keys = F.transform(starts, _window_hash(n))
        g = d.filter(F.size("words") >= n).select("doc_id", F.explode(F.array_distinct(keys)).alias("key"), F.lit(n).alias("n"))
        grams = g if grams is None else grams.union(g)
    if grams is None:
        grams = d.select("doc_id", F.lit(0).cast("long").alias("key"), F.lit(0).alias("n")).limit(0)
    hits = grams.join(p, ["key", "n"]).select("doc_id", "item_id", "needle").distinct().join(d, "doc_id")
    found = hits.withColumn("first_word", t.find_tokens(F.col("words"), F.col("needle"))).filter("first_word >= 0")
    return found.select("doc_id", "item_id", "first_word", (F.col("first_word") + F.size("needle") - 1).alias("last_word"))


def resolve_spans(text: str, spans: list[str]) -> list[tuple[int, int]]:
    """Word spans of evidence texts in order: exact after a moving cursor, else by whole words without
    punctuation from the start; the cursor moves past each hit, and misses are (-1, -1)."""
    norm = re.sub(r"\s+", " ", text).lower().strip()
    words = [re.sub(r"[!-/:-@\[-`{-~]", "", w) for w in norm.split(" ")] if norm else []
    out, cursor = [], 0
    for span in spans:
        needle = re.sub(r"\s+", " ", span).lower().strip()
        at = norm.find(needle, cursor) if needle else -1
        if at >= 0:
            out.append((norm.count(" ", 0, at), norm.count(" ", 0, at + len(needle))))
            cursor = at + len(needle)
            continue
        want = [w for w in (re.sub(r"[!-/:-@\[-`{-~]", "", w) for w in needle.split(" ")) if w]
        hit = next((i for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want), -1) if want else -1
        if hit < 0:
            out.append((-1, -1))
            continue
        last = hit + len(want) - 1
        out.append((hit, last))
        ends = [m.start() for m in re.finditer(" ", norm)] + [len(norm)]
        cursor = ends[last]
    return out


def evidence_ordered(documents: DataFrame, concepts: DataFrame) -> DataFrame:
    """(doc_id, ord, first_word, last_word): each document's concepts resolved in order by ``resolve_spans``."""

    def run(key, d: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(d):
            return pd.DataFrame([], columns=["doc_id", "ord", "first_word", "last_word"])
        c = c.sort_values("ord")
        got = resolve_spans(d["text"].iloc[0] or "", [x or "" for x in c["evidence"]])
        return pd.DataFrame({"doc_id": key[0], "ord": c["ord"].to_numpy(), "first_word": [g[0] for g in got], "last_word": [g[1] for g in got]})

    return documents.select("doc_id", "text").groupBy("doc_id").cogroup(concepts.select("doc_id", "ord", "evidence").groupBy("doc_id")).applyInPandas(run, "doc_id long, ord int, first_word int, last_word int")


_ATTRIBUTES = ("gleason_primary", "gleason_secondary", "percent_involvement")


def merge_concepts(concepts: pd.DataFrame) -> pd.DataFrame:
    """One slide's concepts, in order, folded: a concept joins an earlier one if both are asserted alike, no
    attribute contradicts, and one has attributes the other lacks. Texts are joined by " | ", spans become
    their hull without misses, the flag is or-ed, and a graded concept gives the type."""
    out: list[dict] = []
    for r in concepts.sort_values("ord").to_dict("records"):
        r = {k: (None if not isinstance(v, str) and pd.isna(v) else v) for k, v in r.items()}
        for o in out:
            if o["assertion"] != r["assertion"]:
                continue
            both = [(o[a], r[a]) for a in _ATTRIBUTES]
            if any(x is not None and y is not None and x != y for x, y in both):
                continue
            if not any((x is None) != (y is None) for x, y in both):
                continue
            for a in _ATTRIBUTES:
                o[a] = o[a] if o[a] is not None else r[a]
            o["evidence"] = " | ".join(x for x in (o["evidence"], r["evidence"]) if x)
            o["kind"] = "gleason_grade" if "gleason_grade" in (o["kind"], r["kind"]) else o["kind"]
            hits = [x for x in (o["first_word"], r["first_word"]) if x is not None and x >= 0]
            ends = [x for x in (o["last_word"], r["last_word"]) if x is not None and x >= 0]
            o["first_word"], o["last_word"] = min(hits, default=-1), max(ends, default=-1)
            o["is_global"] = bool(o["is_global"] or r["is_global"])
            break
        else:
            out.append(r)
    return pd.DataFrame(out, columns=concepts.columns)


def concept_merge(concepts: DataFrame, by: str = "slide") -> DataFrame:
    """``merge_concepts`` slide by slide (slide, ord, evidence, kind, assertion, attributes, words, is_global)."""
    return concepts.groupBy(by).applyInPandas(merge_concepts, concepts.schema)


def spans_to_time(concepts: DataFrame, words: DataFrame, by: str = "slide") -> DataFrame:
    """Adds t0 and t1: the start of a span's first word and the end of its last. Misses have none."""
    first = words.select(by, F.col("word_idx").alias("first_word"), F.col("start_ms").alias("t0"))
    last = words.select(by, F.col("word_idx").alias("last_word"), F.col("end_ms").alias("t1"))
    return concepts.join(first, [by, "first_word"], "left").join(last, [by, "last_word"], "left")


def slide_search(slides: DataFrame, annotations: DataFrame, q: str) -> DataFrame:
    """(slide, only_annotation): slides whose label or any annotation contains ``q``, case ignored."""
    hit = annotations.filter(F.contains(F.lower("name"), F.lit(q.lower()))).select("slide").distinct().withColumn("hit", F.lit(True))
    j = slides.join(hit, "slide", "left").withColumn("own", F.contains(F.lower("label"), F.lit(q.lower())))
    return j.filter("own or hit").select("slide", "label", (~F.col("own")).alias("only_annotation"))


def search(rows: DataFrame, column: str, q: str) -> DataFrame:
    return rows.filter(F.contains(F.lower(column), F.lit(q.lower())))


def report_exists(concepts: DataFrame, by: str, kind: str, assertion: str = "present", if_true: str = "Present", if_false: str = "Not identified") -> DataFrame:
    """(by, answer, cited): whether any concept of a kind has the assertion, and the slides that say so."""
    hit = (F.col("kind") == kind) & (F.col("assertion") == assertion)
    any_ = F.coalesce(F.bool_or(hit), F.lit(False))
    return concepts.groupBy(by).agg(F.when(any_, if_true).otherwise(if_false).alias("answer"), F.array_sort(F.collect_set(F.when(hit, F.col("slide")))).alias("cited"))


def classify_text(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Answer of the first rule whose pattern the text contains; null if none."""
    out = F.lit(None).cast("string")
    for pattern, answer in reversed(rules):
        out = F.when(F.lower(text).contains(pattern), answer).otherwise(out)
    return out


def report_classify(annotations: DataFrame, by: str, text: str, rules: list[tuple[str, str]], conflict: str = "Cannot be determined", fallback: str = "Not specified") -> DataFrame:
    """(by, answer): the one answer all annotations give, ``conflict`` if they differ, ``fallback`` if none does."""
    a = annotations.withColumn("_a", classify_text(F.col(text), rules)).groupBy(by).agg(F.count_distinct("_a").alias("n"), F.min("_a").alias("a"))
    return a.select(by, F.when(F.col("n") == 0, fallback).when(F.col("n") == 1, F.col("a")).otherwise(conflict).alias("answer"))


def report_applicable(questions: DataFrame, answers: DataFrame, by: str) -> DataFrame:
    """Questions whose parent (if any) has the answer they depend on. ``questions``: (question, parent, needs)."""
    parent = answers.select(by, F.col("question").alias("parent"), F.col("answer").alias("given"))
    free = questions.filter("parent is null").join(answers.select(by).distinct()).select(by, "question")
    return free.union(questions.filter("parent is not null").join(parent, "parent").filter("given = needs").select(by, "question"))


def delete_annotation(rows: DataFrame, masks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations and masks without those in ``doomed`` (slide, anno_id)."""
    return rows.join(doomed, ["slide", "anno_id"], "left_anti"), masks.join(doomed, ["slide", "anno_id"], "left_anti")


def append_annotations(existing: DataFrame, clicks: DataFrame) -> DataFrame:
    """(slide, anno_id, ...) with the clicks' annotations after the existing ones, ids going on from the largest."""
    last = existing.groupBy("slide").agg(F.max("anno_id").alias("_last"))
    turn = F.row_number().over(Window.partitionBy("slide").orderBy("order"))
    new = clicks.join(last, "slide", "left").withColumn("anno_id", F.coalesce(F.col("_last") + 1, F.lit(0)) + turn - 1)
    return existing.unionByName(new.select(existing.columns))
