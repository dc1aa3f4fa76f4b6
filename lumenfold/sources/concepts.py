"""Concept spans and report templates as JSON; configuration as XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPAN = (
    "evidence_text string, concept_text string, concept_type string, assertion string, slide_level boolean, span_start_i int, span_end_i int, start_ms bigint, end_ms bigint, "
    "start_frame_idx bigint, end_frame_idx bigint, attributes struct<gleason_primary:int,gleason_secondary:int,percent_involvement:double>"
)


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """One row a span, in file order (``ord``), with the file it came from."""
    j = spark.read.schema(f"concept_spans array<struct<{_fields()}>>").json(path, multiLine=True).withColumn("file", F.input_file_name())
    return j.select("file", F.posexplode("concept_spans").alias("ord", "s")).select("file", "ord", "s.*")


def _columns() -> list[tuple[str, str]]:
    """Names and types of a span's fields."""
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(SPAN)]


def _fields() -> str:
    return ",".join(f"{name}:{kind}" for name, kind in _columns())


def concepts_json(spans: DataFrame, by: str, order: str) -> DataFrame:
    """(by, json): each group's spans as one document."""
    item = F.struct(order, F.struct(*[name for name, _ in _columns()]).alias("s"))
    return spans.groupBy(by).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]).alias("concept_spans"))).alias("json"))


def parse_model_reply(replies: DataFrame, column: str) -> DataFrame:
    """Spans from a language model's reply: the JSON object in it, with or without a fence around it."""
    body = F.regexp_extract(F.col(column), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, f"struct<concept_spans:array<struct<{_fields()}>>>")
    return replies.withColumn("_p", parsed).select("*", F.explode("_p.concept_spans").alias("_s")).drop("_p").select(*replies.columns, "_s.*")


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """(id, prompt, rule_type, parent, needs, allowed) of a report template's questions; answers may be texts or objects."""
    schema = "questions array<struct<id:string,prompt:string,question:string,rule:struct<type:string>,applicability:struct<question:string,equals:string>,allowed_answers:array<string>>>"
    j = spark.read.schema(schema).json(path, multiLine=True)
    q = j.select(F.explode("questions").alias("q"))
    allowed = F.transform("q.allowed_answers", lambda a: F.coalesce(F.get_json_object(a, "$.value"), F.get_json_object(a, "$.label"), a))
    return q.select("q.id", F.coalesce("q.prompt", "q.question").alias("prompt"), F.col("q.rule.type").alias("rule_type"), F.col("q.applicability.question").alias("parent"), F.col("q.applicability.equals").alias("needs"), allowed.alias("allowed"))


@dataclass
class Config:
    """Processing options with their defaults. Unknown elements are collected, not refused."""

    threads: int = 4
    detector: str = "orb"
    features: int = 500
    scale: float = 0.25
    crop: float = 0.5
    matcher_ratio: float = 0.75
    width: int = 6464
    height: int = 4852
    input_list: str = ""
    output: str = ""
    unknown: list[str] = field(default_factory=list)


_KEYS = {
    "threads": ("threads", int, lambda v: v > 0),
    "detector": ("detector", str, lambda v: v in ("orb", "sift", "surf", "akaze", "brisk", "gftt")),
    "num_features": ("features", int, lambda v: v > 0),
    "scale": ("scale", float, lambda v: 0 < v <= 1),
    "crop": ("crop", float, lambda v: 0 < v <= 1),
    "ratio": ("matcher_ratio", float, lambda v: 0 < v <= 1),
    "width": ("width", int, lambda v: v > 0),
    "height": ("height", int, lambda v: v > 0),
    "input_list": ("input_list", str, lambda v: True),
    "output": ("output", str, lambda v: True),
}


def parse_config(text: str) -> Config:
    """Raises ValueError, saying where, for malformed XML and for values out of range."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"malformed configuration: {e}") from e
    out = Config()
    for node in root.iter():
        if len(node):
            continue
        if node.tag not in _KEYS:
            out.unknown.append(node.tag)
            continue
        name, kind, ok = _KEYS[node.tag]
        try:
            value = kind((node.text or "").strip())
        except ValueError as e:
            raise ValueError(f"{node.tag}: {node.text!r} is not a {kind.__name__}") from e
        if not ok(value):
            raise ValueError(f"{node.tag}: {value!r} is out of range")
        setattr(out, name, value)
    return out
