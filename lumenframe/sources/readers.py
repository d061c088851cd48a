"""File readers: declared schemas, no inference on large files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", na: str | None = None,
             header: bool = True) -> DataFrame:
    """Delimited file with a header; broken lines land in ``_corrupt_record`` if the schema names it."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "PERMISSIVE")
    if na is not None:
        reader = reader.option("nullValue", na)
    return reader.csv(path)


def read_tsv_log(spark: SparkSession, path: str) -> DataFrame:
    """Experiment log: tab separated, ``-`` means missing."""
    return read_csv(spark, path, EXPERIMENT_LOG, sep="\t", na="-")


EXPERIMENT_LOG = (
    "id string, metric string, val_score double, test_score double, memory_mb double, "
    "status string, description string"
)


def read_parquet(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """One file, a folder or a glob; the filter reaches the scan."""
    df = spark.read.parquet(path)
    return df if where is None else df.where(where)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_xml_pairs(spark: SparkSession, path: str, row_tag: str = "qa_pair",
                   fields: tuple[str, ...] = ("question", "answer")) -> DataFrame:
    """Question and answer elements as trimmed strings (an answer ``007`` stays ``007``)."""
    schema = ", ".join(f"{f} string" for f in fields)
    df = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return df.select(*[F.trim(f).alias(f) for f in fields])


ARFF_TYPES = {"numeric": "double", "real": "double", "integer": "bigint", "string": "string", "date": "string"}


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Comments start with ``%``; ``@ATTRIBUTE`` lines give the columns; quoted CSV after ``@DATA``."""
    lines = spark.read.text(path)
    bare = F.trim("value")
    attribute = r"(?i)^@attribute\s+(?:'([^']+)'|\"([^\"]+)\"|(\S+))\s+(.+)$"
    head = lines.where(bare.rlike(r"(?i)^@attribute\s"))
    named = head.select(
        F.monotonically_increasing_id().alias("pos"),
        F.concat(F.regexp_extract(bare, attribute, 1), F.regexp_extract(bare, attribute, 2),
                 F.regexp_extract(bare, attribute, 3)).alias("name"),
        F.lower(F.trim(F.regexp_extract(bare, attribute, 4))).alias("type"),
    )
    columns = named.orderBy("pos").collect()  # one entry per column of the file
    schema = ", ".join(f"`{c['name']}` {ARFF_TYPES.get(c['type'].split()[0], 'string')}" for c in columns)
    data = lines.where((bare != "") & ~bare.startswith("%") & ~bare.startswith("@"))
    row = F.from_csv("value", schema, {"nullValue": "?", "quote": "'", "ignoreLeadingWhiteSpace": "true"})
    return data.select(row.alias("r")).select("r.*")


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole files decoded as UTF-8, else Latin-1, with length and line count."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.decode("content", "UTF-8")).otherwise(
        F.decode("content", "ISO-8859-1"))
    return raw.select("path", text.alias("text")).select(
        "path", "text", F.length("text").alias("n_chars"), F.size(F.split("text", "\n")).alias("n_lines"))


# Substring of the path, MIME part, type. First match wins.
DOC_TYPES = (
    ((".pdf",), ("application/pdf",), "pdf"),
    ((".docx",), ("application/vnd.openxmlformats",), "docx"),
    ((".txt",), ("text/plain",), "txt"),
    ((".md",), ("text/markdown",), "markdown"),
    ((".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp"), (), "image"),
    ((), ("image/",), "image"),
)


def detect_doc_type(path: Column, content_type: Column | None = None) -> Column:
    low = F.lower(path)
    mime = F.coalesce(content_type, F.lit("")) if content_type is not None else F.lit("")
    out = None
    for parts, mimes, name in DOC_TYPES:
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        for m in mimes:
            hit = hit | mime.contains(m)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")
