"""Readers and writers: explicit schemas, corrupt rows kept apart, one exploded dimension table for each nested file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TAXONOMY = (
    "domains MAP<STRING,STRUCT<description:STRING,primary_keywords:ARRAY<STRING>,domain_keywords:ARRAY<STRING>,min_domain_matches:INT,tier_whitelist:ARRAY<STRING>,"
    "score_adjustments:MAP<STRING,DOUBLE>>>, tiers MAP<STRING,STRUCT<priority:INT,name:STRING,description:STRING,concepts:ARRAY<STRING>>>"
)
CHAPTER = "STRUCT<chapter_number:INT,title:STRING,summary:STRING,content:STRING,keywords:ARRAY<STRING>,concepts:ARRAY<STRING>,similar_chapters:ARRAY<STRUCT<book:STRING,chapter:INT,title:STRING,score:DOUBLE>>,code_snippets:ARRAY<STRING>>"
BOOK = f"metadata STRUCT<title:STRING>, chapters ARRAY<{CHAPTER}>"
PAIR = "anchor STRING, positive STRING, negative STRING, score DOUBLE"
CODE_PAIR = "anchor STRING, positive STRING, negative STRING, concept STRING"
METADATA = "title STRING, keywords ARRAY<STRING>, concepts ARRAY<STRING>, start_page INT, end_page INT"
AUDIT = ["Concept", "Domain", "Occurrences", "Books", "Chapters", "Sample_Keywords", "Keep"]


def _whole_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _corrupt_record STRING").option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("_corrupt_record is null").drop("_corrupt_record")


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value fields) of files that are one object: each of its entries, keys in lower case."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"MAP<STRING,{value}>")).alias("key", "v")).where("v is not null").select(F.lower("key").alias("key"), "v.*")


def alias_file(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical_term, classification); entries without a canonical term, such as a file's own metadata, go."""
    return json_map(spark, path, "STRUCT<canonical_term:STRING,classification:STRING>").where("canonical_term is not null").withColumnRenamed("key", "alias")


def dictionary_file(spark: SparkSession, path: str) -> DataFrame:
    """(term, kind) of a file with lists of keywords and concepts."""
    df = _whole_json(spark, path, "keywords ARRAY<STRING>, concepts ARRAY<STRING>")
    parts = [df.select(F.explode(c).alias("term"), F.lit(k).alias("kind")) for c, k in (("keywords", "keyword"), ("concepts", "concept"))]
    return parts[0].unionByName(parts[1]).select(F.trim(F.lower("term")).alias("term"), "kind").distinct()


def noise_file(spark: SparkSession, path: str) -> DataFrame:
    """(term, category, priority) of a YAML file of lists; terms are text even where YAML would make them booleans."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), "value").where("value rlike '^([a-z_]+:|\\\\s*- )'")
    heading = F.regexp_extract("value", r"^([a-z_]+):", 1)
    in_order = Window.orderBy("n")  # one small file
    x = rows.withColumn("category", F.last(F.nullif(heading, F.lit("")), True).over(in_order)).withColumn("priority", F.sum((heading != "").cast("int")).over(in_order))
    return x.where("value rlike '^\\\\s*- '").select(F.lower(F.trim(F.regexp_replace("value", r"^\s*-\s*[\"']?|[\"']?\s*$", ""))).alias("term"), "category", "priority")


def stopword_file(spark: SparkSession, path: str) -> DataFrame:
    """(term): all lists of a file of lists, in lower case."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "MAP<STRING,ARRAY<STRING>>")).alias("k", "v")).select(F.explode("v").alias("v")).select(F.lower("v").alias("term")).distinct()


def taxonomy_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(domain, keyword, kind) and (domain, min_matches, boost, penalty, tier)."""
    d = _whole_json(spark, path, TAXONOMY).select(F.explode("domains").alias("domain", "x"))
    both = [d.select("domain", F.explode(f"x.{k}_keywords").alias("keyword"), F.lit(k).alias("kind")) for k in ("primary", "domain")]
    adjust = lambda name, default: F.coalesce(F.try_element_at("x.score_adjustments", F.lit(name)), F.lit(default))
    dims = d.select("domain", F.coalesce("x.min_domain_matches", F.lit(1)).alias("min_matches"), adjust("domain_keyword_present", 0.1).alias("boost"), adjust("primary_only_no_domain", 0.0).alias("penalty"), F.try_element_at("x.tier_whitelist", F.lit(1)).alias("tier"))
    return both[0].unionByName(both[1]), dims


def books(spark: SparkSession, path: str) -> DataFrame:
    """(book, chapter fields) of a directory of books; a book without a title is named by its file."""
    df = _whole_json(spark, path, BOOK).withColumn("_f", F.input_file_name())
    stem = F.regexp_extract("_f", r"([^/]+?)(\.[^./]*)?$", 1)
    return df.select(F.coalesce(F.nullif("metadata.title", F.lit("")), stem).alias("book"), F.explode("chapters").alias("c")).select("book", "c.*")


def chapter_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term): keywords and concepts of all metadata files, of those equal but for case the first in sorted order."""
    df = spark.read.schema(METADATA).json(path)
    terms = df.select(F.explode(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.coalesce("concepts", F.array().cast("array<string>")))).alias("term"))
    return terms.groupBy(F.lower("term").alias("k")).agg(F.min("term").alias("term")).select("term")


def pairs(spark: SparkSession, path: str, code: bool = False) -> DataFrame:
    """Training pairs, one JSON object a line; blank lines and code pairs without anchor or positive go."""
    df = spark.read.schema(CODE_PAIR if code else PAIR).json(path)
    return df.where("anchor is not null and positive is not null") if code else df.where("anchor is not null")


def write_pairs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """One row a document and call, with term lists and their sizes; appends."""
    lists = [c for c, t in df.dtypes if t == "array<string>"]
    df.select("*", *[F.size(c).alias(f"{c}_count") for c in lists], F.current_timestamp().alias("timestamp")).write.mode("append").json(path)


def write_audit(df: DataFrame, path: str) -> None:
    df.toDF(*AUDIT).write.mode("overwrite").option("header", True).csv(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("Concept STRING, Domain STRING, Occurrences BIGINT, Books BIGINT, Chapters BIGINT, Sample_Keywords STRING, Keep STRING").csv(path)


def save_concepts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_concepts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What save_concepts wrote; an empty table if there is none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    return spark.read.schema(schema).json(path) if exists else spark.createDataFrame([], schema)


def book_of_file(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
