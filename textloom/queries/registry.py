"""Where queries register, and the tables and SQL that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import lexical
from textloom.sources.scratch import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, pos, term)"""
    return docs(spark, d).select("doc_id", F.posexplode(T.words("text")).alias("pos", "term"))


#: Terms that reach every rule of the filters; the documents are invented prose.
FIXTURE = [
    "implementation", "configuration", "simplicity", "dependencies", "services", "bus", "APIs", "ll", "n't", "'ve", "_add", "__init__", "3.14", "42", "www", "chapter",
    "self", "API gateway", "api-gateway", "John Ousterhout", "clean code", "microservice architecture", "Copyright 2020", "Robert C. Martin", "user_id", "k8s-cluster",
    " x ", "http", "2nd", "data", "split", "x", "kubernetes", "Kubernetes", "processing", "complexity", "packt", "safari", "Figure 3", "good", "many people", "email",
    "def main", "a -> b", "string list", "All Rights Reserved", "models", "class", "use case", "json_schema", "the end", "API Gateway",
]


def literals(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def terms(spark: SparkSession, d: str) -> DataFrame:
    """(term): all distinct words of the documents, and FIXTURE. They are written once: a filter that follows would else be pushed down to every word of every text, and each use would read the texts again."""
    fixture = spark.createDataFrame([(t,) for t in FIXTURE], "term string")
    return materialize(spark, lexical.word_counts(docs(spark, d)).select("term").unionByName(fixture).distinct())


WORDS = "regexp_extract_all(lower(text), '[a-z0-9_]{2,}')"
TOKENS_SQL = f"tok AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {WORDS} AS w FROM documents))"
TERMS_SQL = f"{TOKENS_SQL}, terms AS (SELECT DISTINCT term FROM tok UNION SELECT unnest([{literals(FIXTURE)}]))"
#: Words between white space.
SPLIT = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


def split(c: str) -> str:
    return SPLIT.format(c)


BM25 = f"""dw AS (SELECT doc_id, {split('lower(text)')} AS w FROM documents), tokb AS (SELECT doc_id, unnest(w) AS term FROM dw), ln AS (SELECT doc_id, len(w) AS l FROM dw), st AS (SELECT count(*) AS n, avg(l) AS a FROM ln),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tokb GROUP BY ALL), q AS (SELECT item_id AS query_id, unnest(list_distinct({split('lower(text)')})) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN ln USING (doc_id), st GROUP BY ALL)"""


#: Documents made of parts with diagrams in them, as the generated prose has none.
PART_LINES_SQL = """SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'Figure 1.' || p_size || ': ' || p_name || chr(10) || p_type WHEN 1 THEN p_name || chr(10) || '+----+' || chr(10) || '| ab |' || chr(10) || '+----+' || chr(10) || p_type
 WHEN 2 THEN 'Architecture Diagram' || chr(10) || '-----' || chr(10) || p_type || chr(10) || 'diagram 2 - ' || p_name ELSE chr(10) || '|--|' || chr(10) || '|  |' || chr(10) || p_name END AS text FROM part"""


def PART_LINES(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    k = F.col("p_partkey") % 4
    n = F.lit("\n")
    text = (
        F.when(k == 0, F.concat(F.lit("Figure 1."), F.col("p_size").cast("string"), F.lit(": "), "p_name", n, "p_type"))
        .when(k == 1, F.concat("p_name", F.lit("\n+----+\n| ab |\n+----+\n"), "p_type"))
        .when(k == 2, F.concat(F.lit("Architecture Diagram\n-----\n"), "p_type", F.lit("\ndiagram 2 - "), "p_name"))
        .otherwise(F.concat(F.lit("\n|--|\n|  |\n"), "p_name"))
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
