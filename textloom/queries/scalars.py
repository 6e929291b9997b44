"""T: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom import vocabulary as V
from textloom.functions import text as T
from textloom.operators import documents
from textloom.operators.phrases import holding
from textloom.queries.registry import PART_LINES, PART_LINES_SQL, TERMS_SQL, TOKENS_SQL, docs, literals, query, split, table, terms, tokens
from textloom.queries.windows import STOP, stem_sql


@query("t01_stem", f"WITH {TERMS_SQL} SELECT term, {stem_sql('term')} AS stem FROM terms")
def t01(spark, d):
    return terms(spark, d).select("term", T.stem("term").alias("stem"))


@query("t02_canonical", f"WITH {TERMS_SQL} SELECT term, regexp_replace(regexp_replace(trim(lower(term)), '[\\s-]+', '_', 'g'), '[^\\w]', '', 'g') AS canonical FROM terms")
def t02(spark, d):
    return terms(spark, d).select("term", T.canonical("term").alias("canonical"))


@query("t03_aliases", f"""WITH {TERMS_SQL}, v AS (SELECT term, trim(lower(term)) AS t FROM terms) SELECT DISTINCT term, unnest([t, CASE WHEN contains(t, ' ') THEN replace(t, ' ', '-') ELSE t END, CASE WHEN contains(t, ' ') THEN replace(t, ' ', '_') ELSE t END, CASE WHEN contains(t, ' ') THEN replace(t, ' ', '') ELSE t END,
 CASE WHEN contains(t, '-') THEN replace(t, '-', ' ') ELSE t END, CASE WHEN contains(t, '-') THEN replace(t, '-', '_') ELSE t END, CASE WHEN contains(t, '_') THEN replace(t, '_', ' ') ELSE t END, CASE WHEN contains(t, '_') THEN replace(t, '_', '-') ELSE t END]) AS alias FROM v""")
def t03(spark, d):
    return terms(spark, d).select("term", F.explode(T.aliases("term")).alias("alias"))


@query("t04_simple_terms", f"WITH q AS (SELECT conv_id, turn, list_filter({split('lower(text)')}, lambda w: length(w) > 2 AND w NOT IN ({literals(V.SIMPLE_STOPWORDS)})) AS w FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS terms FROM q")
def t04(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.simple_terms("text"), " ").alias("terms"))


@query("t05_ngram_candidates", f"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(regexp_replace(text, '[^ -~]+', ' ', 'g'), '\\b[a-zA-Z][a-zA-Z0-9_-]*\\b'), lambda x: length(x) > 1 AND lower(x) NOT IN ({literals(STOP)})) AS w FROM conversations),
c AS (SELECT conv_id, turn, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS c FROM w),
l AS (SELECT conv_id, turn, c, list_transform(c, lambda x: lower(x)) AS lc FROM c) SELECT conv_id, turn, array_to_string(list_filter(c, lambda x, i: list_position(lc, lower(x)) = i), '|') AS candidates FROM l""")
def t05(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.candidates(F.regexp_replace("text", "[^ -~]+", " "), STOP), "|").alias("candidates"))


@query("t06_delimited_terms", f"""WITH x AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~]+', ' ', 'g') AS t FROM conversations), p AS (SELECT conv_id, turn, CASE WHEN contains(t, ',') THEN string_split(t, ',') WHEN contains(t, ';') THEN string_split(t, ';') WHEN contains(t, chr(10)) THEN string_split(t, chr(10))
 WHEN contains(t, '|') THEN string_split(t, '|') WHEN contains(t, '•') THEN string_split(t, '•') WHEN contains(t, '-') THEN string_split(t, '-') WHEN contains(t, ':') THEN string_split(t, ':') END AS parts, t FROM x)
SELECT conv_id, turn, array_to_string(CASE WHEN parts IS NOT NULL THEN list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 1 AND lower(x) NOT IN ({literals(STOP)}))
 ELSE list_filter(regexp_extract_all(t, '\\b[a-zA-Z][a-zA-Z0-9_-]*\\b'), lambda x: length(x) > 2 AND lower(x) NOT IN ({literals(STOP)})) END, '|') AS terms FROM p""")
def t06(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.delimited_terms(F.regexp_replace("text", "[^ -~]+", " "), STOP), "|").alias("terms"))


@query("t07_think_tags", "WITH x AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<think>' || text || '</think> ' || role WHEN 1 THEN role || ' <think>' || text ELSE text END AS t FROM conversations) SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '<think>.*?</think>\\s*', '', 'gs'), '<think>.*$', '', 's'), '^\\s+|\\s+$', '', 'g') AS clean FROM x")
def t07(spark, d):
    k = F.col("turn") % 3
    t = F.when(k == 0, F.concat(F.lit("<think>"), "text", F.lit("</think> "), "role")).when(k == 1, F.concat("role", F.lit(" <think>"), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.without_thoughts(t).alias("clean"))


LINES = "ln AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {})), dens AS (SELECT *, CASE WHEN line = '' THEN 0.0 ELSE (length(line) - length(translate(line, '─│┌┐└┘├┤┬┴┼═║╔╗╚╝╠╣╦╩╬+-|', ''))) / length(line) END AS density FROM ln)"


@query("t08_box_density", f"WITH {LINES.format('documents')} SELECT doc_id, line_no, round(density, 6)::DOUBLE AS density FROM dens")
def t08(spark, d):
    return documents.lines(docs(spark, d)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.round(T.box_density("line"), 6).alias("density"))


@query("t09_labelled_diagrams", f"WITH part_lines AS ({PART_LINES_SQL}), {LINES.format('part_lines')}, hit AS (SELECT doc_id, line_no, line, CASE WHEN regexp_matches(line, '(?i)^\\s*figure\\s+[\\d.]+') THEN 'figure' WHEN regexp_matches(line, '(?i)^\\s*diagram\\s+[\\d.]+') THEN 'diagram' WHEN regexp_matches(line, '(?i)^\\s*architecture\\s+diagram') THEN 'architecture' END AS type FROM ln), lab AS (SELECT *, regexp_extract(line, '(?i)^\\s*((figure|diagram)\\s+[\\d.]+|architecture\\s+diagram)', 1) AS label FROM hit WHERE type IS NOT NULL), cap AS (SELECT *, trim(regexp_replace(substr(trim(line), length(label) + 1), '^\\s*[:\\-]?\\s*', '')) AS c FROM lab) SELECT doc_id, line_no, type, label, CASE WHEN c = '' THEN label ELSE c END AS caption FROM cap")
def t09(spark, d):
    x = documents.labelled_diagrams(PART_LINES(spark, d))
    return x.withColumn("line_no", F.col("line_no").cast("long"))


BLOCKS = f"""{LINES.format('part_lines')}, nb AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS behind FROM dens WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
isl AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM nb WHERE density >= 0.05), blk AS (SELECT doc_id, min(line_no) AS first_line, count(*) AS n_lines, arg_min(before, line_no) AS a, arg_max(behind, line_no) AS b FROM isl GROUP BY doc_id, g HAVING count(*) >= 2)"""


@query("t10_art_blocks", f"WITH part_lines AS ({PART_LINES_SQL}), {BLOCKS} SELECT doc_id, first_line, n_lines FROM blk")
def t10(spark, d):
    x = documents.art_blocks(PART_LINES(spark, d))
    return x.select("doc_id", F.col("first_line").cast("long").alias("first_line"), "n_lines")


@query("t11_context", f"WITH part_lines AS ({PART_LINES_SQL}), {BLOCKS} SELECT blk.doc_id, first_line AS line_no, string_agg(line, chr(10) ORDER BY ln.line_no) AS context FROM blk JOIN ln ON ln.doc_id = blk.doc_id AND ln.line_no BETWEEN first_line - 3 AND first_line + 3 GROUP BY ALL")
def t11(spark, d):
    x = PART_LINES(spark, d)
    at = documents.art_blocks(x).select("doc_id", F.col("first_line").alias("line_no"))
    return documents.context(x, at).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "context")


@query("t12_captions", f"WITH part_lines AS ({PART_LINES_SQL}), {BLOCKS} SELECT doc_id, first_line, CASE WHEN trim(a) <> '' AND trim(a) NOT LIKE '%-%' AND trim(a) NOT LIKE '%|%' AND trim(a) NOT LIKE '%+%' THEN 'ASCII Diagram: ' || trim(a) WHEN trim(b) <> '' AND trim(b) NOT LIKE '%-%' AND trim(b) NOT LIKE '%|%' AND trim(b) NOT LIKE '%+%' THEN 'ASCII Diagram: ' || trim(b) ELSE 'ASCII Diagram' END AS caption FROM blk")
def t12(spark, d):
    x = documents.art_blocks(PART_LINES(spark, d))
    return x.select("doc_id", F.col("first_line").cast("long").alias("first_line"), "caption")


@query("t13_index_lines", """WITH l AS (SELECT p_partkey, p_name AS term, p_size AS a, p_size + p_partkey % 5 AS b FROM part WHERE p_partkey % 4 < 3) SELECT p_partkey, term, unnest(CASE p_partkey % 4 WHEN 0 THEN [a, a + 7] WHEN 1 THEN CASE WHEN b > a THEN range(a, b + 1) ELSE [] END ELSE [a] END)::INT AS page FROM l""")
def t13(spark, d):
    a, b, k = F.col("p_size"), F.col("p_size") + F.col("p_partkey") % 5, F.col("p_partkey") % 4
    text = lambda c: c.cast("string")
    line = F.when(k == 0, F.concat("p_name", F.lit(", "), text(a), F.lit(", "), text(a + 7))).when(k == 1, F.concat("p_name", F.lit("  "), text(a), F.lit("-"), text(b))).when(k == 2, F.concat("p_name", F.lit("  "), text(a), F.lit("n"))).otherwise(F.lit("Index"))
    return documents.index_entries(table(spark, d, "part").withColumn("line", line), "line", ["p_partkey"])


@query("t14_variant_search", "WITH v AS (SELECT unnest(['green', 'blue-', 'steel']) AS v) SELECT p_partkey, list_sort(list(v))[1] AS variant FROM part JOIN v ON contains(lower(p_name || ' ' || p_type), v) GROUP BY p_partkey")
def t14(spark, d):
    v = spark.createDataFrame([("green",), ("blue-",), ("steel",)], "v string")  # a few given variants
    x = holding(table(spark, d, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("t")), v, "p_partkey", "t", "v")
    return x.groupBy("p_partkey").agg(F.min("v").alias("variant"))


@query("t15_cache_key", "SELECT conv_id, md5(string_agg(text, '||' ORDER BY turn)) AS key FROM conversations GROUP BY conv_id")
def t15(spark, d):
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return x.select("conv_id", T.cache_key("t").alias("key"))


@query("t16_fenced_json", "SELECT event_id, props::JSON->>'$.k' AS k FROM events")
def t16(spark, d):
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("text\n```json\n"), "props", F.lit("\n```\nmore"))).otherwise(F.concat(F.lit("```\n"), "props", F.lit("```")))
    return table(spark, d, "events").select("event_id", F.get_json_object(T.fenced_json(body), "$.k").alias("k"))


@query("t17_prompts_and_batches", "SELECT doc_id, 'Title: ' || source || chr(10) || 'Text: ' || left(text, 8000) AS prompt, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 25 AS batch FROM documents")
def t17(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return docs(spark, d).select("doc_id", T.prompt("source", "text").alias("prompt"), F.floor(n / 25).alias("batch"))


@query("t18_map_helpers", "SELECT n_nationkey, coalesce({'AFRICA': 1, 'ASIA': 2}[r_name], 0) AS code, upper(left(n_name, 3)) AS head FROM nation JOIN region ON n_regionkey = r_regionkey".replace("{'AFRICA': 1, 'ASIA': 2}[r_name]", "CASE r_name WHEN 'AFRICA' THEN 1 WHEN 'ASIA' THEN 2 END"))
def t18(spark, d):
    codes = F.map_concat(F.create_map(F.lit("AFRICA"), F.lit(1)), F.create_map(F.lit("ASIA"), F.lit(2)))
    x = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    head = F.array_join(F.slice(F.split(F.upper("n_name"), ""), 1, 3), "")
    return x.select("n_nationkey", F.coalesce(F.try_element_at(codes, F.col("r_name")), F.lit(0)).alias("code"), head.alias("head"))


@query("t19_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, date_trunc('hour', ts)::TIMESTAMP AS hour, dayofweek(ts) + 1 AS weekday FROM events")
def t19(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_trunc("hour", "ts").alias("hour"), F.dayofweek("ts").cast("long").alias("weekday"))


@query("t20_text_choice", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS text FROM part")
def t20(spark, d):
    from textloom.operators.training import chapter_text

    x = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("summary"), F.col("p_name").alias("title"))
    return x.select("p_partkey", chapter_text().alias("text"))
