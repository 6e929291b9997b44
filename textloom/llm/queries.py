"""One query for each operator, over whole tables, with production parameters; and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, jaccard, linedup, lines, middle, mixing, passages, quality, secrets, sharding, suffixes, tokens, trie
from textloom.llm.common import table


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classify(table(spark, sf_dir, "documents"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.default_samples(docs)))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean(table(spark, sf_dir, "documents"), with_text=False)


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(table(spark, sf_dir, "documents"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations"))


def op13_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup(table(spark, sf_dir, "documents"), with_text=False)


#: Poisson counts and copies: the cumulative distribution of each source is a list, and a count is the number of its values below the document's hash.
OP5_SQL = """
WITH sizes AS (SELECT coalesce(source, '') AS src, sum(strlen(coalesce(text, ''))) AS bytes FROM documents GROUP BY 1),
totals AS (SELECT sum(bytes) AS everything, count(*) FILTER (WHERE bytes > 0) AS weights FROM sizes),
rates AS (SELECT src, CASE WHEN bytes > 0 THEN 1.0::DOUBLE / weights * everything * 1.0::DOUBLE / bytes ELSE 0.0::DOUBLE END AS rate FROM sizes, totals),
mass AS (SELECT src, rate, k, exp(-rate + CASE WHEN k = 0 THEN 0.0 ELSE k * ln(rate) END - lgamma(k + 1)) AS p FROM rates, range(0, 80) t(k) WHERE rate > 0),
cdf AS (SELECT src, any_value(rate) AS rate, list(c ORDER BY k) AS cs FROM (SELECT src, rate, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM mass) GROUP BY src),
counted AS (SELECT d.*, rate, len(list_filter(cs, lambda c: c < (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':0'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)) AS n_copies
  FROM documents d JOIN cdf ON coalesce(d.source, '') = cdf.src),
copies AS (SELECT *, unnest(range(0, n_copies)) AS copy_no FROM counted)
SELECT doc_id, text, lang, source, n_chars, rate, n_copies::INT AS n_copies, copy_no::INT AS copy_no,
  md5('0:place:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':' || copy_no::VARCHAR) AS mix_key
FROM copies
"""

#: Shared shingles of pairs whose sizes allow a link, links, and the least id that they lead to.
OP3_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
edges AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (na + nb - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, min(r.b) AS component_id FROM s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s)
"""

#: Windows by their words, the least document of each, and what is left of each text.
OP4_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
least_id AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least_id USING (h) WHERE doc_id > d),
lists AS (SELECT doc_id, list(p ORDER BY p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(w) AS n, coalesce(ps, []) AS ps, list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)) AS k FROM w LEFT JOIN lists ON lists.doc_id = w.doc_id)
SELECT doc_id, n::BIGINT AS n_words, len(ps)::BIGINT AS n_removed, len(list_filter(ps, lambda x, i: i = 1 OR ps[i - 1] <> x - 1))::BIGINT AS n_spans, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

#: Draws from the digest of each id, two cuts in characters, and the parts in the order of the form.
OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS p, ('0x' || h[25:32])::BIGINT % 100 AS q FROM d),
f AS (SELECT doc_id, t, n, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form, least(a, b) AS a, greatest(a, b) AS b FROM u),
c AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM c
"""

#: Prefixes of rebuilt conversations as lists of turns; nodes are named by their smallest member and depth, and joined with all nodes above them.
OP12_SQL = """
WITH own AS (SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h FROM own),
r AS (SELECT a.c, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) AS t FROM h a LEFT JOIN own b ON b.c = a.c - a.c % 20),
p AS (SELECT c, d, len(t) AS n, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(t[d].text, '[^\\x20\\x09-\\x0D]+')) END AS words, t[1:d] AS k FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM r)),
m AS (SELECT c, d, n, words, min(c) OVER w AS id, count(*) OVER w AS members FROM p WINDOW w AS (PARTITION BY d, k)),
up AS (SELECT DISTINCT a.id, a.d, b.id AS over_id, b.d AS over_d, a.members, a.words FROM m a JOIN m b ON a.c = b.c AND b.d <= a.d),
kids AS (SELECT over_id AS id, over_d AS d, count(*) AS children FROM up WHERE d = over_d + 1 GROUP BY 1, 2),
sums AS (SELECT over_id AS id, over_d AS d, sum((children IS NULL)::INT) AS leaves, sum((members - 1) * words) AS saved FROM up LEFT JOIN kids USING (id, d) GROUP BY 1, 2),
nodes AS (SELECT id, d, any_value(members) AS members, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends FROM m GROUP BY 1, 2)
SELECT a.id AS conv_id, a.d::BIGINT AS depth, u.over_id AS parent_conv_id, a.members AS n_convs, coalesce(children, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM nodes a JOIN sums USING (id, d) LEFT JOIN kids k USING (id, d) LEFT JOIN (SELECT DISTINCT id, d, over_id FROM up WHERE d = over_d + 1) u USING (id, d)
"""

#: Lines by their keys, the least document of each key, and what is left of each text.
OP13_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
keyed AS (SELECT doc_id, i, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k),
gone AS (SELECT doc_id, list(i) AS gone FROM keyed JOIN owners USING (k) WHERE doc_id > owner GROUP BY doc_id)
SELECT s.doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped, sha256(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(coalesce(gone, []), i)), chr(10))) AS kept_sha256
FROM split s LEFT JOIN gone USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tokens": op1_tokens,
    "op2_decontaminate": op2_decontaminate,
    "op3_jaccard": op3_jaccard,
    "op4_passages": op4_passages,
    "op5_mix": op5_mix,
    "op6_secrets": op6_secrets,
    "op7_suffixes": op7_suffixes,
    "op8_quality": op8_quality,
    "op9_shard": op9_shard,
    "op10_lines": op10_lines,
    "op11_middle": op11_middle,
    "op12_trie": op12_trie,
    "op13_linedup": op13_linedup,
}

ORACLES: dict[str, str] = {"op3_jaccard": OP3_SQL, "op4_passages": OP4_SQL, "op5_mix": OP5_SQL, "op11_middle": OP11_SQL, "op12_trie": OP12_SQL, "op13_linedup": OP13_SQL}
