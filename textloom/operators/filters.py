"""Predicates over terms and results: each is one CASE expression, so a filter needs no join and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import vocabulary as V
from textloom.functions import text as T


def noise_reason(term: Column | str) -> Column:
    """Why the built-in noise filter rejects a term, null if it doesn't; the first rule that matches counts."""
    t = T.col(term)
    low = T.strip(F.lower(t))
    return (
        F.when(t.isNull() | (t == ""), "single_char").when(F.length(low) == 1, "single_char").when(low.rlike(r"^\d+$"), "pure_number")
        .when(low.rlike(r"^['`]?(ll|nt|n't|s|ve|d|re|m)$"), "contraction").when(low.rlike(r"^_+\w*$"), "code_artifact")
        .when(low.isin(V.WATERMARKS + V.MORE_WATERMARKS), "watermark").when(low.isin(V.URL_FRAGMENTS), "url_fragment")
        .when(low.isin(V.GENERIC_FILLER), "generic_filler").when(low.isin(V.CODE_ARTIFACTS), "code_artifact").when(low.isin(V.PAGE_MARKERS), "page_marker")
    )


def is_noise(term: Column | str) -> Column:
    """Whether noise_reason() rejects a term: one look-up and one pattern, for use on every word of a text."""
    words = sorted({*V.WATERMARKS, *V.MORE_WATERMARKS, *V.URL_FRAGMENTS, *V.GENERIC_FILLER, *V.CODE_ARTIFACTS, *V.PAGE_MARKERS})
    shape = r"^(\d+|['`]?(ll|nt|n't|s|ve|d|re|m)|_+\w*)$"
    t = T.col(term)
    return t.isNull() | (t == "") | T.once(T.strip(F.lower(t)), lambda low: (F.length(low) == 1) | low.isin(words) | low.rlike(shape))


def heuristic_reason(term: Column | str, categories: dict[str, list[str]] | None = None) -> Column:
    """The cascade's rule tier: other codes and slightly other rules than noise_reason, and configurable categories."""
    low = F.lower(T.strip(T.col(term)))
    out = (
        F.when(low == "", "noise_empty").when(F.length(low) == 1, "noise_single_char").when(low.rlike(r"^[\d.]+$"), "noise_pure_number")
        .when(low.rlike(r"^_+\w+"), "noise_underscore_prefix").when(low.rlike("^(ll|nt|ve|re|s|d|m)$"), "noise_broken_contraction")
    )
    for name, terms in (V.NOISE_CATEGORIES if categories is None else categories).items():
        out = out.when(low.isin(terms), f"noise_{name}")
    return out


def split_noise(df: DataFrame, key: str, term: str, pos: str) -> DataFrame:
    """(key, accepted, rejected, reasons): a document's terms in order, and the reason of each rejected one."""
    flagged = df.withColumn("_reason", noise_reason(term))
    entry = F.struct(F.col(pos).alias("p"), F.col(term).alias("t"), F.col("_reason").alias("r"))
    rows = flagged.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    names = lambda keep: F.transform(F.filter("_all", lambda x: x["r"].isNull() if keep else x["r"].isNotNull()), lambda x: x["t"])
    pairs = F.array_distinct(F.transform(F.filter("_all", lambda x: x["r"].isNotNull()), lambda x: F.struct(x["t"].alias("key"), x["r"].alias("value"))))
    return rows.select(key, names(True).alias("accepted"), names(False).alias("rejected"), F.map_from_entries(pairs).alias("reasons"))


def dictionary(df: DataFrame, term: str, approved: DataFrame, key: str = "term", keep: bool = True) -> DataFrame:
    """Terms that are in the approved dictionary (or are not): a semi or anti join on the trimmed lower-case term."""
    known = approved.select(T.strip(F.lower(F.col(key))).alias("_k")).distinct()
    return df.join(known, T.strip(F.lower(F.col(term))) == F.col("_k"), "left_semi" if keep else "left_anti")


def clean_text(text: Column | str) -> Column:
    """The text's words that are no noise, joined by one blank."""
    return F.array_join(F.filter(T.split_words(text), lambda w: ~is_noise(w)), " ")


def clean_phrase(term: Column | str) -> Column:
    """True if no word of the phrase is noise."""
    return ~F.exists(T.split_words(term), lambda w: is_noise(w))


def concept_reason(concept: Column | str) -> Column:
    """Why a phrase is no concept: too short, a single word, an author, or noise."""
    c = T.col(concept)
    author = T.any_of([c.rlike(p) for p in V.AUTHOR_PATTERNS]) | F.arrays_overlap(T.split_words(F.lower(c)), F.array(*[F.lit(a) for a in V.KNOWN_AUTHORS]))
    return F.when(F.length(c) < 2, "noise_term").when(F.size(T.split_words(c)) < 2, "single_word_not_concept").when(author, "author_pattern").when(F.lower(c).isin(V.CONCEPT_NOISE), "noise_term")


def generic_reason(term: Column | str) -> Column:
    low = T.strip(F.lower(T.col(term)))
    return F.when(F.length(low) < 2, "too_short").when(low.isin(V.GENERIC_TERMS), "too_generic")


def graph_split(generated: Column | str, related: Column | str) -> tuple[Column, Column]:
    """Validated and rejected terms of a state, generated ones before related ones."""
    both = F.concat(T.col(generated), T.col(related))
    return F.filter(both, lambda t: ~F.lower(t).isin(V.GRAPH_GENERIC_TERMS)), F.filter(both, lambda t: F.lower(t).isin(V.GRAPH_GENERIC_TERMS))


def matches_domain(title: Column | str, domain: str) -> Column:
    return T.title_domain(title).isin(domain, "general")


def confidence(score: Column | str) -> Column:
    """Of a score that is better when lower."""
    return 1 - F.least(T.col(score), F.lit(1.0))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and the others with the names of those they break."""
    marked = df.withColumn("broken", F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])))
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)
