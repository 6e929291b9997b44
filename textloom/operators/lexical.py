"""Term weights over whole corpora: TF-IDF, BM25, statistical keyword scores and co-occurrence ranks, as joins and aggregates."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

TOKEN = r"\w\w+"


def terms(docs: DataFrame, key: str = "doc_id", text: str = "text", stopwords: list[str] | None = None, most: int = 2, pattern: str = "[a-z0-9_]{2,}") -> DataFrame:
    """(key, term): every occurrence of 1- to n-grams of the words left after stopwords go."""
    stop = stopwords or []
    found = T.words(text, pattern)
    left = F.filter(found, lambda w: ~w.isin(stop)) if stop else found
    words = docs.select(key, left.alias("_w"))
    return words.select(key, F.explode(F.concat(*[T.ngrams("_w", n) for n in range(1, most + 1)])).alias("term"))


#: Distinct words that a task holds before it hands them on.
HELD = 500_000


def word_counts(docs: DataFrame, text: str = "text", pattern: str = "[a-z0-9_]{2,}", held: int = HELD) -> DataFrame:
    """(term, n): all words of the lower-cased texts and how often they occur. A task counts the words that it reads, and hands counts on whenever it holds `held` words: no row for each word of a text."""

    def run(batches):
        import pyarrow as pa

        found, counts = re.compile(pattern).findall, Counter()
        hand = lambda: pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        for batch in batches:
            for t in batch.column(0):
                counts.update(found(t.as_py() or ""))
                if len(counts) >= held:
                    yield hand()
                    counts.clear()
        if counts:
            yield hand()

    return docs.select(F.lower(F.col(text)).alias("_text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", stopwords: list[str] | None = None, pattern: str = "[a-z0-9_]{2,}") -> DataFrame:
    """(key, length, term, tf): each document's distinct words but stopwords with their counts, and the length of its text; a document without words has one row without term. A document's words are counted where it is read, before they are shuffled."""
    stop = stopwords or []
    found = T.words(text, pattern)
    left = F.filter(found, lambda w: ~w.isin(stop)) if stop else found
    # the length is taken before words become rows, which would each carry the text
    words = docs.select(key, F.length(text).alias("length"), left.alias("_w")).select(key, "length", F.explode_outer("_w").alias("term"))
    return words.groupBy(key, "term").agg(F.count("term").alias("tf"), F.max("length").alias("length"))


def tfidf(occurrences: DataFrame, documents: int | DataFrame, key: str = "doc_id", max_df: float = 1.0, min_df: int = 1, scope: str = "corpus") -> DataFrame:
    """(key, term, tf, df, weight): tf * (ln((1 + n) / (1 + df)) + 1), each document's weights of length 1.

    scope 'document' treats every document as a corpus of its own: its idf is 1. Counting has partial sums, df is an
    aggregate of the term counts, and only terms that stay are joined back.
    """
    tf = occurrences.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    if scope == "document":
        weighted = tf.withColumn("df", F.lit(1).cast("long")).withColumn("_x", F.col("tf").cast("double"))
    else:
        n = documents.agg(F.count(F.lit(1)).alias("_n")) if isinstance(documents, DataFrame) else None
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        df = df.join(F.broadcast(n)) if n is not None else df.withColumn("_n", F.lit(documents))  # one row
        df = df.where((F.col("df") >= min_df) & (F.col("df") <= F.col("_n") * max_df))
        weighted = tf.join(df, "term").withColumn("_x", F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", "tf", "df", (F.col("_x") / norm).alias("weight"))


#: Bytes of text of the documents that are weighted together, and of those whose terms meet in a part.
CHUNK, PART = 2_000_000, 16_000_000


def counted_terms(table, stop: frozenset[str], most: int, pattern: str):
    """(keys, terms, rows, codes, tf) of a chunk's documents (columns _key and _text, in lower case): rows and codes number keys and terms, each pair once. Rows of one key are one document."""
    import numpy as np

    found, number, keys, code, tf, row = re.compile(pattern).findall, {}, {}, [], [], []
    each: dict = {}
    for key, text in zip(table["_key"].to_pylist(), table["_text"].to_pylist(), strict=True):
        words = [w for w in found(text or "") if w not in stop]
        counts = each.setdefault(key, Counter())
        counts.update(words)
        for n in range(2, most + 1):
            counts.update(map(" ".join, zip(*[words[i:] for i in range(n)], strict=False)))
    for key, counts in each.items():
        if counts:
            at = keys.setdefault(key, len(keys))
            code += [number.setdefault(t, len(number)) for t in counts]
            tf += counts.values()
            row += [at] * len(counts)
    return list(keys), list(number), np.array(row, np.int64), np.array(code, np.int64), np.array(tf, np.int64)


def _by_part(terms: list[str], parts: int):
    """(hashes, order, bounds): 64-bit hashes of terms; `order` sorts them by part and hash, and part p is order[bounds[p]:bounds[p + 1]]."""
    import numpy as np
    import pandas as pd

    hashes = pd.util.hash_array(np.array(terms, object), categorize=False) if terms else np.zeros(0, np.uint64)
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((hashes, part))
    return hashes, order, np.searchsorted(part[order], np.arange(parts + 1))


def weighted(docs: DataFrame, key: str = "doc_id", text: str = "text", stopwords: list[str] | None = None, most: int = 2, pattern: str = "[a-z0-9_]{2,}", max_df: float = 1.0, min_df: int = 1, scope: str = "corpus", chunk: int = CHUNK) -> DataFrame:
    """(key, terms): the rows of tfidf(terms(docs)) with one row a document, an array of (term, tf, df, weight).

    Documents are dealt into chunks of about `chunk` bytes by a hash of their key. A chunk sends each of its distinct
    terms once, as 64 bits with a count, to parts by hash, and gets the document frequencies back in that order; so rows
    of documents and terms are never shuffled, only texts and a chunk's distinct terms are.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    low = _chunked(docs, key, text, F.pmod(F.xxhash64(key), F.lit(max(1, -(-int(size.bytes) // chunk)))))
    out = f"{key} {dict(docs.dtypes)[key]}, terms array<struct<term: string, tf: long, df: long, weight: double>>"
    send, answer, weigh = _frequencies(size.n, max(1, -(-int(size.bytes) // PART)), frozenset(stopwords or []), most, pattern, max_df, min_df, scope)

    def rows_of(table, answers=None):
        import numpy as np
        import pyarrow as pa

        keys, terms, row, code, tf, df, weight = weigh(table, answers)
        starts = np.searchsorted(row, np.arange(len(keys) + 1))
        lists = pa.StructArray.from_arrays([pa.array(terms, pa.string()).take(pa.array(code)), pa.array(tf), pa.array(df), pa.array(weight)], ["term", "tf", "df", "weight"])
        full = np.flatnonzero(starts[1:] > starts[:-1])
        bounds = pa.array(np.append(starts[:-1][full], len(row)).astype(np.int32))
        return pa.table({key: pa.array([keys[i] for i in full], table.schema.field("_key").type), "terms": pa.ListArray.from_arrays(bounds, lists)})

    if scope != "corpus":
        return low.groupBy("_chunk").applyInArrow(lambda t: rows_of(t), out)
    back = low.groupBy("_chunk").applyInArrow(send, SENT).groupBy("_part").applyInArrow(answer, ANSWERED)
    return low.groupBy("_chunk").cogroup(back.groupBy("_chunk")).applyInArrow(lambda t, answers: rows_of(t, answers), out)


def _chunked(docs: DataFrame, key: str, text: str, number) -> DataFrame:
    return docs.select(number.cast("int").alias("_chunk"), F.col(key).alias("_key"), F.lower(text).alias("_text"))


#: What a chunk sends to the parts, and what it gets back.
SENT, ANSWERED = "_part int, _chunk int, hashes binary, counts binary", "_chunk int, _part int, df binary"


def _frequencies(documents: int, parts: int, stop: frozenset[str], most: int, pattern: str, max_df: float, min_df: int, scope: str = "corpus"):
    """(send, answer, weigh) of weighted(): a chunk's distinct terms by part; each part's document frequencies, 0 for terms that are left out; and (keys, terms, rows, codes, tf, df, weight) of a chunk and what it got back."""

    def send(table):
        import numpy as np
        import pyarrow as pa

        _, terms, _, code, _ = counted_terms(table, stop, most, pattern)
        hashes, order, bounds = _by_part(terms, parts)
        counts = np.bincount(code, minlength=len(terms)).astype(np.int32)
        some = [p for p in range(parts) if bounds[p + 1] > bounds[p]]
        slices = [order[bounds[p] : bounds[p + 1]] for p in some]
        return pa.table({"_part": pa.array(some, pa.int32()), "_chunk": pa.array([table["_chunk"][0].as_py()] * len(some), pa.int32()), "hashes": pa.array([hashes[o].tobytes() for o in slices], pa.binary()), "counts": pa.array([counts[o].tobytes() for o in slices], pa.binary())})

    def answer(table):
        import numpy as np
        import pyarrow as pa

        sent = table["hashes"].to_pylist()
        hashes, place = np.unique(np.frombuffer(b"".join(sent), np.uint64), return_inverse=True)
        df = np.zeros(len(hashes), np.int64)
        np.add.at(df, place, np.frombuffer(b"".join(table["counts"].to_pylist()), np.int32))
        df[(df < min_df) | (df > documents * max_df)] = 0
        back = np.split(df[place].astype(np.int32), np.cumsum([len(h) // 8 for h in sent])[:-1])
        return pa.table({"_chunk": table["_chunk"], "_part": table["_part"], "df": pa.array([b.tobytes() for b in back], pa.binary())})

    def weigh(table, answers):
        import numpy as np

        keys, terms, row, code, tf = counted_terms(table, stop, most, pattern)
        df = np.ones(len(terms), np.int64)
        if scope == "corpus":
            df[:] = 0
            _, order, bounds = _by_part(terms, parts)
            for p, b in zip(answers["_part"].to_pylist(), answers["df"].to_pylist(), strict=True):
                df[order[bounds[p] : bounds[p + 1]]] = np.frombuffer(b, np.int32)
        df = df[code]
        kept = df > 0
        row, code, tf, df = row[kept], code[kept], tf[kept], df[kept]
        x = tf * (np.log((1 + documents) / (1 + df)) + 1) if scope == "corpus" else tf.astype(float)
        return keys, terms, row, code, tf, df, x / np.sqrt(np.bincount(row, x * x, len(keys)))[row]

    return send, answer, weigh


def hashed_grams(texts, stop: frozenset[str], most: int, pattern: str):
    """(hashes, at) of all 1- to n-grams of lower-cased texts: 64 bits of each, and the number of its text."""
    import numpy as np
    import pandas as pd

    found, words, lengths = re.compile(pattern).findall, [], []
    for t in texts:
        own = found(t or "")
        words += own
        lengths.append(len(own))
    code, own = pd.factorize(np.array(words, object))
    one = pd.util.hash_array(own, categorize=False)[code] if words else np.zeros(0, np.uint64)
    at = np.repeat(np.arange(len(lengths)), lengths)
    if stop:
        out = pd.util.hash_array(np.array(sorted(stop), object), categorize=False)
        kept = ~np.isin(one, out)
        one, at = one[kept], at[kept]
    hashes, own, last = [one], [at], one
    for n in range(2, most + 1):
        inside = at[n - 1 :] == at[: len(at) - n + 1] if len(at) >= n else np.zeros(0, bool)
        last = last[: len(inside)] * np.uint64(0x9E3779B97F4A7C15) + one[n - 1 :] if len(inside) else np.zeros(0, np.uint64)  # no overflow check: modulo 2^64
        last ^= last >> np.uint64(29)
        hashes.append(last[inside])
        own.append(at[: len(inside)][inside])
    return np.concatenate(hashes), np.concatenate(own)


def heaviest_terms(docs: DataFrame, key: str, topic: str, text: str = "text", stopwords: list[str] | None = None, most: int = 3, min_df: int = 2, k: int = 10, pattern: str = "[a-z0-9_]{2,}", chunk: int = CHUNK, texts: DataFrame | None = None) -> DataFrame:
    """(topic, term, weight, rank): of each topic (an int of at most 32,767; negative: none) the k terms of 1 to `most` words, in at least `min_df` documents of any topic, that are heaviest by cluster.heaviest(). Rows of one key are one document, of one topic.

    Terms are counted as 64-bit hashes, in arrays: by chunks of documents, then by part of the hashes. Parts say how much they hold, then
    what their best weights are, then which terms reach the k-th best of a topic; only those are looked for in the texts (`texts`: where they lie without a topic).
    """
    from textloom.sources.scratch import discard, materialize

    spark, stop, texts = docs.sparkSession, frozenset(stopwords or []), docs if texts is None else texts
    size = texts.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    chunks, parts = max(1, -(-size // chunk)), max(1, -(-2 * size // PART))

    def send(table):
        import numpy as np
        import pyarrow as pa

        number: dict = {}
        document = np.array([number.setdefault(n, len(number)) for n in table["_key"].to_pylist()], np.int64)
        topics = np.zeros(len(number), np.int64)
        topics[document] = np.maximum(-1, np.asarray(table["_topic"])) + 1
        hashes, at = hashed_grams(table["_text"].to_pylist(), stop, most, pattern)
        own, code = np.unique(hashes, return_inverse=True)
        many = int(topics.max(initial=0)) + 1
        # cells: a term in a topic
        cell, tf = np.unique(code * many + topics[document[at]], return_counts=True)
        pair = np.sort(code * len(number) + document[at])  # unique() of integers is several times slower
        pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
        df = np.bincount(np.searchsorted(cell, pair // len(number) * many + topics[pair % len(number)]), minlength=len(cell))
        h, t = own[cell // many], (cell % many - 1).astype(np.int16)
        part = (h % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[by], np.arange(parts + 1))
        some = [p for p in range(parts) if bounds[p + 1] > bounds[p]]
        cut = lambda x: pa.array([x[by[bounds[p] : bounds[p + 1]]].tobytes() for p in some], pa.binary())
        return pa.table({"_part": pa.array(some, pa.int32()), "h": cut(h), "t": cut(t), "tf": cut(tf.astype(np.int32)), "df": cut(df.astype(np.int32))})

    def add(table):
        import numpy as np
        import pyarrow as pa

        h, t, tf, df = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("h", np.uint64), ("t", np.int16), ("tf", np.int32), ("df", np.int32)))
        own, code = np.unique(h, return_inverse=True)
        often = np.bincount(code, df, len(own)) >= min_df
        some = often[code] & (t >= 0)
        code, t, tf = code[some], t[some].astype(np.int64), tf[some]
        total = np.bincount(code, tf, len(own)).astype(np.int64)
        many = int(t.max(initial=0)) + 1
        cell, place = np.unique(code * many + t, return_inverse=True)
        code, t, tf = cell // many, (cell % many).astype(np.int32), np.bincount(place, tf, len(cell)).astype(np.int64)
        there = np.unique(t)
        cut = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table({"n": pa.array([int(tf.sum())], pa.int64()), "topics": pa.array([there.tolist()], pa.list_(pa.int32())), "h": cut(own[code].view(np.int64)), "t": cut(t), "tf": cut(tf), "all": cut(total[code])})

    number = F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("_chunk")
    low = docs.select(number, F.col(key).alias("_key"), F.col(topic).cast("int").alias("_topic"), F.lower(text).alias("_text"))
    sent = low.groupBy("_chunk").applyInArrow(send, "_part int, h binary, t binary, tf binary, df binary")
    held = materialize(spark, sent.groupBy("_part").applyInArrow(add, "n long, topics array<int>, h binary, t binary, tf binary, all binary"))
    there = held.select(F.explode("topics").alias("topic")).distinct().count()
    mean = (held.agg(F.sum("n")).first()[0] or 0) / max(1, there)

    def weights(batches):
        import numpy as np

        for batch in batches:
            for h, t, tf, total in zip(*(batch.column(c).to_pylist() for c in ("h", "t", "tf", "all")), strict=True):
                h, t, tf, total = (np.frombuffer(x, kind) for x, kind in ((h, np.int64), (t, np.int32), (tf, np.int64), (total, np.int64)))
                yield h, t, tf, total, tf * np.log(1 + mean / np.maximum(1, total))

    def best(batches):
        import numpy as np
        import pyarrow as pa

        for _, t, _, _, w in weights(batches):
            by = np.lexsort((-w, t))
            by = by[np.arange(len(by)) - np.searchsorted(t[by], t[by]) < k]
            yield pa.RecordBatch.from_pydict({"topic": pa.array(t[by]), "weight": pa.array(w[by])})

    packs = held.select("h", "t", "tf", "all")
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight")))
    edge = {r.topic: r.weight for r in packs.mapInArrow(best, "topic int, weight double").withColumn("_n", place).where(F.col("_n") <= k).groupBy("topic").agg(F.min("weight").alias("weight")).collect()}

    def reach(batches):
        import numpy as np
        import pyarrow as pa

        least = np.full(max(edge, default=0) + 1, np.inf)
        for t, w in edge.items():
            least[t] = w * (1 - 1e-9)  # equal ones go by term
        for h, t, tf, total, w in weights(batches):
            some = w >= least[t]
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[some]), "topic": pa.array(t[some]), "tf": pa.array(tf[some]), "all": pa.array(total[some])})

    found = materialize(spark, packs.mapInArrow(reach, "h long, topic int, tf long, all long"), held)
    asked = [r.h for r in found.select("h").distinct().collect()]

    def look(batches):
        import numpy as np
        import pyarrow as pa

        left, find = np.sort(np.array(asked, np.int64).view(np.uint64)), re.compile(pattern).findall
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                if not len(left):
                    break
                some = batch.column(0).slice(i, 256).to_pylist()
                hashes, at = hashed_grams(some, stop, most, pattern)
                hit = np.isin(hashes, left)
                if not hit.any():
                    continue
                terms = {}
                for text in np.unique(at[hit]):
                    words = [w for w in find(some[text] or "") if w not in stop]
                    names = [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]
                    own, _ = hashed_grams([some[text]], stop, most, pattern)
                    terms |= {h: name for h, name, ok in zip(own.tolist(), names, np.isin(own, left).tolist(), strict=True) if ok}
                got = np.array(list(terms), np.uint64)
                left = left[~np.isin(left, got)]
                yield pa.RecordBatch.from_pydict({"h": pa.array(got.view(np.int64)), "term": pa.array(list(terms.values()), pa.string())})

    # a task stops looking once it has all of them
    terms = texts.select(F.lower(text).alias("_text")).mapInArrow(look, "h long, term string").dropDuplicates(["h"])
    weight = F.col("tf") * F.log(1 + F.lit(mean) / F.col("all"))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    out = materialize(spark, found.join(terms, "h").withColumn("weight", weight).withColumn("rank", rank).where(F.col("rank") <= k).select("topic", "term", "weight", "rank"))
    discard(spark, found)
    return out


#: Bytes of text of the documents whose words are judged together.
JUDGED = 8_000_000


def judged_words(docs: DataFrame, judge, key: str = "doc_id", text: str = "text", stopwords: list[str] | None = None, top: int = 20, pattern: str = "[a-z0-9_]{2,}", chunk: int = JUDGED) -> DataFrame:
    """(key, length, n_words, n_noise, n_good, keywords, rejected) of every document: the length of its text, how many distinct words but stopwords it has, how many of them are noise and how many are good, the `top` good ones with the highest counts (of equal ones those that sort last), and (term, reason) of the others by term.

    judge() takes rows with a column term and adds noise and reason, null for good words. Documents are dealt into chunks
    of about `chunk` bytes by a hash of their key; a chunk sends each of its distinct words once, to be judged once for all chunks, and gets the bad ones
    back, so no row for each word of a document is shuffled. Rows of one key are one document.
    """
    stop = frozenset(stopwords or [])
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first().bytes
    chunks = max(1, -(-int(size) // chunk))
    low = docs.select(F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("_chunk"), F.col(key).alias("_key"), F.length(text).alias("_length"), F.lower(text).alias("_text"))

    def distinct(table):
        import pyarrow as pa

        find, found = re.compile(pattern).findall, set()
        for t in table["_text"]:
            found.update(find(t.as_py() or ""))
        terms = sorted(found - stop)
        return pa.table({"_chunk": pa.array([table["_chunk"][0].as_py()] * len(terms), pa.int32()), "term": pa.array(terms, pa.string())})

    def lists(table, bad):
        import numpy as np
        import pyarrow as pa

        lengths: dict = {}
        for one, n in zip(table["_key"].to_pylist(), table["_length"].to_pylist(), strict=True):
            lengths[one] = n if lengths.get(one) is None else max(lengths[one], n or 0)
        number = {one: i for i, one in enumerate(lengths)}
        keys, terms, row, code, tf = counted_terms(table.select(["_key", "_text"]), stop, 1, pattern)
        row = np.array([number[one] for one in keys], np.int64)[row] if keys else row
        order = np.zeros(len(terms), np.int64)
        order[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
        at = {t: i for i, t in enumerate(terms)}
        where = np.array([at[t] for t in bad["term"].to_pylist()], np.int64)
        reasons, noise, why = bad["reason"].combine_chunks(), np.zeros(len(terms), bool), np.full(len(terms), -1)
        noise[where], why[where] = ~np.asarray(bad["noise"].is_null()), np.arange(len(where))
        good = why[code] < 0
        count = lambda some: np.bincount(row[some], minlength=len(number))
        bounds = lambda rows: pa.array(np.searchsorted(rows, np.arange(len(number) + 1)).astype(np.int32))
        names = pa.array(terms, pa.string())
        best = np.flatnonzero(good)
        best = best[np.lexsort((-order[code[best]], -tf[best], row[best]))]
        best = best[np.arange(len(best)) - np.searchsorted(row[best], row[best]) < top]
        out = np.flatnonzero(~good)
        out = out[np.lexsort((order[code[out]], row[out]))]
        rejected = pa.StructArray.from_arrays([names.take(pa.array(code[out])), reasons.take(pa.array(why[code[out]]))], ["term", "reason"])
        return pa.table({
            key: pa.array(list(number), table.schema.field("_key").type), "length": pa.array(list(lengths.values()), pa.int32()), "n_words": count(np.ones(len(row), bool)), "n_noise": count(noise[code]), "n_good": count(good),
            "keywords": pa.ListArray.from_arrays(bounds(row[best]), names.take(pa.array(code[best]))), "rejected": pa.ListArray.from_arrays(bounds(row[out]), rejected),
        })

    found = low.groupBy("_chunk").applyInArrow(distinct, "_chunk int, term string").groupBy("term").agg(F.collect_list("_chunk").alias("_chunks"))  # each word is judged once
    judged = judge(found).where("reason is not null").select(F.explode("_chunks").alias("_chunk"), "term", "noise", "reason")
    columns = f"{key} {dict(docs.dtypes)[key]}, length int, n_words long, n_noise long, n_good long, keywords array<string>, rejected array<struct<term: string, reason: string>>"
    return low.groupBy("_chunk").cogroup(judged.groupBy("_chunk")).applyInArrow(lists, columns)


def top_terms(weights: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k heaviest terms of each document; among equal weights the term that sorts last comes first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), F.desc("term")))
    return weights.where("weight > 0").withColumn("rank", rank).where(F.col("rank") <= k)


#: Products that are added up at a time.
STEP = 2_000_000


def sparse_pack(data: bytes, _=None):
    """(keys, rows, hashes, weights, frequent, dense) of a pack of rows (key, _h, _w), by hash; `frequent` are the hashes that many rows have, and `dense` the matrix of their weights."""
    import numpy as np
    import pyarrow as pa

    pack = pa.ipc.open_stream(data).read_all().combine_chunks()
    h, w = (pack[c].combine_chunks() for c in ("_h", "_w"))
    row, h, w = np.repeat(np.arange(len(h)), np.asarray(h.value_lengths())), np.asarray(h.flatten()), np.asarray(w.flatten())
    by = np.argsort(h, kind="stable")
    row, h, w = row[by], h[by], w[by]
    own, place, many = np.unique(h, return_inverse=True, return_counts=True)
    often = many >= max(FREQUENT, pack.num_rows // 32)
    dense = np.zeros((pack.num_rows, int(often.sum())))
    some, number = often[place], np.cumsum(often) - 1
    np.add.at(dense, (row[some], number[place[some]]), w[some])
    return pack.column(0).combine_chunks(), row[~some], h[~some], w[~some], own[often], dense, (row[some], h[some], w[some])


#: A term in fewer rows of a pack is not multiplied as a column of a matrix.
FREQUENT = 16


def sparse_products(q, r):
    """Record batches (a, b, score) of the pairs of two packs with a term in common, by score.

    Neighbours in that order have nearly the same score, so that the files of such rows, of which there are as many as
    pairs, take half the bytes.
    """
    import numpy as np
    import pyarrow as pa

    a, arow, ah, aw, often, dense, _ = q
    b, brow, bh, bw = r[0], *(np.concatenate((r[i + 1], r[6][i])) for i in range(3))
    score = np.zeros((len(b), len(a)))
    if len(often):
        at = np.minimum(np.searchsorted(often, bh), len(often) - 1)
        hit = often[at] == bh
        own = np.zeros((len(b), len(often)))
        np.add.at(own, (brow[hit], at[hit]), bw[hit])
        score += own @ dense.T
        brow, bh, bw = brow[~hit], bh[~hit], bw[~hit]
    score = score.reshape(-1)
    first, last = np.searchsorted(ah, bh, "left"), np.searchsorted(ah, bh, "right")
    some = last > first
    brow, bw, first, many = brow[some], bw[some], first[some], (last - first)[some]
    done = np.cumsum(many)
    cuts = np.unique(np.searchsorted(done, np.arange(STEP, (done[-1] if len(done) else 0) + STEP, STEP)))
    for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(many)], strict=True):
        n = many[i:j]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[i:j], n)
        np.add.at(score, np.repeat(brow[i:j] * len(a), n) + arow[at], np.repeat(bw[i:j], n) * aw[at])
    found = np.flatnonzero(score)
    found = found[np.argsort(score[found])]
    for i in range(0, len(found), 500_000):
        some = found[i : i + 500_000]
        yield pa.RecordBatch.from_pydict({"a": a.take(pa.array(some % len(a))), "b": b.take(pa.array(some // len(a))), "score": score[some]})


def cosine_pairs(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """(left key, right key, score): sparse dot products of rows (key, terms) as weighted() gives them, for pairs with a term in common.

    Packs of both meet as in vectors.compared() and products are added up where they do: no row for each pair and term.
    Terms are told apart by 64 bits.
    """
    from textloom.operators.vectors import compared

    flat = lambda df, name: df.select(F.col(key).alias(name), F.transform("terms", lambda t: F.xxhash64(t["term"])).alias("_h"), F.transform("terms", lambda t: t["weight"]).alias("_w"))
    types = [dict(df.dtypes)[key] for df in (left, right)]
    return compared(flat(left, "a"), flat(right, "b"), "_h", sparse_products, f"a {types[0]}, b {types[1]}, score double", load=sparse_pack)


def similar_documents(docs: DataFrame, asked: Column, key: str = "doc_id", text: str = "text", stopwords: list[str] | None = None, most: int = 2, pattern: str = "[a-z0-9_]{2,}", max_df: float = 1.0, min_df: int = 1, chunk: int = CHUNK, broadcast: int | None = None) -> DataFrame:
    """(a, b, score): cosine_pairs() of the weighted() documents that `asked` holds for, with all documents.

    Only the document frequencies and the packs of the asked documents are written. All documents are weighted where they are
    multiplied, so their weights are neither kept nor shuffled. Asked documents lie in chunks of their own. Their packs
    are broadcast; beyond `broadcast` bytes the packs of all documents are written once and meet a block of them at a time.
    """
    from textloom.operators.vectors import MOST_BYTES, PACK, TASK_PAIRS
    from textloom.sources.scratch import materialize

    spark, asked, kind = docs.sparkSession, F.coalesce(asked, F.lit(False)), dict(docs.dtypes)[key]
    each = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(each), F.lit(0)).alias("bytes"), F.count_if(asked).alias("asked"), F.coalesce(F.sum(F.when(asked, each)), F.lit(0)).alias("asked_bytes")).first()
    chunks, own = (max(1, -(-n // chunk)) for n in (size.bytes, size.asked_bytes))
    low = _chunked(docs, key, text, F.when(asked, F.pmod(F.xxhash64(key), F.lit(own)) + chunks).otherwise(F.pmod(F.xxhash64(key), F.lit(chunks))))
    send, answer, weigh = _frequencies(size.n, max(1, -(-size.bytes // PART)), frozenset(stopwords or []), most, pattern, max_df, min_df)
    back = materialize(spark, low.groupBy("_chunk").applyInArrow(send, SENT).groupBy("_part").applyInArrow(answer, ANSWERED))

    def packs(table, answers):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        keys, terms, row, code, _, _, weight = weigh(table, answers)
        hashes = pd.util.hash_array(np.array(terms, object), categorize=False).view(np.int64) if terms else np.zeros(0, np.int64)
        starts, made = np.searchsorted(row, np.arange(len(keys) + 1)), []
        for i in range(0, len(keys), PACK):
            j = min(i + PACK, len(keys))
            cells = slice(starts[i], starts[j])
            bounds = pa.array((starts[i : j + 1] - starts[i]).astype(np.int32))
            batch = pa.RecordBatch.from_pydict({"_key": pa.array(keys[i:j], table.schema.field("_key").type), "_h": pa.ListArray.from_arrays(bounds, pa.array(hashes[code[cells]])), "_w": pa.ListArray.from_arrays(bounds, pa.array(weight[cells]))})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            made.append(sink.getvalue().to_pybytes())
        first = -1 if not keys else table["_chunk"][0].as_py()
        return pa.table({"_n": pa.array([first * 10_000_000_000 + i for i in range(len(made))], pa.int64()), "_p": pa.array(made, pa.binary())})

    def packed(texts, answers, tasks):
        both = [x.repartition(tasks, "_chunk").groupBy("_chunk") for x in (texts, answers)]
        return both[0].cogroup(both[1]).applyInArrow(packs, "_n long, _p binary")

    q = materialize(spark, packed(low.where(F.col("_chunk") >= chunks), back.where(F.col("_chunk") >= chunks), own))
    blocks = max(1, -(-(q.agg(F.sum(F.octet_length("_p"))).first()[0] or 0) // (broadcast or MOST_BYTES)))
    r = packed(low, back, min(chunks + own, max(-(-chunks // 4), size.n * size.asked // TASK_PAIRS)))
    r = materialize(spark, r, back) if blocks > 1 else r

    def run(batches):
        last, held = (None, None), {}
        for batch in batches:
            for n, a, m, b in zip(*batch.columns, strict=True):
                if last[0] != m.as_py():
                    last = m.as_py(), sparse_pack(b.as_py())
                n = n.as_py()
                if n not in held:
                    held[n] = sparse_pack(a.as_py())
                yield from sparse_products(held[n], last[1])

    block = lambda i: q.where(F.pmod(F.xxhash64("_n"), F.lit(blocks)) == i).select("_n", F.col("_p").alias("_q"))
    rows = r.select(F.col("_n").alias("_m"), F.col("_p").alias("_r"))
    met = [rows.crossJoin(F.broadcast(block(i))).select("_n", "_q", "_m", "_r").mapInArrow(run, f"a {kind}, b {kind}, score double") for i in range(blocks)]
    return reduce(DataFrame.unionByName, met)


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", query: str = "query_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, key, score): Okapi BM25 with a smoothed positive idf; only documents that share a word with the query have a row."""
    words = T.split_words(F.lower(F.col(text)))
    asked = queries.select(query, F.explode(F.array_distinct(words)).alias("term"))
    stats = docs.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size(words)).alias("_avg"))  # one row
    # only words that are asked for leave the place where they are read, with the length of their document
    tokens = docs.select(key, words.alias("_w")).select(key, F.size("_w").alias("len"), F.explode("_w").alias("term"))
    tf = tokens.join(asked.select("term").distinct(), "term", "left_semi").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("_avg")))
    return asked.join(df, "term").join(tf, "term").join(F.broadcast(stats)).groupBy(query, key).agg(F.sum(part).alias("score"))


def edits(a: str, b: str) -> int:
    """Insertions, deletions and replacements between two strings."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def alike(a: str, b: str, similar: float) -> bool:
    """Whether 1 - edits / length of the longer one exceeds `similar`. Most pairs are told apart by their lengths, ends and letters, without counting edits."""
    longer = max(len(a), len(b))
    if a == b or longer - min(len(a), len(b)) >= (1 - similar) * longer:
        return a == b
    most = (1 - similar) * longer  # fewer edits than this
    if most <= 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i = 0
    while i < min(len(a), len(b)) and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if most <= 2 and max(len(a), len(b)) > 1:  # one edit leaves one letter at most
        return False
    # an edit changes two counts of letters at most
    if sum(abs(a.count(c) - b.count(c)) for c in {*a, *b}) >= 2 * most:
        return False
    return 1 - edits(a, b) / longer > similar


#: Words, ends of sentences, and other signs.
WORD = re.compile(r"[^\W\d_]\w*|[.!?\n]|\S")
LETTER = re.compile(r"[^\W\d_]").match
#: Characters of the texts that are worked on together.
TOGETHER = 500_000


def together(rows, most: int = TOGETHER):
    """Lists of (key, text) of about `most` characters."""
    some, size = [], 0
    for one, t in rows:
        some.append((one, t))
        size += len(t)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def keywords_of(text: str, stop: frozenset[str], most: int, top: int | None, similar: float) -> list[tuple[str, int, float]]:
    return keywords_of_all([text], stop, most, top, similar)[0]


def keywords_of_all(texts: list[str], stop: frozenset[str], most: int, top: int | None, similar: float) -> list[list[tuple[str, int, float]]]:
    """(candidate, tf, score) of each text, best (lowest) first; see keyword_scores(). Words of all texts are numbered together and counted in arrays."""
    import numpy as np

    number: dict[str, int] = {}
    codes, lengths = [], []
    for t in texts:
        found = WORD.findall(t)
        codes += [number.setdefault(w, len(number)) for w in found]
        lengths.append(len(found))
    out: list[list[tuple[str, int, float]]] = [[] for _ in texts]
    raw = list(number)
    is_word = np.array([LETTER(w) is not None for w in raw], bool)
    low_of: dict[str, int] = {}
    lows = np.array([low_of.setdefault(w.lower(), len(low_of)) for w in raw], np.int64)
    low = list(low_of)
    weak_of = np.array([w in stop or len(w) < 3 for w in low], bool)
    code, doc = np.array(codes, np.int64), np.repeat(np.arange(len(texts)), lengths)
    if not len(code) or not is_word[code].any():
        return out
    word, end = is_word[code], np.array([w in ".!?\n" for w in raw], bool)[code]
    first = np.ones(len(code), bool)
    first[1:] = doc[1:] != doc[:-1]
    begins = ~end & (first | np.r_[True, end[:-1]])  # signs alone are a sentence, too
    sentence = np.cumsum(begins)  # in all texts
    cut = first | ~np.r_[False, word[:-1]]  # a sign or a number between two words parts them
    at = np.flatnonzero(word)
    code, doc, sentence, cut = code[at], doc[at], sentence[at], cut[at]
    head = np.r_[True, sentence[1:] != sentence[:-1]]
    upper = np.array([len(w) > 1 and w.isupper() for w in raw], bool)[code]
    capital = np.array([w[0].isupper() for w in raw], bool)[code] & ~upper & ~head
    # a text's distinct words, numbered text by text
    names, g = np.unique(doc * len(low) + lows[code], return_inverse=True)
    own, name = names // len(low), names % len(low)
    starts = np.searchsorted(own, np.arange(len(texts)))
    tf, weak, n = np.bincount(g), weak_of[name], len(names)
    strong = (~weak).astype(float)
    per_text = lambda x: np.bincount(own, x, len(texts))
    with np.errstate(invalid="ignore", divide="ignore"):
        many = per_text(strong)
        mean = per_text(strong * tf) / many
        spread = np.sqrt(per_text(strong * (tf - mean[own]) ** 2) / many)
    highest = np.zeros(len(texts))
    np.maximum.at(highest, own, tf)
    last = np.zeros(len(texts), np.int64)
    before = np.r_[0, np.cumsum(begins)][np.cumsum(lengths) - lengths]  # sentences of earlier texts
    place = sentence - before[doc] - 1
    np.maximum.at(last, doc, place)
    wide = int(place.max()) + 1
    seen = np.unique(g * wide + place)
    spots = np.bincount(seen // wide, minlength=n)
    opens, seen = np.cumsum(spots) - spots, seen % wide
    middle = (seen[opens + (spots - 1) // 2] + seen[opens + spots // 2]) / 2
    joined = np.flatnonzero(~cut[1:])  # a word and the next one
    pairs, counts = np.unique(g[joined] * n + g[joined + 1], return_counts=True)
    share = lambda side: np.bincount(side, minlength=n) / np.maximum(1, np.bincount(side, counts, n))
    related = 1 + (share(pairs % n) + share(pairs // n)) * tf / highest[own]
    case = np.maximum(np.bincount(g, upper, n), np.bincount(g, capital, n)) / (1 + np.log(tf))
    with np.errstate(invalid="ignore", divide="ignore"):
        weight = np.log(np.log(3 + middle)) * related / (case + tf / (mean + spread)[own] / related + spots / (1 + last)[own] / related)
    count_of = lambda a, b: counts[np.searchsorted(pairs, a * n + b)]
    # candidates of 1 to `most` words: (text, first place, words, tf, score)
    chosen, run, at = [], np.arange(len(g)), g
    for k in range(1, most + 1):
        if k > 1:  # runs of k words, each a run of k - 1 and the next word
            on = run + k - 1 < len(g)
            on[on] = ~cut[run[on] + k - 1]
            run, at = run[on], np.unique(at[on] * n + g[run[on] + k - 1], return_inverse=True)[1] if on.any() else at[:0]
        if not len(run):
            break
        _, where, times = np.unique(at, return_index=True, return_counts=True)
        begin = run[where]
        good = ~weak[g[begin]] & ~weak[g[begin + k - 1]]
        begin, times = begin[good], times[good]
        product, total = np.ones(len(begin)), np.zeros(len(begin))
        for i in range(k):
            w = g[begin + i]
            inner = np.flatnonzero(weak[w])
            factor, plus = weight[w].copy(), weight[w].copy()
            if len(inner):  # a weak word inside counts by how often its neighbours go with it
                a, b, c = g[begin[inner] + i - 1], w[inner], g[begin[inner] + i + 1]
                chance = count_of(a, b) / tf[a] * count_of(b, c) / tf[c]
                factor[inner], plus[inner] = 2 - chance, chance - 1
            product, total = product * factor, total + plus
        chosen.append((doc[begin], begin, np.full(len(begin), k), times, np.round(product / (times * (total + 1)), 9)))
    doc_of, begin, size, times, score = (np.concatenate(x) for x in zip(*chosen, strict=True))
    by = np.lexsort((score, doc_of))
    doc_of, begin, size, times, score = doc_of[by], begin[by], size[by], times[by], score[by]
    edges = np.searchsorted(doc_of, np.arange(len(texts) + 1))
    spelled = lows[code]
    for d in range(len(texts)):
        i, kept = int(edges[d]), out[d]
        while i < edges[d + 1] and (top is None or len(kept) < top):
            j = i + int(np.searchsorted(score[i : edges[d + 1]], score[i], "right"))  # equal ones go by their words
            for words, x in sorted((" ".join([low[c] for c in spelled[begin[x] : begin[x] + size[x]].tolist()]), x) for x in range(i, j)):
                if top is not None and len(kept) >= top:
                    break
                if not any(alike(words, y, similar) for y, _, _ in kept):
                    kept.append((words, int(times[x]), float(score[x])))
            i = j
    return out


def keyword_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", stopwords: list[str] | None = None, most: int = 3, top: int | None = 20, similar: float = 0.9) -> DataFrame:
    """(key, word, tf, score, rank), the best `top` candidates of 1 to `most` words of each document, lower is better, after the published YAKE statistics.

    A word's weight comes from its casing, its place, frequency, relatedness to its neighbours and spread over sentences;
    a candidate's from the product of its words' weights, over its frequency and their sum; candidates neither begin nor
    end with a stopword or a word of fewer than three letters, and don't cross punctuation or numbers. A candidate goes
    if it is alike (edit distance) to a better one. All that is counted belongs to one document, so it is computed where
    the document is read: no shuffle. Null and blank texts have no row.
    """
    stop = frozenset(stopwords or [])

    def run(batches):
        import pyarrow as pa

        rows = ((one, t.as_py() or "") for batch in batches for one, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for some in together(rows):
            found = keywords_of_all([t for _, t in some], stop, most, top, similar)
            keys = [one for (one, _), own in zip(some, found, strict=True) for _ in own]
            if keys:
                words, tf, score = zip(*(x for own in found for x in own), strict=True)
                rank = [i for own in found for i in range(1, len(own) + 1)]
                yield pa.RecordBatch.from_pydict({key: pa.array(keys, pa.int64()), "word": pa.array(words, pa.string()), "tf": pa.array(tf, pa.int64()), "score": pa.array(score, pa.float64()), "rank": pa.array(rank, pa.int32())})

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} long, word string, tf long, score double, rank int")


def word_ranks(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 2, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6, stopwords: list[str] | None = None, top: int | None = None, places: int = 9) -> DataFrame:
    """(key, word, rank): PageRank over each document's graph of words that stand at most `window` apart, until a round moves less than `tolerance` in all (after `rounds` at the latest). With `top`, each document's best words by rank to `places` places, and by word, which then need not leave the task.

    A document's graph is as small as the document, so it is built and ranked where the document is read: no shuffle.
    """
    from textloom.operators.vectors import rounded

    stop = frozenset(stopwords or [])

    def ranked(lists):
        """(text, word, rank) of lists of words; the graphs of all lists lie side by side."""
        import numpy as np

        number: dict[str, int] = {}
        codes = np.array([number.setdefault(w, len(number)) for words in lists for w in words], np.int64)
        doc = np.repeat(np.arange(len(lists)), [len(words) for words in lists])
        names, g = np.unique(doc * max(1, len(number)) + codes, return_inverse=True)
        n = len(names)
        near = [(g[:-k], g[k:], (doc[k:] == doc[:-k]) & (g[k:] != g[:-k])) for k in range(1, window + 1)]
        a, b = (np.concatenate([x[i][x[2]] for x in near]) for i in (0, 1))
        edges, weight = np.unique(np.concatenate([a * n + b, b * n + a]), return_counts=True)
        a, b = edges // max(1, n), edges % max(1, n)
        share = weight / np.bincount(a, weight, n)[a]
        linked = np.flatnonzero(np.bincount(a, minlength=n) > 0)
        own = (names // max(1, len(number)))[linked]
        back = np.zeros(n, np.int64)
        back[linked] = np.arange(len(linked))
        a, b = back[a], back[b]
        size = np.bincount(own, minlength=len(lists))
        rank = 1.0 / np.maximum(1, size)[own]
        done = np.zeros(len(own))
        at, texts, base = np.arange(len(own)), own, ((1 - damping) / np.maximum(1, size))[own]
        for _ in range(rounds):
            last, rank = rank, base + damping * np.bincount(b, share * rank[a], len(rank))
            done[at] = rank
            moves = np.bincount(texts, np.abs(rank - last), len(lists)) >= tolerance
            stay = moves[texts]
            if not stay.all():  # a text that moves no more is left as it is
                new = np.cumsum(stay) - 1
                on = stay[a]
                a, b, share = new[a[on]], new[b[on]], share[on]
                at, texts, base, rank = at[stay], texts[stay], base[stay], rank[stay]
            if not len(at):
                break
        spelled, at = list(number), (names % max(1, len(number)))[linked]
        if top is not None:
            order = np.zeros(len(spelled), np.int64)
            order[sorted(range(len(spelled)), key=spelled.__getitem__)] = np.arange(len(spelled))
            by = np.lexsort((order[at], -rounded(done, places), own))
            by = by[np.arange(len(by)) - np.searchsorted(own, own[by]) < top]  # rows lie text by text
            own, at, done = own[by], at[by], done[by]
        return own, [spelled[c] for c in at.tolist()], done

    def run(batches):
        import pyarrow as pa

        find = re.compile("[a-z]{3,}").findall
        rows = ((one, t.as_py() or "") for batch in batches for one, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for some in together(rows):
            own, names, rank = ranked([[w for w in find(t) if w not in stop] for _, t in some])
            keys = pa.array([one for one, _ in some], pa.int64()).take(pa.array(own))
            yield pa.RecordBatch.from_pydict({key: keys, "word": pa.array(names, pa.string()), "rank": pa.array(rank)})

    return docs.select(F.col(key).cast("long").alias(key), F.lower(F.col(text)).alias("_text")).mapInArrow(run, f"{key} long, word string, rank double")
