"""Token ids in binary shards, with a minimal perfect hash index from document keys to places in them.

File format, two Parquet tables under one path (any file system that Spark reads; the commit protocol makes half-written
files of lost executors invisible):

payload  one row a chunk: shard, chunk, n_docs, n_tokens, doc_ids (int64, little-endian), known (a byte each, 0 for a
         document without an id, whose doc_id is a hash of its text), ends (uint32: tokens up to the end of each
         document), ids (raw uint16 or uint32, little-endian), width (2 or 4 bytes). Shards hold ascending, disjoint
         ranges of documents, chunks and documents ascend within them; documents without an id come last.
index    one row a hash bucket of document keys: levels (sizes of the hash function's levels, uint64), bits (their bit
         arrays, packed), ranks (set bits before each 512-bit block, uint32), and by the key's minimal perfect hash:
         fingerprints (uint32), shards, chunks (uint32), offsets, starts, lengths (uint64; in tokens).

A document's key is (doc_id, known, nth): nth counts the documents of one id from 0, in the order in which they are stored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import documents_of, id_out, scratch_path, shuffle_parts, shuffles_freed, text_steps
from textloom.llm.hashing import BASE_BYTES, BASE_WORDS, U, VALUES, inverse, mix, powers, prefix
from textloom.llm.repeats import spread

#: A chunk ends after so many tokens.
CHUNK_TOKENS = 1_000_000
#: Distinct words whose ids a Python worker remembers at most, and bytes of text that it encodes in one step.
CACHED_WORDS = 1_500_000
STEP = 8_000_000
#: Keys of one hash bucket of the index, about.
BUCKET_KEYS = 100_000
GAMMA = 1.5
LEVELS = 48
BLOCK = 512
#: Numbers of rows of one id that are made in one array.
NUMBERS = 65_536

#: Bytes that are letters, and punctuation marks but for the apostrophe.
LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
SIGN = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))

_encoders: dict[str, "Encoder"] = {}


class Clash(Exception):
    """Cuts that can't be told apart by their hashes."""


class Encoder:
    """Encodes with the tokenizers library; words that came before are not encoded anew.

    Only for byte-level tokenizers whose pre-tokenizer keeps a blank with the word behind it and a lone line feed by
    itself: there every blank or line feed between other characters starts a new piece, as does a punctuation mark other
    than an apostrophe behind a letter, and pieces are independent. So a text is cut before each of them, equal cuts are found by two 64-bit hashes, and each distinct one is encoded
    once. Texts where this might not hold (other white space, two blanks in a row, control characters, special tokens)
    are encoded whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.end = end_id
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        blank, feed = (self.tokenizer.id_to_token(self.ids(x)[0])[0] for x in (" a", "\n"))
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.opens = {b" ": np.array([n.startswith(blank) for n in names]), b"\n": np.array([n.startswith(feed) for n in names])}
        self.forget()

    def forget(self) -> None:
        self.known = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # hash, check, place, length
        self.pool = [np.zeros(0, self.kind)]
        self.pooled = 0

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def together(self, cuts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and lengths of cuts that all begin with a blank, or all with a line feed: encoded as one text, where only a cut's first token opens with that sign."""
        ids, lengths = [], []
        for at in range(0, len(cuts), 5000):
            own = self.ids(b"".join(cuts[at : at + 5000]).decode())
            begins = np.flatnonzero(self.opens[cuts[0][:1]][own])
            if len(begins) != len(cuts[at : at + 5000]):
                return self.apart(cuts)
            ids.append(own)
            lengths.append(np.diff(begins, append=len(own)))
        return ids, lengths

    def apart(self, cuts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and lengths of cuts, each encoded by itself."""
        ids = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast([c.decode() for c in cuts], add_special_tokens=False)]
        return ids, [np.array([len(x) for x in ids], np.int64)]

    def learn(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> None:
        raw, heads = data.tobytes(), data[begins]
        groups = [np.flatnonzero(heads == 32), np.flatnonzero(heads == 10), np.flatnonzero((heads != 32) & (heads != 10))]
        ids, lengths = [np.zeros(0, self.kind)], []
        for own in groups:
            cuts = [raw[a:b] for a, b in zip(begins[own].tolist(), ends[own].tolist(), strict=True)]
            more, sizes = self.together(cuts) if cuts and heads[own[0]] in (32, 10) else self.apart(cuts)
            ids += more
            lengths += sizes
        order, sizes = np.concatenate(groups), np.concatenate(lengths)
        places = self.pooled + np.cumsum(sizes) - sizes
        self.pool.append(np.concatenate(ids))
        self.pooled += int(sizes.sum())
        both = [np.concatenate(x) for x in zip(self.known, (hashes[order], checks[order], places, sizes), strict=True)]
        order = np.argsort(both[0], kind="stable")
        self.known = [x[order] for x in both]

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are known, and where in the table."""
        if not len(self.known[0]):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known[0], hashes), len(self.known[0]) - 1)
        met = self.known[0][at] == hashes
        if (self.known[1][at[met]] != checks[met]).any():
            raise Clash
        return met, at

    def cuttable(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that may be cut."""
        after = np.append(data[1:], 0)
        gap = (data == 32) | (data == 10)
        next_gap = np.append(gap[1:], False)
        inner = offsets[1:-1]
        next_gap[inner[(inner > 0) & (inner <= len(data))] - 1] = False
        bad = (data < 32) & (data != 10) | gap & next_gap | (data == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (data == 0xE1) & (after == 0x9A) | (data == 0xE2) & ((after == 0x80) | (after == 0x81)) | (data == 0xE3) & (after == 0x80)
        out = np.ones(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = False
        raw = data.tobytes()
        for sign in self.added:
            at = raw.find(sign)
            while at >= 0:
                out[np.searchsorted(offsets, at, "right") - 1] = False
                at = raw.find(sign, at + 1)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind, and where each text's ids end."""
        try:
            return self.encode_cuts(data, offsets)
        except Clash:
            self.forget()
            end = np.array([self.end], self.kind)
            parts = [np.concatenate([self.ids(data[a:b].tobytes().decode()), end]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.concatenate([np.zeros(0, self.kind), *parts]), np.cumsum([len(x) for x in parts], dtype=np.int64)

    def encode_cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        plain = self.cuttable(data, offsets)
        sizes = np.diff(offsets)
        start = np.zeros(len(data) + 1, bool)
        start[:-1] = (data == 32) | (data == 10)
        start[1:-1] |= LETTER[data[:-1]] & SIGN[data[1:]]
        start[offsets[:-1][sizes > 0]] = True
        begins = np.flatnonzero(start[:-1])
        owner = np.searchsorted(offsets, begins, "right") - 1
        ends = np.append(begins[1:], len(data))
        own = plain[owner]
        begins, ends, owner = begins[own], ends[own], owner[own]
        hashes, checks = (
            mix((p[ends] - p[begins]) * powers(inverse(base), max(1, len(data)))[begins] + (ends - begins).astype(np.uint64))
            for base in (BASE_BYTES, BASE_WORDS)
            for p in (prefix(VALUES[data], base),)
        )
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        if (checks != checks[first][number]).any():
            raise Clash
        if len(self.known[0]) > CACHED_WORDS:
            self.forget()
        met, at = self.find(hashes[first], checks[first])
        if not met.all():
            fresh = first[~met]
            self.learn(data, begins[fresh], ends[fresh], hashes[fresh], checks[fresh])
            _, at = self.find(hashes[first], checks[first])
        if len(self.pool) > 1:
            self.pool = [np.concatenate(self.pool)]
        places, lengths = self.known[2][at][number], self.known[3][at][number]
        counts = np.bincount(owner, lengths, n).astype(np.int64)
        whole = {}
        for i in np.flatnonzero(~plain).tolist():
            whole[i] = self.ids(data[offsets[i] : offsets[i + 1]].tobytes().decode())
            counts[i] = len(whole[i])
        stops = np.cumsum(counts + 1)
        out = np.full(int(stops[-1]) if n else 0, self.end, self.kind)
        if len(owner):
            before = np.cumsum(lengths) - lengths
            of_text = np.zeros(n, np.int64)
            heads = np.concatenate([[True], owner[1:] != owner[:-1]])
            of_text[owner[heads]] = before[heads]
            target = (stops - counts - 1)[owner] + before - of_text[owner]
            which, inside = spread(lengths)
            out[target[which] + inside] = self.pool[0][places[which] + inside]
        for i, x in whole.items():
            out[stops[i] - 1 - len(x) : stops[i] - 1] = x
        return out, stops


def encoder(path: str, end_id: int) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, end_id)
    return _encoders[path]


PAYLOAD = "shard int, chunk int, n_docs long, n_tokens long, width int, doc_ids binary, known binary, ends binary, ids binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shards: int | None = None) -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes payload and index under `path`.

    Documents are dealt to shards by ranges of (doc_id, hash of the text), those without an id last, and sorted within
    them; rows of one id, or equal ones, may be dealt to several shards.
    """
    spark = docs.sparkSession
    parts = shards or shuffle_parts(spark)

    def run(batches):
        own = encoder(tokenizer, end_id)
        shard = TaskContext.get().partitionId()
        chunk, held, tokens = 0, [], 0

        def row():
            keys, known, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "chunk": chunk, "n_docs": len(keys), "n_tokens": len(ids), "width": own.kind.itemsize, "doc_ids": keys.astype("<i8").tobytes(), "known": known.astype(np.uint8).tobytes(), "ends": np.cumsum(lengths).astype("<u4").tobytes(), "ids": ids.tobytes()}],
                schema,
            )

        for batch in batches:
            keys, known = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_steps(batch, step=STEP):
                ids, stops = own.encode(data, offsets)
                lengths = np.diff(stops, prepend=0)
                at = 0
                while at < last - first:  # chunks end with a document
                    room = np.searchsorted(stops, (stops[at - 1] if at else 0) + CHUNK_TOKENS - tokens)
                    upto = min(last - first, max(at + 1, int(room)))
                    begin = int(stops[at - 1]) if at else 0
                    held.append((keys[first + at : first + upto], known[first + at : first + upto], lengths[at:upto], ids[begin : int(stops[upto - 1])]))
                    tokens += int(stops[upto - 1]) - begin
                    at = upto
                    if tokens >= CHUNK_TOKENS or at < last - first:
                        yield row()
                        chunk, held, tokens = chunk + 1, [], 0
        if held:
            yield row()

    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.binary()), ("known", pa.binary()), ("ends", pa.binary()), ("ids", pa.binary())])
    rows = documents_of(docs).select((~F.col("known")).alias("unknown"), "doc_id", "tag", "text", F.monotonically_increasing_id().alias("_row"))
    dealt = rows.repartitionByRange(parts, "unknown", "doc_id", "tag", "_row").sortWithinPartitions("unknown", "doc_id", "tag")
    with shuffles_freed(spark):
        dealt.select("doc_id", ~F.col("unknown"), "text").mapInArrow(run, PAYLOAD).write.option("compression", "zstd").parquet(f"{path}/payload")
        _index(spark, path).write.parquet(f"{path}/index")


def payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).parquet(f"{path}/payload")


def chunk_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, chunk, first): tokens before each chunk. A sum over shards, of which there are as many as write() had partitions, and one over each shard's chunks."""
    sizes = payload(spark, path).select("shard", "chunk", "n_tokens")
    in_order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("_n")).select("shard", F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(shards, "shard").select("shard", "chunk", (F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("first"))


def _stored(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, whether they are known, begins and ends of a chunk's documents."""
    ends = np.frombuffer(r["ends"], "<u4").astype(np.int64)
    return np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["known"], np.uint8) == 1, np.concatenate([[0], ends[:-1]]), ends


def _same_before(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How many documents of the same id stand right before each."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])
    heads = np.flatnonzero(new)
    return np.arange(len(ids)) - heads[np.cumsum(new) - 1]


def _places(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, known, nth, shard, chunk, offset, n_tokens, start) of every stored document."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, known, begins, ends = _stored(r)
                same = _same_before(ids, known)
                head = np.arange(len(ids)) == same  # of the chunk's first id, of which the chunk before may have more
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids, "known": known, "same": same, "head": head, "shard": np.full(len(ids), r["shard"], np.int32), "chunk": np.full(len(ids), r["chunk"], np.int32),
                    "offset": begins, "n_tokens": ends - begins,
                })

    def edges(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, known, _, _ = _stored(r)
                same = _same_before(ids, known)
                first = int((np.arange(len(ids)) == same).sum())
                rows = [(ids[0], known[0], first, True)] + [(ids[-1], known[-1], int(same[-1]) + 1, False)] * (first < len(ids))
                a, b, c, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(a, pa.int64()), "known": pa.array(b, pa.bool_()), "n": pa.array(c, pa.int64()), "head": pa.array(d), "shard": pa.array([r["shard"]] * len(rows), pa.int32()), "chunk": pa.array([r["chunk"]] * len(rows), pa.int32())})

    chunks = payload(spark, path).select("shard", "chunk", "doc_ids", "known", "ends")
    place = "shard int, chunk int"
    stored = chunks.mapInArrow(run, f"doc_id long, known boolean, same long, head boolean, {place}, offset long, n_tokens long")
    # two rows a chunk at most: ids that go on from one chunk to the next
    ends = chunks.mapInArrow(edges, f"doc_id long, known boolean, n long, head boolean, {place}")
    earlier = Window.partitionBy("doc_id", "known").orderBy("shard", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carry", F.sum("n").over(earlier)).where("head and carry > 0").select("shard", "chunk", "carry")
    whole = stored.join(chunk_starts(spark, path).join(carried, ["shard", "chunk"], "left"), ["shard", "chunk"])
    nth = F.col("same") + F.when(F.col("head"), F.coalesce("carry", F.lit(0))).otherwise(0)
    return whole.select("doc_id", "known", nth.cast("long").alias("nth"), "shard", "chunk", "offset", "n_tokens", (F.col("first") + F.col("offset")).alias("start"))


def _key_hash(ids: np.ndarray, rest: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(ids ^ U((seed * 0x9E3779B97F4A7C15 + 1) % 2**64)) + rest * U(0xD6E8FEB86659FD93))


def _level_hash(ids: np.ndarray, rest: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_key_hash(ids, rest, level) % U(size)).astype(np.int64)


def fingerprint(ids: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (_key_hash(ids, rest, LEVELS) >> U(32)).astype(np.uint32)


def build(ids: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels, packed bits and ranks of a minimal perfect hash function of distinct keys (two 64-bit numbers each): a level's bit is set where one key alone falls; the others go on to the next level."""
    sizes, bits = [], []
    for level in range(LEVELS):
        if not len(ids):
            break
        size = max(64, int(len(ids) * GAMMA) + 63 & ~63)
        at = _level_hash(ids, rest, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        ids, rest = ids[~alone[at]], rest[~alone[at]]
    if len(ids):
        raise ValueError("keys are not distinct")
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    flat = np.concatenate([flat, np.zeros(-len(flat) % BLOCK, bool)])
    ranks = np.concatenate([[0], np.cumsum(flat.reshape(-1, BLOCK).sum(1))])[:-1] if len(flat) else np.zeros(0)
    return np.array(sizes, np.uint64), np.packbits(flat, bitorder="little"), ranks.astype(np.uint32)


def slots(ids: np.ndarray, rest: np.ndarray, levels: np.ndarray, bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The minimal perfect hash of each key, -1 where no level takes it: one bit a level, then a rank within one block."""
    out = np.full(len(ids), -1, np.int64)
    todo, base = np.arange(len(ids)), 0
    for level, size in enumerate(levels.tolist()):
        at = base + _level_hash(ids[todo], rest[todo], level, size)
        hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        found, places = todo[hit], at[hit]
        blocks = places // BLOCK
        words = bits.reshape(-1, BLOCK // 8)[blocks]
        inside = np.unpackbits(words, axis=1, bitorder="little")
        out[found] = ranks[blocks].astype(np.int64) + (inside * (np.arange(BLOCK) < (places % BLOCK)[:, None])).sum(1)
        todo, base = todo[~hit], base + size
    return out


def _bucket(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", "known", "nth"), F.lit(buckets)).cast("int")


def _keys(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rest = pdf["nth"].to_numpy(np.int64) * 2 + pdf["known"].to_numpy(bool)
    return pdf["doc_id"].to_numpy(np.int64).view(np.uint64), rest.view(np.uint64)


INDEX = "bucket int, buckets int, n long, levels binary, bits binary, ranks binary, fingerprints binary, shards binary, chunks binary, offsets binary, starts binary, lengths binary"


def _index(spark: SparkSession, path: str) -> DataFrame:
    """The index table; buckets follow from the number of keys."""
    keys = payload(spark, path).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first().n
    buckets = max(1, -(-int(keys) // BUCKET_KEYS))

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, rest = _keys(pdf)
        levels, bits, ranks = build(ids, rest)
        at = np.argsort(slots(ids, rest, levels, bits, ranks))
        pdf = pdf.iloc[at]
        packed = {"levels": levels, "bits": bits, "ranks": ranks, "fingerprints": fingerprint(ids[at], rest[at])}
        packed |= {"shards": pdf["shard"].to_numpy(np.uint32), "chunks": pdf["chunk"].to_numpy(np.uint32), "offsets": pdf["offset"].to_numpy(np.uint64)}
        packed |= {"starts": pdf["start"].to_numpy(np.uint64), "lengths": pdf["n_tokens"].to_numpy(np.uint64)}
        return pd.DataFrame([{"bucket": key[0], "buckets": buckets, "n": len(ids)} | {k: v.tobytes() for k, v in packed.items()}])

    return _places(spark, path).withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(one, INDEX)


def keys_of(docs: DataFrame) -> DataFrame:
    """(doc_id, known, nth): the keys under which write() stores documents."""
    counted = documents_of(docs).groupBy("doc_id", "known").agg((F.count(F.lit(1)) - 1).alias("_last"))
    # a frequent key's numbers come from arrays of bounded length
    blocks = counted.select("doc_id", "known", "_last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"), F.lit(NUMBERS).cast("long"))).alias("_from"))
    return blocks.select("doc_id", "known", F.explode(F.sequence("_from", F.least(F.col("_from") + (NUMBERS - 1), F.col("_last")))).alias("nth"))


PLACE = "doc_id long, known boolean, nth long, shard int, chunk int, offset long, start long, n_tokens long"


def lookup(spark: SparkSession, path: str, keys: DataFrame, strict: bool = False) -> DataFrame:
    """Places (doc_id, known, nth, shard, chunk, offset, start, n_tokens) of the distinct keys that are stored: hash bucket, minimal perfect hash, fingerprint, place.

    keys: (doc_id) or (doc_id, known, nth); the former means the first document with that id. `strict`: a key that the
    index does not know is an error.
    """
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    found = index.select("buckets").first()
    buckets = found.buckets if found else 1
    if "nth" not in keys.columns:
        keys = keys.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("known"), F.lit(0).cast("long").alias("nth")).distinct()
    names = [c.split()[0] for c in PLACE.split(", ")]

    def one(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        known = np.zeros(len(asked), bool)
        out = pd.DataFrame({n: pd.Series(dtype=bool if n == "known" else np.int64) for n in names})
        if len(asked) and len(index):
            r = index.iloc[0]
            read = lambda c, t: np.frombuffer(r[c], t)
            ids, rest = _keys(asked)
            levels, bits, ranks = read("levels", np.uint64), read("bits", np.uint8), read("ranks", np.uint32)
            if int(levels.sum()) > 8 * len(bits) or BLOCK * len(ranks) != 8 * len(bits):
                raise ValueError(f"the index says that bucket {r['bucket']} has other levels than bits")
            slot = slots(ids, rest, levels, bits, ranks)
            known = (slot >= 0) & (slot < r["n"])
            known[known] = read("fingerprints", np.uint32)[slot[known]] == fingerprint(ids[known], rest[known])
            at = slot[known]
            kinds = {"shard": ("shards", np.uint32), "chunk": ("chunks", np.uint32), "offset": ("offsets", np.uint64), "start": ("starts", np.uint64), "n_tokens": ("lengths", np.uint64)}
            out = asked.loc[known, ["doc_id", "known", "nth"]].reset_index(drop=True)
            for n, (c, t) in kinds.items():
                out[n] = read(c, t)[at].astype(np.int64)
        if strict and not known.all():
            raise ValueError(f"the index lacks {int((~known).sum())} of {len(known)} keys")
        return out[names]

    wanted = keys.select("doc_id", "known", "nth").withColumn("bucket", _bucket(buckets))
    return wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(one, PLACE)


def fetch(spark: SparkSession, path: str, places: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, known, nth, shard, chunk, offset, start, n_tokens, ids_crc32[, ids]): the raw ids at each place, cut out of its chunk by offset and length.

    What stands there must be the document that the place is said to hold, in id and length, and its start must be that
    of the chunk and the offset, from the sizes of the chunks; anything else is an error.
    Places are packed by chunk (as many as a chunk has documents), and each chunk is read once.
    """
    names = ["doc_id", "known", "nth", "offset", "start", "n_tokens"]
    packed = places.groupBy("shard", "chunk").agg(F.collect_list(F.struct(*names)).alias("_asked"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in ("shard", "chunk", "width", "doc_ids", "known", "ends", "ids", "first")}
                if r["ids"] is None:
                    raise ValueError(f"the index says that there is a chunk {r['chunk']} in shard {r['shard']}")
                ids, known, begins, ends = _stored(r)
                asked = dict(zip(names, batch.column("_asked")[i].values.flatten(), strict=True))
                offset, length = asked["offset"].to_numpy(), asked["n_tokens"].to_numpy()
                at = np.searchsorted(begins, offset)
                right = (at < len(begins)) & (length > 0)
                at = np.where(right, at, 0)
                right &= (begins[at] == offset) & (ends[at] - begins[at] == length) & (ids[at] == asked["doc_id"].to_numpy()) & (known[at] == asked["known"].to_numpy(zero_copy_only=False))
                right &= asked["start"].to_numpy() == offset + r["first"]
                if not right.all():
                    raise ValueError(f"shard {r['shard']}, chunk {r['chunk']}: {int((~right).sum())} places don't hold what the index says")
                wide = np.frombuffer(r["ids"], "<u2" if r["width"] == 2 else "<u4").astype("<u4")
                parts = [wide[a:b] for a, b in zip(offset.tolist(), (offset + length).tolist(), strict=True)]
                columns = [asked["doc_id"], asked["known"], asked["nth"], pa.array(np.full(len(offset), r["shard"], np.int32)), pa.array(np.full(len(offset), r["chunk"], np.int32)), asked["offset"], asked["start"], asked["n_tokens"], pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array(parts, pa.list_(pa.uint32())).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "known", "nth", "shard", "chunk", "offset", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    schema = "doc_id long, known boolean, nth long, shard int, chunk int, offset long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    chunks = payload(spark, path).select("shard", "chunk", "width", "doc_ids", "known", "ends", "ids")
    return packed.join(chunks.join(chunk_starts(spark, path), ["shard", "chunk"]), ["shard", "chunk"], "left").mapInArrow(run, schema)


def read_back(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, chunk, offset) of the keys (keys_of()), all of which must be stored: places come from the index, and the ids from those places of the files."""
    rows = fetch(spark, path, lookup(spark, path, keys, strict=True), with_ids=False)
    return rows.select(id_out().alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard", "chunk", "offset")


def digest(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes all documents to the shared folder and reads each back through the index. Null texts have the end id alone; repeated rows and rows without an id are all stored; an empty table gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write(docs, path, tokenizer, end_id)
    return read_back(spark, path, keys_of(docs))
