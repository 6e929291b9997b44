"""Fill-in-the-middle rows: texts cut at two code points, found by rank and select over a packed vector of character boundaries."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import text_steps

#: Bits of the vector that one entry of the directory counts: eight words of 64.
BLOCK = 512
WORDS = BLOCK // 64


class Boundaries:
    """A bit for each byte, set where a character begins, and a directory of the bits set before each block."""

    def __init__(self, data: np.ndarray) -> None:
        packed = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        words = np.zeros((len(data) // BLOCK + 1) * WORDS, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words.reshape(-1, WORDS)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Bits set before each byte: the directory's entry of its block, whole words, and a part of one."""
        block, inside = at // BLOCK, at % BLOCK
        words = self.words[block]
        word = inside // 64
        whole = (np.bitwise_count(words) * (np.arange(WORDS) < word[:, None])).sum(1, dtype=np.int64)
        part = words[np.arange(len(at)), word] & ((np.uint64(1) << (inside % 64).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + whole + np.bitwise_count(part)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The byte of each nth bit set, from 0: a search in the directory, then within its block."""
        block = np.searchsorted(self.before, nth, "right") - 1
        left = nth - self.before[block]
        upto = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        word = (upto <= left[:, None]).sum(1)
        row = np.arange(len(nth))
        left = left - np.where(word > 0, upto[row, word - 1], 0)
        bits = np.unpackbits(self.words[block, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * BLOCK + word * 64 + np.argmax(np.cumsum(bits, axis=1, dtype=np.int64) > left[:, None], axis=1)


@dataclass(frozen=True)
class Rule:
    """Sentinels, percents of texts that stay plain and of the others that have the suffix first, and the seed of all draws."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain: int = 10
    suffix_first: int = 20
    seed: int = 1

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(rule: Rule, doc_id: int | None, text: bytes) -> list[int]:
    """Four numbers of 32 bits from the seed and the id; from the seed and the text where there is no id."""
    name = hashlib.sha256(text).hexdigest() if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{rule.seed}:{name}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4)]


OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each document: its characters, how it is written (plain, psm or spm), the lengths of prefix and middle in characters (null if plain), and the text with its parts in that order behind their sentinels.

    Texts are worked on by themselves, about 2 MB at a time: no shuffle. A text that is empty or holds a sentinel stays
    plain. A null text is an empty one; a row without an id draws by its text; repeated rows give a row each; other
    columns are ignored; an empty table gives an empty result.
    """
    marks = [s.encode() for s in rule.sentinels]
    p, s, m = marks
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())]

    def run(batches):
        for batch in batches:
            for row, last, data, offsets in text_steps(batch):
                bits = Boundaries(data)
                ranks = bits.rank(offsets)
                begins, n = ranks[:-1], np.diff(ranks)
                ids = batch.column(0)[row:last].to_pylist()
                whole = data.tobytes()
                texts = [whole[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                h = np.array([draws(rule, i, t) for i, t in zip(ids, texts, strict=True)], np.int64)
                one, two = np.sort(h[:, :2] % (n + 1)[:, None], axis=1).T
                plain = np.array([not t or any(x in t for x in marks) for t in texts]) | (h[:, 2] % 100 >= 100 - rule.plain)
                first = h[:, 3] % 100 < rule.suffix_first
                cuts = []
                for k in (one, two):
                    inside = (k > 0) & (k < n)
                    at = np.where(k > 0, offsets[1:], offsets[:-1]) - offsets[:-1]
                    at[inside] = bits.select((begins + k)[inside]) - offsets[:-1][inside]
                    cuts.append(at.tolist())
                outputs = [
                    t if x else (s + t[b:] + p + t[:a] + m + t[a:b] if y else p + t[:a] + s + t[b:] + m + t[a:b])
                    for t, x, y, a, b in zip(texts, plain.tolist(), first.tolist(), *cuts, strict=True)
                ]
                form = np.where(plain, "plain", np.where(first, "spm", "psm"))
                columns = [pa.array(ids, pa.int64()), pa.array(n), pa.array(form.tolist()), pa.array(one, mask=plain), pa.array(two - one, mask=plain), pa.array(outputs, pa.large_binary()).view(pa.large_string())]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, OUT)


def restored(output: F.Column, form: F.Column, rule: Rule = Rule()) -> F.Column:
    """The text that an output of transform() was made of. No part holds a sentinel, and none can arise where parts meet."""
    p, s, m = rule.sentinels
    middle = F.substring_index(output, m, -1)

    def part(mark: str, upto: str) -> F.Column:
        return F.substring_index(F.substring_index(output, mark, -1), upto, 1)

    return F.when(form == "plain", output).when(form == "psm", F.concat(part(p, s), middle, part(s, m))).otherwise(F.concat(part(p, m), middle, part(s, p)))


def digest(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Rows of the contract: transform() with digests of its outputs and of the texts that restored() makes of them."""
    rows = transform(docs, rule)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"), rule)).alias("restored_sha256"))
