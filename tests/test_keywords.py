"""The batched keyword statistics against the plain computation of one text."""

import math
import random
import re
from collections import Counter
from statistics import median

from textloom.operators import lexical
from textloom.operators.lexical import alike

SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]\w*")


def plain(text: str, stop: frozenset[str], most: int, top: int | None, similar: float) -> list[tuple[str, int, float]]:
    """(candidate, tf, score) of one text, best (lowest) first; see keyword_scores()."""
    chunks, sentence_no, heads = [], [], []
    for no, sentence in enumerate(s for s in SENTENCE.split(text) if s.strip()):
        end = None
        for m in WORD.finditer(sentence):
            if end is None or sentence[end : m.start()].strip():  # a sign or a number between two words parts them
                chunks.append([])
                sentence_no.append(no)
                heads.append(end is None)
            chunks[-1].append(m[0])
            end = m.end()
    sentences = 1 + max(sentence_no, default=0)
    tf, capital, acronym, where, pairs = Counter(), Counter(), Counter(), {}, Counter()
    left, right = {}, {}
    low = [[w.lower() for w in chunk] for chunk in chunks]
    for chunk, words, no, head in zip(chunks, low, sentence_no, heads, strict=True):
        tf.update(words)
        pairs.update(zip(words, words[1:], strict=False))
        for i, (raw, w) in enumerate(zip(chunk, words, strict=True)):
            where.setdefault(w, []).append(no)
            if len(raw) > 1 and raw.isupper():
                acronym[w] += 1
            elif raw[0].isupper() and not (head and i == 0):
                capital[w] += 1
    for (a, b), n in pairs.items():
        right.setdefault(a, []).append(n)
        left.setdefault(b, []).append(n)
    weak = {w for w in tf if w in stop or len(w) < 3}
    counts = [n for w, n in tf.items() if w not in weak]
    if not counts:
        return []
    mean = sum(counts) / len(counts)
    spread = math.sqrt(sum((n - mean) ** 2 for n in counts) / len(counts))
    highest = max(tf.values())
    share = lambda x: len(x) / sum(x) if x else 0.0
    weight = {}
    for w, n in tf.items():
        if w not in weak:
            related = 1 + (share(left.get(w)) + share(right.get(w))) * n / highest
            place = math.log(math.log(3 + median(set(where[w]))))
            case = max(acronym[w], capital[w]) / (1 + math.log(n))
            weight[w] = place * related / (case + n / (mean + spread) / related + len(set(where[w])) / sentences / related)
    found: Counter = Counter()
    for words in low:
        for i, w in enumerate(words):
            if w not in weak:
                for j in range(i + 1, min(i + most, len(words)) + 1):
                    if words[j - 1] not in weak:
                        found[tuple(words[i:j])] += 1
    scored = []
    for words, n in found.items():
        product, total = 1.0, 0.0
        for i, w in enumerate(words):
            if w in weak:  # a weak word inside counts by how often its neighbours go with it
                chance = pairs[words[i - 1], w] / tf[words[i - 1]] * pairs[w, words[i + 1]] / tf[words[i + 1]]
                product *= 2 - chance
                total -= 1 - chance
            else:
                product *= weight[w]
                total += weight[w]
        scored.append((round(product / (n * (total + 1)), 9), " ".join(words), n))
    out: list[tuple[str, int, float]] = []
    for score, words, n in sorted(scored):
        if top is not None and len(out) >= top:
            break
        if not any(alike(words, x, similar) for x, _, _ in out):
            out.append((words, n, score))
    return out


def test_keywords_of_many_texts():
    r = random.Random(4)
    signs = [" ", " ", " ", " ", ", ", ". ", "\n", " 3 ", "! ", " - ", "_", "  "]
    listed = ["alpha", "Beta", "GAMMA", "the", "of", "data", "Data", "delta9", "x", "Épée", "design", "pattern", "Patterns", "b2b", "ß", "AI", "²x", "x²"]
    texts = ["", " ", "...", "1 2 3", "the of", "alpha"] + ["".join(r.choice(listed) + r.choice(signs) for _ in range(r.randrange(1, 80))) for _ in range(300)]
    stop = frozenset({"the", "of"})
    for most, top in ((3, 20), (4, None), (1, 5)):
        got = lexical.keywords_of_all(texts, stop, most, top, 0.9)
        for t, rows in zip(texts, got, strict=True):
            wanted = plain(t, stop, most, top, 0.9)
            assert [x[:2] for x in rows] == [x[:2] for x in wanted], t
            assert all(abs(x[2] - y[2]) < 2e-9 for x, y in zip(rows, wanted, strict=True))


def test_best_word_ranks(spark):
    """The best words of each text are those of ranking all, and no others leave the task; texts in one batch don't meet."""
    from pyspark.sql import functions as F

    r = random.Random(5)
    listed = ["alpha", "beta", "gamma", "delta", "omega", "data", "design", "the"]
    texts = [(i, " ".join(r.choice(listed) for _ in range(r.randrange(0, 40)))) for i in range(60)] + [(60, None), (61, "alpha alpha"), (62, "one two")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows = lambda x: [(a.doc_id, a.word, round(a.rank, 9)) for a in x.collect()]
    whole = rows(lexical.word_ranks(df, stopwords=["the"]))
    alone = [x for one in texts[:20] for x in rows(lexical.word_ranks(df.where(F.col("doc_id") == one[0]), stopwords=["the"]))]
    assert sorted(alone) == sorted(x for x in whole if x[0] < 20)
    wanted = [x for i, _ in texts for x in sorted((x for x in whole if x[0] == i), key=lambda x: (-x[2], x[1]))[:3]]
    assert sorted(rows(lexical.word_ranks(df, stopwords=["the"], top=3))) == sorted(wanted) and wanted
