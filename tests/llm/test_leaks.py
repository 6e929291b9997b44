"""Benchmark decontamination against a plain rendering of its rule, and its recall on re-parameterised word problems."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
import regex
from test_llm import IDENTITY, ODD, frame, prose

from textloom.llm import decontaminate

DROP = str.maketrans("", "", decontaminate.DROPPED)


def read(text, names=True):
    """Words, with typed placeholders that carry their values."""
    marked = text.translate(str.maketrans("", "", "<>="))
    if names:
        marked = regex.sub(decontaminate.NAME, r"<name=\g<0>>", marked)
    if regex.search("[0-9]", text):
        marked = regex.sub(decontaminate.UNIT, r"\1\2<unit=\3>", regex.sub(decontaminate.NUMBER, r"<num=\g<0>>", marked))
    return [w for w in regex.split(decontaminate.BLANKS, marked.lower().translate(DROP)) if w]


def bare(words):
    return tuple(regex.sub("=[^>]*>", ">", w) for w in words)


def cut(words, width):
    return [(i, tuple(words[i : i + width])) for i in range(len(words) - width + 1)]


def item_windows(text, width):
    """(variant, strict, windows, {template: [(position, values)]})."""
    w0, out = read(text), []
    if not w0:
        return out
    word = regex.sub("^<name=([^>]*)>", r"\1", w0[0])
    name = w0[0] if w0[0].startswith("<") else f"<name={w0[0]}>"
    forms = {0: [w0, [word, *w0[1:]], [name, *w0[1:]]]}
    if any(w.startswith("<name") for w in w0):
        forms[1] = [read(text, names=False)]
    for variant, lists in forms.items():
        rows = {x for w in lists for x in (cut(w, width) if len(w) >= width else [(0, tuple(w))])}
        strict = {x: sum(not k.startswith("<") for k in bare(x[1])) < decontaminate.LITERALS for x in rows}
        only = min(strict.values())
        rows = {x for x in rows if strict[x] == only}
        by_key = {}
        for p, vals in rows:
            by_key.setdefault(bare(vals), []).append((p, vals))
        out.append((variant, only, len({p for p, _ in rows}), by_key))
    return out


def stretch_best(found, windows, share):
    """(matched, slots) of the windows (position, place) of one stretch, or None."""
    count = {}
    for _, at in found:
        count[at] = count.get(at, 0) + 1
    main = -max((n, -at) for at, n in count.items())[1]
    near = {}
    for (p, at), (same, slots) in found.items():
        near[p] = min(near.get(p, (math.inf,)), (abs(at - main), at, same, slots))
    votes = {}
    for _, _, _, slots in near.values():
        for z in set(slots):
            votes[z] = votes.get(z, 0) + 1
    most = {}
    for (i, d), n in votes.items():
        most[i] = max(most.get(i, (0,)), (n, i == d, d))
    ok = {p: all(most[i][2] == d for i, d in x[3]) for p, x in near.items()}
    score = lambda chosen: (len(chosen), len({i for p in chosen for i, _ in near[p][3]}))
    best = max(score([p for p in near if ok[p]]), score([p for p in near if near[p][2]]))
    return best if best[0] >= share * windows else None


def brute(docs, items, width=5, share=0.8):
    out = []
    texts = {(i, t) for i, t in items if t is not None}
    forms = {x: item_windows(x[1], width) for x in texts}
    for doc, text in {(d, t) for d, t in docs if t is not None}:
        words = read(text)
        cuts = {size: [(q, v, bare(v)) for q, v in cut(words, size)] for size in {len(k) for f in forms.values() for x in f for k in x[3]}}
        for item in texts:
            best = None
            for _, strict, windows, by_key in forms[item]:
                hits = [(q, v, p, vals) for size in {len(k) for k in by_key} for q, v, b in cuts[size] for p, vals in by_key.get(b, ())]
                if len({p for _, _, p, _ in hits}) < share * windows:
                    continue
                places = {}
                for q, v, p, vals in hits:
                    slots = [(i, d) for i, d in zip(vals, v, strict=True) if i.startswith("<")]
                    same = all(i == d for i, d in slots)
                    if same or not strict:
                        places[p, q - p] = max(places.get((p, q - p), (False, [])), (same, slots))
                stretches = {}
                for (p, at), x in places.items():
                    for key in ((0, math.floor(at / windows)), (1, math.floor(at / windows + 0.5)), (2, at)):
                        stretches.setdefault(key, {})[p, at] = x
                for found in stretches.values():
                    got = stretch_best(found, windows, share)
                    if got:
                        row = (got[0] / windows, got[0], windows, got[1])
                        best = row if best is None else max(best, row)
            if best:
                out.append((doc, item[0], best[2], best[1], best[0], best[3]))
    return sorted(out, key=repr)


NAMES = "Natalia Marcus Priya Tom Wei Fatima Olga Diego Aiko Lars Zoe Emil Nora Ivan Ruth Hugo".split()
THINGS = "clips apples stickers marbles books coins shells cards stamps pencils".split()
UNITS = ("kg", "km", "hours", "dollars", "miles", "grams")


def problem(r):
    """A word problem of several sentences, most of which begin with a name, as a template and the values for it."""
    a, b = r.choice(THINGS), r.choice(THINGS)
    extra = prose(r.randrange(10**6), r.randrange(3, 9))
    return (
        r.choice([
            "{A} sold {n} " + a + " to friends in spring. {A} then sold half as many " + b + ". {B} bought {m} of them near " + extra + ". How many does {A} have left?",
            "{A} walks {n} {u} to " + extra + " each day. {B} walks {m} {u} more than {A}. {C} drives back. What do {A} and {B} walk in all?",
            "On a farm near " + extra + " {A} packs {n} {u} of " + a + ". {B} eats {m} of the " + b + " at noon. {A} packs {m} more. How much is there at night?",
        ])
    )


def filled(r, template):
    a, b, c = r.sample(NAMES, 3)
    n, m = r.sample(range(2, 900), 2)
    return template.replace("{A}", a).replace("{B}", b).replace("{C}", c).replace("{n}", str(n)).replace("{m}", str(m)).replace("{u}", r.choice(UNITS))


@pytest.fixture(scope="module")
def problems():
    """Items; documents that hold one re-parameterised, word for word, or in one case; documents that hold a mix of values; clean ones."""
    r = random.Random(11)
    templates = [problem(r) for _ in range(40)]
    items = [(i, filled(r, t)) for i, t in enumerate(templates)]
    docs, holds = [], {}
    for i, t in enumerate(templates):
        around = lambda x: f"{prose(r.randrange(10**6), 40)}. {x} {prose(r.randrange(10**6), 40)}"
        for k, text in enumerate([filled(r, t), items[i][1], items[i][1].lower(), items[i][1].upper()]):
            docs.append((100 * i + k, around(text)))
            holds[100 * i + k] = i
        docs.append((100 * i + 8, around(" ".join(filled(r, w) for w in t.split(" ")))))  # each slot another value
        docs.append((100 * i + 9, around(prose(r.randrange(10**6), 40))))
    return items, docs, holds


def leaks(spark, docs, items, **more):
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(frame(spark, [(d, t, "a") for d, t in docs]), table, **more)
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 0])
def test_leaks_against_brute_force(spark, problems, most):
    items, docs, _ = problems
    got = leaks(spark, docs, items, most=most)
    assert got == brute(docs, items) and len(got) > 100


def test_recall(spark, problems):
    items, docs, holds = problems
    found = {(d, i) for d, i, *_ in leaks(spark, docs, items)}
    for kind in range(4):
        wanted = {(d, i) for d, i in holds.items() if d % 100 == kind}
        assert len(wanted & found) >= 0.9 * len(wanted)
    assert not {d for d, _ in found if d % 100 == 9}


def test_leaks_odd_rows(spark):
    """Null and repeated ids, long texts, items without literal words, empty and repeated items."""
    item = "Natalia sold 48 clips to friends in April. Marcus sold half as many clips in May."
    other = item.replace("Natalia", "Priya").replace("Marcus", "Olga").replace("48", "90")
    long = prose(77, 30_000)
    docs = [r[:2] for r in ODD + IDENTITY] + [(None, other), (None, "unrelated words here"), (20, other), (20, "other words of the same id"), (21, f"{long} {other} {long}"), (22, "1 2 3 4 5 6 7"), (23, "1 2 3 4 5 6 8"), (20, other)]
    items = [(1, item), (1, item), (2, ""), (3, None), (None, item), (4, "1 2 3 4 5 6 7"), (5, long), (6, "Natalia"), (5, other + " And how many are left after that?"), (None, "words without an id of their own")]
    got = leaks(spark, docs, items)
    assert got == brute(docs, items)
    assert {(d, i) for d, i, *_ in got} == {(d, i) for d in (None, 20, 21) for i in (1, None)} | {(22, 4), (21, 5)}
    df = frame(spark, [(d, t, "a") for d, t in docs])
    kept = decontaminate.clean(df, spark.createDataFrame(items, "item_id long, text string"))
    gone = [(d, t) for d, t in docs if t in (other, f"{long} {other} {long}", "1 2 3 4 5 6 7")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([x for x in docs if x not in gone], key=repr)


def test_leaks_of_the_tables(spark, sf_dir):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    assert leaks(spark, docs, items) == brute(docs, items)
