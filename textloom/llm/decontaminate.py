"""Benchmark decontamination by template canonicalisation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import ROW, documents_of, id_out, row_identity

#: Units that count as such right after a number.
UNITS = (
    "kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "ft", "in", "l", "ml", "s", "ms", "min", "h", "hr", "hrs", "mph", "kmh",
    "meters", "metres", "miles", "feet", "inches", "grams", "kilograms", "pounds", "liters", "litres", "seconds", "minutes", "hours", "days",
    "weeks", "months", "years", "dollars", "cents", "euros", "percent", "degrees", "watts", "volts", "kb", "mb", "gb", "tb",
)
#: Words that begin sentences with a capital and are no names; of the languages in turn.
NOT_NAMES = (
    "A An And Are As At But By Can Could Did Do Does Each Every Find For From Given Had Has Have He Her His How I If In Is It Its Let Many Much My No Not Of On One Or Our She Should So "
    "Some Suppose That The Their Then There These They This Those To Was We Were What When Where Which While Who Why Will With Would You Your "
    "Au Aux Avec Ce Ces Cette Combien Dans De Des Du Elle En Est Et Il Ils La Le Les Leur Mais Ne Nous On Ou Par Pas Pour Quand Que Quel Quelle Qui Sa Ses Si Son Sur Un Une Vous "
    "Aber Als Am An Auch Auf Aus Bei Das Dem Den Der Des Die Ein Eine Einem Einen Einer Er Es Für Hat Ich Ihr Im Ist Man Mit Nach Nicht Oder Sie Sind Und Von Was Wenn Wer Wie Wieviel Wir Zu Zum Zur "
    "Al Como Con Cual Cuando Cuánto Cuántos De Del El Ella En Es Esta Este Hay Las Lo Los Más No Para Pero Por Qué Se Si Sin Su Sus Un Una Y Yo"
)
#: A capitalised word, wherever it stands: those of NOT_NAMES are words as others.
NAME = r"(?=\p{Lu})(?<![\p{L}\p{N}])(?!(?:" + "|".join(sorted(set(NOT_NAMES.split()))) + r")(?![\p{L}\p{N}]))\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
NUMBER = r"(?=[0-9])(?<![\p{L}\p{N}])[0-9][0-9.,]*"
UNIT = r"(?i)(<num=[^>]*>)(\x20?)(" + "|".join(UNITS) + r")(?![\p{L}\p{N}])"
DROPPED = ".,;:!?\"'()[]{}"
BLANKS = r"[\x20\x09-\x0D]+"

#: Windows of the benchmark are broadcast up to this many bytes, as counted; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 64_000_000
#: Literal words that a window needs to be told from others by its template.
LITERALS = 2


def _marked(text: F.Column, names: bool, values: bool) -> F.Column:
    """The text with numbers, units after numbers and names as placeholders."""
    cleared = F.translate(text, "<>=", "")
    named = F.regexp_replace(cleared, NAME, "<name=$0>" if values else "<name>") if names else cleared
    counted = F.regexp_replace(F.regexp_replace(named, NUMBER, "<num=$0>"), UNIT, "$1$2<unit=$3>")
    return F.when(text.rlike("[0-9]"), counted if values else F.regexp_replace(counted, r"=[^>]*>", ">")).otherwise(named)


def _tokens(text: F.Column, names: bool = True, values: bool = True) -> F.Column:
    """Words in lower case without punctuation; numbers, units and names are <num=value>, <unit=value>, <name=value>, or bare without `values`."""
    return F.filter(F.split(F.translate(F.lower(_marked(text, names, values)), DROPPED, ""), BLANKS), lambda w: w != "")


def _bare(word: F.Column) -> F.Column:
    return F.regexp_replace(word, "=[^>]*>", ">")


def _starts(words: F.Column, width: int) -> F.Column:
    n = F.size(words)
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def _hashes(words: F.Column, width: int) -> F.Column:
    return F.transform(_starts(words, width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def _cuts(bare: F.Column, words: F.Column, width: int) -> F.Column:
    return F.transform(_starts(words, width), lambda i: F.struct(i.alias("doc_pos"), F.slice(bare, i + 1, width).alias("key"), F.slice(words, i + 1, width).alias("doc_vals")))


def _item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item, variant, item_pos, key, vals, strict, windows). item names a row by item_id and text: every text is searched for, whether its id is null, repeated or neither.

    Variant 0 has names as placeholders, variant 1 has them as words: that is how a text in lower or upper case reads. An
    item's first word may stand behind other text, so variant 0 has the windows there with it as a word and as a name.
    An item of fewer than `width` words is one window. Windows of fewer than LITERALS literal words don't count, unless
    the item has no others: these are strict, their values must be the same.
    """
    usable = benchmark.where("text is not null").select(F.struct("item_id", F.xxhash64("text").alias("one"), F.xxhash64(F.lit("two"), "text").alias("two")).alias("item"), "text")
    tokens = usable.select("item", _tokens(F.col("text")).alias("w0"), _tokens(F.col("text"), names=False).alias("w1"))
    first, rest = F.col("w0")[0], F.slice("w0", 2, F.greatest(F.size("w0") - 1, F.lit(0)))
    as_word = F.regexp_replace(first, r"^<name=([^>]*)>", "$1")
    as_name = F.when(first.startswith("<"), first).otherwise(F.concat(F.lit("<name="), first, F.lit(">")))
    form = lambda variant, words: F.struct(F.lit(variant).alias("variant"), words.alias("w"))
    forms = F.array(form(0, F.col("w0")), form(0, F.concat(F.array(as_word), rest)), form(0, F.concat(F.array(as_name), rest)), form(1, F.col("w1")))
    named = F.exists("w0", lambda w: w.startswith("<name"))
    both = tokens.where(F.size("w0") > 0).select("item", F.explode(F.when(named, forms).otherwise(F.slice(forms, 1, 3))).alias("f")).select("item", "f.*")
    # windows are cut before they become rows, which then carry no more than a window
    short = F.array(F.struct(F.lit(0).alias("doc_pos"), F.col("b").alias("key"), F.col("w").alias("doc_vals")))
    cuts = F.when(F.size("w") >= width, _cuts(F.col("b"), F.col("w"), width)).otherwise(short)
    rows = both.withColumn("b", F.transform("w", _bare)).select("item", "variant", F.explode(cuts).alias("x"))
    rows = rows.select("item", "variant", F.col("x.doc_pos").alias("item_pos"), "x.key", F.col("x.doc_vals").alias("vals")).distinct()
    rows = rows.withColumn("strict", F.size(F.filter("key", lambda k: ~k.startswith("<"))) < LITERALS)
    needed = rows.groupBy("item", "variant").agg(
        F.min("strict").alias("_strict"), F.count_distinct("item_pos").alias("_all"), F.count_distinct(F.when(~F.col("strict"), F.col("item_pos"))).alias("_literal")
    )
    whole = rows.join(needed, ["item", "variant"]).where(F.col("strict") == F.col("_strict"))
    return whole.select("item", "variant", "item_pos", "key", "vals", "strict", F.when(F.col("_strict"), F.col("_all")).otherwise(F.col("_literal")).alias("windows"))


def _leaks(docs: DataFrame, benchmark: DataFrame, width: int, share: float, most: int) -> DataFrame:
    """leaks() by row: doc_id, known and tag name a document."""
    items = _item_windows(benchmark.select("item_id", "text"), width)
    # get() is null behind the end of a short item, and nulls don't change the hash
    hashed = items.select("item", "variant", "item_pos", "windows", F.size("key").alias("_k"), F.xxhash64(*[F.get("key", F.lit(i)) for i in range(width)]).alias("_h")).distinct()
    sizes = {r["_k"]: r["count"] for r in hashed.groupBy("_k").count().collect()}  # `width` numbers at most
    hashed = hashed.drop("_k")
    if 64 * sum(sizes.values()) <= most:
        hashed = F.broadcast(hashed)
    long = F.aggregate(F.concat("key", "vals"), F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 16)
    if items.agg(F.coalesce(F.sum(long + 64), F.lit(0)).alias("n")).first().n <= most:
        items = F.broadcast(items)
    widths = sorted({width, *sizes})
    doc = list(ROW)
    own = documents_of(docs.where("text is not null").select("doc_id", "text"))
    words = own.select(*doc, _tokens(F.col("text"), values=False).alias("_w"))
    hashes = words.select(*doc, F.explode(F.concat(*[_hashes(F.col("_w"), n) for n in widths])).alias("_h"))
    met = hashes.join(hashed, "_h").groupBy(*doc, "item", "variant").agg(F.count_distinct("item_pos").alias("_m"), F.first("windows").alias("_n"))
    pairs = met.where(F.col("_m") >= share * F.col("_n")).select(*doc, "item")

    found = own.join(pairs.select(*doc).distinct(), doc, "left_semi")
    cut = F.concat(*[_cuts(F.col("b"), F.col("w"), n) for n in widths])
    aligned = found.select(*doc, _tokens(F.col("text")).alias("w")).select(*doc, "w", F.transform("w", _bare).alias("b"))
    windows = aligned.select(*doc, F.explode(cut).alias("x")).select(*doc, "x.*")
    matched = windows.join(items.withColumnRenamed("vals", "item_vals"), "key")
    slots = F.filter(F.arrays_zip(F.col("item_vals").alias("i"), F.col("doc_vals").alias("d")), lambda z: z["i"].startswith("<"))
    matched = matched.withColumn("slots", slots)
    # all that follows is about one document and one item: dealt once
    pair = [*doc, "item", "variant", "windows"]
    same = F.size(F.filter("slots", lambda z: z["i"] != z["d"])) == 0
    matched = matched.where(~F.col("strict") | same).repartition("doc_id", "item").withColumn("at", F.col("doc_pos") - F.col("item_pos"))
    places = matched.groupBy(*pair, "item_pos", "at").agg(F.max(F.struct(same.alias("same"), F.col("slots"))).alias("x")).select(*pair, "item_pos", "at", "x.*")
    # stretches: each alignment by itself, and parts of the document as long as the item, in two grids that overlap by half
    grid = lambda n, no: F.struct(F.lit(n).alias("grid"), no.cast("long").alias("no"))
    part = F.col("at") / F.col("windows")
    places = places.withColumn("stretch", F.explode(F.array(grid(0, F.floor(part)), grid(1, F.floor(part + 0.5)), grid(2, F.col("at")))))
    stretch = [*pair, "stretch"]
    places = places.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*stretch, "at")))
    places = places.withColumn("_main", F.max(F.struct("_n", (-F.col("at")).alias("at"))).over(Window.partitionBy(*stretch)))
    off = F.abs(F.col("at") + F.col("_main.at"))
    near = places.groupBy(*stretch, "item_pos").agg(F.min(F.struct(off.alias("off"), F.col("at"), F.col("same"), F.col("slots"))).alias("x")).select(*stretch, "item_pos", "x.same", "x.slots")
    # each value of the item with the document's value that most windows have
    slot = near.select(*stretch, "item_pos", "same", F.explode_outer(F.array_distinct("slots")).alias("z"))
    slot = slot.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*stretch, "z.i", "z.d")))
    common = F.max(F.struct(F.col("_c"), (F.col("z.i") == F.col("z.d")).alias("same"), F.col("z.d").alias("d"))).over(Window.partitionBy(*stretch, "z.i"))
    slot = slot.withColumn("_ok", F.col("z").isNull() | (F.col("z.d") == common["d"]))
    agreed = slot.groupBy(*stretch, "item_pos").agg(F.min("_ok").alias("ok"), F.first("same").alias("same"), F.collect_set("z.i").alias("values"))
    counted = lambda c: F.struct(F.sum(F.col(c).cast("long")).alias("matched"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col(c), F.col("values")))))).alias("slots"))
    best = agreed.groupBy(*stretch).agg(F.greatest(counted("ok"), counted("same")).alias("_b")).where(F.col("_b.matched") >= share * F.col("windows"))
    coverage = (F.col("_b.matched") / F.col("windows")).alias("coverage")
    out = best.groupBy(*doc, "item").agg(F.max(F.struct(coverage, F.col("_b.matched").alias("matched"), F.col("windows"), F.col("_b.slots").alias("slots"))).alias("_b"))
    return out.select(*doc, F.col("item.item_id").alias("item_id"), "_b.windows", "_b.matched", "_b.coverage", "_b.slots")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, share: float = 0.8, most: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, windows, matched, coverage, slots): documents that hold an item or a re-parameterised form of it.

    Every word is canonicalised (numbers, units after numbers and capitalised words but NOT_NAMES become typed
    placeholders), template windows of `width` words are joined by hash, and a document is reported for an item when at
    least `share` of the item's windows stand in one stretch of it and agree on the slots. A stretch is one alignment of
    the item with the document, or, as words may be put in or left out, the alignments about the one with most windows;
    each window of the item then counts at its nearest place. Each value of the item has one value in the document, that
    of most windows; windows with another one don't count. Several values of the item may have the same one in the
    document. If more windows have the item's own values, those count. A text all in lower or upper case has no names:
    items are looked for with their names as words too.

    First pass: hashes of all windows of all documents against the benchmark's. Second pass: exact templates, positions
    and slots of the few documents found. The benchmark's windows are broadcast up to `most` bytes, as counted, and
    joined by a shuffle beyond.

    An item of fewer than `width` words is one window. Null texts match nothing. Each item is one of its own, named by
    item_id and text: texts of one item_id, or without any (reported as null), give a row each. Each row is a document of its own,
    whether its id is null (and reported as null), repeated or neither; rows equal in id and text give one row. Empty
    tables give an empty result; other columns are ignored.
    """
    return _leaks(docs, benchmark, width, share, most).select(id_out().alias("doc_id"), "item_id", "windows", "matched", "coverage", "slots")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """The documents that hold no item, with their own columns. A row goes only for its own text: rows of the same id, or without one, stay."""
    bad = _leaks(docs, benchmark, width, share, BROADCAST_BYTES).select(F.struct(*ROW).alias("_bad")).distinct()
    marked = docs.drop("_row").withColumn("_row", F.struct(*row_identity()))
    return marked.join(bad, F.col("_row") == F.col("_bad"), "left_anti").drop("_row")
