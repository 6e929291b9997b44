"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # maximal runs: a shorter match can't hold a longer one
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: States of the Markov models; any other character is the last state.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: Random strings that training makes.
TRAINING_ROWS = 20_000
#: Items of one chunk of a walk: what a walk gathers is copied at each of its steps, so long ones are cut.
CHUNK = 256
SPANS = "array<struct<s:int,o:int,e:int,kind:string>>"


def _state(char: Column) -> Column:
    place = F.instr(F.lit(ALPHABET), char)
    return F.when(place > 0, place - 1).otherwise(STATES - 1)


def default_samples(docs: DataFrame) -> DataFrame:
    """(token, secret): labelled samples.

    Secret: TRAINING_ROWS strings made of digests of numbers, as hex, base64 and upper-case alphanumerics. Ordinary: the
    distinct words of 6 or more characters of all documents, and compounds of each with itself joined as identifiers
    are, except those that a fixed pattern matches.
    """
    spark = docs.sparkSession
    digest = spark.range(TRAINING_ROWS // 4).select(F.sha2(F.col("id").cast("string"), 256).alias("x"), "id")
    width = (20 + F.col("id") % 30).cast("int")
    b64 = F.base64(F.unhex("x"))
    random = digest.select(F.explode(F.array(F.col("x").substr(F.lit(1), width), b64.substr(F.lit(1), width), F.regexp_replace(b64, "[+/=]", "").substr(F.lit(1), width), F.upper(F.regexp_replace(b64, "[+/=]", "")).substr(F.lit(1), width))).alias("token"))
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_-]{6,}"), 0)).alias("token")).distinct().where(~F.col("token").rlike(HEX) & ~F.col("token").rlike(ACCESS))
    joined = words.select(F.explode(F.array(F.col("token"), F.concat(F.lower("token"), F.lit("_"), F.reverse(F.lower("token"))), F.initcap(F.concat_ws("-", "token", "token")), F.upper("token"), F.upper(F.concat("token", F.reverse("token"))), F.concat(F.initcap("token"), F.initcap(F.reverse("token"))))).alias("token"))
    return random.withColumn("secret", F.lit(1)).unionByName(joined.withColumn("secret", F.lit(0)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, STATES x STATES in one list: of random strings against ordinary identifiers.

    Reads (token, secret), secret 1 or 0; each label's counts get one added everywhere. 2 x STATES x STATES counts at
    most come to the driver, whatever the sample.
    """
    usable = samples.where("token is not null and secret in (0, 1)").select("token", "secret")
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))
    # states are looked up once for each distinct pair of characters
    counted = usable.where(F.length("token") >= 2).select("secret", F.explode(pairs).alias("pair")).groupBy("secret", "pair").count()
    step = _state(F.substring("pair", 1, 1)) * STATES + _state(F.substring("pair", 2, 1))
    counts = counted.groupBy("secret", step.alias("t")).agg(F.sum("count").alias("count")).collect()
    logs = {}
    for label in (0, 1):
        table = [[1.0] * STATES for _ in range(STATES)]
        for r in counts:
            if r.secret == label:
                table[r.t // STATES][r.t % STATES] += r["count"]
        logs[label] = [math.log(x / sum(row)) for row in table for x in row]
    return [a - b for a, b in zip(logs[1], logs[0], strict=True)]


def log_ratio(token: Column, model: list[float]) -> Column:
    """Sum of the transitions' log-likelihood ratios: one pass over the characters, whatever the token's length."""
    # one literal: a list of as many would be planned value by value
    table = F.split(F.lit(" ".join(map(repr, model))), " ").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(a: Column, char: Column) -> Column:
        more = F.when(a["last"] < 0, 0.0).otherwise(F.element_at(table, (a["last"] * STATES + _state(char) + 1).cast("int")))
        return F.struct(_state(char).cast("int").alias("last"), (a["sum"] + more).alias("sum"))

    return F.aggregate(F.split(token, ""), start, step, lambda a: a["sum"])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _none() -> Column:
    return F.array().cast(SPANS)


def _walked(items: Column, total: Callable, add: Callable, walk: Callable) -> Column:
    """Spans that walk(chunk, carry) finds in each chunk of the items; carry is what add() makes of the totals (integers) of the chunks before, from 0. In time linear in the items, but for one number a chunk."""

    def carries(chunks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        more = lambda a, t: F.struct(add(a["at"], t).cast("int").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(F.transform(chunks, total), start, more, lambda a: a["out"])

    def cut(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / CHUNK).cast("int"))
        return F.transform(numbers, lambda i: F.slice(all_, i * CHUNK + 1, CHUNK))

    return _let(items, lambda all_: _let(cut(all_), lambda chunks: F.flatten(F.zip_with(chunks, carries(chunks), walk))))


def _spans(text: Column, pattern: str, kind: str, order: int, keep=None) -> Column:
    """Array of (s, o, e, kind) of the pattern's matches, leftmost first, without overlap: the lengths of what stands between and of the matches themselves give the places."""
    # the last gap has no match behind it
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("match"))
    length = lambda part: F.length(part["gap"]) + F.coalesce(F.length(part["match"]), F.lit(0))

    def step(a: Column, part: Column) -> Column:
        s = a["at"] + F.length(part["gap"])
        e = a["at"] + length(part)
        span = F.array(F.struct(s.alias("s"), F.lit(order).alias("o"), e.alias("e"), F.lit(kind).alias("kind")))
        wanted = part["match"].isNotNull() if keep is None else part["match"].isNotNull() & keep(part["match"])
        return F.struct(e.alias("at"), F.when(wanted, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    def walk(chunk: Column, carry: Column) -> Column:
        return F.aggregate(chunk, F.struct(carry.alias("at"), _none().alias("spans")), step, lambda a: a["spans"])

    total = lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, part: n + length(part))
    return F.when(text.rlike(pattern), _walked(parts, total, lambda a, b: a + b, walk)).otherwise(_none())


def _free(likely: Column, base: Column) -> Column:
    """The spans of `likely`, which don't overlap each other, that overlap none of `base`: one walk over all of them by their starts, as only the ends before and the next span matter to each."""
    markov = lambda x: x["kind"] == "markov"

    def pairs(all_: Column) -> Column:
        return F.arrays_zip(all_.alias("x"), F.slice(all_, 2, F.greatest(F.size(all_) - 1, F.lit(0))).alias("next"))

    def step(a: Column, p: Column) -> Column:
        x, after = p["x"], p["next"]
        hit = (x["s"] < a["upto"]) | F.coalesce(~markov(after) & (after["s"] < x["e"]), F.lit(False))
        upto = F.when(markov(x), a["upto"]).otherwise(F.greatest(a["upto"], x["e"]))
        return F.struct(upto.alias("upto"), F.when(markov(x) & ~hit, F.concat(a["spans"], F.array(x))).otherwise(a["spans"]).alias("spans"))

    def walk(chunk: Column, carry: Column) -> Column:
        return F.aggregate(chunk, F.struct(carry.alias("upto"), _none().alias("spans")), step, lambda a: a["spans"])

    ends = lambda chunk: F.aggregate(chunk, F.lit(0), lambda m, p: F.when(markov(p["x"]), m).otherwise(F.greatest(m, p["x"]["e"])))
    found = _let(F.array_sort(F.concat(base, likely)), lambda all_: _walked(pairs(all_), ends, F.greatest, walk))
    return F.when(F.size(likely) > 0, found).otherwise(_none())


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float], threshold: float = 16.0) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov): secrets of each text, as spans kind:start:end in code points.

    Fixed patterns give kinds assign, access and hex. A run of 16 or more of A-Za-z0-9+/_=- is of kind markov when
    its log-likelihood ratio exceeds `threshold` and it touches no span of the fixed patterns. Each row is worked on by
    itself, there is no shuffle; a null text is empty, an empty table gives none, and repeated rows each give a row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id"), text.alias("_text")).select(
        "doc_id", "_text",
        _spans(F.col("_text"), ASSIGN, "assign", 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6).alias("_assign"),
        _spans(F.col("_text"), ACCESS, "access", 1).alias("_access"),
        _spans(F.col("_text"), HEX, "hex", 2).alias("_hex"),
    ).withColumn("_base", F.concat("_assign", "_access", "_hex"))
    likely = _spans(F.col("_text"), CANDIDATE, "markov", 3, lambda m: log_ratio(m, model) > threshold)
    return base.withColumn("_likely", likely).withColumn("_markov", _free(F.col("_likely"), F.col("_base"))).select(
        "doc_id", F.size("_assign").cast("long").alias("n_assign"), F.size("_access").cast("long").alias("n_access"), F.size("_hex").cast("long").alias("n_hex"),
        F.sha2(_written(F.col("_base")), 256).alias("base_sha256"), _written(F.concat("_base", "_markov")).alias("spans"), F.size("_markov").cast("long").alias("n_markov"),
    )
