"""Rows that carry their state through a graph of stages: branches by condition, and another try after transient errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import filters, ranking
from textloom.sources.scratch import materialize

#: An error is transient if it says one of these, and a row is tried again so often at most.
TRANSIENT = ["timeout", "network", "connection", "temporary", "transient"]
RETRIES = 3

WORDS, REASONS, SCORES = "array<string>", "array<struct<term:string,reason:string>>", "array<struct<term:string,score:double>>"
FINAL = "array<struct<term:string,score:double,models_agreed:int>>"
#: What a row carries; all but the last two start anew with each try.
STATE = {"generated_terms": WORDS, "related_terms": WORDS, "validated_terms": WORDS, "rejected_terms": REASONS, "ranked_terms": SCORES, "final_terms": FINAL, "excluded_terms": REASONS, "stages_completed": WORDS, "errors": WORDS, "retry_count": "int"}
KEPT = ("errors", "retry_count")

#: A stage: the rows that stand at it (a condition) get new state, or an error in `_error`.
Stage = Callable[[DataFrame, Column], DataFrame]


def update(df: DataFrame, active: Column, **columns: Column) -> DataFrame:
    """df with the columns set where `active` holds."""
    return df.withColumns({c: F.when(active, v.cast(STATE[c]) if c in STATE else v).otherwise(F.col(c)) for c, v in columns.items()})


def transient(errors: Column | str) -> Column:
    """Whether the last error may go away by itself."""
    last = F.lower(F.try_element_at(T.col(errors), F.lit(-1)))
    return F.coalesce(T.any_of([F.contains(last, F.lit(t)) for t in TRANSIENT]), F.lit(False))


def start(df: DataFrame) -> DataFrame:
    empty = {c: (F.lit(0) if t == "int" else F.array()).cast(t) for c, t in STATE.items()}
    return df.withColumns(empty)


def run(df: DataFrame, stages: dict[str, Stage], route: Callable[[str], Column], retries: int = RETRIES) -> DataFrame:
    """df with its state at the end. Stages are in an order in which none leads back; route(stage) is the stage that a row goes to next, null for the end.

    A stage that fails leaves its message in `errors`. If that is transient, the row starts again, with its errors and
    retry_count + 1, at most `retries` times; if not, or after that, it ends where it is. All rows go through a stage at
    once; there are at most retries + 1 rounds, each over the rows that failed in the one before, and what a round did
    is written, so nothing is asked twice.
    """
    spark = df.sparkSession
    names = list(stages)
    todo, done = start(df), None
    for _ in range(retries + 1):
        now = todo.withColumns({"_at": F.lit(names[0]), "_error": F.lit(None).cast("string")})
        for name, stage in stages.items():
            here = F.coalesce(F.col("_at") == name, F.lit(False))
            now = stage(now, here)
            failed = here & F.col("_error").isNotNull()
            passed = here & F.col("_error").isNull()
            now = update(now, failed, errors=F.concat("errors", F.array("_error")))
            now = update(now, passed, stages_completed=F.concat("stages_completed", F.array(F.lit(name))))
            now = now.withColumn("_at", F.when(failed, F.lit(None)).when(passed, route(name)).otherwise(F.col("_at")))
        now = materialize(spark, now.drop("_at"))
        again = F.col("_error").isNotNull() & transient("errors") & (F.col("retry_count") < retries)
        ended = now.where(~again).drop("_error")
        done = ended if done is None else done.unionByName(ended)
        todo = now.where(again).drop("_error")
        if todo.isEmpty():
            break
        fresh = {c: F.array().cast(t) for c, t in STATE.items() if c not in KEPT}
        todo = todo.withColumns(fresh | {"retry_count": F.col("retry_count") + 1})
    return done


# ---- keywords of queries -----------------------------------------------------------------------------------------


def generate(text: str = "text", first: int = 5, related: int = 5, error: Column | None = None) -> Stage:
    """Simple terms of the query: the first ones, and related ones after them. `error`: a message for rows whose generator fails."""

    def stage(df: DataFrame, here: Column) -> DataFrame:
        terms = T.simple_terms(text)
        df = df.withColumn("_error", F.when(here, error if error is not None else F.lit(None).cast("string")).otherwise(F.col("_error")))
        fine = here & F.col("_error").isNull()
        return update(df, fine, generated_terms=F.slice(terms, 1, first), related_terms=F.slice(terms, first + 1, related))

    return stage


def validate(df: DataFrame, here: Column) -> DataFrame:
    good, bad = filters.graph_split("generated_terms", "related_terms")
    return update(df, here, validated_terms=good, rejected_terms=F.transform(bad, lambda t: F.struct(t.alias("term"), F.lit("too generic").alias("reason"))))


def rank(df: DataFrame, here: Column) -> DataFrame:
    """Scores by place; equal scores stay in order."""
    scored = F.transform("validated_terms", lambda t, i: F.struct(t.alias("term"), F.round(ranking.positional_score(i), 6).alias("score")))
    return update(df, here, ranked_terms=scored)


def consensus(df: DataFrame, here: Column) -> DataFrame:
    """Ranked terms have the agreement of all three stages; rejected ones are excluded."""
    final = F.transform("ranked_terms", lambda x: F.struct(x["term"].alias("term"), x["score"].alias("score"), F.lit(3).alias("models_agreed")))
    return update(df, here, final_terms=final, excluded_terms=F.col("rejected_terms"))


def keyword_route(name: str) -> Column:
    """Rank is left out if no term is valid."""
    if name == "validate":
        return F.when(F.size("validated_terms") > 0, "rank").otherwise("consensus")
    return F.lit({"generate": "validate", "rank": "consensus"}.get(name)).cast("string")


def keywords(queries: DataFrame, text: str = "text", error: Column | None = None, retries: int = RETRIES) -> DataFrame:
    """queries with the state of the keyword graph: generate, validate, rank (if any term is valid), consensus."""
    stages: dict[str, Stage] = {"generate": generate(text, error=error), "validate": validate, "rank": rank, "consensus": consensus}
    return run(queries, stages, keyword_route, retries)
