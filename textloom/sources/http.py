"""Clients of remote services over HTTP, to be passed to services.request(): plain functions of a row's values that workers can take along."""

from __future__ import annotations

import http.client
import json
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import classify
from textloom.sources import services

#: Fixed value: answers of at least this confidence are kept as aliases.
SURE = 0.9


@dataclass
class Endpoint:
    """One address that takes a JSON object and gives one back. Keeps its connection between calls; 4xx is a ClientError, 5xx and time-outs are tried again by services.with_retries()."""

    url: str
    timeout: float = 30.0
    headers: dict[str, str] = field(default_factory=dict)
    _open: Any = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_open": None}

    def __call__(self, body: dict) -> dict:
        where = urllib.parse.urlsplit(self.url)
        if self._open is None:
            kind = http.client.HTTPSConnection if where.scheme == "https" else http.client.HTTPConnection
            self._open = kind(where.netloc, timeout=self.timeout)
        try:
            path = urllib.parse.urlunsplit(("", "", where.path or "/", where.query, ""))
            self._open.request("POST", path, json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers})
            answer = self._open.getresponse()
            raw = answer.read()
        except Exception:
            self._open.close()
            self._open = None
            raise
        if 400 <= answer.status < 500:
            raise services.ClientError(f"status {answer.status}")
        if answer.status != 200:
            raise ConnectionError(f"status {answer.status}")
        return json.loads(raw)


def search_client(endpoint: Endpoint, top: int = 10) -> Callable[[str], dict]:
    """keywords (joined by blanks) -> results: a list of (book, chapter, score, content)."""

    def client(keywords: str) -> dict:
        found = endpoint({"keywords": keywords.split(), "top_k": top}).get("results", [])
        return {"results": [{"book": str(r["book"]), "chapter": int(r["chapter"]), "score": float(r["score"]), "content": r.get("content", "")} for r in found]}

    return client


RESULTS = "results array<struct<book:string,chapter:long,score:double,content:string>>"


def search(queries: DataFrame, keywords: str, endpoint: Endpoint, top: int = 10, attempts: int = 3) -> DataFrame:
    """queries with one row a result (book, chapter, score, content); a query whose service fails has none."""
    found = services.request(queries, [keywords], RESULTS, search_client(endpoint, top), attempts)
    return found.withColumn("_r", F.explode("results")).select(*queries.columns, "_r.*")


def summary_client(endpoint: Endpoint, model: str, prompt: str = "Summarize: {}", most: int = 8000) -> Callable[[str], dict]:
    """text -> summary, model, tokens_used, from an endpoint for chat completions."""

    def client(text: str) -> dict:
        answer = endpoint({"model": model, "messages": [{"role": "user", "content": prompt.format(text[:most])}]})
        return {"summary": answer["choices"][0]["message"]["content"].strip(), "model": answer.get("model", model), "tokens_used": int(answer.get("usage", {}).get("total_tokens", 0))}

    return client


SUMMARY = "summary string, model string, tokens_used long"


def classify_client(endpoint: Endpoint) -> Callable[[str], dict]:
    """term -> classification, confidence, canonical_term; an answer without the first two is an error."""

    def client(term: str) -> dict:
        answer = endpoint({"term": term})
        if "classification" not in answer or "confidence" not in answer:
            raise services.ClientError("fields are missing")
        return {"classification": answer["classification"], "confidence": float(answer["confidence"]), "canonical_term": answer.get("canonical_term", term)}

    return client


CLASS = "classification string, confidence double, canonical_term string"


def classify_open(terms: DataFrame, term: str, client: Callable[[str], dict], aliases: DataFrame, attempts: int = 3, sure: float = SURE) -> tuple[DataFrame, DataFrame]:
    """terms with (classification, confidence, canonical_term), and the aliases with the sure answers added, for the alias tier to find next time.

    Each distinct term is asked for once, only those that no alias answers. Write the aliases before they are used: they
    are computed from the service's answers.
    """
    known = classify.lookup_aliases(terms.select(term).distinct(), term, aliases)
    asked = services.request(known.where("classification is null").select(term), [term], CLASS, client, attempts)
    answered = known.where("classification is not null").select(term, "classification", F.lit(1.0).alias("confidence"), "canonical_term").unionByName(asked)
    new = asked.where(F.col("confidence") >= sure).select(F.lower(F.trim(F.col(term))).alias("alias"), "canonical_term", "classification").dropDuplicates(["alias"])
    return terms.join(answered, term, "left"), aliases.unionByName(new)
