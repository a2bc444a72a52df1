"""Entities from a language model: prompts, client, retries, cache.

No client for a service is shipped; anything with ``complete(prompt) -> str``
serves, and ``PatternClient`` shows how.  Answers are cached by model and prompt after they have been validated.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.session import staged

# Own wording of the prompts; {text} is replaced literally, so other braces are safe.
_ANSWER = 'Answer with one JSON object {"entities": [{"text": "...", "type": "...", "base_form": "..."}]} and nothing else. Copy every text exactly as it stands.'
PROMPTS = {
    "simple": "List the personal data in the text below: people, organisations, places, addresses, contact data, numbers issued to a person. " + _ANSWER + "\n\nText:\n{text}",
    "detailed": "List the personal data in the text below. Give names of people without titles as base_form, so that variants share one. Add as INDIRECT every phrase that points to one person without a name. " + _ANSWER + "\n\nText:\n{text}",
    "hipaa": "List every identifier of the safe-harbor rule in the text below: names, places smaller than a state, dates but years, ages over 89, contact data, record, plan, account, licence, vehicle and device numbers, addresses on networks, biometric data, photographs. " + _ANSWER + "\n\nText:\n{text}",
    "residual": "The text below has been masked with labels such as PERSON_1. List personal data that are still in it; labels are none. " + _ANSWER + "\n\nText:\n{text}",
}


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


class PatternClient:
    """A client without a service: a deterministic one that names what a pattern finds in the prompt's text.

    For trying out the way through a model, and for tests.  Every prompt whose
    MD5 begins with a digit below ``failing`` is refused on its first try, as a
    busy service would.  A first group of the pattern is the base form.
    """

    MARK = "\nText:\n"

    def __init__(self, pattern: str, type_: str = "PERSON", failing: int = 0) -> None:
        self.pattern, self.type_, self.failing = pattern, type_, failing
        self.refused: set[str] = set()

    def complete(self, prompt: str) -> str:
        digest = hashlib.md5(prompt.encode()).hexdigest()
        if digest[0] < str(self.failing) and digest not in self.refused:
            self.refused.add(digest)
            raise RuntimeError("429 too many requests")
        _, mark, text = prompt.partition(self.MARK)
        found = [{"text": m[0], "type": self.type_, "base_form": m[1] if m.re.groups else None} for m in re.finditer(self.pattern, text if mark else prompt)]
        return json.dumps({"entities": found})


# Words by which errors are told apart, in the order they are tried.
_ERRORS = (
    ("RATE_LIMIT_ERROR", ("429", "rate limit", "ratelimit")),
    ("SERVER_ERROR", ("500", "502", "503", "504", "server error")),
    ("CONNECTION_ERROR", ("connection", "timeout")),
    ("AUTHENTICATION_ERROR", ("401", "403", "apikey", "api key", "unauthorized", "authentication")),
)


def classify(error: BaseException) -> tuple[bool, str]:
    """(worth another try, class) of an error; all but wrong credentials are."""
    said = f"{type(error).__name__} {error}".lower()
    for name, words in _ERRORS:
        if any(w in said for w in words):
            return name != "AUTHENTICATION_ERROR", name
    return True, "PARSING_ERROR" if isinstance(error, ValueError) else "GENERIC_ERROR"


def parse_answer(answer: str) -> list[dict]:
    """The entities of an answer, with or without a code fence; ValueError if it isn't what was asked for."""
    body = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", answer)
    data = json.loads(body)
    found = data.get("entities") if isinstance(data, dict) else None
    if not isinstance(found, list):
        raise ValueError("the answer has no list of entities")
    out = []
    for e in found:
        if not isinstance(e, dict) or not isinstance(e.get("text"), str) or not isinstance(e.get("type"), str):
            raise ValueError("an entity without text or type")
        base = e.get("base_form")
        out.append({"text": e["text"], "type": e["type"].upper(), "base_form": base if isinstance(base, str) and base else None})
    return out


def ask(client: Client, prompt: str, retries: int = 3, base_delay: float = 1.0, max_delay: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> list[dict] | None:
    """The entities of one prompt, or None after the last failure; waits grow twofold with up to a tenth at random."""
    for attempt in range(max(1, retries)):
        try:
            return parse_answer(client.complete(prompt))
        except Exception as e:
            if not classify(e)[0] or attempt + 1 >= retries:
                return None
            sleep(min(max_delay, base_delay * 2**attempt) * (1 + random.random() / 10))
    return None


def prompt_key(model: str, prompt: str) -> str:
    return f"{model}:{hashlib.md5(prompt.encode()).hexdigest()}"


def prompt_key_column(model: str, template: str, text: Column) -> Column:
    """The same for a column of texts."""
    return F.concat(F.lit(f"{model}:"), F.md5(F.replace(F.lit(template), F.lit("{text}"), text)))


def model_hits(chunks: DataFrame, client: Client, template: str = PROMPTS["simple"], doc: str = "doc_id", retries: int = 3, base_delay: float = 1.0, max_delay: float = 10.0, cache: DataFrame | None = None, model: str = "model") -> tuple[DataFrame, DataFrame]:
    """(hits, new cache rows) of chunks (doc, chunk_idx, text).

    Each distinct prompt is asked once; prompts that the cache (key, entities)
    holds are not asked.  A prompt that failed gives no hits and no cache row, so
    it is asked again next time.  Answers are written to the shared folder,
    since asking twice may answer twice.  The client is sent to the workers, so
    it must pickle.
    """
    keyed = chunks.withColumn("key", prompt_key_column(model, template, F.col("text")))
    schema = "key string, entities array<struct<text:string,type:string,base_form:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [ask(client, template.replace("{text}", t), retries, base_delay, max_delay) for t in b["text"]]
            answered = [g is not None for g in got]
            if any(answered):
                yield pd.DataFrame({"key": b["key"], "entities": got})[answered]

    todo = keyed.select("key", "text").dropDuplicates(["key"])
    if cache is not None:
        todo = todo.join(cache.select("key"), "key", "left_anti")
    new = staged(todo.mapInPandas(run, schema), "answers")
    answers = new if cache is None else new.unionByName(cache.select("key", "entities"))
    joined = keyed.select(doc, "chunk_idx", "key").join(answers, "key").select(doc, "chunk_idx", F.posexplode("entities").alias("match_idx", "e"))
    hits = joined.select(doc, F.col("chunk_idx").cast("long").alias("chunk_idx"), F.lit(1).alias("stage"), F.lit(0).alias("pattern_idx"), "match_idx", "e.text", "e.type", "e.base_form")
    return hits.where(F.trim("text") != ""), new
