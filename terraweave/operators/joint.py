"""Typed relations out of chunks by a model, with the history of its attempts.

A chunk whose call fails is asked again with a stricter prompt and a higher
temperature; every attempt stays in the row. Chunks that fail to the end are
dead letters: a later run asks only for those, and for chunks it has not seen.
"""

from __future__ import annotations

import time
import urllib.error
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.arrays import elements
from . import extract

ATTEMPTS = "array<struct<attempt:int,temperature:double,strict:boolean,error:string,seconds:double>>"


def final(error: Exception) -> bool:
    """Answers of the server that another attempt would only repeat."""
    return isinstance(error, urllib.error.HTTPError)


@dataclass
class RelationModel:
    """Relation extractor backed by any ``chat(system, user, temperature) -> str`` callable.

    ``make_client`` is called once per task. Attempt n runs at ``temperature + n * step``, at most ``temperature_max``,
    and from the second on with ``stricter`` behind the system prompt. A response that cannot be parsed has no relations
    and is asked for again only with ``retry_unparsed``.
    """

    make_client: Callable[[], Callable[[str, str, float], str]]
    system: str = ""
    user: str = "{sentence}"
    stricter: str = ""
    temperature: float = 0.1
    temperature_step: float = 0.05
    temperature_max: float = 0.3
    max_attempts: int = 3
    backoff: float = 2.0
    retry_unparsed: bool = False

    def attach(self, chunks: DataFrame, text: str = "sentence") -> DataFrame:
        """``chunks`` with ``relations`` (all fields as strings, as the model wrote them), ``attempts`` and ``_error``."""
        cfg = self

        def usable(answer: str | None) -> bool:
            return not cfg.retry_unparsed or (answer is not None and "{" in answer and "}" in answer)

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            chat = cfg.make_client()
            for batch in batches:
                answers, histories, errors = [], [], []
                for passage in batch[text]:
                    answer, history = None, []
                    for attempt in range(cfg.max_attempts):
                        heat = min(cfg.temperature + attempt * cfg.temperature_step, max(cfg.temperature, cfg.temperature_max))
                        began, error = time.monotonic(), None
                        try:
                            answer = chat(cfg.system + (cfg.stricter if attempt else ""), cfg.user.format(sentence=passage or ""), heat)
                            error = None if usable(answer) else "unparsed"
                        except Exception as exc:  # kept with the row, not fatal
                            error, stop = repr(exc), final(exc)
                        else:
                            stop = error is None
                        history.append({"attempt": attempt, "temperature": heat, "strict": attempt > 0, "error": error,
                                        "seconds": time.monotonic() - began})
                        if stop:
                            break
                        if attempt + 1 < cfg.max_attempts and error != "unparsed":
                            time.sleep(cfg.backoff ** attempt if cfg.backoff else 0)
                    answers.append(answer)
                    histories.append(history)
                    errors.append(history[-1]["error"] if history[-1]["error"] != "unparsed" else None)
                yield batch.assign(response=answers, attempts=histories, _error=errors)

        schema = T.StructType([*chunks.schema.fields, *T.StructType.fromDDL(f"response string, attempts {ATTEMPTS}, _error string").fields])
        answered = chunks.mapInPandas(ask, schema)
        kind = answered.select(extract.parse_relations("response").alias("r")).schema["r"].dataType
        return answered.withColumn("relations", F.coalesce(extract.parse_relations("response"), F.array().cast(kind))).drop("response")


def relation_rows(answers: DataFrame, keep: list[str], min_confidence: float | None = 0.55) -> DataFrame:
    """One validated row per relation with its place ``ord`` in the answer; names, labels, class hints and distances cleaned."""
    rows = answers.select(*keep, F.posexplode(elements("relations")).alias("ord", "_r")).select(*keep, "ord", "_r.*")
    return extract.valid_relations(rows, min_confidence)


def outstanding(chunks: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks that no run has answered: new ones and dead letters."""
    return chunks.join(answers.where(F.col("_error").isNull()).select(*keys).distinct(), keys, "left_anti")


def latest(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Of each chunk the answer of its last run (``run``)."""
    others = [c for c in answers.columns if c not in keys]
    return answers.groupBy(*keys).agg(F.max_by(F.struct(*others), "run").alias("_a")).select(*keys, "_a.*")


def dead_letters(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, runs, attempts, last_error) of chunks that no run has answered."""
    return answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.size("attempts")).alias("attempts"), F.max_by("_error", "run").alias("last_error"),
        F.min(F.col("_error").isNotNull()).alias("_failed")).where("_failed").drop("_failed")
