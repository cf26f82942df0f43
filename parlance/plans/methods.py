"""Methods that are compared on a benchmark: a registry, a one-call baseline, and runs that resume."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators import ports
from parlance.sources import sinks
from parlance.sources.benchmark import common_schema, rendered


@dataclass(frozen=True)
class Method:
    """``run`` takes turns and a maker of models and gives (meeting_id, answer, error); ``fingerprint`` names its prompt and settings."""

    name: str
    run: Callable[[DataFrame, Callable[[], ports.LLM]], DataFrame]
    fingerprint: str


METHODS: dict[str, Method] = {}


def register(method: Method) -> Method:
    METHODS[method.name] = method
    return method


def load(name: str) -> Method:
    if name not in METHODS:
        raise ValueError(f"no method {name!r}; there are {', '.join(sorted(METHODS))}")
    return METHODS[name]


def _zero_shot(turns: DataFrame, make: Callable[[], ports.LLM]) -> DataFrame:
    asked = ports.ask(rendered(turns), "zero_shot", "prompt", {}, make)
    return asked.select("meeting_id", "answer", F.col("answer_error").alias("error"))


ZERO_SHOT = register(Method("zero_shot", _zero_shot, "zero_shot/1"))


def cache_key(method: Method, prompt: Column) -> Column:
    """What a stored result depends on: the method, its prompt and settings, and the meeting."""
    return F.left(F.sha2(F.concat_ws("\n", F.lit(method.name), F.lit(method.fingerprint), prompt), 256), F.lit(32))


def run(names: list[str], turns: DataFrame, make: Callable[[], ports.LLM], path: str) -> DataFrame:
    """Runs the methods on the meetings that have no good result under the same key yet, and gives all newest results."""
    for name in names:
        method = load(name)
        asked = rendered(turns).select(F.lit(name).alias("method"), "meeting_id", cache_key(method, F.col("prompt")).alias("cache_key"))
        open_ = sinks.unfinished(asked, path)
        got = method.run(turns.join(open_.select("meeting_id"), "meeting_id", "left_semi"), make).join(open_, "meeting_id")
        status = F.when(F.col("answer").isNull(), "error").otherwise("ok")
        sinks.save_results(got.select("method", "meeting_id", "cache_key", status.alias("status"), "error", F.to_json(common_schema(F.col("answer"))).alias("output")), path)
    return sinks.results(turns.sparkSession, path)
