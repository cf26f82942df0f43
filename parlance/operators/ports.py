"""Models behind ports: what they are asked, how a table calls them, and fakes that need no model.

A port is called once per different input (the table's inputs are made distinct first and joined
back), inside ``mapInPandas``, with retries there. A call that fails gives an error, not an
exception, so that a failed row never takes its partition along.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LLM(Protocol):
    def generate_json(self, system: str, user: str, schema: dict) -> dict: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Judge(Protocol):
    def judge(self, text: str) -> dict[str, float]: ...


class UpstreamError(Exception):
    """A port's service failed; ``kind`` is timeout, connection, rate or other."""

    def __init__(self, message: str, kind: str = "other") -> None:
        super().__init__(message)
        self.kind = kind


ATTEMPTS = {"timeout": 4, "connection": 6, "rate": 8, "other": 1}


def with_retries(call: Callable[[], object], pause: float = 0.5, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The call's result; failures are tried again within the budget of their kind, pausing longer each time."""
    failed: dict[str, int] = {}
    while True:
        try:
            return call()
        except UpstreamError as error:
            failed[error.kind] = failed.get(error.kind, 0) + 1
            if failed[error.kind] >= ATTEMPTS.get(error.kind, 1):
                raise
            sleep(min(most, pause * 2 ** (failed[error.kind] - 1)))


def first_json_object(text: str) -> dict:
    """The first JSON object in a model's answer, fenced or not; ValueError if there is none."""
    text = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text)
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = json.JSONDecoder().raw_decode(text, at)
            if isinstance(found, dict):
                return found
        except ValueError:
            pass
        at = text.find("{", at + 1)
    raise ValueError("no JSON object")


def strict_schema(schema: dict) -> dict:
    """The schema with every object closed and all of its properties required."""
    if isinstance(schema, list):
        return [strict_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: strict_schema(v) for k, v in schema.items()}
    if out.get("type") == "object" and "properties" in out:
        out |= {"additionalProperties": False, "required": list(out["properties"])}
    return out


def ask(rows: DataFrame, system: str, prompt: str, schema: dict, make: Callable[[], LLM], out: str = "answer") -> DataFrame:
    """Adds ``out`` (JSON text) and ``out``_error: the model's answer to each row's prompt column."""
    asked = rows.select(F.col(prompt).alias("_prompt")).filter("_prompt is not null").distinct()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        llm = make()
        for part in parts:
            answers, errors = [], []
            for p in part["_prompt"]:
                try:
                    answers.append(json.dumps(with_retries(lambda p=p: llm.generate_json(system, p, schema)), ensure_ascii=False))
                    errors.append(None)
                except Exception as error:
                    answers.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pd.DataFrame({"_prompt": part["_prompt"], out: pd.Series(answers, dtype=object), f"{out}_error": pd.Series(errors, dtype=object)})

    answered = asked.mapInPandas(run, f"_prompt string, {out} string, {out}_error string")
    return rows.join(answered, rows[prompt] == answered["_prompt"], "left").drop("_prompt")


def embed(rows: DataFrame, text: str, make: Callable[[], Embedder], out: str = "embedding") -> DataFrame:
    """Adds the embedding of a text column."""
    asked = rows.select(F.col(text).alias("_text")).filter("_text is not null").distinct()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            texts = part["_text"].tolist()
            order = np.argsort([len(t) for t in texts], kind="stable")  # neighbours of one length pad least
            vectors = np.empty(len(texts), dtype=object)
            for lo in range(0, len(texts), 64):
                at = order[lo : lo + 64]
                for i, v in zip(at, model.embed([texts[i] for i in at]), strict=True):
                    vectors[i] = v.astype(np.float32)
            yield pd.DataFrame({"_text": texts, out: vectors})

    vectors = asked.mapInPandas(run, f"_text string, {out} array<float>")
    return rows.join(vectors, rows[text] == vectors["_text"], "left").drop("_text")


def judge(rows: DataFrame, text: str, make: Callable[[], Judge], out: str = "labels") -> DataFrame:
    """Adds the labels' probabilities of a text column, and whether the call failed."""
    asked = rows.select(F.col(text).alias("_text")).filter("_text is not null").distinct()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            labels, failed = [], []
            for t in part["_text"]:
                try:
                    labels.append({str(k): float(v) for k, v in with_retries(lambda t=t: model.judge(t)).items()})
                    failed.append(False)
                except Exception:
                    labels.append(None)
                    failed.append(True)
            yield pd.DataFrame({"_text": part["_text"], out: pd.Series(labels, dtype=object), f"{out}_failed": failed})

    judged = asked.mapInPandas(run, f"_text string, {out} map<string,double>, {out}_failed boolean")
    return rows.join(judged, rows[text] == judged["_text"], "left").drop("_text")


# --- fakes ------------------------------------------------------------------------------------------


class FakeLLM:
    """Answers from a table by what the prompt holds, else by ``default``."""

    def __init__(self, answers: dict[str, dict | Exception] | None = None, default: dict | None = None) -> None:
        self.answers, self.default = answers or {}, default or {}

    def generate_json(self, system: str, user: str, schema: dict) -> dict:
        for key, answer in self.answers.items():
            if key in user:
                if isinstance(answer, Exception):
                    raise answer
                return answer
        return self.default


class HashingEmbedder:
    """Unit vectors from the hashes of words: texts with common words are near."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                row[h % self.dims] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class CueJudge:
    """Probabilities from cue phrases, for tests without a model."""

    def __init__(self, cues: dict[str, list[str]]) -> None:
        self.cues = cues

    def judge(self, text: str) -> dict[str, float]:
        hits = {label: sum(c in text.lower() for c in cues) for label, cues in self.cues.items()}
        total = sum(hits.values())
        return {k: (v / total if total else 1 / len(hits)) for k, v in hits.items()}
