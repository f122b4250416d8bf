"""Pluggable models: embedders and generators behind small protocols, with offline defaults."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import numbered, without_fence


class Embedder(Protocol):
    """Vectors of a fixed dimension for a batch of texts."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of lower-case words; unit vectors, equal for equal texts, without any model file."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1.0 if h >> 63 else -1.0
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(lengths > 0, lengths, 1)


def embed(chunks: DataFrame, embedder: Embedder, text: str = "text", batch: int = 100) -> DataFrame:
    """Add embedding to chunks; the embedder is made once a task and asked for `batch` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            rows: list = []
            for i in range(0, len(texts), batch):
                rows += list(embedder.embed(texts.iloc[i : i + batch].fillna("").tolist()))
            yield pd.Series(rows, index=texts.index, dtype=object)

    return chunks.withColumn("embedding", run(F.col(text)))


#: Vector lengths by embedding model.
DIMENSIONS = {"text-embedding-ada-002": 1536, "text-embedding-3-small": 1536, "text-embedding-3-large": 3072}


def dimension_of(model: str, embedder: Embedder | None = None) -> int:
    """A known model's vector length, else that of a vector which the embedder makes."""
    for name, n in DIMENSIONS.items():
        if name in model.lower():
            return n
    if embedder is None:
        raise ValueError(f"the vectors of {model!r} have no known length, and there is no embedder to ask")
    return len(embedder.embed(["test"])[0])


def embed_levels(chunks: DataFrame, embedders: dict[str, Embedder], batch: int = 100) -> DataFrame:
    """Add embedding to chunks of several levels, each by its level's embedder; null for levels without one."""
    found = None
    for level, embedder in embedders.items():
        own = embed(chunks.filter(F.col("level") == level), embedder, batch=batch)
        found = own if found is None else found.unionByName(own)
    rest = chunks.filter(~F.col("level").isin(*embedders) | F.col("level").isNull()).withColumn("embedding", F.lit(None).cast("array<float>"))
    return rest if found is None else found.unionByName(rest)


class Generator(Protocol):
    """Text for a prompt."""

    def generate(self, prompt: str) -> str: ...


def unfenced(text: str) -> str:
    """What stands in a code fence, or the whole text without one."""
    inside = re.search(r"```[a-zA-Z]*\s*\n?(.*?)```", text, re.S)
    return (inside[1] if inside else text).strip()


def fits(*required: str) -> Callable[[str], str | None]:
    """A check that an answer is a JSON object with these keys; a key with [] is a list, and a.b looks into each entry."""

    def lacks(value: object, path: list[str]) -> bool:
        head, rest = path[0], path[1:]
        if isinstance(value, list):
            return any(lacks(v, path) for v in value)
        if not isinstance(value, dict) or head.removesuffix("[]") not in value:
            return True
        inner = value[head.removesuffix("[]")]
        return head.endswith("[]") and not isinstance(inner, list) or bool(rest) and lacks(inner, rest)

    def check(text: str) -> str | None:
        try:
            made = json.loads(text)
        except ValueError as e:
            return f"not JSON: {e}"
        wrong = [r for r in required if lacks(made, r.split("."))]
        return f"without {', '.join(wrong)}" if wrong else None

    return check


def speaks(pattern: str) -> Callable[[str], str | None]:
    """A check that an answer has a line of some pattern."""
    return lambda text: None if re.search(pattern, text, re.M) else f"no line like {pattern}"


@dataclass(frozen=True)
class Task:
    """What a generator is asked for: a template, which XXX numbers, and a check of the answer."""

    template: str
    check: Callable[[str], str | None]


#: The six documents that are generated for a meeting.
TASKS = {
    "transcript": Task("Rewrite the recording as the transcript dataXXX: one paragraph a turn, each with its tag [#P001], its time and its speaker.", speaks(r"^\[#P\d+\]")),
    "metadata": Task("Describe meeting dataXXX as a JSON object with meeting_id, title, datetime, participants, topics, keywords, summary_brief and actions.", fits("meeting_id", "title", "participants[].name", "topics[]", "actions[].description_plain")),
    "meeting_level": Task("List the key topics and action items of dataXXX under ## headings, each entry with its id and the paragraphs that it refers to.", speaks(r"^## ")),
    "summary": Task("Summarise dataXXX as bullets [SXXX-T01] Topic and [SXXX-A01] Action, each with a Reference line to entries.", speaks(r"\[S\d+-[TA]\d+\]")),
    "outline": Task("Outline dataXXX as a JSON object with high_level_topic and second_level_topics, each with topic_name and bullet_points.", fits("high_level_topic", "second_level_topics[].topic_name", "second_level_topics[].bullet_points[].point")),
    "report": Task("Write a report on dataXXX from its outline and transcript, a ## section for each topic.", speaks(r"^## ")),
}


def generate_task(rows: DataFrame, task: str, generator: Generator, fallback: Generator | None = None, **columns: str) -> DataFrame:
    """One of the six documents for each row, checked; see generate."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}; known: {', '.join(TASKS)}")
    return generate(rows, generator, TASKS[task].template, fallback=fallback, check=TASKS[task].check, **columns)


class TemplateGenerator:
    """Offline stand-in: gives back the prompt's last lines as a fenced block, so that the steps around it can run."""

    def __init__(self, n_lines: int = 5):
        self.n_lines = n_lines

    def generate(self, prompt: str) -> str:
        return "```\n" + "\n".join(prompt.splitlines()[-self.n_lines :]) + "\n```"


def generate(
    rows: DataFrame, generator: Generator, template: str, number: str = "file_num", text: str = "text", fallback: Generator | None = None, check: Callable[[str], str | None] | None = None
) -> DataFrame:
    """Add generated: the template with the row's number, then its text, through a generator, without code fences.

    check gives what is wrong with an answer, or None. Where the generator fails or its answer is wrong, the fallback is
    asked; where that fails too, generated is null and error says why.
    """
    import pyarrow as pa

    prompts = rows.withColumn("prompt", F.concat(numbered(F.lit(template), F.col(number)), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, errors = [], []
            for prompt in batch.column("prompt").to_pylist():
                result, error = None, None
                for model in filter(None, (generator, fallback)):
                    try:
                        result = model.generate(prompt)
                        error = check(unfenced(result)) if check else None
                        if error is None:
                            break
                        result = None
                    except Exception as e:  # a model's failure is this row's result
                        error = f"{type(e).__name__}: {e}"
                made.append(result)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(number), pa.array(made, pa.string()), pa.array(errors, pa.string())], [number, "generated", "error"])

    kind = rows.schema[number].dataType.simpleString()
    answered = prompts.select(number, "prompt").mapInArrow(run, f"{number} {kind}, generated string, error string")
    return answered.withColumn("generated", without_fence(F.col("generated")))
