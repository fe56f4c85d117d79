"""[IO3, S3] Benchmarks: how each one's own columns become an item (bench, id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.sources.io import source


def items(raw: DataFrame, bench: str, key: Column, text: Column) -> DataFrame:
    return raw.select(F.lit(bench).alias("bench"), key.cast("string").alias("id"), text.alias("text"))


def _plain(bench: str, key: str, text: str):
    """A benchmark whose item is one column."""

    @source(bench)
    def read(raw: DataFrame) -> DataFrame:
        return items(raw, bench, F.col(key), F.col(text))

    return read


# The columns that name and make an item. `row` is a row's number in its split.
for _bench, _key, _text in (
    ("gsm8k", "row", "question"),
    ("mmlu", "row", "question"),
    ("arc_easy", "id", "question"),
    ("arc_challenge", "id", "question"),
    ("winogrande", "row", "sentence"),
    ("humaneval_prompt", "task_id", "prompt"),
    ("humaneval_solution", "task_id", "canonical_solution"),
    ("triviaqa", "question_id", "question"),
):
    _plain(_bench, _key, _text)


@source("hellaswag")
def hellaswag(raw: DataFrame) -> DataFrame:
    """The context with its right ending; label counts from 0."""
    return items(raw, "hellaswag", F.col("row"), F.concat("ctx", F.lit(" "), F.get("endings", F.col("label").cast("int"))))


@source("piqa")
def piqa(raw: DataFrame) -> DataFrame:
    """The goal with its right solution."""
    return items(raw, "piqa", F.col("row"), F.concat("goal", F.lit(" "), F.get(F.array("sol1", "sol2"), F.col("label").cast("int"))))


@source("conversations")
def conversations(raw: DataFrame) -> DataFrame:
    """Chat sets whose turns are `from` and `value` or `role` and `content`: (id, messages)."""
    known = set(raw.schema["messages"].dataType.elementType.fieldNames())
    role, content = ("from", "value") if "from" in known else ("role", "content")
    return raw.select("id", F.transform("messages", lambda m: F.struct(m[role].alias("role"), m[content].alias("content"))).alias("messages"))
