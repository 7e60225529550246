"""Model steps behind a pluggable backend, and the variants made of them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHARS_FREE_TEXT, CHARS_JSON, truncate
from . import claims, documents, freetext, grounding, verify

#: Token budgets and sampling of each step: fixed values.
STEPS = {"free_text": {"max_tokens": 1024, "temperature": 0.1, "top_p": 0.9, "repeat_penalty": 1.1}, "extract": {"max_tokens": 2048, "temperature": 0.2}, "verify": {"max_tokens": 256, "temperature": 0.0}, "repair": {"max_tokens": 2048, "temperature": 0.0}}
#: Most characters of a broken answer that its repair sees: a fixed value.
REPAIR_CHARS = 3_000


class Backend(Protocol):
    """A model: prompts in, answers out. It is made once in each Python worker."""

    def __call__(self, prompts: list[str], **options) -> list[str]: ...


class Stub:
    """A deterministic stand-in: answers yes or no by a hash of the prompt, or echoes an empty document."""

    def __call__(self, prompts: list[str], **options) -> list[str]:
        if options.get("max_tokens", 0) <= 256:
            return ["Yes." if hashlib.sha256(p.encode()).digest()[0] % 2 else "No." for p in prompts]
        return ['{"report_metadata": {"report_type": "campaign"}, "indicators_of_compromise": {}, "summary": "%s"}' % hashlib.sha256(p.encode()).hexdigest() for p in prompts]


def generate(rows: DataFrame, prompt: Column, step: str, backend: Callable[[], Backend] = Stub, name: str = "answer", drop: tuple[str, ...] = ()) -> DataFrame:
    """The columns of rows but those of `drop`, and the model's answer to each prompt; a prompt that fails has a null answer and its error.

    Columns to drop do not go to Python, which gets a text once, in its prompt; prompts are read from Arrow one at a time."""
    options = STEPS[step]
    sent = rows.withColumn("_prompt", prompt).drop(*drop)
    kept = sent.drop("_prompt")
    names = kept.columns
    schema = kept.withColumn(name, F.lit("")).withColumn("error", F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = backend()
        for batch in batches:
            answers, errors = [], []
            for p in batch.column("_prompt"):
                try:
                    answers.append(model([p.as_py()], **options)[0])
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  one prompt must not end the job
                    answers.append(None)
                    errors.append(str(error))
            columns = {c: batch.column(c) for c in names} | {name: pa.array(answers, pa.string()), "error": pa.array(errors, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], names=[f.name for f in schema])

    for field in schema:
        field.nullable = True
    return sent.mapInArrow(run, schema)


def free_text_prompt(text: Column) -> Column:
    return F.concat(F.lit("List the indicators, tools and techniques of this report, one labelled line each, then a summary.\n\n"), truncate(text, CHARS_FREE_TEXT))


def extract_prompt(text: Column) -> Column:
    return F.concat(F.lit("Return one JSON object with the indicators, techniques, timeline and summary of this report, each with the words that support it.\n\n"), truncate(text, CHARS_JSON))


def verify_prompt(question: Column, text: Column) -> Column:
    return F.concat(F.lit("Answer yes or no from the report alone.\nQuestion: "), question, F.lit("\n\n"), truncate(text, CHARS_JSON))


def repair_prompt(broken: Column) -> Column:
    return F.concat(F.lit("Return this as one valid JSON object.\n\n"), F.substring(broken, 1, REPAIR_CHARS))


def v0(reports: DataFrame, backend=Stub) -> tuple[DataFrame, DataFrame]:
    """(doc_id, doc; sentinels): free text read line by line; a report that the model gave nothing for is a sentinel."""
    raw = generate(reports.select("doc_id", "text"), free_text_prompt(F.col("text")), "free_text", backend, drop=("text",)).select("doc_id", F.col("answer").alias("text"), "error")
    given = raw.where("text is not null").select("doc_id", "text")
    docs = documents.from_freetext(freetext.indicators(given), freetext.techniques(given), freetext.summary(freetext.lines(given)), given)
    return docs, documents.sentinels(raw.where("text is null").select("doc_id", F.coalesce("error", F.lit("no answer")).alias("error")))


def v1(reports: DataFrame, backend=Stub) -> tuple[DataFrame, DataFrame]:
    """(doc_id, doc; sentinels): JSON, repaired, coerced and validated. Only answers that no local repair parses go to the model again."""
    raw = generate(reports.select("doc_id", "text"), extract_prompt(F.col("text")), "extract", backend, "raw_output", ("text",))
    first = documents.parse_outputs(raw)
    again = generate(first.where("strategy is null").select("doc_id", "raw_output"), repair_prompt(F.col("raw_output")), "repair", backend, drop=("raw_output",)).select("doc_id", F.col("answer").alias("raw_output"), "error")
    both = first.where("strategy is not null").unionByName(documents.parse_outputs(again))
    ok, bad = documents.split(both)
    why = F.coalesce("error", F.when(F.col("strategy").isNull(), "json repair failed after four strategies").otherwise(F.concat(F.lit("invalid: "), F.array_join("violations", ", "))))
    return ok.select("doc_id", "doc"), documents.sentinels(bad.select("doc_id", why.alias("error")))


def v2(extracted: DataFrame, reports: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(doc_id, doc; judged claims): v1's documents with only the items that their reports support; options as in grounding.ground."""
    judged = grounding.ground(claims.flatten(extracted), reports, **options)
    docs, _ = documents.without(extracted, judged.where(~F.col("kept")))
    return docs, judged


def v3(extracted: DataFrame, reports: DataFrame, backend=Stub) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, doc; answers; steps): v1's documents without the items that a question of their own rejects. v1's output is read, not made again.

    A question that the model gave no answer to rejects nothing; its error is in `answers`."""
    every = claims.flatten(extracted, subject=True)
    # The question is joined with the part of the report that its prompt holds, not with all of it.
    asked = verify.questions(every).join(reports.select("doc_id", truncate(F.col("text"), CHARS_JSON).alias("text")), "doc_id", "left")
    answers = generate(asked, verify_prompt(F.col("question"), F.coalesce("text", F.lit(""))), "verify", backend, drop=("text",))
    answers = answers.withColumn("supported", F.when(F.col("answer").isNotNull(), verify.supported(F.col("answer"))))
    gone = verify.deleted(every, answers.where(~F.col("supported")))
    docs, fallback = documents.without(extracted, gone)
    return docs, answers, verify.steps(every, answers, gone, fallback)


#: The variants by name.
VARIANTS: dict[str, Callable] = {"v0": v0, "v1": v1, "v2": v2, "v3": v3}
