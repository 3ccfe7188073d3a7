"""User-supplied models: OCR of image bytes and field models over texts.

Both run as pandas functions over the one column they read, with the model made once per task; the other
columns stay where they are. A document that fails becomes a row with `error` set; the others go on. So does one
whose call takes longer than `limit` seconds; calls may run `at_once` several at a time (see `sources.calls`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwright.functions.candidates import MODEL_ENTITIES
from formwright.operators.text_assembly import LINES, text_lines
from formwright.sources.calls import Caller
from formwright.vocabulary import OCR_CALL_LIMIT

ReadLines = Callable[[bytes], Iterable[Mapping[str, Any]]]
ReadText = Callable[[bytes], str]
FindEntities = Callable[[str], Iterable[Mapping[str, Any]]]


def choose_provider(
    providers: Mapping[str, Callable[..., Any]], order: Sequence[str], keys: Mapping[str, str]
) -> tuple[str, Callable[..., Any]]:
    """The first provider of `order` whose key is there; the last one needs none."""
    return next(_candidates(providers, order, keys))


def _candidates(providers, order, keys) -> Iterator[tuple[str, Callable[..., Any]]]:
    if not order or order[-1] not in providers:
        raise ValueError(f"unknown OCR provider: {order[-1] if order else None}")
    for name in order[:-1]:
        if keys.get(name):
            yield name, providers[name]
    yield order[-1], providers[order[-1]]


def make_first_provider(
    providers: Mapping[str, Callable[..., Any]], order: Sequence[str], keys: Mapping[str, str]
) -> tuple[str, Any, dict[str, str]]:
    """The first provider that can be made, and the errors of those before it.

    Providers with a key are called with it, the last one without. If none can be made, the last error stands.
    """
    failed: dict[str, str] = {}
    for name, make in _candidates(providers, order, keys):
        try:
            return name, make(keys[name]) if name != order[-1] else make(), failed
        except Exception as problem:
            if name == order[-1]:
                raise
            failed[name] = str(problem) or type(problem).__name__
    raise ValueError("no OCR provider")


def _apply(
    df: DataFrame,
    source: str,
    column: str,
    type_name: str,
    make: Callable[[], Callable],
    shape,
    limit: float | None,
    at_once: int,
) -> DataFrame:
    """`df` with the result of a model on `source`, and `error` where it failed.

    Rows that failed earlier are passed over. Image bytes are not kept: nothing after this needs them.
    """
    if at_once > 1:
        df = in_long_tasks(df)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = make()
        caller = Caller(lambda value: shape(model(value)), limit, at_once)
        rows = ([None if skip else (value,) for value, skip in zip(values, skipped)] for values, skipped in batches)
        for results, errors in caller.batches(rows):
            yield pd.DataFrame({"result": results, "error": errors}, dtype=object)

    # As a random function it is neither moved nor repeated by the optimizer.
    model = F.pandas_udf(run, f"result: {type_name}, error: string").asNondeterministic()
    earlier = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    done = fresh_name(df, "_model")
    applied = df.withColumn(done, model(F.col(source), earlier.isNotNull()))
    kept = [c for c in df.columns if c not in (column, "error", "content")]
    return applied.select(
        *kept,
        F.col(done)["result"].alias(column),
        F.coalesce(earlier, F.col(done)["error"]).alias("error"),
    )


#: Tasks a core of calls that are waited for.
LONG_TASKS = 4


def in_long_tasks(df: DataFrame) -> DataFrame:
    """The rows in few tasks, without a shuffle, for calls that are waited for several at a time.

    At the end of its rows a task waits for the last calls with a part of those it may have, and at their begin for its model.
    So many short tasks wait much longer for the same calls than a few that go on.
    """
    return df.coalesce(LONG_TASKS * df.sparkSession.sparkContext.defaultParallelism)


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column has it."""
    while name in df.columns:
        name = "_" + name
    return name


def ocr_lines(
    images: DataFrame, make_reader: Callable[[], ReadLines], limit: float | None = OCR_CALL_LIMIT, at_once: int = 1
) -> DataFrame:
    """Adds `lines` (see `LINES`) by a reader of image bytes that reports lines.

    `make_reader` is called once per task; its reader gives mappings with text, confidence, bbox. With `at_once`
    above one it is called from several threads.
    """

    def shape(lines):
        return [
            {
                "line_no": i,
                "text": line["text"],
                "confidence": float(line["confidence"]),
                "bbox": [[float(c) for c in point] for point in line["bbox"]],
            }
            for i, line in enumerate(lines)
        ]

    return _apply(images, "content", "lines", LINES, make_reader, shape, limit, at_once)


def ocr_text(
    images: DataFrame, make_reader: Callable[[], ReadText], limit: float | None = OCR_CALL_LIMIT, at_once: int = 1
) -> DataFrame:
    """Adds `raw_text` by a reader of image bytes that reports plain text, and `lines` from it."""
    read = _apply(images, "content", "raw_text", "string", make_reader, lambda text: text, limit, at_once)
    return read.withColumn("lines", text_lines(F.col("raw_text")))


def model_entities(
    docs: DataFrame, make_model: Callable[[], FindEntities], limit: float | None = None, at_once: int = 1
) -> DataFrame:
    """Adds `entities` by a field model over `text`; without a `limit` a call may take as long as it wants.

    `make_model` is called once per task; its model gives mappings with entity_group, word, score,
    start, end in the order found.
    """

    def shape(entities):
        return [
            {
                "entity_group": e["entity_group"],
                "word": e["word"],
                "score": float(e["score"]),
                "start": e.get("start"),
                "end": e.get("end"),
            }
            for e in entities
        ]

    return _apply(docs, "text", "entities", MODEL_ENTITIES, make_model, shape, limit, at_once)


def failures(docs: DataFrame, at: Column | None = None) -> DataFrame:
    """The failed documents of a frame with `error`."""
    return docs.filter(F.col("error").isNotNull()).select(
        "doc_id",
        "path",
        "error",
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        F.lit("failed").alias("status"),
    )


def succeeded(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("error").isNull()).drop("error")
