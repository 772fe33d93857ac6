"""Conversations rendered by a compiled template, as Spark rows of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwatch.llm import chat_template
from quietwatch.llm.common import arrow_schema, batch_of

#: A long conversation is written in parts of about this many characters, each of whole turns.
PART_CHARS = 1_000_000


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Groups of neighbouring rows of one conversation, read as they come."""
    from itertools import groupby

    rows = (row for batch in batches for row in batch.to_pylist())
    for key, group in groupby(rows, key=lambda r: r["conv_id"]):
        yield key, group


def format_conversations(turns: DataFrame, template: str = chat_template.TEMPLATE) -> DataFrame:
    """Parts of formatted conversations: ``conv_id``, ``part``, ``formatted`` and ``generated`` spans in code points.

    Turns go by ``turn``, equal ones by role and text; null roles and texts are empty; null ids are one
    conversation.  A conversation streams through its task turn by turn, so its length is not bounded by memory;
    one that needs more than a part has several rows, numbered from 0.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {id_type}, part int, formatted string, generated array<struct<start: long, end: long>>"
    target = arrow_schema(turns.sparkSession, schema)

    def run(batches):
        render = chat_template.compile_template(template)
        out: dict[str, list] = {f.name: [] for f in target}
        held = 0

        def put(key, part, texts, spans):
            nonlocal held
            out["conv_id"].append(key)
            out["part"].append(part)
            out["formatted"].append("".join(texts))
            out["generated"].append(spans)
            held += len(out["formatted"][-1])

        for key, group in _conversations(batches):
            part, texts, spans, size, whole = 0, [], [], 0, 0

            def messages(group=group):
                nonlocal whole
                for row in group:
                    whole = len(texts)  # all before this turn is complete
                    yield row["role"], row["text"]

            for text, generated in render(messages()):
                if size >= PART_CHARS and whole == len(texts):
                    put(key, part, texts, spans)
                    part, texts, spans, size, whole = part + 1, [], [], 0, 0
                    yield batch_of(out, target)
                    out, held = {f.name: [] for f in target}, 0
                if generated and text:
                    if spans and spans[-1]["end"] == size:
                        spans[-1]["end"] = size + len(text)
                    else:
                        spans.append({"start": size, "end": size + len(text)})
                texts.append(text)
                size += len(text)
            put(key, part, texts, spans)
            if held >= PART_CHARS or len(out["part"]) >= 1000:
                yield batch_of(out, target)
                out, held = {f.name: [] for f in target}, 0
        if out["part"]:
            yield batch_of(out, target)

    return ordered.mapInArrow(run, schema)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted parts alone; parts must come as ``format_conversations``
    left them, neighbouring and in order."""
    id_type = parts.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long"
    )
    target = arrow_schema(parts.sparkSession, schema)

    def run(batches):
        out: dict[str, list] = {f.name: [] for f in target}
        for key, group in _conversations(batches):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            for row in group:
                text = row["formatted"]
                chars += len(text)
                for role, said in chat_template.read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n_turns += 1
                for span in row["generated"]:
                    learned = chat_template.unescape(text[span["start"] : span["end"]])
                    loss.update(learned.encode())
                    loss_chars += len(learned)
            values = (key, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
            for name, value in zip(target.names, values, strict=True):
                out[name].append(value)
            if len(out["conv_id"]) >= 1000:
                yield batch_of(out, target)
                out = {f.name: [] for f in target}
        if out["conv_id"]:
            yield batch_of(out, target)

    return parts.mapInArrow(run, schema)
