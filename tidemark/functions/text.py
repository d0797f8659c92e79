"""Text rules: identifiers, task names, answers and the participant hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numeric import as_column

UINT32 = 4294967296


def trim_text(c: Column | str) -> Column:
    """Strip every kind of white space at both ends, line breaks and tabs included."""
    left = F.regexp_replace(as_column(c), r"(?U)^[\s﻿]+", "")
    return F.regexp_replace(left, r"(?U)[\s﻿]+$", "")


def normalize_answer(c: Column | str) -> Column:
    return F.lower(trim_text(c))


def answer_is_correct(response: Column | str, target: Column | str) -> Column:
    return normalize_answer(response) == normalize_answer(target)


def uint32_hash(c: Column | str, start: Column | int = 0) -> Column:
    """31-polynomial hash of the UTF-16 code units, modulo 2**32.

    ``start`` continues the hash of a text that stands before ``c``.
    """
    c = as_column(c)
    start = (F.lit(start) if isinstance(start, int) else start).cast("bigint")

    def unit(h: Column, code: Column) -> Column:
        return (h * 31 + code) % UINT32

    def step(h: Column, char: Column) -> Column:
        point = F.ascii(char)
        high = F.lit(55296) + F.floor((point - 65536) / 1024)
        low = F.lit(56320) + point % 1024
        return F.when(point < 65536, unit(h, point)).otherwise(unit(unit(h, high), low))

    return F.when(F.length(c) == 0, start).otherwise(F.aggregate(F.split(c, ""), start, step))


def file_stem(path: Column | str) -> Column:
    name = F.regexp_extract(as_column(path), r"([^/]+)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def task_of_video(path: Column | str) -> Column:
    """Task name for training: the part of the file stem behind the last underscore."""
    path = as_column(path)
    return F.when(F.length(path) > 0, F.element_at(F.split(file_stem(path), "_"), -1))


def task_of_recording(path: Column | str, manifest_task: Column | str) -> Column:
    """Task name at extraction: the manifest's own, else the stem behind the first underscore."""
    stem = file_stem(path)
    tail = F.regexp_extract(stem, r"^[^_]*_(.*)$", 1)
    return F.coalesce(as_column(manifest_task), F.when(F.instr(stem, "_") > 0, tail), F.lit("unknown"))


def split_subject_task(c: Column | str) -> tuple[Column, Column]:
    """User and task of a ``subject_task`` key, cut at the first underscore."""
    parts = F.split(as_column(c), "_", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def interference_group(item_id: Column | str) -> Column:
    return F.substring_index(as_column(item_id), "-", 2)


def join_choices(choices: Column | str) -> Column:
    return F.coalesce(F.array_join(as_column(choices), "|"), F.lit(""))


def record_id(
    participant: Column | str, kind: str, number: Column | str, condition: Column | str, at_ms: Column | str
) -> Column:
    """``participant_s1_condition_millis``; ``kind`` is ``s`` for sessions, ``d`` for delayed tests."""
    return F.concat_ws(
        "_",
        trim_text(participant),
        F.concat(F.lit(kind), as_column(number).cast("string")),
        as_column(condition),
        as_column(at_ms).cast("string"),
    )
