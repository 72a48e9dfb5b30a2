"""Paths into JSON documents, with selectors of list elements, compiled to column expressions over variants.

``a.b``, ``runs[id=x].v`` and ``runs[op.id=x,set=y].v``: a selector names an element by the values at key paths
inside it, and has to match exactly one. Nothing is guessed: what can't be followed has no value and a stated problem.
Scalars are compared as JSON text, strings without quotes; ``True``, ``False`` and ``None`` stand for JSON's own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = re.compile(r"[^\[\]'\"\\]+")
_SELECTOR = re.compile(r"([A-Za-z0-9_-]+)\[(.+)\]")
PROBLEMS = ("not found", "not a list", "a list without a selector", "matched elements")


@dataclass(frozen=True)
class Step:
    """A key, and the (key path, value) pairs that select one element if it holds a list."""

    name: str
    wanted: tuple[tuple[tuple[str, ...], str], ...] = ()


def _checked(name: str, path: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no key, in path {path!r}")
    return name


def parse(path: str) -> list[Step]:
    """The steps of a path. Dots and commas inside brackets belong to the selector; brackets have to be balanced."""
    parts, depth, current = [], 0, ""
    for char in path:
        depth += (char == "[") - (char == "]")
        if depth not in (0, 1):
            raise ValueError(f"unbalanced brackets in path {path!r}")
        if char == "." and not depth:
            parts.append(current)
            current = ""
        else:
            current += char
    if depth:
        raise ValueError(f"unbalanced brackets in path {path!r}")
    steps = []
    for part in (p for p in [*parts, current] if p):
        selector = _SELECTOR.fullmatch(part)
        if not selector:
            steps.append(Step(_checked(part, path)))
            continue
        pairs = [pair.partition("=") for pair in selector[2].split(",")]
        if any(not sign for _, sign, _ in pairs):
            raise ValueError(f"a selector needs key=value, in path {path!r}")
        steps.append(Step(selector[1], tuple((tuple(_checked(k, path) for k in key.strip().split(".")), value.strip()) for key, _, value in pairs)))
    if not steps:
        raise ValueError(f"path {path!r} names nothing")
    return steps


def _at(document: Column, keys: tuple[str, ...], kind: str = "variant") -> Column:
    return F.try_variant_get(document, "$" + "".join(f"['{k}']" for k in keys), kind)


def _matcher(step: Step):
    """Whether an element has all the values of a selector."""

    def matches(element: Column) -> Column:
        held = F.lit(True)
        for keys, value in step.wanted:
            if value == "None":
                same = F.is_variant_null(_at(element, keys))
            else:
                same = _at(element, keys, "string") == (value.lower() if value in ("True", "False") else value)
            held = held & F.coalesce(same, F.lit(False))
        return held

    return matches


def _kind(document: Column) -> Column:
    return F.substring(F.schema_of_variant(document), 1, 5)


def follow(document: Column, path: str) -> Column:
    """struct<value: variant, problem: string> of a variant: the value at the path, or why there is none."""
    value, problem = document, F.when(document.isNull(), "no document")
    for step in parse(path):
        name = F.lit(f"{step.name}: ")
        found = _at(value, (step.name,))
        fault = F.when(_kind(value) == "ARRAY", F.concat(name, F.lit(PROBLEMS[2]))).when(found.isNull(), F.concat(name, F.lit(PROBLEMS[0])))
        if step.wanted:
            hits = F.filter(F.try_variant_get(found, "$", "array<variant>"), _matcher(step))
            n = F.size(hits)
            fault = fault.when(_kind(found) != "ARRAY", F.concat(name, F.lit(PROBLEMS[1]))).when(n != 1, F.concat(name, F.lit("matched "), n.cast("string"), F.lit(" elements")))
            found = F.get(hits, F.lit(0))
        problem = F.coalesce(problem, fault)
        value = F.when(problem.isNull(), found)
    return F.struct(value.alias("value"), problem.alias("problem"))


def text_at(document: Column, path: str) -> Column:
    """struct<value: string, problem: string> of JSON text; scalars as text, lists and objects as JSON."""
    parsed = F.try_parse_json(document)
    found = follow(parsed, path)
    plain = F.coalesce(F.try_variant_get(found["value"], "$", "string"), F.to_json(found["value"]))
    return F.struct(plain.alias("value"), F.when(parsed.isNull() & document.isNotNull(), "broken document").otherwise(found["problem"]).alias("problem"))
