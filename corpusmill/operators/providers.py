"""Model providers as batched partition functions, and small configuration helpers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str]]


def echo_provider(prompts: list[str]) -> list[str]:
    """Deterministic offline stand-in: a JSON verdict from the prompt's length."""
    return [f'{{"reasoning": "length", "score": {(0, 0.5, 1)[len(p) % 3]}, "reason": "stub"}}' for p in prompts]


def complete(rows: DataFrame, prompt: str, key: str, provider: Provider = echo_provider, batch: int = 16) -> DataFrame:
    """(key, reply): prompts sent in batches of ``batch`` from each partition."""
    rows = rows.select(key, prompt)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            prompts = pdf[prompt].tolist()
            replies = [r for i in range(0, len(prompts), batch) for r in provider(prompts[i : i + batch])]
            yield pd.DataFrame({key: pdf[key], "reply": replies})

    return rows.mapInPandas(run, f"`{key}` {kind}, reply string")


def second_pass(rows: DataFrame, prompt: str, key: str, provider: Provider, batch: int = 16) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows split by a provider's verdict; only a reply that begins with ``irrelevant`` removes a row."""
    name = "reply"
    judged = rows.join(complete(rows, prompt, key, provider, batch).withColumnRenamed("reply", name), key)
    removed = F.coalesce(F.lower(F.ltrim(name)).startswith("irrelevant"), F.lit(False))
    return judged.where(~removed).drop(name), judged.where(removed)


def pdf_to_markdown(files: DataFrame, convert: Callable[[bytes], str], key: str = "path", content: str = "content") -> DataFrame:
    """(key, markdown) of PDF files by a converter that is passed in; files that it can't read, and empty ones, are dropped."""
    rows = files.select(key, content)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for data in pdf[content]:
                try:
                    out.append(convert(bytes(data)) if data is not None else None)
                except Exception:  # noqa: BLE001  whatever a converter raises for a broken file
                    out.append(None)
            yield pd.DataFrame({key: pdf[key], "markdown": pd.Series(out, dtype="object")})

    return rows.mapInPandas(run, f"`{key}` {kind}, markdown string").where(F.trim("markdown") != "")


def rephrase(rows: DataFrame, n: int = 10) -> DataFrame:
    """``n`` numbered variants of each question-and-answer row, for a provider to fill."""
    return rows.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(n))))


def yaml_scalar_replace(text: str, key: str, value: str) -> str:
    """The text with the scalar of a top-level key exchanged; nested keys stay, a missing key raises KeyError."""
    lines = text.splitlines(keepends=True)
    for at, line in enumerate(lines):
        name, colon, rest = line.partition(":")
        if colon and name == key:
            scalar = rest.strip()
            blank, end = (rest[: rest.index(scalar)], rest[rest.index(scalar) + len(scalar) :]) if scalar else ("", rest)
            lines[at] = f"{key}:{blank or ' '}{value}{end.lstrip(' ')}"
            return "".join(lines)
    raise KeyError(key)


def lift_key(config: dict, nested: str, key: str) -> dict:
    """A copy with ``config[nested][key]`` at the top level too, unless it is there already."""
    inner = config.get(nested)
    if key in config or not isinstance(inner, dict) or key not in inner:
        return dict(config)
    return config | {key: inner[key]}
