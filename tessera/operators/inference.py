"""Stages that run a user's model over rows, and what follows them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import arrow_batches, with_fields

Model = Callable[[list[str]], list[str]]


def model_stage(df: DataFrame, prompt_col: str, load: Callable[[], Model], batch: int = 64) -> DataFrame:
    """``df`` with ``reply, tokens_in, tokens_out, error``.

    ``load`` makes the model once per task; it gets batches of prompts. The number of
    partitions bounds the calls in flight. A batch that fails is retried row by row,
    and a row that fails carries its error instead of stopping the job. Write the
    result before using it twice: models are paid by the call.
    """
    arrow_batches(df.sparkSession)
    place = df.columns.index(prompt_col)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(prompt: str) -> tuple[str | None, str | None]:
            try:
                return model([prompt])[0], None
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}"

        for part in parts:
            prompts = [p if isinstance(p, str) else "" for p in part.iloc[:, place]]
            replies: list[tuple[str | None, str | None]] = []
            for at in range(0, len(prompts), batch):
                some = prompts[at : at + batch]
                try:
                    got = model(some)
                    if len(got) != len(some):
                        raise ValueError("a reply for each prompt is needed")
                    replies.extend((r, None) for r in got)
                except Exception:  # noqa: BLE001
                    replies.extend(one(p) for p in some)
            part["reply"] = [r for r, _ in replies]
            part["tokens_in"] = [len(p.split()) for p in prompts]
            part["tokens_out"] = [len(r.split()) if r else 0 for r, _ in replies]
            part["error"] = [e for _, e in replies]
            yield part

    return df.mapInPandas(run, with_fields(df, reply="string", tokens_in="long", tokens_out="long", error="string"))


def group_inputs(df: DataFrame, key: str, order: str, value: str, least: int = 2) -> DataFrame:
    """``<key>, inputs``: values of a group in order, for stages that compare; groups below ``least`` are left out."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("_v")))), lambda x: x["_v"])
    return df.groupBy(key).agg(rows.alias("inputs")).filter(F.size("inputs") >= least)


def smallest_reply(schema: dict[str, Any]) -> Any:
    """The smallest value that a schema allows."""
    if schema.get("enum"):
        return schema["enum"][0]
    kind = schema.get("type")
    kind = kind[0] if isinstance(kind, list) else kind
    if kind == "object" or "properties" in schema:
        return {k: smallest_reply(schema.get("properties", {}).get(k, {})) for k in schema.get("required", [])}
    if kind == "array":
        return [smallest_reply(schema.get("items", {})) for _ in range(schema.get("minItems", 0))]
    return {"string": "x" * schema.get("minLength", 0), "integer": 0, "number": 0, "boolean": False}.get(kind)


def fake_model(schema: dict[str, Any]) -> Callable[[], Model]:
    """A deterministic model for tests and dry runs: fenced JSON of the smallest valid reply; prompts with FAIL raise."""
    body = "```json\n" + json.dumps(smallest_reply(schema)) + "\n```"

    def load() -> Model:
        def answer(prompts: list[str]) -> list[str]:
            if any("FAIL" in p for p in prompts):
                raise RuntimeError("asked to fail")
            return [body for _ in prompts]

        return answer

    return load


def usage_rollup(windows: DataFrame, key: str = "session_id") -> DataFrame:
    """``<key>, windows, tokens_in, tokens_out, cost_cents``; nulls count 0."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return windows.groupBy(key).agg(F.count("*").alias("windows"), total("tokens_in"), total("tokens_out"), total("cost_cents"))
