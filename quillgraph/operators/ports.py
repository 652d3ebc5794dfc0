"""Ports for model calls: a caller's function runs over rows in Arrow batches, one client for each partition, with retries."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def answered(prompts: DataFrame, client: Callable[[], Callable[[str, str], str]], retries: int = 3, pause: float = 1.0) -> DataFrame:
    """prompts (system, user, ...) with answer, JSON text, and error, why there is none.

    client() gives a partition's function of (system, user); an answer that isn't JSON counts as a failed try.
    """
    names = prompts.columns
    schema = StructType([*prompts.schema.fields, StructField("answer", StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for batch in batches:
            found = []
            for system, user in zip(batch["system"], batch["user"], strict=True):
                why = None
                for i in range(retries):
                    try:
                        found.append((json.dumps(json.loads(ask(system, user))), None))
                        break
                    except Exception as e:  # a model may fail in any way
                        why = f"{type(e).__name__}: {e}"
                        time.sleep(pause * i)
                else:
                    found.append((None, why))
            yield batch[names].assign(answer=[f[0] for f in found], error=[f[1] for f in found])

    return prompts.mapInPandas(run, schema)


def rating(answer: Column) -> Column:
    """A rating, 0 to 100, from an answer with `score`; 0 where there is none."""
    score = F.coalesce(F.get_json_object(answer, "$.score").try_cast("double").cast("int"), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def names_asked(answer: Column, most: int = 5) -> Column:
    """Names in an answer's `entities`: strings only, the first `most`."""
    items = F.from_json(F.get_json_object(answer, "$.entities"), "array<string>")
    return F.slice(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), 1, most)


def route(answer: Column) -> Column:
    """`global` where an answer says so, else `local`."""
    return F.when(F.lower(F.get_json_object(answer, "$.route")) == "global", "global").otherwise("local")
