"""Heading-level predictors: two baselines, a remote endpoint, and any function of one's own."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.functions import markdown as M
from headwater.functions.answers import parse_levels
from headwater.operators.chat import SYSTEM_PROMPT

# Headings that stand at the top level.
TOP_LEVEL = [
    "introduction", "conclusion", "abstract", "references", "appendix", "acknowledgments", "background", "methods", "results", "discussion", "overview", "summary",
    "table of contents", "getting started", "installation", "usage", "license", "contributing",
]


def flat_levels(text_col: Column) -> Column:
    return F.transform(text_col, lambda _: F.lit(1))


def heuristic_levels(text_col: Column) -> Column:
    """First heading 1; one of the usual top-level titles 1; a leading dotted number its dots + 1, six at most; else 2."""

    def level(t: Column, i: Column) -> Column:
        number = F.regexp_extract(t, r"^((?:[0-9]+\.)+[0-9]*)\s", 1)
        dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
        return F.when(i == 0, 1).when(M.full_trim(F.lower(t)).isin(TOP_LEVEL), 1).when(number != "", F.least(dots + 1, F.lit(6))).otherwise(2)

    return F.transform(text_col, level)


class LevelPredictor(Protocol):
    """Anything that gives levels for the heading texts of one document and its stripped text."""

    def predict(self, texts: list[str], stripped: str) -> list[int]: ...


class BatchPredictor(Protocol):
    """The same for several documents (texts, stripped) at once, as a model on a GPU wants them."""

    def predict_batch(self, documents: list[tuple[list[str], str]]) -> list[list[int]]: ...


@dataclass
class ModelPredictor:
    """A local model: ``generate`` answers a batch of chats, each a list of {role, content}, with at most that many tokens each."""

    generate: Callable[[list[list[dict[str, str]]], int], list[str]]
    system: str = SYSTEM_PROMPT
    per_heading: int = 40
    least_tokens: int = 256

    def predict_batch(self, documents: list[tuple[list[str], str]]) -> list[list[int]]:
        chats = [[{"role": "system", "content": self.system}, {"role": "user", "content": stripped}] for _, stripped in documents]
        most = max((self.per_heading * len(texts) for texts, _ in documents), default=0)
        return [parse_levels(answer) for answer in self.generate(chats, max(most, self.least_tokens))]


@dataclass
class FunctionPredictor:
    """A plain function list[str] -> list[int] as a predictor."""

    function: Callable[[list[str]], list[int]]

    def predict(self, texts: list[str], stripped: str) -> list[int]:
        return self.function(texts)


class HeuristicPredictor:
    """The native heuristic's rules for one document."""

    def predict(self, texts: list[str], stripped: str) -> list[int]:
        out = []
        for i, t in enumerate(texts):
            number = re.match(r"((?:[0-9]+\.)+[0-9]*)\s", t)
            out.append(1 if i == 0 or t.strip().lower() in TOP_LEVEL else min(number[1].count(".") + 1, 6) if number else 2)
        return out


@dataclass
class RemotePredictor:
    """A chat-completions endpoint; HTTP errors raise, nothing is tried again."""

    endpoint: str
    model: str = "heading-levels"
    api_key: str | None = None
    most_tokens: int = 4096
    timeout: float = 300.0

    def predict(self, texts: list[str], stripped: str) -> list[int]:
        body = {
            "model": self.model,
            "messages": [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": stripped}],
            "max_tokens": self.most_tokens, "temperature": 0.0, "chat_template_kwargs": {"enable_thinking": False},
        }
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(self.endpoint.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return parse_levels(json.load(answer)["choices"][0]["message"]["content"])


_MADE: dict = {}


def once_a_worker(make: Callable):
    """make()'s result, kept by the worker: tasks that come with the same factory share it."""
    key = cloudpickle.dumps(make)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def answer(predictor, documents: list[tuple[list[str], str]], tokens: list[int], batch_size: int, long_tokens: int | None, long_size: int) -> list[list[int]]:
    """Levels of each document, documents of like length together, those of at least long_tokens tokens long_size at a time."""
    if not hasattr(predictor, "predict_batch"):
        return [predictor.predict(*d) for d in documents]
    out: list = [None] * len(documents)
    order = sorted(range(len(documents)), key=tokens.__getitem__)
    is_long = [i for i in order if long_tokens is not None and tokens[i] >= long_tokens]
    usual = order[: len(order) - len(is_long)]
    for group, size in ((usual, batch_size), (is_long, long_size)):
        for at in range(0, len(group), size):
            part = group[at : at + size]
            for i, levels in zip(part, predictor.predict_batch([documents[i] for i in part]), strict=True):
                out[i] = levels
    return out


def predict_levels(
    df: DataFrame, make: Callable[[], LevelPredictor | BatchPredictor], *, texts_col: str = "titles", stripped_col: str = "stripped", batch_size: int = 16, long_tokens: int | None = None, long_size: int = 1, token_col: str = "token_count"
) -> DataFrame:
    """df with a column predicted: array<int>; the predictor is made once per worker.

    Rows keep their place, so the result needs no join.  A predictor with predict_batch gets documents
    of like length, batch_size at a time; those of at least long_tokens tokens apart, long_size at a time.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predictor = once_a_worker(make)
        for titles, stripped, tokens in batches:
            given = [i for i, t in enumerate(titles) if t is not None]
            levels = answer(predictor, [(list(titles[i]), stripped[i]) for i in given], [int(tokens[i]) for i in given], batch_size, long_tokens, long_size)
            out: list = [None] * len(titles)
            for i, found in zip(given, levels):
                out[i] = [int(x) for x in found]
            yield pd.Series(out, dtype=object)

    size = F.coalesce(F.col(token_col), F.lit(0)) if token_col in df.columns else F.coalesce(F.length(stripped_col), F.lit(0))
    return df.withColumn("predicted", F.pandas_udf(run, T.ArrayType(T.IntegerType())).asNondeterministic()(F.col(texts_col), F.col(stripped_col), size.cast("long")))


def rehead(df: DataFrame, make: Callable[[], LevelPredictor], text_col: str = "content", *, spec: str = "piece", compat: bool = False) -> DataFrame:
    """df with a column reheaded: predicted levels written back; texts without headings stay as they are."""
    parsed = df.withColumn("spans", M.spans(F.col(text_col)))
    plain = parsed.where(F.coalesce(F.size("spans"), F.lit(0)) <= 0).withColumn("reheaded", F.col(text_col))
    work = parsed.where(F.size("spans") > 0).withColumn("titles", M.texts(F.col("spans")))
    work = work.withColumn("stripped", M.strip_document(F.col(text_col), F.col("spans"), spec=spec))
    work = predict_levels(work, make)
    work = work.withColumn("reheaded", M.apply_levels(F.col(text_col), F.col("spans"), M.align_levels(M.headings(F.col("spans")), F.col("predicted")), compat))
    keep = [*df.columns, "reheaded"]
    return work.select(*keep).unionByName(plain.select(*keep))
