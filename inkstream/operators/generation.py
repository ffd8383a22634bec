"""Calls of a language model or encoder that is passed in: answers, rewritten queries, embeddings."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Model(Protocol):
    """A language model. It is sent to the tasks, so it must pickle; connections belong into ``generate``."""

    def generate(self, prompt: str) -> str: ...


@dataclass
class CannedModel:
    """Answers offline, always the same way."""

    answer: str | None = None

    def generate(self, prompt: str) -> str:
        return self.answer if self.answer is not None else "答案-" + hashlib.sha256(prompt.encode()).hexdigest()[:12]


# What a question says besides its subject.
FILLERS = ["请问", "什么是", "是什么", "什么意思", "为什么", "有哪些", "怎么样", "怎么", "如何", "哪些", "多少", "什么", "吗", "呢", "？", "?", "！", "!", "。"]


@dataclass
class ExtractiveModel:
    """A model without a network: it answers a prompt with passages by their sentences that have most character pairs in common with the question, and rewrites a query to what is left without question words."""

    sentences: int = 2

    def generate(self, prompt: str) -> str:
        if "用户问题: " in prompt:
            context, question = prompt.rpartition("参考资料:\n")[2].rsplit("用户问题: ", 1)
            return self.answer(context, question.partition("\n")[0])
        query = re.findall(r"查询：([^\n]*)", prompt)
        return self.keywords(query[-1] if query else prompt)

    def answer(self, context: str, question: str) -> str:
        asked, found = self.pairs(question), []
        for source, content in re.findall(r"^\[\d+\] 来源: ([^\n]*)\n(.*?)(?=\n\n\[\d+\] 来源: |\Z)", context.strip(), re.M | re.S):
            found += [(len(asked & self.pairs(s)), s.strip(), source) for s in re.split(r"(?<=[。！？])|\n", content)]
        best = sorted((x for x in enumerate(found) if x[1][0]), key=lambda x: (-x[1][0], x[0]))[: self.sentences]
        return "\n".join(f"{s} [来源: {source}]" for _, (_, s, source) in sorted(best)) or "未找到相关信息"

    @staticmethod
    def pairs(text: str) -> set[str]:
        plain = "".join(c for c in text if c.isalnum())
        return {plain[i : i + 2] for i in range(len(plain) - 1)}

    @staticmethod
    def keywords(query: str) -> str:
        out = query
        for word in FILLERS:
            out = out.replace(word, " ")
        return " ".join(out.split()) or query.strip()


MODELS: dict[str, Callable[..., Model]] = {}
# Providers, the variable that holds their key, and their default models.
PROVIDERS = {"openai": ("OPENAI_API_KEY", "gpt-3.5-turbo"), "deepseek": ("DEEPSEEK_API_KEY", "deepseek-chat")}


def register_model(kind: str, make: Callable[..., Model]) -> None:
    MODELS[kind] = make


def create_model(kind: str, api_key: str | None = None, model: str | None = None, max_tokens: int = 512, temperature: float = 0.7) -> Model:
    """A model of a provider by its registered client; ValueError for other providers and missing keys."""
    kind = kind.lower().strip()
    if kind not in PROVIDERS:
        raise ValueError(f"unsupported client type {kind!r}; supported are {list(PROVIDERS)}")
    variable, default = PROVIDERS[kind]
    key = api_key or os.environ.get(variable)
    if not key:
        raise ValueError(f"{kind} needs an API key: set {variable} or pass api_key")
    if kind not in MODELS:
        raise ValueError(f"no client is registered for {kind!r}: register_model({kind!r}, ...)")
    return MODELS[kind](api_key=key, model=model or default, max_tokens=max_tokens, temperature=temperature)


@dataclass
class IntentConfig:
    """Settings of the query rewriter; ``${NAME}`` in strings stands for a variable of the environment."""

    values: dict = field(default_factory=dict)

    def _section(self) -> dict:
        return self.values.get("intent", {})

    def _expand(self, value: object) -> object:
        return os.environ.get(value[2:-1], "") if isinstance(value, str) and value.startswith("${") and value.endswith("}") else value

    @property
    def api_client(self) -> dict:
        return {k: self._expand(v) for k, v in self._section().get("api_client", {}).items()}

    @property
    def prompt_template(self) -> str:
        return self._section().get("prompt_template", "query_rewrite_basic")


def generate_answers(prompts: DataFrame, model: Model) -> DataFrame:
    """``(qid, query_type, answer, error)`` of ``(qid, query_type, system_prompt, user_prompt)``; a failing call leaves its error and no answer."""
    kind = prompts.schema["qid"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers, errors = [], []
            for system, user in zip(part["system_prompt"], part["user_prompt"]):
                try:
                    answers.append(model.generate(f"{system}\n\n{user}"))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"qid": part["qid"], "query_type": part["query_type"], "answer": answers, "error": errors})

    return prompts.select("qid", "query_type", "system_prompt", "user_prompt").mapInPandas(run, f"qid {kind}, query_type string, answer string, error string")


def stream_answer(model: Model, question: str, prompt: str, pieces: Callable[[str], Iterator[str]] | None = None) -> Iterator[dict]:
    """One answer piece by piece, at the driver; the last record is finished."""
    said = ""
    for delta in (pieces or (lambda p: iter([model.generate(p)])))(prompt):
        said += delta
        yield {"question": question, "answer": said, "delta": delta, "finished": False}
    yield {"question": question, "answer": said, "delta": "", "finished": True}


def rewrite_one(model: Model, query: str, prompt: str | None) -> str:
    if not query or not query.strip() or prompt is None:
        raise ValueError("the query is empty")
    try:
        return model.generate(prompt).strip()
    except Exception as e:
        raise ValueError(f"the query could not be rewritten: {e}") from e


def rewrite_queries(rows: DataFrame, prompt: Column, model: Model, query: str = "query") -> DataFrame:
    """``rows`` with ``rewritten``; a blank query or a failing call leaves the query as it is."""

    @F.pandas_udf("string")
    def call(queries: pd.Series, prompts: pd.Series) -> pd.Series:
        def one(q: str, p: str) -> str | None:
            try:
                return rewrite_one(model, q, p)
            except ValueError:
                return None

        return pd.Series([one(q, p) for q, p in zip(queries, prompts)], dtype=object)

    return rows.withColumn("rewritten", F.coalesce(call(F.col(query), prompt), F.col(query)))


class Encoder(Protocol):
    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


@dataclass
class HashingEncoder:
    """Unit vectors of hashed character bigrams: similar texts get similar vectors, without a model."""

    dimension: int = 64

    def encode(self, texts: list[str]) -> np.ndarray:
        out, size = np.zeros((len(texts), self.dimension)), self.dimension
        places: dict[str, int] = {}
        for i, t in enumerate(texts):
            if len(places) > 200_000:
                places.clear()
            own = [t[a : a + 2] for a in range(len(t) - 1)]
            for pair in set(own).difference(places):
                h = int.from_bytes(hashlib.blake2b(pair.encode(), digest_size=8).digest(), "little")
                places[pair] = h % size + (size if h >> 63 else 0)
            counts = np.bincount(np.array([places[pair] for pair in own], np.int64), minlength=2 * size)
            out[i] = counts[size:] - counts[:size]
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def embed(text: Column, encoder: Encoder) -> Column:
    """The encoder over Arrow batches; null counts as empty."""

    @F.pandas_udf("array<float>")
    def call(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encoder.encode([t if isinstance(t, str) else "" for t in texts]).astype(np.float32)))

    return call(text)
