"""Replaceable models: generators, judges and text embedders, with deterministic offline versions.

A generator maps a request (system text, messages) to a reply with its token counts. Messages are lists of
{role, parts: [{kind: text or video, text}]}. Live services plug in through `Service`, which shapes requests and reads
replies of the two usual HTTP forms; sending them is left to a callable, so that tests need no network.
"""

from __future__ import annotations

import base64
import importlib
import math
import re
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.jsontext import judge_reply

Messages = list[dict[str, Any]]


@dataclass
class Reply:
    text: str | None
    input_tokens: int = 0
    output_tokens: int = 0
    total_tokens: int = 0
    api_calls: int = 0


class Generator(Protocol):
    def __call__(self, system: str, messages: Messages) -> Reply: ...


@dataclass
class Echo:
    """Offline generator: from the last text of the user it repeats the first words, every `every`-th request; else silence."""

    every: int = 5
    words: int = 4

    def __call__(self, system: str, messages: Messages) -> Reply:
        said = [p["text"] for m in messages if m["role"] == "user" for p in m["parts"] if p["kind"] == "text" and p["text"]]
        size = sum(len(p["text"] or "") for m in messages for p in m["parts"]) + len(system)
        talk = bool(said) and sum(len(m["parts"]) for m in messages) % self.every == 0
        text = " ".join(said[-1].split()[: self.words]) if talk else "Silent."
        return Reply(text, size, len(text), size + len(text), 1)


def backoff(attempt: int, base: float = 1.0, cap: float = 60.0) -> float:
    """Seconds to wait before retry number `attempt` (from 0): exponential, bounded."""
    return min(cap, base * 2.0**attempt)


class ServiceError(RuntimeError):
    """A reply of a service that is no success; `status` is its HTTP status, if it has one."""

    def __init__(self, text: str, status: int | None = None):
        super().__init__(text)
        self.status = status


_STATUS = re.compile(r"(?i)(?:^|\bhttp(?:/[\d.]+)? |\b(?:status|code|error)(?: code)?[ :=]{1,2})(\d{3})\b")


def is_final(error: Exception) -> bool:
    """Whether trying again is in vain: client errors other than time-outs and limits, and faults of the call itself.

    The status is the error's own, or the number that its text begins with or names as status, code or error."""
    status = getattr(error, "status", None)
    if status is None and (m := _STATUS.search(str(error))):
        status = int(m.group(1))
    if status is not None:
        return 400 <= status < 500 and status not in (408, 409, 425, 429)
    return isinstance(error, (FileNotFoundError, PermissionError, TypeError, KeyError))


def with_retry(call: Generator, tries: int = 5, wait: Callable[[int], float] = backoff, sleep: Callable[[float], None] = time.sleep) -> Generator:
    """The generator, tried again after errors that may pass; a NULL reply after the last try or a final error."""

    def run(system: str, messages: Messages) -> Reply:
        for k in range(tries):
            try:
                return call(system, messages)
            except Exception as e:  # noqa: BLE001
                if k + 1 == tries or is_final(e):
                    break
                sleep(wait(k))
        return Reply(None)

    return run


# ---- HTTP forms --------------------------------------------------------------------------------------------


def chat_payload(model: str, system: str, messages: Messages, load: Callable[[str], bytes], **sampling: Any) -> dict:
    """A request of the chat-completions form; video parts become data URLs of what `load` reads."""
    part = lambda p: ({"type": "text", "text": p["text"]} if p["kind"] == "text" else
                      {"type": "video_url", "video_url": {"url": f"data:video/mp4;base64,{base64.b64encode(load(p['text'])).decode()}"}})
    start = [{"role": "system", "content": system}] if system else []
    turns = [{"role": "assistant" if m["role"] == "model" else m["role"], "content": [part(p) for p in m["parts"]]} for m in messages]
    return {"model": model, "messages": start + turns, **sampling}


def chat_reply(body: dict) -> Reply:
    use = body.get("usage") or {}
    return Reply(body["choices"][0]["message"]["content"], use.get("prompt_tokens", 0), use.get("completion_tokens", 0), use.get("total_tokens", 0), 1)


def contents_payload(system: str, messages: Messages, load: Callable[[str], bytes]) -> dict:
    """A request of the generate-content form; the assistant's role is called model."""
    part = lambda p: ({"text": p["text"]} if p["kind"] == "text" else
                      {"inlineData": {"mimeType": "video/mp4", "data": base64.b64encode(load(p["text"])).decode()}})
    return {"systemInstruction": {"parts": [{"text": system}]},
            "contents": [{"role": "model" if m["role"] == "assistant" else m["role"], "parts": [part(p) for p in m["parts"]]} for m in messages]}


def contents_reply(body: dict) -> Reply:
    """What the first candidate says aloud, its thoughts left out; no text at all reads as silence. Thoughts count as output."""
    aloud = [part["text"] for part in body["candidates"][0].get("content", {}).get("parts", ()) if "text" in part and not part.get("thought", False)]
    count = lambda name: (body.get("usageMetadata") or {}).get(name) or 0
    return Reply("".join(aloud), count("promptTokenCount"), count("candidatesTokenCount") + count("thoughtsTokenCount"), count("totalTokenCount"), 1)


def template_messages(system: str, messages: Messages) -> list[dict]:
    """The form of local chat templates: content as typed parts under the kind's own name; parts and messages without content are left out."""
    said = ([{"role": "system", "parts": [{"kind": "text", "text": system}]}] if system else []) + messages
    shaped = [{"role": m["role"], "content": [{"type": p["kind"], p["kind"]: p["text"]} for p in m["parts"] if p["text"]]} for m in said]
    return [m for m in shaped if m["content"]]


@dataclass
class Local:
    """A model in this process: `run` gets the template form and returns a text, or a text and its (input, output) token counts.

    It is built once per task, so a task is one worker; give it as many cores or one device as it needs."""

    run: Callable[[list[dict]], Any]

    def __call__(self, system: str, messages: Messages) -> Reply:
        got = self.run(template_messages(system, messages))
        text, (given, made) = got if isinstance(got, tuple) else (got, (0, 0))
        return Reply(text, given, made, given + made, 1)


@dataclass
class Http:
    """Posts JSON and reads JSON: the `send` of a `Service`. Anything but status 200 is a `ServiceError`."""

    url: str
    key: str = ""
    timeout: float = 1200.0
    verify: bool = True
    headers: dict = field(default_factory=dict)

    def __call__(self, payload: dict) -> dict:
        import json
        import ssl
        import urllib.error
        import urllib.request

        head = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {}), **self.headers}
        tls = ssl.create_default_context() if self.verify else ssl._create_unverified_context()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(payload).encode(), head), timeout=self.timeout, context=tls if self.url.startswith("https") else None) as reply:
                if reply.status != 200:
                    raise ServiceError(f"status {reply.status}", reply.status)
                return json.loads(reply.read())
        except urllib.error.HTTPError as e:
            raise ServiceError(f"status {e.code}: {e.read(500)!r}", e.code) from e


# Model names that start so are spoken to in the chat form.
CHAT_PREFIXES = ("doubao", "gpt", "claude", "deepseek", "qwen")


@dataclass
class Service:
    """A live service: `send` posts a JSON payload and returns the JSON reply. Models with one of the prefixes use the chat form."""

    model: str
    send: Callable[[dict], dict]
    load: Callable[[str], bytes] = lambda path: open(path, "rb").read()  # noqa: E731, SIM115
    chat_prefixes: tuple[str, ...] = CHAT_PREFIXES
    sampling: dict = field(default_factory=lambda: {"temperature": 0.5, "max_tokens": 4096})

    def __call__(self, system: str, messages: Messages) -> Reply:
        if self.model.startswith(self.chat_prefixes):
            return chat_reply(self.send(chat_payload(self.model, system, messages, self.load, **self.sampling)))
        return contents_reply(self.send(contents_payload(system, messages, self.load)))


def load_model(path: str, /, **kwargs: Any) -> Any:
    """An object from a dotted class or function path and its arguments."""
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)(**kwargs)


@dataclass
class Maker:
    """Makes a model by path and arguments where it is called, so that it can be sent to executors."""

    path: str
    kwargs: dict = field(default_factory=dict)

    def __call__(self) -> Any:
        return load_model(self.path, **self.kwargs)


# ---- on tables ---------------------------------------------------------------------------------------------


def generate(requests: DataFrame, make: Callable[[], Generator], *keys: str) -> DataFrame:
    """keys, pred and the token counters for each request (keys, system, messages). `make` builds one generator per task.

    Concurrency is the number of tasks; a failed request has a NULL pred and no counts.
    """
    fields = [requests.schema[k] for k in keys]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields),
                        "pred string, input_tokens long, output_tokens long, total_tokens long, api_calls long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(make())
        for pdf in batches:
            got = [call(s or "", [{"role": m["role"], "parts": [dict(p) for p in m["parts"]]} for m in ms]) for s, ms in zip(pdf["system"], pdf["messages"])]
            out = pdf[list(keys)].copy()
            for name in ("text", "input_tokens", "output_tokens", "total_tokens", "api_calls"):
                out["pred" if name == "text" else name] = pd.Series([getattr(r, name) for r in got], index=out.index)
            yield out

    return requests.select(*keys, "system", "messages").mapInPandas(run, schema)


def judge_with(make: Callable[[], Callable[[str], str]], tries: int = 3):
    """A judge for `events`: a column function that asks a text model for a JSON reply and reads score and explanation.

    The reply is read with `judge_reply`; a request is repeated up to `tries` times in all while its reply has no score. A NULL
    response asks nothing.
    """
    from cadenza.operators.messages import judge_prompt

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for prompts in batches:
            out = []
            for p in prompts:
                reply = None
                for _ in range(tries if p is not None else 0):
                    try:
                        reply = model(p)
                        if re.search(r'"score"\s*:\s*"?-?[\d.]', reply or ""):
                            break
                    except Exception:  # noqa: BLE001
                        reply = None
                out.append(reply)
            yield pd.Series(out, dtype=object)

    return lambda question, response, answer: judge_reply(ask(F.when(response.isNotNull(), judge_prompt(question, response, answer))))


def hashed_embeddings(texts: DataFrame, text: str = "text", size: int = 64) -> DataFrame:
    """(text, vec) of distinct texts: signed hashed words and character pairs, unit length. An offline stand-in for an encoder."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            out = []
            for t in part:
                v = np.zeros(size)
                low = (t or "").casefold()
                for x in [*re.findall(r"\w+", low), *(low[i:i + 2] for i in range(len(low) - 1))]:
                    h = zlib.crc32(x.encode())
                    v[h % size] += 1 if h >> 16 & 1 else -1
                n = math.sqrt(float(v @ v))
                out.append((v / n if n else v).tolist())
            yield pd.Series(out)

    return texts.select(F.col(text).alias("text")).where("text is not null").distinct().withColumn("vec", embed("text"))


def model_embeddings(texts: DataFrame, make: Callable[[], Callable[[list[str]], Any]], text: str = "text", batch: int = 64) -> DataFrame:
    """(text, vec) of distinct texts by an encoder that maps a list of texts to vectors; it is made once per task."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for part in batches:
            out: list = []
            for a in range(0, len(part), batch):
                out += [[float(x) for x in v] for v in encode(list(part.iloc[a:a + batch]))]
            yield pd.Series(out)

    return texts.select(F.col(text).alias("text")).where("text is not null").distinct().withColumn("vec", embed("text"))


def table_embeddings(texts: DataFrame, embeddings: DataFrame, text: str = "text") -> DataFrame:
    """(text, vec) of distinct texts from a table of vectors (vec_id from 0, embedding): the text's MD5 picks the row."""
    n = embeddings.agg(F.count(F.lit(1)).alias("n"))
    pick = F.conv(F.substring(F.md5(F.col("text")), 1, 8), 16, 10).cast("bigint")
    t = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    return t.withColumn("vec_id", pick % n.scalar()).join(embeddings.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("text", "vec")
