"""Model providers behind one interface, called from the executors with bounded concurrency and own retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.plans.ship import ensure_shipped

# Statuses that are worth another try.
RETRYABLE = {408, 409, 425, 429, 500, 502, 503, 504, 529}
CONCURRENCY = 3


class ProviderError(Exception):
    def __init__(self, detail: str, retryable: bool = False) -> None:
        super().__init__(detail)
        self.retryable = retryable


class Provider(Protocol):
    """complete(system, user) gives (text, prompt tokens or None, completion tokens or None)."""

    def complete(self, system: str, user: str) -> tuple[str, int | None, int | None]: ...


class Scripted:
    """Answers by rule, for tests and offline runs: script(user, attempt) gives a text or raises ProviderError."""

    def __init__(self, script: Callable[[str, int], str]) -> None:
        self.script, self.attempts = script, {}

    def complete(self, system: str, user: str) -> tuple[str, int | None, int | None]:
        self.attempts[user] = self.attempts.get(user, 0) + 1
        text = self.script(user, self.attempts[user])
        return text, len(user) // 4, len(text) // 4


class HttpJson:
    """POST of a JSON body; build makes it from (system, user), read takes (text, tokens, tokens) from the answer."""

    def __init__(self, url: str, headers: dict[str, str], build: Callable[[str, str], dict], read: Callable[[dict], tuple], timeout: float = 120.0) -> None:
        self.url, self.headers, self.build, self.read, self.timeout = url, headers, build, read, timeout

    def complete(self, system: str, user: str) -> tuple[str, int | None, int | None]:
        request = urllib.request.Request(self.url, json.dumps(self.build(system, user)).encode(), {"Content-Type": "application/json", **self.headers})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                body = answer.read()
        except urllib.error.HTTPError as e:
            raise ProviderError(f"status {e.code}", e.code in RETRYABLE) from e
        except OSError as e:
            raise ProviderError(str(e), True) from e
        try:
            return self.read(json.loads(body))
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise ProviderError("the answer has another form") from e


def _chat(model: str, limit: int, temperature: float) -> Callable[[str, str], dict]:
    return lambda system, user: {"model": model, "temperature": temperature, "max_tokens": limit, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}


def registry(kind: str, *, url: str = "", key: str | None = None, model: str = "", limit: int = 4000, temperature: float = 0.0, prefill: bool = False, headers: dict[str, str] | None = None) -> Callable[[], Provider]:
    """Maker of a provider for a kind (chat, messages or local); made anew on each executor. A missing key is an error here.

    prefill opens the answer of a messages model with a brace, for older models that would begin with a preface; newer
    ones take neither that nor a temperature. headers are sent besides the key, such as the version a service asks for.
    """
    if kind in ("chat", "messages") and not key:
        raise ValueError(f"provider {kind} needs a key")
    if kind == "chat":
        return lambda: HttpJson(f"{url}/chat/completions", {"Authorization": f"Bearer {key}", **(headers or {})}, _chat(model, limit, temperature), lambda a: (a["choices"][0]["message"]["content"], (a.get("usage") or {}).get("prompt_tokens"), (a.get("usage") or {}).get("completion_tokens")))
    if kind == "messages":

        def build(system: str, user: str) -> dict:
            messages = [{"role": "user", "content": user}, *[{"role": "assistant", "content": "{"}] * prefill]
            return {"model": model, "max_tokens": limit, "system": system, "messages": messages} | ({"temperature": temperature} if prefill else {})

        def read(a: dict) -> tuple:
            text = "".join(b.get("text", "") for b in a["content"] if b.get("type") == "text")
            text = "{" + text if prefill and not text.lstrip().startswith("{") else text
            return text, (a.get("usage") or {}).get("input_tokens"), (a.get("usage") or {}).get("output_tokens")

        return lambda: HttpJson(f"{url}/messages", {"x-api-key": str(key), **(headers or {})}, build, read)
    if kind == "local":
        build = lambda system, user: {"model": model, "stream": False, "format": "json", "options": {"temperature": temperature, "num_ctx": 8192}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        return lambda: HttpJson(f"{url}/api/chat", {}, build, lambda a: (a["message"]["content"], a.get("prompt_eval_count"), a.get("eval_count")))
    raise ValueError(f"no provider {kind!r}")


def prompted(chunks: DataFrame, *, template: str = "Часть {n} из {total} ({label})\n\n{text}") -> DataFrame:
    """Adds prompt; n is the chunk's place in the whole document, total the number of chunks sent."""
    total = chunks.groupBy("doc_id").agg(F.count("*").alias("_total"))
    first, last = F.col("first_page").cast("string"), F.col("last_page").cast("string")
    label = F.when(first == last, F.concat(F.lit("стр. "), first)).otherwise(F.concat(F.lit("стр. "), first, F.lit("–"), last))
    out = F.lit(template)
    for name, value in (("{n}", (F.col("chunk_idx") + 1).cast("string")), ("{total}", F.col("_total").cast("string")), ("{label}", F.coalesce(label, F.lit(""))), ("{text}", F.coalesce("text", F.lit("")))):
        out = F.replace(out, F.lit(name), value)
    return chunks.join(total, "doc_id").withColumn("prompt", out).drop("_total")


def called(chunks: DataFrame, make: Callable[[], Provider], *, system: str = "", retries: int = 2, concurrency: int = CONCURRENCY, tasks: int = 1, wait: Callable[[int], float] = lambda n: min(15.0, 2.0**n)) -> DataFrame:
    """doc_id, chunk_idx, reply, failure, attempts, prompt_tokens, completion_tokens.

    Calls run in `tasks` tasks, `concurrency` at a time in each, so that at most tasks * concurrency are under way in the
    whole cluster. A failed call becomes a row with its failure and stops no other. Only failures marked retryable are
    tried again, by this loop: the engine's own retries of a task would repeat calls that were paid for, so write the
    result before using it twice.
    """
    ensure_shipped(chunks.sparkSession)
    kind = "doc_id string, chunk_idx int, reply string, failure string, attempts int, prompt_tokens int, completion_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()

        def one(doc: str, idx: int, prompt: str) -> tuple:
            for attempt in range(1, retries + 2):
                try:
                    reply, a, c = provider.complete(system, prompt)
                    return doc, idx, reply, None, attempt, a, c
                except ProviderError as e:
                    if not e.retryable or attempt > retries:
                        return doc, idx, None, str(e), attempt, None, None
                    time.sleep(max(0.0, wait(attempt)))
            raise AssertionError("unreachable")

        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                c = list(zip(*pool.map(one, *(b.column(i).to_pylist() for i in range(3)))))
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()])], names=[x.split()[0] for x in kind.split(", ")])

    asked = prompted(chunks).select(F.col("doc_id").cast("string"), F.col("chunk_idx").cast("int"), "prompt").repartition(tasks)
    return asked.mapInArrow(run, kind)


def unavailable(calls: DataFrame, *, shown: int = 3) -> DataFrame:
    """doc_id, code, detail of documents all of whose calls failed; detail holds the first failures."""
    per = calls.groupBy("doc_id").agg(F.count("reply").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("failure").isNotNull(), F.struct("chunk_idx", "failure")))).alias("_f"))
    return per.where("_n = 0").select("doc_id", F.lit("provider_unavailable").alias("code"), F.array_join(F.transform(F.slice("_f", F.lit(1), F.lit(shown)), lambda x: x["failure"]), "; ").alias("detail"))
