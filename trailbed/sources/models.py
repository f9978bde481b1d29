"""Remote language models as a generation source.

``client`` is called in the tasks with one prompt and the number of wanted texts and returns a list of texts. What failed is
said in a column, so an empty answer and a failure differ: a failed prompt stays pending for the next run, an empty one does not.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Client = Callable[[str, int], list[str]]


def http_client(base: str, token: str, model: str, temperature: float = 0.9, top_p: float = 0.95, timeout: float = 120.0) -> Client:
    """A client of an endpoint with the common chat-completions interface."""

    def call(prompt: str, n: int) -> list[str]:
        body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}], "n": n, "temperature": temperature, "top_p": top_p}).encode()
        request = urllib.request.Request(f"{base}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {token}"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return [c["message"]["content"] for c in json.load(answer)["choices"]]

    return call


def passing(error: Exception) -> bool:
    """Whether asking again may help: the service is busy or out of reach."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code == 429 or error.code >= 500
    return isinstance(error, OSError)  # time-outs and broken connections are


def generate(prompts: DataFrame, client: Client, n: int = 4, tries: int = 5, wait: float = 1.0) -> DataFrame:
    """prompts: key, prompt. Result: key, raw array<string>, error (null where the client answered). Repartition first for as many parallel calls as wanted.

    Failures that may pass are tried again after waits that double from ``wait``, with some jitter; others end the prompt, not the job.
    """

    def ask(prompt: str, chance: random.Random) -> tuple[list[str], str | None]:
        left = tries
        while True:
            try:
                return list(client(prompt, n)), None
            except Exception as error:  # noqa: BLE001 - told in the error column
                left -= 1
                if left <= 0 or not passing(error):
                    return [], f"{type(error).__name__}: {error}"
            time.sleep(wait * 2 ** (tries - left - 1) * (0.5 + chance.random()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chance = random.Random()
        for pdf in batches:
            answers = [ask(p, chance) for p in pdf["prompt"]]
            yield pd.DataFrame({"key": pdf["key"], "raw": [a for a, _ in answers], "error": [e for _, e in answers]})

    return prompts.select("key", "prompt").mapInPandas(run, "key string, raw array<string>, error string")
