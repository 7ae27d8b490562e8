"""Embedding over HTTP, spread over several servers."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import numpy as np


class HttpEmbedder:
    """Sends batches to the server with the fewest requests in flight; ties go in turn.

    ``hosts`` is a comma-separated list of base addresses. An answer must hold a
    vector for each text; they are put in the order of their ``index``.
    """

    def __init__(self, hosts: str, model: str, timeout: float = 120) -> None:
        self.hosts = [h.strip().rstrip("/") for h in hosts.split(",") if h.strip()]
        if not self.hosts:
            raise ValueError("no embedding server is named")
        self.model, self.timeout = model, timeout
        self._start()

    def _start(self) -> None:
        self._lock, self._open, self._turn = threading.Lock(), [0] * len(self.hosts), 0

    def __getstate__(self) -> dict:
        return {"hosts": self.hosts, "model": self.model, "timeout": self.timeout}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _take(self) -> int:
        with self._lock:
            n = len(self.hosts)
            k = min(range(n), key=lambda i: (self._open[i], (i - self._turn) % n))
            self._open[k] += 1
            self._turn = (k + 1) % n
            return k

    def embed(self, texts: list[str]) -> np.ndarray:
        k = self._take()
        try:
            return self._ask(self.hosts[k], texts)
        finally:
            with self._lock:
                self._open[k] -= 1

    def _ask(self, host: str, texts: list[str]) -> np.ndarray:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(f"{host}/embeddings", body, {"Content-Type": "application/json"})  # noqa: S310
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                data = json.loads(answer.read())["data"]
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"{host}: HTTP {e.code}: {e.read()[:200].decode(errors='replace')}") from None
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise RuntimeError(f"{host}: no embeddings came: {e!r}") from None
        if len(data) != len(texts):
            raise RuntimeError(f"{host}: {len(data)} vectors for {len(texts)} texts")
        vectors = [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
        if not all(vectors):
            raise RuntimeError(f"{host}: an empty vector came")
        return np.asarray(vectors, np.float32)
