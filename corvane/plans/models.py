"""Clients for language and embedding models behind HTTP; picklable, so executors can call them."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from dataclasses import dataclass


def message_text(message: object) -> str:
    """Text of a reply in any of its usual shapes: a string, a list of blocks, or an object with ``content`` or ``text``."""
    if message is None:
        return ""
    if isinstance(message, str):
        return message.strip()
    if isinstance(message, list):
        return "".join(x if isinstance(x, str) else message_text(x) for x in message).strip()
    for name in ("content", "text"):
        part = message.get(name) if isinstance(message, dict) else getattr(message, name, None)
        if part is not None:
            return message_text(part() if callable(part) else part)
    return str(message).strip()


def post_json(url: str, body: dict, headers: dict[str, str] | None = None, attempts: int = 3, timeout: float = 60, pause: float = 1) -> dict:
    """POST and parse; server errors and lost connections are tried again after growing pauses."""
    for i in range(1, attempts + 1):
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if i == attempts or e.code < 500:
                raise
        except (urllib.error.URLError, TimeoutError):
            if i == attempts:
                raise
        time.sleep(pause * i)
    raise AssertionError("unreachable")


@dataclass(frozen=True)
class CompatibleChat:
    """Chat completions in the widespread ``/chat/completions`` form."""

    base_url: str
    model: str
    key: str = ""
    temperature: float = 0.0

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]}
        reply = post_json(self.base_url.rstrip("/") + "/chat/completions", body, {"Authorization": f"Bearer {self.key}"} if self.key else None)
        return message_text(reply["choices"][0]["message"])


@dataclass(frozen=True)
class LocalChat:
    """Chat of a local model server in the ``/api/chat`` form."""

    base_url: str
    model: str

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "stream": False, "messages": [{"role": "user", "content": prompt}]}
        return message_text(post_json(self.base_url.rstrip("/") + "/api/chat", body)["message"])


@dataclass(frozen=True)
class CompatibleEmbedder:
    """Embeddings in the widespread ``/embeddings`` form: texts to vectors, in order."""

    base_url: str
    model: str
    key: str = ""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        body = {"model": self.model, "input": texts}
        reply = post_json(self.base_url.rstrip("/") + "/embeddings", body, {"Authorization": f"Bearer {self.key}"} if self.key else None)
        return [x["embedding"] for x in sorted(reply["data"], key=lambda x: x["index"])]


def choose_chat(base_url: str = "", model: str = "", key: str = "", local_url: str = "http://localhost:11434", local_model: str = "") -> CompatibleChat | LocalChat:
    """A compatible endpoint if its address, model and key are all given, else the local server."""
    return CompatibleChat(base_url, model, key) if base_url and model and key else LocalChat(local_url, local_model)
