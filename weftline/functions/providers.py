"""Embedders and text writers behind HTTP services, with batches, pauses and retries. Nothing here runs unless it is configured."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from weftline.operators.vector import hashing_embedder

Embed = Callable[[list[str]], list[list[float]]]


class Writer(Protocol):
    """What a text service may do for a document; each method gets evidence as text."""

    def full_document(self, evidence: Sequence[str]) -> str: ...
    def update_section(self, content: str, evidence: Sequence[str]) -> str: ...
    def from_draft(self, draft: str, evidence: Sequence[str]) -> str: ...
    def new_section(self, evidence: Sequence[str]) -> str: ...
    def insertion_point(self, titles: Sequence[str], content: str) -> int: ...


def post(url: str, body: dict, headers: dict[str, str], retries: int, wait: float, timeout: float) -> dict:
    """JSON in, JSON out. 429 and 5xx are tried again after ``wait`` seconds."""
    for left in range(retries, -1, -1):
        try:
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if not left or e.code != 429 and e.code < 500:
                raise
            time.sleep(wait)
    raise AssertionError


@dataclass
class HttpEmbedder:
    """kind: ``list`` services take {model, input} and answer {data: [{index, embedding}]}; ``plain`` ones answer {embeddings}; ``parts`` ones take and answer lists of requests."""

    url: str
    model: str
    kind: str = "list"
    key: str = ""
    batch: int = 64
    pause: float = 0.4
    retries: int = 5
    wait: float = 3.0
    timeout: float = 60.0

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            if i:
                time.sleep(self.pause)
            part = texts[i : i + self.batch]
            headers = {"Authorization": f"Bearer {self.key}"} if self.key and self.kind != "parts" else {"x-goog-api-key": self.key} if self.key else {}
            body = {"requests": [{"model": self.model, "content": {"parts": [{"text": t}]}} for t in part]} if self.kind == "parts" else {"model": self.model, "input": part}
            answer = post(self.url, body, headers, self.retries, self.wait, self.timeout)
            found = [e["embedding"] for e in sorted(answer["data"], key=lambda e: e["index"])] if self.kind == "list" else answer["embeddings"] if self.kind == "plain" else [e["values"] for e in answer["embeddings"]]
            if len(found) != len(part):
                raise ValueError(f"{len(found)} vectors for {len(part)} texts")
            out += found
        return out


def _listed(evidence: Sequence[str]) -> str:
    return "\n\n".join(f"[{i}]\n{text}" for i, text in enumerate(evidence, 1))


@dataclass
class HttpWriter:
    """A Writer behind a chat service: takes {model, messages}, answers {choices: [{message: {content}}]}."""

    url: str
    model: str
    key: str = ""
    retries: int = 5
    wait: float = 3.0
    timeout: float = 60.0

    def ask(self, task: str, text: str) -> str:
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        body = {"model": self.model, "messages": [{"role": "system", "content": "You maintain technical documentation. Use only the evidence given."}, {"role": "user", "content": f"{task}\n\n{text}"}]}
        return post(self.url, body, headers, self.retries, self.wait, self.timeout)["choices"][0]["message"]["content"]

    def full_document(self, evidence: Sequence[str]) -> str:
        return self.ask("Write the project's documentation in Markdown.", _listed(evidence))

    def update_section(self, content: str, evidence: Sequence[str]) -> str:
        return self.ask("Bring this section up to date with the evidence. Answer with the section only.", f"{content}\n\nEvidence:\n{_listed(evidence)}")

    def from_draft(self, draft: str, evidence: Sequence[str]) -> str:
        return self.ask("Turn this draft into prose in Markdown. Keep its headings and claims.", f"{draft}\n\nEvidence:\n{_listed(evidence)}")

    def new_section(self, evidence: Sequence[str]) -> str:
        return self.ask("Write a new section in Markdown for this code.", _listed(evidence))

    def insertion_point(self, titles: Sequence[str], content: str) -> int:
        listed = "\n".join(f"{i}: {t}" for i, t in enumerate(titles))
        return parse_index(self.ask("After which of these sections does the text belong? Answer with its number only.", f"{listed}\n\n{content}"), len(titles))


def embedder(kind: str = "hashing", dimension: int = 64, **options) -> Embed:
    if kind == "hashing":
        return hashing_embedder(dimension)
    if kind in ("list", "plain", "parts"):
        return HttpEmbedder(kind=kind, **options)
    raise ValueError(f"unsupported embedder: {kind}")


def writer(kind: str = "none", **options) -> Writer | None:
    """A text service by name; none where texts stay as drafted."""
    if kind in ("", "none"):
        return None
    if kind == "chat":
        return HttpWriter(**options)
    raise ValueError(f"unsupported writer: {kind}")


def parse_index(reply: str, n: int) -> int:
    """The first integer of a reply if it is a valid position, else -1."""
    digits = ""
    for c in reply.strip():
        if c.isdigit():
            digits += c
        elif digits:
            break
    return int(digits) if digits and int(digits) < n else -1
