"""A chat client for a local model server that streams JSON lines, and the note tools it may call."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

# Fixed values of the protocol and its limits.
TIMEOUT_S, CONTEXT_TOKENS, MOST_STEPS = 600, 16384, 20
SYSTEM = "You suggest tags and links for Markdown notes. Answer with JSON only: {tags: [...], links: [{target, reason}], summary}."
JUDGE = "You judge whether two notes should be linked. Answer with JSON only: {should_link, reason, link_from, link_to}."


class Tools(Protocol):
    """What a client offers to its model; it travels to executors with the client."""

    def schemas(self) -> list[dict]: ...

    def __call__(self, name: str, arguments: dict) -> str: ...


def joined(stream: Iterator[bytes]) -> dict:
    """One message of the streamed chunks: contents and thoughts one after the other, all tool calls."""
    message: dict = {"role": "assistant", "content": "", "thinking": "", "tool_calls": []}
    for line in stream:
        if not line.strip():
            continue
        chunk = json.loads(line)
        part = chunk.get("message", {})
        message["content"] += part.get("content") or ""
        message["thinking"] += part.get("thinking") or ""
        message["tool_calls"] += part.get("tool_calls") or []
        if chunk.get("done"):
            break
    return {"message": message}


def content_of(reply: dict) -> str:
    return reply.get("message", {}).get("content", "")


def calls_of(reply: dict) -> list[dict]:
    return reply.get("message", {}).get("tool_calls") or []


@dataclass
class ChatClient:
    """Enricher and Verifier over HTTP; it travels to executors, so it holds settings only. With tools,
    the model may call them while it enriches a note."""

    url: str = "http://localhost:11434"
    model: str = "qwen3"
    think: bool = False
    tools: Tools | None = None
    verbose: bool = False

    def chat(self, messages: list[dict], tools: Tools | None = None) -> dict:
        body = {"model": self.model, "messages": messages, "stream": True, "think": self.think, "options": {"num_ctx": CONTEXT_TOKENS}}
        if tools is not None:
            body["tools"] = tools.schemas()
        request = urllib.request.Request(f"{self.url}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as response:
            return joined(response)

    def loop(self, messages: list[dict]) -> str:
        """Answers tool calls until the model replies; an error text after MOST_STEPS."""
        messages = list(messages)
        for _ in range(MOST_STEPS):
            reply = self.chat(messages, self.tools)
            calls = calls_of(reply)
            if self.verbose:
                said = reply.get("message", {})
                print(f"[model] {said.get('thinking') or ''}{said.get('content') or ''} {[c.get('function') for c in calls]}", flush=True)
            if not calls or self.tools is None:
                return content_of(reply)
            messages.append(reply["message"])
            for call in calls:
                function = call.get("function", {})
                messages.append({"role": "tool", "content": self.tools(function.get("name", ""), function.get("arguments") or {})})
        return "Error: too many steps"

    def enrich(self, path: str, content: str) -> str:
        return self.loop([{"role": "system", "content": SYSTEM}, {"role": "user", "content": f"Note {path}:\n\n{content}"}])

    def verify(self, pair: dict) -> str:
        sides = [f"Note {pair[f'note_{s}']}\nTags: {list(pair.get(f'tags_{s}') if pair.get(f'tags_{s}') is not None else [])}\n{pair[f'preview_{s}']}" for s in "ab"]
        text = "\n\n".join([*sides, f"Shared tags: {list(pair['shared'])}"])
        return content_of(self.chat([{"role": "system", "content": JUDGE}, {"role": "user", "content": text}]))
