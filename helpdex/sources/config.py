"""Settings of the engine: defaults, YAML overrides, environment values in keys and addresses, validation."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass, replace
from urllib.parse import urlparse

from helpdex.operators.chunking import CHUNK_CHARS, DOC_PREFIX, QUERY_PREFIX

#: What the chat model must reply where it has no answer or the question is not Polish, and the rule for that.
NO_ANSWER = "NO_ANSWER"
NOT_POLISH = "NOT_POLISH"
POLISH_ONLY = f"""Questions must be written in Polish. If the question is written in any other
language (for example English), do not answer it and reply with exactly one word: {NOT_POLISH}"""
SYSTEM_PROMPT = f"""You are a helpdesk assistant. Use nothing but the knowledge base articles below; do not add steps, commands
or settings that they do not have. Answer briefly in the language of the question and keep the article's steps,
verification and escalation. If the articles do not answer the question, reply with exactly one word: {NO_ANSWER}"""


@dataclass(frozen=True)
class Embedding:
    base_url: str = "http://localhost:11434/v1"
    api_key: str = ""
    model: str = "embeddinggemma-2"
    query_prefix: str = QUERY_PREFIX
    doc_prefix: str = DOC_PREFIX
    dims: int = 256
    batch_size: int = 1
    timeout_sec: float = 120


@dataclass(frozen=True)
class Search:
    top_k: int = 5
    min_score: float = 0.5
    max_gap: float = 0.05


@dataclass(frozen=True)
class Answer:
    mode: str = "llm"
    base_url: str = "http://localhost:11434/v1"
    api_key: str = ""
    model: str = "gemma4"
    system_prompt: str = SYSTEM_PROMPT
    temperature: float = 0.1
    timeout_sec: float = 300


@dataclass(frozen=True)
class Language:
    expected: str = "pl"
    other_message: str = "No information is available. Please write to support@example.com or call +48 000 000 000."


@dataclass(frozen=True)
class Server:
    addr: str = "127.0.0.1:8080"


@dataclass(frozen=True)
class Config:
    docs_dir: str = "./docs"
    db_path: str = "./helpdex-index"
    chunk_chars: int = CHUNK_CHARS
    embedding: Embedding = field(default_factory=Embedding)
    search: Search = field(default_factory=Search)
    answer: Answer = field(default_factory=Answer)
    fallback_message: str = "Nie znaleźliśmy odpowiedzi na to pytanie w bazie wiedzy. Napisz do nas na support@example.com lub zadzwoń pod numer +48 000 000 000."
    language: Language = field(default_factory=Language)
    unanswered_log: str = ""
    server: Server = field(default_factory=Server)


def _overlaid(base, values: dict):
    known = {f.name for f in fields(base)}
    changes = {}
    for key, value in (values or {}).items():
        if key in known and value is not None:
            own = getattr(base, key)
            changes[key] = _overlaid(own, value) if is_dataclass(own) else value
    return replace(base, **changes)


def problems(c: Config) -> list[str]:
    """Everything that is wrong with the settings."""
    needs_key = [(name, part) for name, part in (("embedding", c.embedding), ("answer", c.answer)) if (host := urlparse(part.base_url).hostname or "") == "ollama.com" or host.endswith(".ollama.com")]
    checks = [
        (c.chunk_chars < 100, "chunk_chars must be at least 100"),
        (not c.embedding.base_url or not c.embedding.model, "embedding needs base_url and model"),
        (c.embedding.dims < 0, "embedding.dims must not be negative"),
        (c.embedding.batch_size < 1, "embedding.batch_size must be at least 1"),
        (c.search.top_k < 1, "search.top_k must be at least 1"),
        (c.search.max_gap < 0, "search.max_gap must not be negative"),
        (c.answer.mode not in ("llm", "fragments"), "answer.mode must be llm or fragments"),
        (c.answer.mode == "llm" and not (c.answer.base_url and c.answer.model), "answer needs base_url and model"),
        (not c.fallback_message.strip(), "fallback_message must not be blank"),
        (c.language.expected not in ("", "pl"), "language.expected must be pl or empty"),
        (c.language.expected == "pl" and not c.language.other_message.strip(), "language.other_message must not be blank"),
        *((not part.api_key and (name == "embedding" or c.answer.mode == "llm"), f"{name}.api_key is required for this host") for name, part in needs_key),
    ]
    return [text for bad, text in checks if bad]


def load(path: str | None = None, default_path: str = "config.yaml") -> Config:
    """Settings from a YAML file over the defaults. A missing default file means the defaults, a missing named file is an error."""
    at = path or default_path
    config = Config()
    if path or os.path.exists(at):
        import yaml

        with open(at, encoding="utf-8") as f:
            config = _overlaid(config, yaml.safe_load(f) or {})

    def filled(part):
        return replace(part, base_url=os.path.expandvars(part.base_url), api_key=os.path.expandvars(part.api_key))

    config = replace(config, embedding=filled(config.embedding), answer=filled(config.answer))
    if found := problems(config):
        raise ValueError("; ".join(found))
    return config
