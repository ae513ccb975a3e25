"""Configuration: typed defaults, layered by global and project files in JSON with comments."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    provider: str = "hashing"
    model: str = ""
    dimension: int = 64
    search_min_score: float | None = None
    search_limit: int = 20
    dense_weight: float = 1.0
    sparse_weight: float = 0.3
    sparse_guarantee: bool = True
    include_mode: str = "or"
    reranker: str | None = None
    reranker_min_score: float | None = None
    highlight_lines: int = 10
    chunk_least: int = 100
    chunk_most: int = 2000
    file_bytes: int = 1 << 20
    analysis_bytes: int = 10 << 20
    cache_days: int = 30
    instruct: bool = False


def without_comments(text: str) -> str:
    """JSON without // and /* */ comments and without commas before a closing bracket; strings stay as they are."""
    keep = r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/'
    text = re.sub(keep, lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", text, flags=re.S)


def layered(*texts: str | None) -> Config:
    """The defaults under the files' settings, later ones over earlier ones; unknown keys are errors, null means unset."""
    known = {f.name for f in fields(Config)}
    out: dict = {}
    for text in filter(None, texts):
        got = json.loads(without_comments(text))
        if unknown := set(got) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out |= {k: v for k, v in got.items() if v is not None}
    return replace(Config(), **out)


def as_json(config: Config) -> str:
    return json.dumps(asdict(config), indent=2, sort_keys=True)


#: Prefixes of queries and of documents by provider and model (fixed values): retrieval models are asked with an instruction.
#: The first row that fits counts.
QUERY_PREFIXES = [
    ("llamacpp", r"(?i)jina.*v5", "Query: "),
    ("llm2vec", "", "Generate a passage that best answers this question: "),
    ("llamacpp-llm", r"(?i)jina.*v5", "Query: "),
    ("llamacpp-llm", "(?i)f2llm", "Instruct: find relevant passages\nQuery: "),
    ("llamacpp-llm", "", "Instruct: Given a search query, retrieve relevant passages that answer the query.\nQuery: "),
    ("ollama", "^qwen3-embedding:", "Instruct: Given a search query, retrieve relevant passages that answer the query.\nQuery: "),
]
DOCUMENT_PREFIXES = [
    ("llm2vec", "", "Summarize the following passage: "),
    ("llamacpp", r"(?i)jina.*v5", "Query: "),
    ("llamacpp-llm", r"(?i)jina.*v5", "Query: "),
]
#: Providers whose prefixes are put only where the configuration asks for them (`instruct`).
ON_REQUEST = ("llamacpp-llm",)
#: The least score of a dense hit by model (fixed values).
MODEL_MIN_SCORES = {
    "text-embedding-3-small": 0.35,
    "text-embedding-3-large": 0.30,
    "text-embedding-ada-002": 0.40,
    "nomic-embed-text": 0.45,
    "mxbai-embed-large": 0.40,
    "all-minilm": 0.50,
    "qwen3-embedding:0.6b": 0.25,
    "qwen3-embedding:4b": 0.30,
    "qwen3-embedding:8b": 0.35,
    "text-embedding-004": 0.45,
    "gemini-embedding-001": 0.40,
    "codestral-embed-2505": 0.35,
    "jina-embeddings-v2-base-code": 0.40,
    "jina-code-embeddings-0.5b": 0.45,
    "jina-code-embeddings-1.5b": 0.35,
    "jina-embeddings-v4": 0.30,
}


def _prefix(provider: str, model: str, instruct: bool, table: list[tuple[str, str, str]]) -> str:
    if provider in ON_REQUEST and not instruct:
        return ""
    return next((prefix for name, pattern, prefix in table if provider == name and re.search(pattern, model or "")), "")


def query_prefix(query: str, provider: str, model: str = "", table: list[tuple[str, str, str]] = QUERY_PREFIXES, instruct: bool = False) -> str:
    """The query with its model's prefix, put once."""
    return query if query.startswith(prefix := _prefix(provider, model, instruct, table)) else prefix + query


def document_prefix(provider: str, model: str = "", instruct: bool = False) -> str:
    """What stands before a text that is indexed; empty for most models."""
    return _prefix(provider, model, instruct, DOCUMENT_PREFIXES)


def pooling_layer(spec: str | int | None, layers: int) -> int:
    """A layer (from 0) from `last`, a signed offset, or a fraction a/b of the depth."""
    text = "last" if spec is None else str(spec).strip()
    if text == "last":
        return layers - 1
    if m := re.fullmatch(r"(\d+)/(\d+)", text):
        a, b = int(m[1]), int(m[2])
        if not 0 < a <= b:
            raise ValueError(f"no layer: {spec!r}")
        return max(0, min(layers - 1, round(layers * a / b) - 1))
    if re.fullmatch(r"[+-]?\d+", text):
        n = int(text)
        at = n if n >= 0 else layers + n
        if 0 <= at < layers:
            return at
    raise ValueError(f"no layer: {spec!r}")
