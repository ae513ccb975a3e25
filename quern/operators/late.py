"""Late chunking: chunks of a file are embedded in their common context and pooled over their own tokens."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

JOIN = "\n\n"


def windows(sizes: list[int], context: int, share: float = 0.95) -> list[list[int]]:
    """Consecutive chunks in groups whose tokens fit into a share of the context; a chunk that is too large is alone."""
    room, out, used = int(context * share), [], 0
    for i, n in enumerate(sizes):
        if not out or used + n > room:
            out.append([])
            used = 0
        out[-1].append(i)
        used += n
    return out


def spans(texts: list[str], tokenize: Callable[[str], list]) -> list[tuple[int, int]]:
    """Token span of each text in their join, from the token counts of growing prefixes."""
    out, prefix, before = [], "", 0
    for i, t in enumerate(texts):
        prefix = t if i == 0 else prefix + JOIN + t
        n = len(tokenize(prefix))
        out.append((min(before, max(0, n - 1)), n))
        before = n
    return out


def pooled(vectors: np.ndarray, span: tuple[int, int], how: str = "mean", temperature: float = 1.0) -> np.ndarray:
    """One vector of a span of token vectors: mean, last, or softmax-weighted by likeness to the last; L2-normalised."""
    part = vectors[span[0] : span[1]]
    if how == "mean":
        v = part.mean(axis=0)
    elif how == "last" or len(part) == 1:
        v = part[-1]
    else:
        n = np.linalg.norm(part, axis=1)
        near = part @ part[-1] / np.maximum(n * n[-1], 1e-12)
        w = np.exp((near - near.max()) / temperature)
        v = (part * (w / w.sum())[:, None]).sum(axis=0)
    size = np.linalg.norm(v)
    return v / size if size else v


def late_chunks(chunks: DataFrame, tokenize: Callable[[str], list], embed: Callable[[str], np.ndarray], context: int = 512, how: str = "mean") -> DataFrame:
    """(id, embedding) for chunks (file_path, id, start_line, content); `embed` gives a vector a token."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start_line", "id"])
        texts, out = rows["content"].tolist(), []
        for group in windows([len(tokenize(t)) for t in texts], context):
            mine = [texts[i] for i in group]
            vectors = np.asarray(embed(JOIN.join(mine)), dtype=np.float64)
            out += [pooled(vectors, s, how).astype(np.float32).tolist() for s in spans(mine, tokenize)]
        return pd.DataFrame({"id": rows["id"].tolist(), "embedding": out})

    kind = chunks.schema["id"].dataType.simpleString()
    return chunks.groupBy("file_path").applyInPandas(work, f"id {kind}, embedding array<float>")
