"""Parameters that take effect, with their defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Params:
    min_similarity: float = 0.75
    unchanged_threshold: float = 0.92
    neighbors_window: int = 1
    max_tokens_per_node: int = 220
    vector_dim: int = 768
    #: 'double': matched pairs are scored again with the candidate score in place of the cosine and that is reported;
    #: 'single': the candidate score is reported.
    score_mode: str = "double"
    #: Python workers' batch for model-backed vectors.
    batch_size: int = 1024
    #: 'hash', or a function from a list of texts to a list of vectors of vector_dim numbers, or its name ('module:function').
    embedder: object = "hash"
    #: None for the built-in summary, or a function from a prompt to a text.
    summarizer: object = None


def load_params(path: str | None = None, env: dict[str, str] | None = None) -> Params:
    """Defaults, then a TOML file, then environment variables (upper-case names); blank variables don't count."""
    out, env = Params(), os.environ if env is None else env
    table = tomllib.loads(Path(path).read_text()) if path else {}
    for f in fields(Params):
        if isinstance(getattr(out, f.name), (int, float, str)):
            given = env.get(f.name.upper(), "").strip() or table.get(f.name)
            if given is not None:
                out = replace(out, **{f.name: type(getattr(out, f.name))(given)})
    return out
