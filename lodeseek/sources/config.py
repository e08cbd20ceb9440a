"""Configuration: where it is looked for, variables, defaults, checks."""

from __future__ import annotations

import copy
import os
import re
import shutil

DEFAULTS = {
    "sources": [],
    "embeddings": {"provider": "hash", "dimensions": 64},
    "reranker": {"provider": "none"},
    "chunking": {"maxTokens": 1000, "overlap": 100},
    "search": {"bm25Weight": 0.4, "vectorWeight": 0.6, "summaryVectorWeight": 0.0, "retrieveTopK": 50, "finalTopK": 10, "rrf": {"k": 60}, "useSummaryVector": False, "approximate": False},
    "summarization": {"enabled": False, "provider": "mock"},
}
NAMES = ("lodeseek.yaml", "lodeseek.yml")


def substituted(value, env: dict | None = None):
    """`${NAME}` replaced in all strings; a name that isn't set stays as it is."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), value)
    if isinstance(value, list):
        return [substituted(v, env) for v in value]
    return {k: substituted(v, env) for k, v in value.items()} if isinstance(value, dict) else value


def merged(base: dict, over: dict) -> dict:
    """over put into base; dictionaries key by key, lists and other values as a whole."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def find(explicit: str | None = None, env: dict | None = None, cwd: str | None = None, home: str | None = None) -> str | None:
    """An explicit path, LODESEEK_CONFIG, the working folder, the home folder; None for defaults alone."""
    env = os.environ if env is None else env
    if explicit or env.get("LODESEEK_CONFIG"):
        return explicit or env["LODESEEK_CONFIG"]
    for folder in (cwd or os.getcwd(), os.path.join(home or os.path.expanduser("~"), ".lodeseek")):
        for name in NAMES:
            if os.path.isfile(p := os.path.join(folder, name)):
                return p
    return None


def checked(config: dict) -> dict:
    """config, or ValueError for what can't be."""
    s = config["search"]
    total = s["bm25Weight"] + s["vectorWeight"] + s["summaryVectorWeight"]
    if s["useSummaryVector"] and abs(total - 1) > 0.01:
        raise ValueError(f"weights must sum to 1 with summary vectors, not {total:g}")
    for name in ("retrieveTopK", "finalTopK"):
        if not isinstance(s[name], int) or s[name] < 1:
            raise ValueError(f"{name} must be a positive integer")
    for source in config["sources"]:
        if source.get("type") not in ("local", "git") or not source.get("name"):
            raise ValueError("a source has a name and type local or git")
        if source["type"] == "local" and not source.get("path") or source["type"] == "git" and not source.get("url"):
            raise ValueError(f"source {source['name']} lacks its path or url")
    for part, plain in (("embeddings", "hash"), ("reranker", "none"), ("summarization", "mock")):
        c = config[part]
        if c["provider"] not in (plain, "remote"):
            raise ValueError(f"unknown {part} provider {c['provider']}")
        if c["provider"] == "remote" and not (c.get("url") and c.get("model")):
            raise ValueError(f"the {part} provider needs a url and a model")
    if not isinstance(config["embeddings"]["dimensions"], int) or config["embeddings"]["dimensions"] < 1:
        raise ValueError("dimensions must be a positive integer")
    return config


def load(explicit: str | None = None, env: dict | None = None, **places) -> dict:
    path = find(explicit, env, **places)
    if path is None:
        return checked(copy.deepcopy(DEFAULTS))
    import yaml

    with open(path, encoding="utf-8") as f:
        return checked(merged(DEFAULTS, substituted(yaml.safe_load(f) or {}, env)))


def copied(path: str, target: str) -> None:
    """The raw file: variables are not resolved, so no secret is written."""
    shutil.copyfile(path, target)
