"""Walks over JSON of any depth. Spark's functions have no recursion over unknown keys, so these are Arrow-batched functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import values

#: Keys whose text values are links.
LINK_KEYS = frozenset(("href", "url", "link", "endpoint", "action", "path"))
MESSAGES = [re.compile(p) for p in values.PARAMETER_MESSAGES]
#: Sure to be in a text that names a parameter.
MESSAGE_HINT = re.compile("param|不能为空|非法的|参数")


def looks_like_json(body):
    return body.rlike(r"\A[ \t\n\r]*[\[{]")


def loaded(text):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def nodes(root):
    """(depth, key or None, value) of everything in a JSON value; depth 1 is the root, arrays count."""
    stack = [(1, None, root)]
    while stack:
        depth, key, value = stack.pop()
        yield depth, key, value
        if isinstance(value, dict):
            stack += [(depth + 1, k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            stack += [(depth + 1, None, v) for v in reversed(value)]


def link_like(value: str) -> bool:
    low = value.lower()
    if len(value.encode("utf-8", "surrogatepass")) < 2 or "\n" in value or "\r" in value or low.startswith(("data:", "blob:", "javascript:", "#")):
        return False
    return low.startswith(("http://", "https://", "ws://", "wss://")) or value.startswith(("/", "./", "../")) or ("/" in value and any(c.isascii() and c.isalpha() for c in value))


def links_of(text: str) -> list[str]:
    found = (v for _, k, v in nodes(loaded(text)) if k is not None and k.lower() in LINK_KEYS and isinstance(v, str) and link_like(v))
    return list(dict.fromkeys(found))


def named_in(text: str) -> list[str]:
    if not MESSAGE_HINT.search(text):
        return []
    return [m for p in MESSAGES for m in p.findall(text) if m]


def parameters_of(text: str) -> list[str]:
    """Keys below the first level, values of param and parameter, and what messages name."""
    root, found = loaded(text), []
    for depth, key, value in nodes(root) if root is not None else ():
        if key is not None and depth >= 3:
            found.append(key)
        if key in ("param", "parameter") and isinstance(value, str):
            found.append(value)
        if isinstance(value, str):
            found += named_in(value)
    return [x for x in dict.fromkeys(found + named_in(text)) if x]


def mapped_paths_of(text: str) -> list[str]:
    """Paths in the mappings of a service's management page: patterns, and the first path of predicates."""
    root, found = loaded(text), []
    for _, key, value in nodes(root) if isinstance(root, dict) else ():
        if key == "patterns" and isinstance(value, list):
            found += [x.strip() for x in value if isinstance(x, str)]
        elif key == "predicate" and isinstance(value, str):
            found += [x for x in re.split(r"[ {}()&|,]+", value) if x.startswith("/")][:1]
    return [x for x in found if x.startswith("/")]


def batched(function):
    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: function(t) if t is not None else [])

    return run


json_links, json_parameters, mapped_paths = batched(links_of), batched(parameters_of), batched(mapped_paths_of)


def json_urls(body):
    """array<string> of links in a JSON body; empty for other bodies."""
    return F.when(looks_like_json(body), json_links(F.when(looks_like_json(body), body))).otherwise(F.array().cast("array<string>"))
