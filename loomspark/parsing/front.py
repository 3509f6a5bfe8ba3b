"""Front matter of one text: its state, its values as JSON and the body below it. Any text gives a result."""

from __future__ import annotations

import json
import math
import re

try:
    import yaml
except ImportError:  # without a YAML reader values are single lines
    yaml = None

BLOCK = re.compile(r"\ufeff?---[ \t]*\r?\n(.*?)(?:(?<=\n)|\r?\n)---[ \t]*(?:\r?\n|$)", re.S)
#: Values that aliases and nesting may make of one front matter, and how deep they may lie.
MOST_VALUES, DEEPEST = 100_000, 100
#: States: no line of dashes, none that closes it, no YAML, a value that is no mapping.
ABSENT, OPEN, UNPARSEABLE, NO_MAPPING, OK = "absent", "open", "unparseable", "no_mapping", "ok"


class Unfit(ValueError):
    """Values that no JSON can hold."""


def _loader():
    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        """Scalars of YAML 1.2: only true and false are booleans, dates stay text, numbers are decimal; no key twice."""

        def construct_mapping(self, node, deep=False):
            seen = set()
            for key, _ in node.value:
                said = (key.tag, key.value) if isinstance(key, yaml.ScalarNode) else id(key)
                if said in seen:
                    raise Unfit("a key stands twice")
                seen.add(said)
            return super().construct_mapping(node, deep)

    kept = ("tag:yaml.org,2002:null", "tag:yaml.org,2002:merge", "tag:yaml.org,2002:value")
    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t in kept] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|false|True|False)$"), list("tfTF"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^[-+]?(?:0|[1-9][0-9]{0,37})$"), list("-+0123456789"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))(?:[eE][-+]?[0-9]{1,3})?$"), list("-+.0123456789"))
    for tag in ("int", "float"):
        Loader.add_constructor(f"tag:yaml.org,2002:{tag}", lambda self, node, of={"int": int, "float": float}[tag]: of(node.value))
    return Loader


_LOADER = _loader() if yaml else None


def plain(value, depth: int = 0, left: list | None = None):
    """A value with keys as text and nothing that JSON lacks; raises Unfit for one that holds itself, is too deep or too large."""
    left = [MOST_VALUES] if left is None else left
    left[0] -= 1
    if left[0] < 0 or depth > DEEPEST:
        raise Unfit("too many values")
    if isinstance(value, dict):
        return {_key(k): plain(v, depth + 1, left) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v, depth + 1, left) for v in value]
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else str(value)
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def _key(key) -> str:
    if isinstance(key, str):
        return key
    return json.dumps(key, default=str) if key is None or isinstance(key, (bool, int, float)) else str(key)


def read(content: str | None) -> tuple[str, str, str]:
    """(state, values as JSON of an object, body). Where the state is not ok, values are {} and the body is the whole text."""
    text = (content or "").removeprefix("\ufeff")
    m = BLOCK.match(text)
    if not m:
        return (OPEN if text.startswith("---") else ABSENT), "{}", text
    try:
        if yaml:
            values = yaml.load(m[1] + "\n", _LOADER)  # noqa: S506 a safe loader
        else:
            values = {k: v.strip().strip("\"'") for k, v in re.findall(r"(?m)^([\w-]+):[ \t]*(.*)$", m[1])}
        if not isinstance(values, dict):
            return NO_MAPPING, "{}", text
        said = json.dumps(plain(values), sort_keys=True, ensure_ascii=False)
        said.encode()  # a lone surrogate is no text
    except Exception:  # whatever the reader finds: one file's front matter ends no job
        return UNPARSEABLE, "{}", text
    return OK, said, text[m.end() :]
