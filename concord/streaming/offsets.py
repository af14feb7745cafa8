"""Positions in a source's stream as text that is kept with the state."""

from __future__ import annotations

import json


def encoded(stream: str, position: int) -> str:
    return json.dumps({"stream": stream, "position": position}, separators=(",", ":"))


def decoded(text: str | None, stream: str) -> int | None:
    """The position, or null, which stands for the start, where text is missing, can't be read, or is of another stream: a full rescan is always safe."""
    try:
        told = json.loads(text) if text else None
    except ValueError:
        return None
    if not isinstance(told, dict) or told.get("stream") != stream or type(told.get("position")) is not int:
        return None
    return told["position"]


def later(a: str, b: str) -> bool:
    """Whether position a comes after b; positions of different streams, or that can't be read, raise."""
    stream = json.loads(a)["stream"]
    first, second = decoded(a, stream), decoded(b, stream)
    if first is None or second is None:
        raise ValueError("positions of different streams can't be compared")
    return first > second
