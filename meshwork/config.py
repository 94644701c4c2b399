"""Settings of the command line, from a plain ``key: value`` file or flags."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    graph: str = ""
    giant_degree: int = 128
    iterations: int = 20
    damping: float = 0.85
    epsilon: float = 1e-6
    start: int = 0
    random_select: int = 10
    seed: int = 42
    shuffle_partitions: int = 0


def number(text: str) -> int | float:
    """A number or a product of numbers, such as ``1024 * 16``."""
    parts = [p.strip() for p in str(text).split("*")]
    values = [int(p) if p.lstrip("+-").isdigit() else float(p) for p in parts]
    return math.prod(values)


def load(path: str) -> Settings:
    """Settings of a file with one ``key: value`` a line; comments, sections and unknown keys are read over."""
    known = {f.name: type(f.default) for f in fields(Settings)}
    found = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            key, colon, value = line.split("#", 1)[0].strip().partition(":")
            if colon and key.strip() in known and value.strip():
                kind, text = known[key.strip()], value.strip().strip("\"'")
                found[key.strip()] = text if kind is str else kind(number(text))
    return replace(Settings(), **found)
