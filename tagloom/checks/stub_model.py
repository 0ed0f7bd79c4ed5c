"""A small pattern tagger that stands in for a trained model."""

from __future__ import annotations

import re
from collections.abc import Callable

# Applied in this order; each finding becomes ``name:TAG``.
RULES = (
    ("NATION [0-9]+", "LC"),
    ("[0-9]{4} [0-9]{2} [0-9]{2}", "DT"),
    ("[0-9]+시", "TI"),
    ("[0-9]+개", "QT"),
)


def pattern_model() -> Callable[[list[str]], list[str]]:
    compiled = [(re.compile(pattern), tag) for pattern, tag in RULES]

    def predict(sentences: list[str]) -> list[str]:
        return [
            " ".join(f"{name}:{tag}" for pattern, tag in compiled for name in pattern.findall(sentence))
            for sentence in sentences
        ]

    return predict
