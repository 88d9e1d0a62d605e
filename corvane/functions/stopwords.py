"""Stop words: the English and Russian lists of Spark's StopWordsRemover, kept beside this module."""

from __future__ import annotations

from functools import cache
from pathlib import Path


@cache
def stop_words(languages: tuple[str, ...] = ("english", "russian")) -> tuple[str, ...]:
    """Union of the lists, lower case, sorted."""
    folder = Path(__file__).parent / "words"
    lines = [w.strip().lower() for x in languages for w in (folder / f"{x}.txt").read_text(encoding="utf-8").splitlines()]
    return tuple(sorted({w for w in lines if w and not w.startswith("#")}))
