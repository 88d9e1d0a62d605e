"""Transforms that turn item records into a document folder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Object classes in order of preference.  Fixed values.
CLASSES = ("safe", "euclid", "keter", "thaumiel", "apollyon")


#: Extension of a code block's language; others have DEFAULT_EXTENSION.  Fixed values.
LANGUAGES = {
    "python": ".py", "py": ".py", "javascript": ".js", "js": ".js", "typescript": ".ts", "ts": ".ts",
    "json": ".json", "yaml": ".yaml", "yml": ".yaml", "bash": ".txt", "shell": ".txt", "text": ".txt",
}
DEFAULT_EXTENSION = ".txt"


def with_content(meta: DataFrame, content: DataFrame, key: str) -> DataFrame:
    """Items with their content; items without any are left out."""
    return meta.join(content, key, "left").where("raw_content IS NOT NULL")


def object_class(current: str, tags: str) -> Column:
    """The stated class, or for ``Unknown`` the first of ``CLASSES`` among the lower-cased tags."""
    known = F.array(*[F.lit(c) for c in CLASSES])
    low = F.transform(tags, F.lower)
    first = F.get(F.filter(known, lambda c: F.array_contains(low, c)), F.lit(0))
    return F.when(F.col(current) != "Unknown", F.col(current)).otherwise(F.coalesce(first, F.lit("Unknown")))


def word_count(text: str) -> Column:
    return F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))


def item_page(title: str, class_: str, tags: str, body: str, max_tags: int = 30) -> Column:
    """A Markdown page: title, class, the first tags, number of words, text."""
    return F.concat(
        F.lit("# "), title, F.lit("\n\nClass: "), class_, F.lit("\nTags: "), F.array_join(F.slice(tags, 1, max_tags), ", "),
        F.lit("\nWords: "), word_count(body).cast("string"), F.lit("\n\n"), body,
    )


def list_page(title: str, kind: str, links: str, most: int = 50) -> Column:
    """A hub or group page: its kind and the first ``most`` links as a list."""
    items = F.transform(F.slice(links, 1, most), lambda x: F.concat(F.lit("- "), x))
    return F.concat(F.lit("# "), title, F.lit("\n\nKind: "), kind, F.lit("\n\n"), F.array_join(items, "\n"))


def code_extension(language: str, extensions: Mapping[str, str] = LANGUAGES, default: str = DEFAULT_EXTENSION) -> Column:
    known = F.create_map(*[F.lit(x) for pair in extensions.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(language)), F.lit(default))


def code_blocks(df: DataFrame, text: str, least: int = 30) -> DataFrame:
    """One row a fenced block of ``least`` characters or more: ``code_lang`` (``text`` if unnamed) and ``code`` added."""
    part = lambda i: F.regexp_extract_all(F.col(text), F.lit(r"(?s)```(\w+)?\n(.*?)```"), F.lit(i))
    out = df.withColumn("__b", F.explode(F.arrays_zip(part(1).alias("l"), part(2).alias("c"))))
    lang = F.coalesce(F.nullif(F.col("__b.l"), F.lit("")), F.lit("text"))
    return out.withColumn("code_lang", lang).withColumn("code", F.col("__b.c")).drop("__b").where(F.length("code") >= least)


def quotas(total: int, shares: Mapping[str, float]) -> dict[str, int]:
    """Whole quotas that sum to ``total``: floors, then the largest remainders."""
    weight = sum(shares.values())
    exact = {k: total * v / weight for k, v in shares.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def carried(quota: Mapping[str, int], used: Mapping[str, int]) -> dict[str, int]:
    """Quotas after what earlier categories left over went, in equal parts, to the later ones."""
    out, names = dict(quota), list(quota)
    for i, name in enumerate(names[:-1]):
        left, later = max(0, out[name] - used.get(name, 0)), names[i + 1 :]
        for j, other in enumerate(later):
            out[other] += left // len(later) + (j < left % len(later))
    return out
