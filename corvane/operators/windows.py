"""Sliding text windows as table-generating expressions: one row in, many rows out, no Python.

A text is cut once into pieces of one stride, and each window is put together from the pieces it
covers, so the work grows with the text and not with its square (``substring`` counts characters from a text's start).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pieced(df: DataFrame, text: str, size: int, stride: int) -> DataFrame:
    """Rows with a text that isn't empty, with ``__n`` (its characters) and ``__ws`` (the ``size`` characters from each stride's start on)."""
    pieces = F.expr(f"regexp_extract_all(`{text}`, '(?s).{{1,{stride}}}', 0)")
    out = df.where(F.expr(f"octet_length(`{text}`) > 0")).withColumn("__p", pieces).withColumn("__n", F.expr(f"length(`{text}`)"))
    return out.withColumn("__ws", F.expr(f"transform(__p, (p, k) -> substring(array_join(slice(__p, k + 1, {-(-size // stride)}), ''), 1, {size}))"))


def window_chunks(df: DataFrame, text: str = "text", size: int = 500, overlap: int = 50, gapless: bool = False) -> DataFrame:
    """Add ``chunk_index, position_start, position_end, content``: windows of ``size`` characters.

    Windows start every ``size - overlap`` characters and, but for the last, end at their last space (the space itself is
    left out) if there is one behind their first character.  The next start doesn't depend on that cut, so a cut of
    more than ``overlap`` leaves a gap; ``gapless`` extends such windows up to the next start.  The last end is clamped to
    the text.  Empty and null texts give no row.
    """
    stride = max(1, size - overlap)
    most = f"1 + greatest(0, CAST(ceil((__n - {size}) / CAST({stride} AS DOUBLE)) AS INT))"
    rows = _pieced(df, text, size, stride).withColumn("__ws", F.expr(f"slice(__ws, 1, {most})"))
    out = rows.select(*[F.col(f"`{c}`") for c in df.columns], "__n", F.posexplode_outer("__ws").alias("chunk_index", "__w"))
    start, cut = f"chunk_index * {stride}", "instr(reverse(__w), ' ')"
    inner = f"{start} + {size} < __n AND __cut > 0 AND length(__w) - __cut > 0"
    cut_end = f"{start} + length(__w) - __cut"
    end = f"CASE WHEN {inner} THEN {f'greatest({cut_end}, {start} + {stride})' if gapless else cut_end} ELSE least({start} + {size}, __n) END"
    out = out.withColumn("__cut", F.expr(cut)).withColumn("position_start", F.expr(f"CAST({start} AS BIGINT)")).withColumn("position_end", F.expr(f"CAST({end} AS BIGINT)"))
    content = F.expr("substring(__w, 1, CAST(position_end - position_start AS INT))")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "chunk_index", "position_start", "position_end", content.alias("content"))


def paragraph_chunks(df: DataFrame, text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """Like :func:`window_chunks`, but a window that holds a blank line ends behind its last one.

    That rule applies to windows already cut at a space, if the blank line is not at their start and
    more than 20 characters before their end.  Windows go on until one reaches the end of
    the text, so the paragraph rule may add windows; they are found with array expressions, one row at a time.
    """
    stride = max(1, size - overlap)
    # each step looks at a window once: its last space, then its last blank line, then its end
    spaced = f"transform(__ws, (w, k) -> named_struct('k', k, 'w', w, 'cut', if(k * {stride} + {size} < __n, instr(reverse(w), ' '), 0)))"
    cut = f"transform({spaced}, x -> named_struct('k', x.k, 'w', if(x.cut > 0 AND x.cut < {size}, substring(x.w, 1, {size} - x.cut), x.w), 'e', if(x.cut > 0 AND x.cut < {size}, {size} - x.cut, {size})))"
    blank = f"transform({cut}, x -> named_struct('k', x.k, 'w', x.w, 'e', x.e, 'b', if(instr(x.w, '\\n\\n') > 0, length(x.w) - instr(reverse(x.w), '\\n\\n') - 1, -1)))"
    ends = f"""transform({blank}, x -> named_struct('k', x.k, 'w', x.w,
        'e', x.k * {stride} + if(x.b > 0 AND x.b < length(x.w) - 20, x.b + 2, x.e)))"""
    # the first window whose end reaches the text's end is the last one
    kept = "slice(__ends, 1, coalesce(CAST(nullif(array_position(transform(__ends, x -> x.e >= __n), true), 0) AS INT), size(__ends)))"
    rows = _pieced(df, text, size, stride).withColumn("__ends", F.expr(ends))
    out = rows.select(*[F.col(f"`{c}`") for c in df.columns], "__n", F.explode_outer(F.expr(kept)).alias("__c"))
    start = f"CAST(__c.k * {stride} AS BIGINT)"
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col("__c.k").alias("chunk_index"),
        F.expr(start).alias("position_start"),
        F.expr("CAST(least(__c.e, __n) AS BIGINT)").alias("position_end"),
        F.expr(f"substring(__c.w, 1, CAST(least(__c.e, __n) AS INT) - __c.k * {stride})").alias("content"),
    )
