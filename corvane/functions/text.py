"""Column functions on texts, names and markup: all built-in expressions, evaluated in the JVM."""

from __future__ import annotations

import fnmatch
import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.stopwords import stop_words

#: Entity words: letters, a hyphen, numbers joined by hyphens or en dashes.
ENTITY_WORD = "^[a-z]+-[0-9]+([-–][0-9]+)*$"
SPACE = r"(?U)\s+"
#: What SPACE matches, spelt out: several times faster than a class that asks for Unicode properties.
SPACES = r"[\t-\r\x{85}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def quoted(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens(text: str) -> Column:
    """Lower-case words without ASCII punctuation or stop words, duplicates kept, in order.

    A word like ``scp-002`` is followed by a copy without its hyphens; since punctuation is
    deleted later, such words count twice.  Null: null.
    """
    stops = ", ".join(quoted(w) for w in stop_words())
    doubled = f"""array_join(flatten(transform(split(lower({text}), {quoted(SPACES)}),
        w -> if(w rlike {quoted(ENTITY_WORD)}, array(w, regexp_replace(w, '[-–]', '')), array(w)))), ' ')"""
    # words are looked at one by one only in texts that hold a hyphen between a letter and a digit
    once = f"CASE WHEN lower({text}) rlike '[a-z]-[0-9]' THEN {doubled} ELSE lower({text}) END"
    return F.expr(f"filter(split(translate({once}, {quoted(string.punctuation)}, ''), {quoted(SPACES)}), t -> t <> '' AND t NOT IN ({stops}))")


def entity_id(name: str) -> Column:
    """Identifier in a file name such as ``scp_002.md``; null if there is none."""
    kinds = "md|txt|py|js|ts|json|yaml|yml"
    pattern = rf"(?i)^(?:scp|mtf|site)[-_.]?(.+?)\.(?:{kinds})$"
    found = lambda x: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))
    return F.coalesce(found(stem(name)), found(F.col(name)))


def stem(name: str) -> Column:
    """Name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(F.col(name), r"(?s)^(.+)\.[^.]*$", "$1")


def extension(name: str) -> Column:
    """Last extension with its dot, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.col(name), r"(?s)^.+(\.[^.]+)$", 1))


def base_name(path: str) -> Column:
    return F.regexp_extract(F.col(path), r"(?s)([^/]*)$", 1)


def glob_match(name: str, pattern: str) -> Column:
    """Whether a base name matches a shell pattern, whole and case-sensitive (braces stand for themselves)."""
    return F.col(name).rlike("^" + re.sub(r"\\Z$", r"\\z", fnmatch.translate(pattern)))


def enriched(content: str, entity: str, name_stem: str) -> Column:
    """Content, entity id (if any) and file stem: what the index stores as a chunk's text."""
    return F.concat_ws(" ", content, entity, name_stem)


def strip_html(html: str) -> Column:
    """Text of markup: comments, scripts and styles dropped, block tags as new lines, other tags dropped,
    the common entities decoded, blanks collapsed."""
    x = F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    x = F.regexp_replace(x, r"(?i)</?(p|div|br|hr|li|ul|ol|tr|table|blockquote|section|article|pre|h[1-6])(\s[^>]*)?/?>", "\n")
    x = F.regexp_replace(x, r"</?[A-Za-z][^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(x, r" ?\n[ \n]*", "\n"))


def file_name(name: str) -> Column:
    """Name without characters that file systems refuse, 80 characters at most; ``untitled`` if nothing is left."""
    x = F.regexp_replace(F.col(name), r'[<>:"/\\|?*]', "_")
    x = F.regexp_replace(F.regexp_replace(x, r"^[ ._]+|[ ._]+$", ""), r"\s+", "_")
    return F.coalesce(F.nullif(F.substring(x, 1, 80), F.lit("")), F.lit("untitled"))


def content_name(url: str) -> Column:
    """Absolute paths: the base name; others without leading ``.`` and ``/``."""
    return F.when(F.col(url).startswith("/"), base_name(url)).otherwise(F.regexp_replace(F.col(url), r"^[./]+", ""))


def position_hint(start: str, end: str) -> Column:
    """``[chars a-b]``, or empty if an offset is missing; 0 is an offset."""
    both = F.col(start).isNotNull() & F.col(end).isNotNull()
    return F.when(both, F.concat(F.lit("[chars "), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"), F.lit("]"))).otherwise("")


def dedup_key(source: str, content: str) -> Column:
    return F.concat(F.col(source), F.lit("::"), F.substring(F.col(content), 1, 200))


def parse_grade(reply: str) -> Column:
    """Struct (relevant, score) of a grader's reply: lines ``relevant: yes|no`` and ``score: x``; the last counts.

    A missing flag means yes, so an unreadable reply is relevant with score 0; a positive score makes relevant too.
    """
    lines = F.split(F.col(reply), r"\R")
    value = lambda p: F.trim(F.element_at(F.transform(F.filter(lines, lambda x: x.startswith(p)), lambda x: F.substr(x, F.lit(len(p) + 1))), -1))
    any_ = lambda p: F.exists(lines, lambda x: x.startswith(p))
    flag = F.when(any_("relevant:"), F.lower(value("relevant:"))).otherwise("yes")
    score = F.when(any_("score:"), F.coalesce(value("score:").try_cast("double"), F.lit(0.0))).otherwise(0.0)
    return F.struct(((flag == "yes") | (score > 0)).alias("relevant"), F.round(score, 4).alias("score"))


def chosen_query(broadened: str, rewritten: str, original: str) -> Column:
    kept = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return F.coalesce(kept(broadened), kept(rewritten), F.trim(F.col(original)))


def yaml_type(value: str) -> Column:
    """Type of a plain YAML scalar."""
    v = F.trim(F.col(value))
    return (
        F.when(v.isNull() | v.isin("", "null", "~"), "null")
        .when(v.isin("true", "false", "yes", "no", "on", "off"), "boolean")
        .when(v.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), "integer")
        .when(v.rlike(r"(?i)^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+)?$|^[+-]?(nan|inf|infinity)$"), "float")
        .otherwise("string")
    )


def json_type(raw: str) -> Column:
    """Type of a raw JSON scalar."""
    v = F.col(raw)
    return (
        F.when(v == "null", "null")
        .when(v.isin("true", "false"), "boolean")
        .when(v.startswith('"'), "string")
        .when(v.rlike(r"^-?[0-9]+$"), "integer")
        .when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "float")
        .otherwise("unknown")
    )


def render(template: str, **values: str) -> Column:
    """A prompt: each ``{name}`` replaced by the column given for it."""
    out = F.lit(template)
    for name, column in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.col(column), F.lit("")))
    return out
