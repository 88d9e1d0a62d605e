"""Benchmark decontamination with native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, UPPER, Scratch, marked, marks, without

WINDOW = 13
#: What separates words: every ASCII character that is neither a digit nor a lower-case letter.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: str) -> Column:
    """Array of words after lower-casing A-Z; null and empty texts have none.

    ``lower`` serves ASCII texts, where it equals the (slower) letter-wise translation.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, NOT_WORD), "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct ``(length, hash, words, item_id)``: windows of the items, or a short item whole; an item without an id is none."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), normal_words("text").alias("w")).where("item_id IS NOT NULL AND size(w) > 0")
    w = w.select("item_id", "w", F.least(F.size("w"), F.lit(window)).alias("length"))
    w = w.select("item_id", "w", "length", F.explode(F.expr("sequence(1, size(w) - length + 1)")).alias("at"))
    piece = F.slice("w", F.col("at"), F.col("length"))
    return w.select("item_id", "length", F.xxhash64(piece).alias("hash"), F.array_join(piece, " ").alias("words")).distinct()


def text_key() -> Column:
    """128 bits that tell one text from another; null counts as empty."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.crc32(t).alias("b"), F.octet_length(t).alias("c"))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Verdict for each row of ``docs(doc_id, text)`` against ``items(item_id, text)``.

    Returns ``doc_id, text_key, n_words, n_hit, n_windows, item_ids, spans, contaminated``: hit words are those inside
    an occurrence of an item's window; ``n_windows`` counts the places where one of ``window`` words occurs; ``item_ids`` are the items
    with occurring windows, sorted as strings; ``spans`` are the merged hit ranges (first word, word after the last);
    ``contaminated`` is n_hit > 0 and share * n_hit >= n_words.

    1. The hashes of all item windows become a broadcast set of fixed size (:func:`marks`), however many there are.
    2. A text's windows are hashed in one pass (one for each window length that occurs among the items) and looked up
       in it; the lookup is a generated loop over the row's windows, of which only marked ones leave the row.
    3. What left is joined with the items' windows on hash and words: a chance mark goes here.  Only
       places, not texts, are shuffled.

    Null or empty texts have no words and no hit; neither has any text if there are no items.  Items without words or without an
    id never occur.  Very long texts need memory for their own words and hashes alone.  Rows are judged
    by their text, so rows with one doc_id are judged apart and repeated rows come out as often as they went in.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "contamination")
    wins = scratch.table(item_windows(items, window), "windows")
    lengths = sorted(r["length"] for r in wins.select("length").distinct().collect())  # at most ``window`` rows
    table = scratch.table(marks(wins, "hash"), "marks")

    rows = docs.select(F.col("doc_id"), text_key().alias("key"), normal_words("text").alias("w"))
    # place 0 stands for the row itself, so that rows without a hit stay
    hashes = "array(named_struct('length', 0, 'hash', array(CAST(NULL AS BIGINT))))"
    for n in lengths:
        of_row = f"CASE WHEN size(w) >= {n} THEN transform(sequence(1, size(w) - {n} + 1), i -> xxhash64(slice(w, i, {n}))) ELSE array() END"
        hashes = f"concat({hashes}, array(named_struct('length', {n}, 'hash', {of_row})))"
    # outer, since a plain explode makes Spark compute its array once more to leave out empty ones
    flat = rows.select("doc_id", "key", "w", F.explode_outer(F.expr(hashes)).alias("x"))
    flat = flat.select("doc_id", "key", "w", "x.length", F.posexplode_outer("x.hash").alias("at", "hash"))
    met = marked(flat, "hash", table).where("length = 0 OR __marked")
    words = F.when(F.col("length") > 0, F.array_join(F.slice("w", F.col("at") + 1, F.greatest("length", F.lit(1))), " "))
    n_words = F.when(F.col("length") == 0, F.size("w").cast("long"))
    met = scratch.table(met.select("doc_id", "key", "length", "at", "hash", words.alias("words"), n_words.alias("n_words")), "met")

    same = ["doc_id", "key"]
    known = wins.select("hash", "words").distinct()
    hits = met.where("length > 0").join(known, ["hash", "words"]).select(*same, "at", "length", "hash", "words")
    hits = scratch.table(hits, "hits")
    # ranges that meet: one exchange by row, then places in order
    placed = hits.repartition(*same).groupBy(*same, "at").agg(F.max("length").alias("length"))
    order = "PARTITION BY doc_id, key ORDER BY at"
    reach = F.expr(f"max(at + length) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    placed = placed.withColumn("reach", reach).withColumn("new", F.when(F.col("at") <= F.col("reach"), 0).otherwise(1))
    placed = placed.withColumn("span", F.expr(f"sum(new) OVER ({order} ROWS UNBOUNDED PRECEDING)"))
    span = placed.groupBy(*same, "span").agg(F.min("at").alias("first"), F.max(F.col("at") + F.col("length")).alias("last"), F.count_if(F.col("length") == window).alias("full"))
    spans = span.groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"), F.sum(F.col("last") - F.col("first")).alias("n_hit"), F.sum("full").alias("n_windows"))
    ids = hits.select(*same, "hash", "words").distinct().join(wins.select("hash", "words", "item_id"), ["hash", "words"])
    ids = ids.groupBy(*same).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    a, b = spans.alias("a"), ids.alias("b")
    found = scratch.table(a.join(b, _null_safe()).select("a.*", "b.item_ids"), "found")
    base = met.where("length = 0").groupBy(*same).agg(F.count("*").alias("copies"), F.max("n_words").alias("n_words"))
    a, b = base.alias("a"), found.alias("b")
    out = a.join(b, _null_safe(), "left").select("a.*", "b.spans", "b.n_hit", "b.n_windows", "b.item_ids")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        F.col("key").alias("text_key"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
        F.coalesce("item_ids", F.expr("CAST(array() AS array<string>)")).alias("item_ids"),
        F.coalesce("spans", F.expr("CAST(array() AS array<struct<first: int, last: int>>)")).alias("spans"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    ).drop("copy")


def _null_safe() -> Column:
    return F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))


def _bad(found: DataFrame) -> DataFrame:
    return found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, whole: bool = False) -> DataFrame:
    """``docs`` without the rows that :func:`find_contamination` calls contaminated; all columns stay.

    ``whole`` drops, besides, each row in which a window of ``window`` item words occurs at all, however long its text is.  Texts of
    clean rows are not shuffled.
    """
    scratch = Scratch(docs.sparkSession, "clean")
    found = find_contamination(docs, items, window, share)
    bad = scratch.table(_bad(found.where("contaminated OR n_windows > 0" if whole else "contaminated")), "bad")
    named = docs.withColumn("__text_key", text_key())
    gone = bad.withColumn("__gone", F.col("__key.a"))
    return without(named, F.col("__text_key.a"), gone, "__gone", _same(), scratch).drop("__text_key")


def without_spans(text: str, spans: str) -> tuple[Column, Column]:
    """What to name ``__parts`` (words with what stands before each), and the ``text`` without the parts in ``spans``, ranges of :func:`normal_words`."""
    other = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # NOT_WORD before A-Z are lower-cased
    parts = F.regexp_extract_all(F.col(text), F.lit(f"[{other}]*[^{other}]+"), F.lit(0))
    # what lies between two spans, before the first and behind the last, as slices
    kept = F.expr(f"""flatten(transform(sequence(0, size({spans})), i -> slice(__parts,
        if(i = 0, 0, {spans}[i - 1].last) + 1,
        if(i = size({spans}), size(__parts), {spans}[i].first) - if(i = 0, 0, {spans}[i - 1].last))))""")
    tail = F.regexp_extract(F.col(text), f"[{other}]*$", 0)
    return parts, F.concat(F.array_join(kept, ""), tail)


def cut_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """:func:`clean_documents` with the hit spans of the documents that stay cut out of their text; ``n_chars`` follows, if there is one.

    A cut brings words together that may form a window anew, so what was cut is searched again until nothing is found.  Texts without
    a hit are not shuffled.
    """
    scratch = Scratch(docs.sparkSession, "cut")
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def hits(df: DataFrame, name: str) -> DataFrame:
        found = find_contamination(df, items, window, share).where("n_hit > 0").distinct()
        found = found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans"), F.col("contaminated").alias("__bad"))
        return scratch.table(found, name)

    found, n = hits(docs, "hits0"), 0
    table = scratch.table(marks(found.select(F.col("__key.a").alias("h")), "h"), "marks")
    rows = marked(docs.withColumn("__text_key", text_key()).withColumn("__h", F.col("__text_key.a")), "__h", table)
    out = rows.where("NOT __marked").select(*columns)
    out = out.unionByName(rows.where("__marked").join(found, _same(), "left_anti").select(*columns))
    part = rows.where("__marked").join(found.where("NOT __bad"), _same())
    while True:
        parts, text = without_spans("text", "__spans")
        part = scratch.table(part.withColumn("__parts", parts), f"parts{n}").withColumn("text", text)
        if "n_chars" in docs.columns:
            part = part.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        part, n = scratch.table(part.select(*columns), f"cut{n}"), n + 1
        found = hits(part, f"hits{n}")
        if found.isEmpty():
            return out.unionByName(part.select(*columns))
        named = part.withColumn("__text_key", text_key())
        out = out.unionByName(named.join(found, _same(), "left_anti").select(*columns))
        part = named.join(found, _same())
