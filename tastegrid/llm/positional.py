"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

The training side is indexed once: a posting is ``(term, next term, document, position)`` for every place where
two neighbouring words are also neighbours in a benchmark window (a lone benchmark word is a term without a next
term). Postings of other places can't belong to a match and are not stored. A window is then looked up by its
rarest term: that list, shifted by the term's offset, proposes starts, and the lists of the other terms, shifted
likewise, are intersected with it. With ``slop`` each term may lie that many words off its place
(proximity match); 0 is the exact phrase.

Defined results: a null or wordless text has no words, hits or items; identical windows of several items are
looked up once and count for each item; rows that share an id but not the text are separate documents, repeated
rows give the same result each; a null id is an id like any other; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.llm.common import ascii_lower, broadcast_if, fresh, joined, without
from tastegrid.operators.staging import stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
MARKS = 64  # terms that stand for rows themselves
TERMS_BROADCAST = 200_000  # most benchmark terms that are sent to every executor; more are joined by shuffle


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _places(rows: DataFrame, keep: list[str], pos: str) -> DataFrame:
    """One row ``(*keep, pos, w, nxt)`` per word of the array column ``found``; the last ``nxt`` is null."""
    after = F.expr("slice(found, 2, 2147483647)")
    lined = rows.select(*keep, "found", after.alias("after"))
    spread = lined.select(*keep, F.posexplode(F.arrays_zip("found", "after")).alias(pos, "_t"))
    return spread.select(*keep, pos, F.col("_t.found").alias("w"), F.col("_t.after").alias("nxt"))


def _marked_places(rows: DataFrame, keep: list[str]) -> DataFrame:
    """As :func:`_places`, after a row with ``pos`` -1 for each of ``rows``: its ``w`` is empty, its ``nxt`` one of the
    ``MARKS``, and its ``n_words`` the number of words."""
    after = F.expr("concat(slice(found, 2, 2147483647), array(cast(null AS string)))")
    mark = F.concat(F.lit(" "), F.pmod(F.col("_text"), F.lit(MARKS)).cast("string"))
    lined = rows.select(
        *keep, F.concat(F.array(F.lit("")), "found").alias("found"), F.concat(F.array(mark), after).alias("after"),
        F.size("found").cast("long").alias("n_words"),
    )
    spread = lined.select(*keep, "n_words", F.posexplode(F.arrays_zip("found", "after")).alias("pos", "_t"))
    return spread.select(*keep, (F.col("pos") - 1).alias("pos"), F.col("_t.found").alias("w"), F.col("_t.after").alias("nxt"), "n_words")


def windows(items: DataFrame, item: str, text: str, length: int) -> DataFrame:
    """``(item, win, n)``: every run of ``length`` words of an item, or all its words if there are fewer."""
    rows = items.select(F.col(item).alias("item"), words(F.col(text)).alias("found")).where(F.size("found") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("found") - length + 1, F.lit(1)))
    runs = rows.select("item", "found", F.explode(starts).alias("at"))
    cut = F.expr(f"slice(found, at, {length})")
    # words hold no spaces, so the joined text names the window
    return runs.select("item", F.array_join(cut, " ").alias("win"), F.size(cut).alias("n")).distinct()


def window_terms(wins: DataFrame) -> DataFrame:
    """``(win, n, off, w, nxt)`` for each distinct window."""
    rows = wins.select("win", "n", F.split("win", " ").alias("found")).distinct()
    rows = _places(rows, ["win", "n"], "off").withColumn("nxt", F.coalesce("nxt", F.lit("")))
    return rows.where((F.col("nxt") != "") | (F.col("n") == 1))


def index(docs: DataFrame, key: str, text: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings ``(key, _text, pos, w, nxt)`` of the given ``terms (w, nxt)`` over whole texts, and ``(key, _text, n_words)``
    of every row; one scan gives both."""
    wanted = terms.select("w", "nxt").distinct()
    marks = docs.sparkSession.range(MARKS).select(F.lit("").alias("w"), F.concat(F.lit(" "), F.col("id").cast("string")).alias("nxt"))
    pairs, lone = wanted.where("nxt != ''").union(marks), wanted.where("nxt = ''").select("w")
    n_pairs, n_lone = wanted.agg(F.count_if(F.col("nxt") != ""), F.count_if(F.col("nxt") == "")).first()
    none = F.array().cast("array<string>")
    found = docs.select(key, F.xxhash64(text).alias("_text"), F.coalesce(words(F.col(text)), none).alias("found"))
    places = _marked_places(found, [key, "_text"])
    columns = [key, "_text", "pos", "w", "nxt", F.when(F.col("pos") < 0, F.col("n_words")).alias("n_words")]
    postings = places.join(broadcast_if(pairs, n_pairs + MARKS, TERMS_BROADCAST), ["w", "nxt"]).select(*columns)
    if n_lone:
        single = places.drop("nxt").join(broadcast_if(lone, n_lone, TERMS_BROADCAST), "w").withColumn("nxt", F.lit(""))
        postings = postings.union(single.select(*columns))
    postings = stage(postings, "postings")
    return postings.where("pos >= 0").drop("n_words"), postings.where("pos < 0").select(key, "_text", "n_words")


def matches(postings: DataFrame, key: str, terms: DataFrame, slop: int = 0) -> DataFrame:
    """``(key, _text, win, n, start)``: places where all terms of a window occur.

    ``start`` is where the window begins as told by its rarest term.
    """
    held = postings.groupBy("w", "nxt").agg(F.count(F.lit(1)).alias("df"))
    sized = terms.join(held, ["w", "nxt"])
    # a window one of whose terms never occurs is out; the others start from their rarest term
    rarest = (
        sized.groupBy("win", "n")
        .agg(F.count(F.lit(1)).alias("terms"), F.min(F.struct("df", "off", "w", "nxt")).alias("a"))
        .where(F.col("terms") == F.greatest(F.col("n") - 1, F.lit(1)))
        .select("win", "n", F.col("a.off").alias("at"), "a.w", "a.nxt")
    )
    starts = (
        postings.join(rarest, ["w", "nxt"])
        .select(key, "_text", "win", "n", "at", (F.col("pos") - F.col("at")).alias("start"))
        .where("start >= 0")
    )
    short = starts.where("n <= 2").select(key, "_text", "win", "n", "start").distinct()
    others = starts.where("n > 2").join(terms.select("win", "off", "w", "nxt"), "win").where("off != at")
    shift = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
    others = others.withColumn("_shift", shift).withColumn("pos", F.col("start") + F.col("off") + F.col("_shift"))
    met = joined(others, postings, [key, "_text", "pos", "w", "nxt"], "inner")
    long = (
        met.groupBy(key, "_text", "win", "n", "start")
        .agg(F.expr("bit_count(bit_or(shiftleft(1L, off)))").alias("met"))
        .where(F.col("met") == F.col("n") - 2)
        .select(key, "_text", "win", "n", "start")
    )
    return short.union(long)


def _found(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    wins = stage(windows(benchmark, item, item_text, length), "windows")
    terms = stage(window_terms(wins), "window-terms")
    postings, rows = index(docs, key, text, terms)
    return wins, stage(matches(postings, key, terms), "matches"), rows


def clean(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    length: int = 10,
) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns."""
    mark = fresh(docs, "_text")
    _, found, _ = _found(docs, benchmark, key, text, item, item_text, length)
    gone = stage(found.select(key, F.col("_text").alias(mark)).distinct(), "contaminated")
    return without(docs.withColumn(mark, F.xxhash64(text)), gone, [key, mark]).drop(mark)


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    length: int = 10,
) -> DataFrame:
    """``(key, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per row of ``docs``.

    A null item counts as one item in ``n_items``; the hash is over the other ids. ``length`` is at most 64.
    """
    wins, found, base = _found(docs, benchmark, key, text, item, item_text, length)
    hit = (
        found.select(key, "_text", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos"))
        .distinct()
        .groupBy(key, "_text")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    items = (
        found.select(key, "_text", "win")
        .distinct()
        .join(wins.select("item", "win"), "win")
        .groupBy(key, "_text")
        .agg(
            F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
            F.size(F.collect_set(F.struct(F.col("item").cast("string")))).alias("n_items"),
        )
    )
    whole = joined(joined(base, hit, [key, "_text"], "left"), items, [key, "_text"], "left")
    none = F.array().cast("array<string>")
    return whole.select(
        key,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
