"""Benchmark decontamination by templates (DataFrame and SQL functions only).

Texts become templates: words lower-cased without punctuation; numbers (with their decimal and thousands marks), names (capitalised
words inside a sentence) and units after a number become typed placeholders, with their values kept aside. Every window of
WINDOW template words is hashed, in items and in documents; an item of fewer words is one window of its own length. A window with
fewer than LITERAL literal words says too little as a template, so its values are hashed with it. Where windows join, they are
compared word by word, and then the slots: within one alignment of a document with an item every value of the item must stand
for one value of the document, whichever it is. So a question whose numbers or names were exchanged is caught, and a chance
likeness of templates isn't. A document leaks an item if consistent windows cover COVERED of it.

No document text is shuffled: the distinct window hashes of the items (12 bytes each) are broadcast, in blocks of BLOCK, and
only document windows that meet one go on. Those are joined with the items' windows by a shuffle that may be split where
a window is common; its result has a row for each item that shares a window with a document.

Defined results: null texts have no words; an empty table on either side gives no rows; texts are read whole, however long; items
of fewer than LEAST words are phrases of ordinary text and never reported; rows that share an id are judged together, and null ids
as one; repeated items are reported under each id; U+0001 in a text acts as the mark of a name; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

WINDOW, LITERAL, LEAST, COVERED = 8, 2, 3, 0.5
#: Window hashes that one broadcast holds; more are taken in blocks, each a pass over the documents.
BLOCK = 4_000_000

#: Units that become placeholders after a number.
UNITS = "mm cm km m mg kg g ml l s ms min h hours hour minutes minute seconds second days day weeks week months month years year meters meter metres metre miles mile feet foot inches inch pounds pound grams gram litres litre liters liter dollars dollar euros euro cents cent percent degrees degree".split()

NAME = r"(?<=[\p{Ll}\p{Nd},;] )(\p{Lu}\p{Ll}+)"
TOKEN = r"[0-9]++(?:[.,][0-9]++)*+|\x01?[\p{L}\p{Nd}]++"


def templates(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, raw, words): the words of a text, and what each is in the template (U+0001 a name, U+0002 a number, U+0003 a unit)."""
    marked = F.lower(F.regexp_replace(F.col(text).cast("string"), NAME, "\u0001$1"))
    # a generator over one element keeps its input from being computed anew in each lambda below
    rows = rows.select(key, F.explode(F.array(F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0)))).alias("raw"))
    number = lambda x: (x >= "0") & (x < ":")  # noqa: E731  its first character is a digit
    unit = lambda x, i: (i > 0) & x.isin(UNITS) & number(F.get("raw", i - 1))
    words = F.transform("raw", lambda x, i: F.when(number(x), "\u0002").when(x < "\u0002", "\u0001").when(unit(x, i), "\u0003").otherwise(x))
    return rows.select(key, "raw", F.explode(F.array(words)).alias("words"))


def _hashes(width: int) -> str:
    """The hashes of all windows of a width, from the words' own hashes."""
    few = f"size(filter(slice(words, i + 1, {width}), w -> w >= '')) < {LITERAL}"
    plain = f"xxhash64({width}, slice(hashed, i + 1, {width}))"
    mixed = f"if({few}, xxhash64(-{width}, slice(raw, i + 1, {width})), {plain})"
    every = f"transform(sequence(0, size(words) - {width}), i -> {{}})"
    # below so many placeholders no window has few literal words
    return f"if(size(words) < {width}, array(), if(placeholders < {width - LITERAL + 1}, {every.format(plain)}, {every.format(mixed)}))"


def windows(rows: DataFrame, key: str, widths: Sequence[int]) -> DataFrame:
    """(key, raw, words, i, h) of every window of all widths; the windows of a width follow those of the widths before it."""
    held = rows.select(key, "raw", "words", F.expr("size(filter(words, w -> w < '\u0004'))").alias("placeholders"), F.explode(F.array(F.transform("words", lambda w: F.xxhash64(w)))).alias("hashed"))
    return held.select(key, "raw", "words", F.posexplode(F.expr(f"concat({', '.join(map(_hashes, widths))})")).alias("i", "h"))


def _of_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """The items' words, their windows (item_id, item_pos, width, h, its words and values), and the widths that occur."""
    items = keep(templates(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item_id").where(f"size(words) >= {LEAST}"))
    widths = sorted({r.n for r in items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("n")).distinct().collect()}, reverse=True)  # at most WINDOW numbers
    out = None
    for width in widths:
        of = items.where(F.size("words") >= WINDOW if width == WINDOW else F.size("words") == width)
        one = windows(of, "item_id", [width]).select("item_id", F.col("i").alias("item_pos"), F.lit(width).alias("width"), "h", F.expr(f"slice(words, i + 1, {width})").alias("item_words"), F.expr(f"slice(raw, i + 1, {width})").alias("item_raw"))
        out = one if out is None else out.union(one)
    return items, (None if out is None else keep(out)), widths


def _met(docs: DataFrame, side: DataFrame, widths: Sequence[int]) -> DataFrame:
    """(doc_id, h, pos, words, raw) of every document window whose hash an item has."""
    wanted = keep(side.select("h", "width").distinct())
    blocks = max(1, -(-wanted.count() // BLOCK))
    before = F.expr("case width " + " ".join(f"when {w} then {' + '.join(['0', *(f'greatest(0, size(words) - {x - 1})' for x in widths[:k])])}" for k, w in enumerate(widths)) + " end")
    out = None
    for block in range(blocks):
        some = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == block)
        one = windows(docs, "doc_id", widths).join(F.broadcast(some), "h").withColumn("pos", F.col("i") - before).where("pos >= 0 and pos + width <= size(words)")
        one = one.select("doc_id", "h", "pos", F.expr("slice(words, pos + 1, width)").alias("words"), F.expr("slice(raw, pos + 1, width)").alias("raw"))
        out = one if out is None else out.union(one)
    return keep(out.distinct())


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, covered_words, item_words, n_changed) of each document with an item it leaks."""
    schema = "doc_id long, item_id long, n_windows long, covered_words long, item_words long, n_changed long"
    docs = templates(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    items, side, widths = _of_items(benchmark)
    if side is None:
        return documents.sparkSession.createDataFrame([], schema)
    fits = _met(docs, side, widths).join(side, "h").where(f"words = item_words and (size(filter(words, w -> w >= '\u0004')) >= {LITERAL} or raw = item_raw)")
    ours = F.expr("filter(transform(item_raw, (x, k) -> struct(words[k] as kind, x as theirs, raw[k] as ours)), p -> p.kind < '\u0004')")
    met = keep(fits.select("doc_id", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), ours.alias("slots")).distinct())
    same = ["doc_id", "item_id", "shift"]
    pairs = met.where("size(slots) > 0").select(*same, F.explode("slots").alias("p")).select(*same, "p.*").distinct()
    values = pairs.groupBy(*same, "kind", "theirs").agg(F.count("*").alias("n"), F.max(F.expr("if(theirs <> ours, 1, 0)")).alias("changed"))
    slots = values.groupBy(*same).agg(F.max("n").alias("most"), F.sum("changed").alias("changed"))
    slots = slots.select(*(F.col(c).alias(f"s_{c}") for c in same), "most", "changed")
    on = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in same]
    fine = met.join(slots, on, "left").where("most is null or most = 1").select("doc_id", "item_id", "item_pos", F.coalesce("changed", F.lit(0)).alias("changed"))
    cover = fine.groupBy("doc_id", "item_id").agg(F.count_distinct("item_pos").alias("n_windows"), F.max("changed").alias("n_changed"), F.collect_set("item_pos").alias("at"))  # at most a number for each word of the item
    sizes = items.select(F.col("item_id").alias("s_item"), F.size("words").cast("long").alias("item_words")).distinct()
    out = cover.join(sizes, F.col("item_id").eqNullSafe(F.col("s_item")))
    out = out.withColumn("covered_words", F.expr(f"cast(size(array_distinct(flatten(transform(at, p -> sequence(p, least(p + {WINDOW - 1}, cast(item_words as int) - 1)))))) as long)"))
    return out.where(F.col("covered_words") >= COVERED * F.col("item_words")).select("doc_id", "item_id", "n_windows", "covered_words", "item_words", "n_changed")
