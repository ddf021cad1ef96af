"""Operator 1, benchmark decontamination [native]: template windows of documents hash-joined with those of the benchmark's items.

Canonical text: numbers, names and units become typed placeholders, the rest is lower-cased and stripped of punctuation; the words stay
aligned with the words as written. Texts are also read in a second form in which names stay words, so that
copies in other case or wrapped anew are found; the form of the better similarity counts. A template window is WINDOW consecutive canonical words (all of them in a shorter item). A document
holds an item if at least SIMILARITY of the item's distinct windows occur in it and its slots are consistent in one alignment that holds
as many, or over all matched windows: each value of the item's slots is replaced by one value of the document (CONSISTENCY: distinct item
values per distinct replacement pair, at least). An alignment pairs each place of the item with one place of a region of a row. So verbatim copies and copies with other numbers, names or units are found alike.

Plan: DataFrame functions only. Documents are exploded to window hashes and joined with the benchmark's windows; those that hold an item
are read again for their slots. A side is broadcast only if it is counted to have at most BROADCAST_ROWS rows; else the join shuffles
both sides by window, where the adaptive plan splits a frequent window's rows over several tasks.

Nulls: null or empty texts hold nothing and items without a word are found nowhere. Rows with one doc_id are judged together, a null
doc_id like any other, and so are items with one item_id, null or not; items with the same text are each reported. Repeated rows count
once. Very long texts are cut into windows like any other. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 5
SIMILARITY = 0.8
CONSISTENCY = 0.5
BROADCAST_ROWS = 200_000

#: Units that follow a number, and signs that are no part of a word.
UNITS = (
    "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|in|l|ml|s|ms|h|hr|hrs|min|mins|kmh|mph|usd|eur|gbp|percent|"
    "kilograms?|grams?|pounds?|ounces?|kilometers?|kilometres?|meters?|metres?|centimeters?|miles?|feet|foot|inch|inches|yards?|"
    "liters?|litres?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|degrees?|dollars?|euros?|cents?"
)
PUNCTUATION = r"[!-/:-@\[-`{-~¡¿«»‐-›…]+"
NUMBER_SLOT, UNIT_SLOT, NAME_SLOT = "\u0001", "\u0002", "\u0003"


def canonical(text: Column) -> Column:
    """Placeholders for numbers and units after numbers, a mark before capitalised words inside a sentence; then lower case without punctuation.

    White space is kept sign by sign, so the words stay aligned with those of the text. Each pattern begins with the signs it replaces
    and looks back from there: a pattern that began by looking back would be tried at every position.
    """
    out = F.regexp_replace(text, r"[0-9](?<=(?<!\S)[^\s\p{L}0-9]{0,4}[0-9])\S*", NUMBER_SLOT)
    out = F.regexp_replace(out, rf"(?i)\x01(\s+)(?:{UNITS})(?![\p{{L}}0-9])", f"{NUMBER_SLOT}$1{UNIT_SLOT}")
    out = F.regexp_replace(out, r"\p{Lu}(?<=[^\s.!?:;][ \t]\p{Lu})\p{Ll}[\p{L}'’-]*", f"{NAME_SLOT}$0")
    return F.regexp_replace(F.lower(out), PUNCTUATION, "")


def bound(value: Column, of) -> Column:
    """``of(value)`` with ``value`` computed once, however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def words(text: Column) -> Column:
    """Canonical words of a text; words that were punctuation only are left out, null and blank texts have none."""
    return F.filter(F.split(canonical(F.coalesce(text, F.lit(""))), r"\s"), lambda w: w != "")


def aligned(text: Column) -> Column:
    """Structs (raw, form) of the words that have a canonical form."""
    text = F.coalesce(text, F.lit(""))
    pairs = F.arrays_zip(F.split(text, r"\s").alias("raw"), F.split(canonical(text), r"\s").alias("form"))
    return F.filter(pairs, lambda p: p["form"] != "")


def form(word: Column, named: bool) -> Column:
    """A canonical word in one of the two forms: a marked name is its placeholder, or the word without its mark."""
    return F.when(word.startswith(NAME_SLOT), F.lit(NAME_SLOT) if named else F.substring(word, 2, 1 << 30)).otherwise(word)


def window_hashes(hashes: Column) -> Column:
    """Hashes of the template windows in order, of the hashes of the words; one for a text shorter than a window, none for one without words."""

    def of(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(h) - WINDOW, F.lit(0)))
        found = F.transform(places, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW))))
        return F.when(F.size(h) > 0, found).otherwise(F.array().cast("array<bigint>"))

    return bound(hashes, of)


def text_hashes(text: Column) -> Column:
    """The distinct window hashes of a text in both forms, which differ only where there are names."""
    of = lambda ws, named: window_hashes(F.transform(ws, lambda w: F.xxhash64(form(w, named))))
    both = lambda ws: F.when(F.exists(ws, lambda w: w.startswith(NAME_SLOT)), F.array_union(of(ws, True), of(ws, False))).otherwise(F.array_distinct(of(ws, True)))
    return bound(words(text), both)


def slots(ws: Column, start: Column) -> Column:
    """The words as written at the placeholders of the window at ``start``, in order, marked by type."""
    window = F.filter(F.slice(ws, start + 1, WINDOW), lambda w: w["form"] <= NAME_SLOT)
    return F.transform(window, lambda w: F.concat(w["form"], F.regexp_replace(F.lower(w["raw"]), r"[^\p{L}\p{N}.,]+|[.,]+$", "")))


def slotted(table: DataFrame, key: str) -> DataFrame:
    """``key``, ``row`` (a hash of the text), and for both values of ``named`` ``h``, the place and the slots of every window."""

    def of(ws: Column) -> Column:
        hashes = window_hashes(F.transform(ws, lambda w: F.xxhash64(w["form"])))
        return F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"), slots(ws, i).alias("slots")))

    def written_out(named: bool) -> Column:
        return F.struct(F.lit(named).alias("named"), F.transform("words", lambda w: F.struct(w["raw"].alias("raw"), form(w["form"], named).alias("form"))).alias("words"))

    split = table.select(key, F.xxhash64("text").alias("row"), aligned(F.col("text")).alias("words"))
    split = split.select(key, "row", F.explode(F.array(written_out(True), written_out(False))).alias("form"))
    # a text is not repeated beside each of its windows: only what a window needs leaves the array
    return split.select(key, "row", "form.named", F.explode(bound(F.col("form.words"), of)).alias("w")).select(key, "row", "named", "w.*")


def small(table: DataFrame) -> DataFrame:
    """``table`` with a broadcast hint if it is counted to be small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def alignments(placed: DataFrame) -> DataFrame:
    """Windows of documents and items, one place of the document for each place of the item, by ``alignment``.

    An alignment is a region of a row's diagonals (place in the document less place in the item), half as wide as the item has windows, so
    that words put in or left out do not end it; regions overlap by half. A place of the item is paired on the diagonal of most windows.
    The last alignment takes all places of the document together, each window as at its first place in the item.
    """
    diagonal = F.col("at") - F.col("item_at")
    wide = F.greatest(F.col("windows") / 2, F.lit(4))
    same = Window.partitionBy("doc_id", "row", "item_id", "named", "item_row", "diagonal")
    counted = placed.withColumn("diagonal", diagonal).withColumn("on", F.count(F.lit(1)).over(same))
    regions = F.array(*(F.struct(F.lit(i).alias("shift"), F.floor(F.col("diagonal") / wide + F.lit(i / 2)).alias("region"), F.col("row"), F.col("item_row")) for i in (0, 1)))
    local = counted.withColumn("alignment", F.explode(regions)).groupBy("doc_id", "item_id", "named", "windows", "alignment", "item_at").agg(
        F.max_by(F.struct("h", "item_slots", "slots"), F.struct("on", -F.col("diagonal"))).alias("p")
    )
    whole = placed.where("first").select("doc_id", "item_id", "named", "windows", F.lit(None).cast(local.schema["alignment"].dataType).alias("alignment"), "h", "item_slots", "slots")
    return local.select("doc_id", "item_id", "named", "windows", "alignment", "p.*").unionByName(whole)


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, windows (of the item), matched, similarity, slots, consistency, changed (slots with another value) of the held items."""
    # in a struct, a null item_id equals itself in joins
    item = slotted(items.select(F.struct("item_id").alias("item_id"), "text"), "item_id").distinct()
    first = F.struct("row", "at") == F.min(F.struct("row", "at")).over(Window.partitionBy("h", "item_id", "named"))
    known = item.select("h", "item_id", "named", F.col("row").alias("item_row"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), first.alias("first"))
    known = common.written(known, "benchmark-windows")
    sizes = known.groupBy("item_id", "named").agg(F.count_distinct("h").alias("windows"))

    found = docs.select("doc_id", F.explode(text_hashes(F.col("text"))).alias("h"))
    hits = found.join(small(known.where("first").select("h", "item_id", "named")), "h").groupBy("doc_id", "item_id", "named", "h").agg(F.count(F.lit(1)).alias("n"))
    matched = hits.groupBy("doc_id", "item_id", "named").agg(F.count(F.lit(1)).alias("matched"))
    similar = matched.join(small(sizes), ["item_id", "named"]).withColumn("similarity", F.col("matched") / F.col("windows"))
    held = common.written(similar.where(F.col("similarity") >= SIMILARITY), "benchmark-held")

    # the words of the documents that hold an item are looked at again, for their slots
    owners = held.select(F.col("doc_id").alias("owner"), F.col("item_id").alias("held_item"), F.col("named").alias("held_named"), "windows")
    again = docs.select("doc_id", "text").join(small(owners.select("owner").distinct()), F.col("doc_id").eqNullSafe(F.col("owner")), "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("owner")) & F.col("item_id").eqNullSafe(F.col("held_item")) & (F.col("named") == F.col("held_named"))
    placed = slotted(again, "doc_id").join(small(known), ["h", "named"]).join(small(owners), same).distinct()
    aligned_windows = alignments(common.written(placed, "benchmark-placed"))
    covers = F.col("alignment").isNull() | (F.count_distinct("h") >= SIMILARITY * F.col("windows"))
    pair = F.explode_outer(F.arrays_zip("item_slots", F.col("slots").alias("doc_slots")))
    keys = ["doc_id", "item_id", "named", "windows", "alignment"]
    each = aligned_windows.select(*keys, "h", pair.alias("p")).select(*keys, "h", "p.*")
    pairs = F.count_distinct(F.when(F.col("item_slots").isNotNull(), F.struct("item_slots", "doc_slots")))
    judged = each.groupBy(*keys).agg(
        covers.alias("covers"),
        F.count_distinct("item_slots").alias("slots"),
        F.coalesce(F.try_divide(F.count_distinct("item_slots"), pairs), F.lit(1.0)).alias("consistency"),
        F.count_distinct(F.when(F.col("item_slots") != F.col("doc_slots"), F.col("item_slots"))).alias("changed"),
    )
    best = F.max(F.struct("consistency", (-F.col("changed")).alias("same"), "slots", "changed")).alias("best")
    checked = judged.where("covers").groupBy("doc_id", "item_id", "named").agg(best).select("doc_id", "item_id", "named", "best.*")
    same = held["doc_id"].eqNullSafe(checked["doc_id"]) & held["item_id"].eqNullSafe(checked["item_id"]) & (held["named"] == checked["named"])
    both = held.join(checked, same, "left").select(
        held["doc_id"], held["item_id"], held["named"], "windows", "matched", "similarity",
        F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("consistency", F.lit(1.0)).alias("consistency"), F.coalesce("changed", F.lit(0)).alias("changed"),
    ).where(F.col("consistency") >= CONSISTENCY)
    # of the two forms, the one of the better similarity
    better = F.max_by(F.struct("windows", "matched", "similarity", "slots", "consistency", "changed"), F.struct("similarity", "named")).alias("better")
    return both.groupBy("doc_id", "item_id").agg(better).select("doc_id", "item_id.item_id", "better.*")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    held = small(common.written(matches(docs, items).select(F.col("doc_id").alias("holder")).distinct(), "benchmark-holders"))
    return docs.join(held, docs["doc_id"].eqNullSafe(held["holder"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item it holds."""
    docs = common.table(spark, sf_dir, "documents")
    return matches(docs.withColumn("doc_id", F.col("doc_id").cast("long")), common.table(spark, sf_dir, "benchmark"))
