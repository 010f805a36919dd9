"""Benchmark decontamination by template canonicalisation, DataFrame functions only.

Texts become template words: numbers, units and names are replaced by typed
placeholders, so that a question with other numbers or names keeps its
template. Windows of five template words are hash-joined: of each item only its
rarest windows are looked up, so many that a document which has the asked
share of all windows must hold one of them. Candidates are aligned and
measured on all windows, and the slots under placeholders must correspond: a
value of the item stands for one value of the document throughout. Every place
where a document may hold an item is examined, and one that passes is enough.

A capital word that starts a sentence may be a name or not. Texts are compared
under two rules, of which one must pass: capital words are names behind a word
of their sentence only (NAME_WORD), or wherever they stand (ANY_NAME).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, row_key, stored

WINDOW_WORDS = 5
MIN_SIMILARITY = 0.8
#: Least share of an item's slot values that have one counterpart each.
MIN_CONSISTENT = 0.9

#: Fixed list of units, as they follow a number.
UNITS = (
    "kg|g|mg|lb|lbs|oz|ton|tons|tonnes|km|m|cm|mm|mile|miles|yard|yards|foot|feet|ft|inch|inches|"
    "l|ml|liter|liters|litre|litres|gallon|gallons|cup|cups|s|sec|second|seconds|min|minute|minutes|h|hr|hour|hours|"
    "day|days|week|weeks|month|months|year|years|dollar|dollars|cent|cents|euro|euros|pound|pounds|percent|"
    "mph|kph|degree|degrees|w|kw|v|hz|khz|mhz|gb|mb|kb"
)
#: Placeholders are digits, which no other template word holds.
NUMBER, UNIT, NAME = "0", "1", "2"
NAME_WORD = r"(?<=[\p{Ll}\p{Nd},;:] )\p{Lu}\p{Ll}+"
ANY_NAME = r"(?<![\p{L}\p{M}\p{Nd}])\p{Lu}\p{Ll}+"
UNIT_WORD = rf"(?i)(?<![\p{{L}}0-9])0 (?:{UNITS})(?![\p{{L}}0-9])"
BETWEEN = r"[^\p{L}\p{M}\p{Nd}]+"


def _aligned(text: Column) -> Column:
    """Digits as words of their own: no separators inside, none stuck to letters."""
    bare = F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", "")
    return F.when(text.rlike("[0-9]"), F.regexp_replace(bare, r"(?<=[0-9])(?=\p{L})|(?<=\p{L})(?=[0-9])", " ")).otherwise(text)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN, -1), lambda w: w != "")


def raw_words(text: Column) -> Column:
    """Lower-cased words, one for each template word."""
    return _words(_aligned(text))


def template_words(text: Column, names: str = NAME_WORD) -> Column:
    """Lower-cased words with numbers, units and names as placeholders."""
    numbered = F.regexp_replace(F.regexp_replace(_aligned(text), "[0-9]+", NUMBER), UNIT_WORD, f"{NUMBER} {UNIT}")
    return _words(F.regexp_replace(F.when(text.rlike("[0-9]"), numbered).otherwise(text), names, NAME))


def windows(hashes: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; none if there are fewer."""
    starts = F.sequence(F.lit(0), F.size(hashes) - size)
    runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    return F.when(F.size(hashes) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_templates(items: DataFrame, id_col: str, text_col: str, size: int, names: str = NAME_WORD) -> DataFrame:
    """item_id, template, raw, wins and n of items with a window at least.

    Items of fewer words than a window are measured by their whole length.
    """
    text = F.coalesce(items[text_col], F.lit(""))
    made = items.select(items[id_col].alias("item_id"), template_words(text, names).alias("template"), raw_words(text).alias("raw"))
    made = made.filter(F.size("template") > 0).withColumn("hashes", _hashed(F.col("template")))
    width = F.least(F.size("hashes"), F.lit(size))
    sized = [F.when(width == k, windows(F.col("hashes"), k)) for k in range(1, size + 1)]
    return made.select("item_id", "template", "raw", width.alias("width"), F.coalesce(*sized).alias("wins")).withColumn("n", F.size("wins"))


def rare_windows(items: DataFrame, similarity: float) -> DataFrame:
    """(win, width, item_id, at): of n windows of an item the rarest that a
    document with the asked share of them can't lack all of."""
    places = items.select("item_id", "n", "width", "template", F.posexplode("wins").alias("at", "win"))
    slots = F.size(F.filter(F.slice("template", F.col("at") + 1, F.col("width")), lambda w: w.isin(NUMBER, UNIT, NAME)))
    common = places.groupBy("win").agg(F.count("*").alias("uses"))
    places = places.withColumn("slots", slots).join(common, "win")
    order = Window.partitionBy("item_id").orderBy("slots", "uses", "win", "at")
    enough = F.floor((1 - similarity) * F.col("n") + 1e-9) + 1
    return places.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= enough).select("win", "width", "item_id", "at")


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = MIN_SIMILARITY, consistent: float = MIN_CONSISTENT, size: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item that it holds.

    Columns: doc_id, item_id, n_windows, n_matched, similarity (share of the
    item's windows that the document has), n_slots, n_changed (slot values, and
    those that differ in the document), kind (``copy`` or ``template``) and
    row_key (a hash of id and text by which a document is found again).
    Null or empty texts hold nothing and are held by nothing; null ids are kept;
    very long texts are read whole; repeated documents give equal rows once; an
    empty table on either side gives no rows; columns other than id and text are
    ignored, whatever their names. Items of fewer than five words must
    occur as a whole. Of several places that pass, the one with the fewest
    changed values is told, then the earliest.
    """
    ruled = [_leaks_by(names, docs, items, similarity, consistent, size, id_col, text_col) for names in (NAME_WORD, ANY_NAME)]
    told = [c for c in ruled[0].columns if c not in ("row_key", "item_id")]
    best = F.min(F.struct("n_changed", "rule", "shift", *[c for c in told if c not in ("n_changed", "rule", "shift")])).alias("best")
    found = ruled[0].unionByName(ruled[1]).groupBy("row_key", "item_id").agg(best).select("row_key", "item_id", "best.*")
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "similarity", "n_slots", "n_changed", F.when(F.col("n_changed") > 0, "template").otherwise("copy").alias("kind"), "row_key")


def _leaks_by(names: str, docs: DataFrame, items: DataFrame, similarity: float, consistent: float, size: int, id_col: str, text_col: str) -> DataFrame:
    """Every place that passes under one rule of names."""
    made = stored(item_templates(items, "item_id", "text", size, names), "items")
    anchors = checked_broadcast(stored(rare_windows(made, similarity), "anchors"))
    widths = sorted(r[0] for r in made.select("width").distinct().collect())  # at most ``size`` numbers
    rows = docs.select(row_key(docs, id_col, text_col).alias("row_key"), docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    hashed = rows.select("row_key", _hashed(template_words(F.col("text"), names)).alias("hashes"))

    # Windows of all widths in one pass over the texts.
    def placed(width: int) -> Column:
        return F.transform(windows(F.col("hashes"), width), lambda w, i: F.struct(w.alias("win"), i.alias("pos"), F.lit(width).alias("width")))

    spread = hashed.select("row_key", F.explode(F.concat(*map(placed, widths or [size]))).alias("w")).select("row_key", "w.win", "w.pos", "w.width")
    met = spread.join(anchors, ["win", "width"]).select("row_key", "item_id", (F.col("pos") - F.col("at")).alias("shift"))
    candidates = stored(met.groupBy("row_key", "item_id").agg(F.sort_array(F.collect_set("shift")).alias("shifts")), "candidates")

    suspects = candidates.select("row_key").distinct()
    texts = rows.join(checked_broadcast(suspects), "row_key", "left_semi").dropDuplicates(["row_key"])
    texts = texts.select("row_key", "doc_id", template_words(F.col("text"), names).alias("words"), raw_words(F.col("text")).alias("raw_doc"))
    texts = texts.withColumn("hashes", _hashed(F.col("words")))
    sized = {k: windows(F.col("hashes"), k) for k in widths}
    texts = stored(texts.select("row_key", "doc_id", "raw_doc", "words", *[w.alias(f"wins_{k}") for k, w in sized.items()]), "suspects")
    pairs = candidates.join(texts, "row_key").join(checked_broadcast(made), "item_id")
    own = F.coalesce(*[F.when(F.col("width") == k, F.col(f"wins_{k}")) for k in widths]) if widths else F.array().cast("array<bigint>")
    pairs = pairs.select("row_key", "doc_id", "item_id", "n", "width", "shifts", "wins", "template", "raw", "raw_doc", own.alias("own"))

    # How many windows the document has does not depend on the place.
    pairs = pairs.withColumn("n_matched", F.size(F.filter("wins", lambda w: F.array_contains("own", w))))
    pairs = pairs.filter(F.col("n_matched") >= F.lit(similarity) * F.col("n") - 1e-9).withColumn("shift", F.explode("shifts"))

    def place(win: Column, j: Column) -> Column:
        """Where a window stands in the document: along the alignment, else nearest to it; -1 if nowhere."""
        along = F.col("shift") + j
        spots = F.filter(F.transform("own", lambda w, i: F.when(w == win, F.struct(F.abs(i - along).alias("off"), i.alias("i")))), lambda x: x.isNotNull())
        return F.when((along >= 0) & F.coalesce(F.get("own", along) == win, F.lit(False)), along).otherwise(F.coalesce(F.array_min(spots)["i"], F.lit(-1)))

    found = pairs.withColumn("places", F.transform("wins", place))
    # Words of the item under matched windows, with the document's words opposite.
    opposite = F.flatten(
        F.transform(
            "places",
            lambda p, j: F.when(p >= 0, F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.struct((j + k).alias("at"), F.get("raw", j + k).alias("item"), F.get("raw_doc", p + k).alias("doc")))).otherwise(
                F.array().cast("array<struct<at:int,item:string,doc:string>>")
            ),
        )
    )
    found = found.withColumn("pairs", F.array_distinct(F.transform(F.filter(opposite, lambda s: F.get("template", s["at"]).isin(NUMBER, UNIT, NAME)), lambda s: F.struct(s["item"].alias("item"), s["doc"].alias("doc")))))
    found = found.withColumn("values", F.array_distinct(F.transform("pairs", lambda s: s["item"])))
    single = F.size(F.filter("values", lambda v: F.size(F.filter("pairs", lambda s: s["item"] == v)) == 1))
    found = found.withColumn("n_slots", F.size("values")).filter(single >= F.lit(consistent) * F.col("n_slots"))
    changed = F.size(F.filter("pairs", lambda s: s["item"] != s["doc"]))
    return found.select(
        "doc_id",
        "item_id",
        F.col("n").cast("long").alias("n_windows"),
        F.col("n_matched").cast("long").alias("n_matched"),
        (F.col("n_matched") / F.col("n")).alias("similarity"),
        F.col("n_slots").cast("long").alias("n_slots"),
        changed.cast("long").alias("n_changed"),
        "row_key",
        "shift",
        F.lit(0 if names == NAME_WORD else 1).alias("rule"),
    )
