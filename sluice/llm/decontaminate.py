"""Benchmark decontamination by template windows, in DataFrame operations only.

Numbers, names and units become typed placeholders, so a question asked again with other
values still has the same template. Windows of the templates are hash-joined; along each
alignment of a document with an item, windows whose slots break the map of values do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.series import small_side

WINDOW = 8
STRIDE = 4
COVER = 0.5
ENOUGH_WORDS = 40
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"

# Words that count as a unit right after a number.
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "metres", "meters",
    "mg", "g", "kg", "ounces", "pounds", "lbs", "tons", "grams", "kilograms",
    "ml", "l", "litres", "liters", "gallons", "cups",
    "seconds", "minutes", "hours", "days", "weeks", "months", "years", "second", "minute", "hour", "day", "week", "month", "year",
    "dollars", "cents", "euros", "percent", "degrees", "mph", "kmh", "hz", "khz", "mb", "gb", "tb", "kb",
]


def marked(text: Column) -> Column:
    """Lower-case words without punctuation; a name (a capitalised word within a sentence), a
    number, or a unit after a number carries a mark before its value.

    Each pattern begins with a test of one or two letters that it implies, so most places cost no look back.
    """
    names = F.regexp_replace(text, r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)", NAME + "$1")
    numbers = F.regexp_replace(names, r"(?=[0-9])(?<![\p{L}\p{N}])([0-9]+(?:[.,:/][0-9]+)*)", NUMBER + "$1")
    units = F.regexp_replace(
        numbers, rf"(?<=[0-9.,:/] )(?<={NUMBER}[0-9.,:/]{{1,24}} )({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", UNIT + "$1")
    bare = F.regexp_replace(F.lower(units), r"[^\p{L}\p{N}\x01-\x03 \t-\r]+", "")
    return F.trim(F.regexp_replace(bare, r"[ \t-\r]{2,}|[\t-\r]", " "))


def template(words: Column) -> Column:
    return F.regexp_replace(words, "([\x01-\x03])[^ ]+", "$1")


def _slots(at: Column, width: int) -> Column:
    """``at`` and how many of the words from there on are slots; no other word comes before them in order."""
    cut = F.filter(F.slice("_template", at + 1, F.lit(width)), lambda x: x <= UNIT)
    return F.struct(at.alias("at"), F.when(F.col("_slots"), F.size(cut)).otherwise(0).alias("full"))


def _window(start: Column, width: int) -> Column:
    """Hash of the template words from a start on (of the real words, where most are slots) and,
    where there are slots, the real words."""
    at, full = start["at"], start["full"]
    real = F.slice("_words", at + 1, F.lit(width))
    h = F.when(2 * full > width, F.xxhash64(F.lit(width), real)).otherwise(
        F.xxhash64(F.lit(width), F.slice("_template", at + 1, F.lit(width))))
    return F.struct(h.alias("h"), at.alias("at"), F.when(full > 0, real).alias("slots"))


def _windows(rows: DataFrame, width: int, stride: int, keep: list[str]) -> DataFrame:
    starts = F.when(F.col("_n") >= width, F.sequence(F.lit(0), F.col("_n") - width, F.lit(stride)))
    return rows.select(*keep, F.explode(F.transform(F.transform(starts, lambda at: _slots(at, width)), lambda x: _window(x, width))).alias("w")).select(
        *keep, F.lit(width).alias("width"), "w.h", "w.at", "w.slots")


def _canonical(df: DataFrame, key: Column, text: str) -> DataFrame:
    base = df.select(key.alias("_key"), marked(F.col(text)).alias("_marked"))
    out = base.select("_key", F.split("_marked", " ").alias("_words"), F.split(template(F.col("_marked")), " ").alias("_template"),
                      F.col("_marked").rlike("[\x01-\x03]").alias("_slots"), (F.col("_marked") == "").alias("_empty"))
    return out.withColumn("_n", F.when(F.col("_empty"), 0).otherwise(F.size("_template")))


def _agreeing(runs: DataFrame) -> DataFrame:
    """``windows`` and ``slots`` (item values) of the windows in ``all`` whose slots agree with the
    alignment's map: for every item value its most frequent document value (ties: the least)."""
    plain = lambda p: F.struct(p["item"].alias("item"), p["doc"].alias("doc"))

    def value(v):
        seen = F.transform(F.filter("_pairs", lambda p: p["item"] == v), lambda p: p["doc"])
        ranked = F.transform(F.array_distinct(seen), lambda d: F.struct((-F.size(F.filter(seen, lambda x: x == d))).alias("n"), d.alias("doc")))
        return F.struct(v.alias("item"), F.array_min(ranked)["doc"].alias("doc"))

    out = runs.withColumn("_pairs", F.array_distinct(F.flatten(F.transform("all", lambda w: w["pairs"]))))
    out = out.withColumn("_kinds", F.array_distinct(F.transform("_pairs", plain))).withColumn(
        "_values", F.array_distinct(F.transform("_pairs", lambda p: p["item"])))
    single = F.size("_kinds") == F.size("_values")
    out = out.withColumn("_map", F.when(single, F.col("_kinds")).otherwise(F.transform("_values", value)))
    held = F.filter("all", lambda w: F.forall(w["pairs"], lambda p: F.array_contains("_map", plain(p))))
    out = out.withColumn("_held", F.when(single, F.col("all")).otherwise(held))
    items = F.flatten(F.transform("_held", lambda w: F.transform(w["pairs"], lambda p: p["item"])))
    return out.withColumn("windows", F.size(F.array_distinct(F.transform("_held", lambda w: w["at"])))).withColumn(
        "slots", F.size(F.array_distinct(items))).drop("all", "_pairs", "_kinds", "_values", "_map", "_held")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, stride: int = STRIDE,
                 cover: float = COVER, enough: int = ENOUGH_WORDS) -> DataFrame:
    """``doc_id, contaminated, item_id, covered_words, windows, slots`` for every row of ``docs``.

    Documents give a template window at every ``stride``-th word, items one at every word; so a
    common passage of ``window + stride - 1`` words cannot pass unseen. Items shorter than that
    are met by one window of their own length (at most ``window``) at every word. Windows with
    fewer than half their words outside slots are met by their literal words, marks and values
    alike, so dense items are found as copies. A window counts for every item it
    stands in, however many they are; only documents that hold it are set against those items.
    The windows of one document and item with the same distance form an alignment. In it every
    item value has one document value (the most frequent; several item values may share one);
    a window with a slot of another value is not covered, the others of the alignment are. An item is leaked when the words covered reach ``cover`` of it, or ``enough`` words;
    ``item_id`` is the leaked item with the most words covered (ties: the least id), null for
    clean documents.

    Null and empty texts are clean; null ids are clean; rows of one id share the decision of all
    of them; repeated items count once; other columns are ignored. Without documents or items
    there is nothing to find.
    """
    items = _canonical(benchmark.filter("item_id is not null and text is not null"), F.col("item_id").cast("bigint"), "text")
    items = items.filter("_n > 0").groupBy("_words", "_template", "_slots", "_n").agg(F.min("_key").alias("item_id"))
    long_item = F.col("_n") >= window + stride - 1
    spans = [("long", window, long_item)]
    spans += [("short", r["w"], ~long_item & (F.least(F.col("_n"), F.lit(window)) == r["w"])) for r in items.filter(~long_item).select(
        F.least("_n", F.lit(window)).alias("w")).distinct().collect()]
    rows = _canonical(docs.filter("doc_id is not null and text is not null"), F.col("doc_id").cast("bigint"), "text")
    found = None
    for kind, width, which in spans:
        own = _windows(items.filter(which), width, 1, ["item_id", "_n"]).withColumnRenamed("_n", "words")
        own = own.withColumnsRenamed({"at": "item_at", "slots": "item_slots"}).drop("width")
        own = small_side(own)
        met = _windows(rows, width, stride if kind == "long" else 1, ["_key"]).join(own, "h").select(
            F.col("_key").alias("doc_id"), "item_id", "words", "width", (F.col("at") - F.col("item_at")).alias("shift"),
            "at", "slots", "item_slots", F.lit(stride if kind == "long" else width).alias("step"))
        found = met if found is None else found.unionByName(met)
    pairs = F.filter(
        F.transform("item_slots", lambda x, i: F.struct((F.col("at") + i).alias("place"), x.alias("item"), F.get("slots", i).alias("doc"))),
        lambda p: F.substring(p["item"], 1, 1).isin(NAME, NUMBER, UNIT))
    runs = found.withColumn("pairs", F.coalesce(pairs, F.expr("array()"))).groupBy("doc_id", "item_id", "words", "width", "step", "shift").agg(
        F.collect_set(F.struct("at", "pairs")).alias("all"))
    runs = _agreeing(runs).filter("windows > 0")
    sums = runs.groupBy("doc_id", "item_id", "words").agg(
        F.sum("windows").alias("windows"), F.max("slots").alias("slots"),
        F.sum(F.col("windows") * F.col("step") + F.col("width") - F.col("step")).alias("covered"))
    sums = sums.withColumn("covered_words", F.least("covered", F.col("words").cast("bigint")))
    leaks = sums.filter((F.col("covered_words") >= F.lit(cover) * F.col("words")) | (F.col("covered_words") >= enough))
    best = leaks.groupBy("doc_id").agg(F.max(F.struct(
        F.col("covered_words"), (-F.col("item_id")).alias("minus"), "windows", "slots")).alias("b"))
    best = best.select("doc_id", (-F.col("b.minus")).alias("item_id"), "b.covered_words", "b.windows", "b.slots")
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return ids.join(best, "doc_id", "left").select(
        "doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("covered_words", "windows", "slots")])
