"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, names and units become typed placeholders, windows of the resulting template are hash-joined with those of
the benchmark, and what filled the placeholders on both sides must map consistently: a passage copied word for word
and a question asked again with other numbers and names are both caught.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.components import shared_folder

WINDOW = 5
COVERAGE = 0.8
#: Benchmark windows, and ids of documents, up to which they are broadcast; beyond, the joins shuffle.
BROADCAST_ROWS = 200_000
#: About as many shifts of a document stand in one row beside its text.
SHIFTS = 256
NUMBER, NAME, UNIT = "", "", ""
# Units that may follow a number.
UNITS = "km|m|cm|mm|mi|miles|mile|feet|ft|inches|inch|kg|g|mg|lb|lbs|pounds|tons|litres|liters|ml|hours|hour|minutes|minute|seconds|second|days|day|weeks|months|years|percent|dollars|euros|cents|mph|kmh|degrees"
TOKEN = r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+"
TEMPLATE_TOKEN = rf"[\p{{L}}\p{{M}}]+|[{NUMBER}{NAME}{UNIT}]"


def _plain(text: Column) -> Column:
    return F.translate(text, NUMBER + NAME + UNIT, "   ")


def raw_tokens(text: Column) -> Column:
    """Words and numbers of the text as written."""
    return F.regexp_extract_all(_plain(text), F.lit(TOKEN), F.lit(0))


def template(text: Column) -> Column:
    """As many tokens as :func:`raw_tokens`: lower-case words, and a placeholder for each number, each capitalised word
    that does not begin a sentence, and each unit after a number."""
    marked = F.regexp_replace(_plain(text), r"\p{Lu}(?<=[\p{L}\p{N},] .)\p{Ll}[\p{L}\p{M}]*", NAME)
    marked = F.regexp_replace(marked, r"\p{N}+(?:[.,]\p{N}+)*", NUMBER)
    marked = F.regexp_replace(marked, rf"{NUMBER}(\s?)(?:{UNITS})(?![\p{{L}}\p{{M}}])", f"{NUMBER}$1{UNIT}")
    return F.regexp_extract_all(F.lower(marked), F.lit(TEMPLATE_TOKEN), F.lit(0))


def _as_written(raw: Column | str) -> Column:
    """Raw tokens in lower case, marked so that none is equal to one of a template."""
    return F.transform(raw, lambda t: F.concat(F.lit("="), F.lower(t)))


def _windows(tokens: Column, window: Column | int) -> Column:
    """The hash of each run of ``window`` tokens; none if there are fewer."""
    starts = F.when(F.size(tokens) >= window, F.sequence(F.lit(1), F.size(tokens) - window + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, window)))


def _small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a hint to broadcast it if its rows, which are narrow, are counted to be few enough."""
    return F.broadcast(df) if df.count() <= most else df


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``(id, item, coverage, kind)`` for every document and benchmark item it repeats.

    ``coverage`` is the part of the item's tokens inside template windows that the document has too; windows with a
    placeholder whose filling in the item stands for several in the same copy of it do not count. What stands at
    shifts that follow each other within half the item's length is one copy, with words put in or left out. A pair is
    reported at ``coverage`` or more. ``kind`` is ``verbatim`` if all of its placeholders were filled alike, else
    ``template``. Windows without any word count where a window with words fits at the same shift; items without
    words are searched as written. An item shorter than ``window`` is one window; with fewer than two words it is
    searched as written, and an item of one token counts only for documents that are that token.

    Null and empty texts are never reported, nor are items without tokens; a null id is an id like any other; rows that repeat an id are judged by themselves and their pairs reported once; empty tables give no
    rows; other columns do not matter.
    """
    result = judged(df, benchmark, id_col, text_col, item_col, item_text_col, window, coverage)
    best = result.groupBy("id", "item").agg(F.max("coverage").alias("coverage"), F.bool_or("alike").alias("alike"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "coverage", F.when(F.col("alike"), "verbatim").otherwise("template").alias("kind"))


def judged(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``(id, h, key, item, coverage, alike)`` as :func:`contaminated`, but for each text of an id: ``h`` is its ``xxhash64``."""
    spark = df.sparkSession
    shared_folder(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").withColumn("h", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    items = items.select("item", raw_tokens(F.col("text")).alias("raw"), template(F.col("text")).alias("tokens")).withColumn("key", F.xxhash64("item", "raw"))
    slot = lambda t: t.isin(NUMBER, NAME, UNIT)
    words = F.size(F.filter("tokens", lambda t: ~slot(t)))
    as_written = (words == 0) | ((F.size("tokens") < window) & (words < 2))
    items = items.where(F.size("tokens") > 0).withColumn("w", F.least(F.size("tokens"), F.lit(window)))
    starts = F.sequence(F.lit(0), F.size("tokens") - F.col("w"))
    bare = F.filter(starts, lambda a: F.forall(F.slice("tokens", a + 1, F.col("w")), slot))
    # Where a copy stands behind a word, its first word looks like a name: what hangs on the first window is also searched as written.
    frail = F.size(F.array_remove(F.array_except(starts, bare), 0)) == 0
    modes = F.when(as_written, F.array(F.lit(True))).when(frail, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    items = items.withColumn("bare", bare).withColumn("exact", F.explode(modes)).withColumn("key", F.xxhash64("key", "exact"))
    items = items.withColumn("bare", F.when(F.col("exact"), F.array().cast("array<int>")).otherwise(F.col("bare"))).checkpoint()
    parts = items.select("key", "bare", F.posexplode(F.when(F.col("exact"), _windows(_as_written("raw"), F.col("w"))).otherwise(_windows(F.col("tokens"), F.col("w")))).alias("at", "window"))
    wanted = parts.where(~F.array_contains("bare", F.col("at"))).select("window", "key", "at").checkpoint()

    # Most benchmarks have one kind of window; short items and those without words add kinds, at most twice ``window``.
    found = None
    for kind in items.select("w", "exact").distinct().collect():
        tokens = _as_written(raw_tokens(F.col("text"))) if kind["exact"] else template(F.col("text"))
        each = docs.select("id", "h", tokens.alias("tokens"))
        each = each.where("size(tokens) = 1") if kind["w"] == 1 else each
        each = each.select("id", "h", F.posexplode(_windows(F.col("tokens"), kind["w"])).alias("pos", "window"))
        found = each if found is None else found.unionByName(each)
    if found is None:
        found = docs.where("false").select("id", "h", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("window"))
    hits = found.join(_small(wanted, BROADCAST_ROWS), "window").select("id", "h", "key", "at", "pos").distinct().checkpoint()
    shape = items.select("key", "w", "bare", F.size("tokens").alias("length"))
    spread = lambda ats: F.array_distinct(F.flatten(F.transform(ats, lambda a: F.sequence(a, a + F.col("w") - 1))))
    near = hits.groupBy("id", "h", "key").agg(F.collect_set("at").alias("ats")).join(_small(shape, BROADCAST_ROWS), "key")
    near = near.where(F.size(spread(F.concat("ats", "bare"))) >= coverage * F.col("length"))
    near = hits.join(near.select(F.col("id").alias("i"), F.col("h").alias("hh"), F.col("key").alias("kk")), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("hh")) & (F.col("key") == F.col("kk")), "left_semi")
    at_shift = near.groupBy("id", "h", "key", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("ats")).checkpoint()

    chosen = _small(at_shift.select(F.col("id").alias("i"), F.col("h").alias("hh")).distinct(), BROADCAST_ROWS)
    texts = docs.join(chosen, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("hh")), "left_semi").dropDuplicates(["id", "h"])
    texts = texts.select(F.col("id").alias("i"), F.col("h").alias("hh"), raw_tokens(F.col("text")).alias("doc_raw"), template(F.col("text")).alias("doc_tokens"))
    # A document meets many shifts at once and gives each the item's length of tokens, so its text is there once for SHIFTS of them.
    lengths = at_shift.join(_small(shape.select("key", "length"), BROADCAST_ROWS), "key")
    many = at_shift.groupBy("id", "h").agg(F.ceil(F.count("*") / SHIFTS).alias("parts")).where("parts > 1").toDF("i", "hh", "parts")
    lengths = lengths.join(_small(many, BROADCAST_ROWS), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("hh")), "left").drop("i", "hh")
    lengths = lengths.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("key", "shift"), F.col("parts"))))
    shifts = lengths.groupBy("id", "h", "part").agg(F.collect_list(F.struct("key", "shift", "ats", "length")).alias("shifts"))
    cut = lambda side, s: F.slice(side, F.greatest(s["shift"], F.lit(0)) + 1, s["length"])
    each = F.transform("shifts", lambda s: F.struct(s["key"].alias("key"), s["shift"].alias("shift"), s["ats"].alias("ats"), cut("doc_raw", s).alias("doc_raw"), cut("doc_tokens", s).alias("doc_tokens")))
    pairs = shifts.join(texts, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("hh"))).select("id", "h", F.inline(each)).join(_small(items, BROADCAST_ROWS), "key")
    pairs = pairs.withColumn("off", F.least("shift", F.lit(0)))  # where the item begins before the document
    # Not by hash alone; a shift may be such that a window without words would begin before the document.
    there = lambda side, a: F.slice(side, F.greatest(a + 1 + F.col("off"), F.lit(1)), "w")
    written = lambda a: F.transform(F.slice("raw", a + 1, "w"), F.lower) == F.transform(there("doc_raw", a), F.lower)
    fits = lambda a: (a + F.col("off") >= 0) & F.when(F.col("exact"), written(a)).otherwise(F.slice("tokens", a + 1, "w") == there("doc_tokens", a))
    pairs = pairs.withColumn("ats", F.filter(F.array_distinct(F.concat("ats", "bare")), fits)).where("size(ats) > 0")
    filled = lambda: F.filter(spread("ats"), lambda p: slot(F.get("tokens", p)))
    pair = lambda p: F.struct(F.lower(F.get("raw", p)).alias("a"), F.lower(F.get("doc_raw", p + F.col("off"))).alias("b"))
    pairs = pairs.withColumn("slots", F.array_distinct(F.transform(filled(), pair)))
    # Shifts near each other are one copy with words put in or left out; what fills its slots must agree over all of it.
    along = Window.partitionBy("id", "h", "key").orderBy("shift")
    apart = F.when(F.col("shift") - F.lag("shift").over(along) <= F.size("tokens") / 2, 0).otherwise(1)
    pairs = pairs.withColumn("apart", apart).withColumn("copy", F.sum("apart").over(along)).drop("apart").checkpoint()
    torn = pairs.select("id", "h", "key", "copy", F.inline("slots")).groupBy("id", "h", "key", "copy", "a").agg((F.min("b") != F.max("b")).alias("torn")).where("torn")
    torn = torn.groupBy("id", "h", "key", "copy").agg(F.collect_list("a").alias("torn")).toDF("i", "hh", "kk", "cc", "torn")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("hh")) & (F.col("key") == F.col("kk")) & (F.col("copy") == F.col("cc"))
    pairs = pairs.join(torn, same, "left").drop("i", "hh", "kk", "cc").withColumn("torn", F.coalesce("torn", F.array().cast("array<string>")))
    whole = lambda a: ~F.exists(F.sequence(a, a + F.col("w") - 1), lambda p: slot(F.get("tokens", p)) & F.array_contains("torn", F.lower(F.get("raw", p))))
    pairs = pairs.withColumn("ats", F.when(F.size("torn") == 0, F.col("ats")).otherwise(F.filter("ats", whole))).where("size(ats) > 0")
    pairs = pairs.withColumn("places", spread("ats"))
    pairs = pairs.withColumn("alike", F.forall(filled(), lambda p: pair(p)["a"] == pair(p)["b"]))
    reach = F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / F.first(F.size("tokens"))
    return pairs.groupBy("id", "h", "key", "item").agg(reach.alias("coverage"), F.bool_and("alike").alias("alike")).where(F.col("coverage") >= coverage)
