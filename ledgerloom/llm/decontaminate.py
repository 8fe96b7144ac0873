"""Benchmark decontamination by template windows and slot consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import BREAK, counted, staged

#: Words of a template window, and words of a common stretch that count as a leak.
WINDOW, STRETCH = 8, 13
#: Words of a window that must be literal, i.e. no placeholder.
LITERAL = 4

# Words that count as units after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb ml l s ms min h hr hrs hour hours minute minutes second "
    "seconds day days week weeks month months year years percent usd eur gbp dollars euros cents "
    "meters metres kilometers kilometres grams kilograms liters litres degrees mph kph"
).split()

_NUMBER, _NAME, _UNIT = "<num>", "<name>", "<unit>"


def template(text: Column) -> Column:
    """The text with typed placeholders, lower case, punctuation around words removed.

    Blanks stay where they are and no word becomes empty, so word k of the template is word k
    of the text. A capitalised word is a name unless a sentence starts with it, that is if a letter, digit
    or comma stands before the blank ahead of it.
    """
    t = F.regexp_replace(text, r"(?<=[\p{L}\p{N},;][\x20\x09-\x0D])\p{Lu}\p{Ll}+(?!\p{L})", _NAME)
    t = F.lower(F.regexp_replace(t, r"[0-9]+(?:[.,:/][0-9]+)*", _NUMBER))
    t = F.regexp_replace(t, rf"(?<=<num>[\x20\x09-\x0D]?)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", _UNIT)
    return _bared(t)


def _bared(text: Column) -> Column:
    """The text without punctuation around its words."""
    return F.regexp_replace(
        text,
        r"(?<=[\p{L}\p{N}>])[^\p{L}\p{N}<>\x20\x09-\x0D]+(?=[\x20\x09-\x0D]|$)"
        r"|(?<![^\x20\x09-\x0D])[^\p{L}\p{N}<>\x20\x09-\x0D]+(?=[\p{L}\p{N}<])",
        "",
    )


def words_of(text: Column) -> Column:
    return F.split(_trimmed(text), BREAK)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _split(texts: DataFrame, key: str) -> DataFrame:
    """``key, words, raw``: the words of each text as templates, and as they stand."""
    return texts.select(
        key, F.split(template(_trimmed(F.col("text"))), BREAK).alias("words"), words_of(F.col("text")).alias("raw")
    )


def _plain() -> Column:
    """The words plainly folded, without placeholders."""
    return F.zip_with("words", "raw", lambda w, r: F.when(w.contains("<"), _bared(F.lower(r))).otherwise(w))


def _forms(texts: DataFrame, key: str) -> DataFrame:
    """``key, words, plain``: the words of each text as templates, and plainly folded without placeholders."""
    return _split(texts, key).select(key, "words", _plain().alias("plain"))


def _windows(docs: DataFrame) -> DataFrame:
    """``doc, at, window``: every template window of every text, and the plain one where it differs."""
    # Both forms of a text without placeholders are the same, so it has one list of windows.
    slots = F.exists("words", lambda w: w.contains("<"))
    hashed = _split(docs, "doc").select(
        "doc", F.transform("words", lambda w: F.xxhash64(w)).alias("words0"),
        F.when(slots, F.transform(_plain(), lambda w: F.xxhash64(w))).alias("plain0"),
    )
    size, last = 1, 0
    while size < WINDOW:  # a column per step keeps the lambdas small
        pairs = []
        for c in ("words", "plain"):
            n = F.greatest(F.size(f"{c}{last}") - size, F.lit(0))
            shifted = F.slice(f"{c}{last}", size + 1, n)
            pair = F.zip_with(F.slice(f"{c}{last}", 1, n), shifted, lambda a, b: F.xxhash64(a, b))
            pairs.append(pair.alias(f"{c}{size}"))
        hashed = hashed.select("doc", *pairs)
        last, size = size, size * 2
    differing = F.zip_with(f"words{last}", f"plain{last}", lambda w, p: F.when(w != p, p))
    none = F.array().cast("array<long>")
    # The size is made before: after it, each exploded row would carry the whole list.
    listed = hashed.select(
        "doc", F.size(f"words{last}").alias("n"), F.concat(f"words{last}", F.coalesce(differing, none)).alias("all")
    )
    # The outer form: for the inner one Spark infers a filter that evaluates all of this again.
    exploded = listed.select("doc", "n", F.posexplode_outer("all").alias("at", "window"))
    return exploded.where(F.col("window").isNotNull()).select("doc", (F.col("at") % F.col("n")).alias("at"), "window")


def _short_windows(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """``doc, at, window``: the plain windows of the given lengths, all under ``WINDOW``."""
    def windows(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size("plain") - 1), lambda k: k <= F.size("plain") - n)
        return F.transform(starts, lambda k: F.struct(k.alias("at"), _short_hash(F.slice("plain", k + 1, n)).alias("window")))

    found = F.flatten(F.array(*[windows(n) for n in lengths]))
    exploded = _forms(docs, "doc").select("doc", F.explode_outer(found).alias("w"))
    return exploded.where("w IS NOT NULL").select("doc", "w.*")


def _short_hash(words: Column) -> Column:
    return F.xxhash64(F.size(words), F.array_join(words, " "))


def _hash(words: list[Column]) -> Column:
    """The hash of one window, as ``_windows`` makes it."""
    if len(words) == 1:
        return F.xxhash64(words[0])
    half = len(words) // 2
    return F.xxhash64(_hash(words[:half]), _hash(words[half:]))


def _literals(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~w.contains("<")))


def _items(benchmark: DataFrame) -> DataFrame:
    """``item_id, words, plain, first, free`` of each item that has words.

    ``first`` is word 0 as a template where a number and a blank stand before it; ``free`` are the places of windows
    with too few literal words to be looked up as templates.
    """
    items = benchmark.where(_trimmed(F.col("text")) != "").distinct()
    inside = F.get(F.split(template(F.concat(F.lit("1 "), _trimmed(F.col("text")))), BREAK), F.lit(1))
    forms = _forms(items.select(F.struct("item_id", inside.alias("first")).alias("key"), "text"), "key")
    at = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)))
    free = F.filter(at, lambda p: _literals(F.slice("words", p + 1, WINDOW)) < LITERAL)
    return forms.select("key.item_id", "words", "plain", "key.first", free.alias("free"))


def _item_windows(items: DataFrame) -> DataFrame:
    """``item_id, item_at, window``: all plain windows, and the template windows with enough literal words.

    An item of fewer than ``WINDOW`` words is one plain window.

    A document may have other text before the window's first word, so that is taken in each of its forms.
    """
    whole = items.where(F.size("words") >= WINDOW)
    rows = whole.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - WINDOW)).alias("item_at"))
    cut = {c: F.slice(c, F.col("item_at") + 1, WINDOW) for c in ("words", "plain")}
    rest = F.slice("words", F.col("item_at") + 2, WINDOW - 1)
    opened = F.when(F.col("item_at") == 0, F.col("first")).otherwise(F.get("plain", F.col("item_at")))
    templates = F.array(cut["words"], *[F.concat(F.array(w), rest) for w in (F.get("plain", F.col("item_at")), opened)])
    forms = F.concat(F.array(cut["plain"]), F.filter(templates, lambda ws: _literals(ws) >= LITERAL))
    exploded = rows.select("item_id", "item_at", F.explode(forms).alias("form"))
    window = _hash([F.get("form", F.lit(k)) for k in range(WINDOW)])
    short = items.where(F.size("words") < WINDOW).select(
        "item_id", F.lit(0).alias("item_at"), _short_hash(F.col("plain")).alias("window")
    )
    return exploded.select("item_id", "item_at", window.alias("window")).union(short).distinct()


def _document() -> Column:
    """What a document is known by: its id, which may be null or stand on several texts, and a hash of its text."""
    return F.struct("doc_id", F.xxhash64("text").alias("mark"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_words, verbatim, consistent, contaminated, text_mark``, a row per matching pair.

    Words become templates (numbers, names and units are typed placeholders). A pair matches where the document
    holds a stretch of ``STRETCH`` words of the item in order, or all of a shorter item;
    a word is the item's if it is equal when folded, or as a template. ``n_words`` is the longest such stretch.
    ``verbatim``: every slot in the stretches
    has the item's own value, or an unchanged part of a stretch has ``STRETCH`` words, values of slots included. ``consistent``: each value of the item's slots is replaced by one value throughout,
    as when a question is asked anew with other numbers. ``contaminated`` is either.

    Items without ``item_id``, and null or blank texts, match nothing. A document is an id with a text (``text_mark``, its hash): rows
    equal in both are one, rows without ``doc_id`` and texts that share one are judged each for itself. Further columns are ignored. Items of fewer than ``WINDOW`` words, and
    windows of fewer than ``LITERAL`` literal words, are known by their own words only. All windows of all texts are looked up by a hash join, as templates and plainly folded. Benchmark windows are
    broadcast only if counted to be few. Only matched documents are read again, and compared word by word.
    """
    docs = docs.where(F.col("text").isNotNull()).select(_document().alias("doc"), "text")
    benchmark = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        "item_id", "text"
    )
    items = staged(_items(benchmark), "items")
    n_items = items.count()
    sought = staged(_item_windows(items), "item-windows")
    n_sought = sought.count()
    hits = _windows(docs).join(counted(sought, n_sought), "window")
    lengths = [r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n") < WINDOW).distinct().collect()]
    if lengths:
        hits = hits.union(_short_windows(docs, sorted(lengths)).join(counted(sought, n_sought), "window"))
    # A stretch is a run of windows on one diagonal; windows not looked up as templates may belong to it.
    lines = hits.groupBy("doc", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set("item_at").alias("hit")
    )
    asked = items.select("item_id", "free", F.size("words").alias("n"))
    lines = lines.join(counted(asked, n_items), "item_id").withColumn("places", F.sort_array(F.array_union("hit", "free")))
    run = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"), F.lit(-9).alias("last")),
        lambda s, p: F.struct(
            F.greatest(s["best"], F.when(p == s["last"] + 1, s["now"] + 1).otherwise(1)).alias("best"),
            F.when(p == s["last"] + 1, s["now"] + 1).otherwise(F.lit(1)).alias("now"),
            p.alias("last"),
        ),
        lambda s: s["best"],
    )
    needed = F.greatest(F.least(F.lit(STRETCH), F.col("n")) - WINDOW + 1, F.lit(1))
    lines = lines.where(run >= needed).select("doc", "item_id", "shift", "n")
    per_doc = lines.groupBy("doc").agg(F.collect_set(F.struct("item_id", "shift", "n")).alias("lines"))
    per_doc = staged(per_doc, "lines-by-doc")
    few = per_doc.count()
    matched = _forms(docs.join(counted(per_doc.select("doc"), few), "doc", "left_semi"), "doc")

    def facing(line: Column) -> Column:
        """The document's words beside the item's, from place ``ahead`` of the item on."""
        start = F.greatest(line["shift"], F.lit(0)) + 1
        return F.struct(
            line["item_id"].alias("item_id"), F.greatest(-line["shift"], F.lit(0)).alias("ahead"),
            F.slice("words", start, line["n"]).alias("words"), F.slice("plain", start, line["n"]).alias("plain"),
        )

    matched = matched.join(counted(per_doc, few), "doc").select(
        "doc", F.explode(F.transform("lines", facing)).alias("line")
    )
    asked = items.select("item_id", F.col("words").alias("slots"), F.col("plain").alias("asked"))

    def there(column: str, p: Column) -> Column:
        return F.get(F.col(column), p - F.col("line.ahead"))

    # Per word of the item: 2 or 3 (a slot) if the document has it, 1 if it has its template only, 0 if neither.
    marks = F.array_join(
        F.transform(
            "slots",
            lambda w, p: F.when(there("line.plain", p) == F.get("asked", p), F.when(w.contains("<"), "3").otherwise("2"))
            .when(there("line.words", p) == w, "1")
            .otherwise("0"),
        ),
        "",
    )
    size = F.size("slots")
    longest = F.array_max(F.transform(F.regexp_extract_all("marks", F.lit("[1-3]+"), F.lit(0)), lambda r: F.length(r)))
    pairs = (
        matched.withColumn("item_id", F.col("line.item_id"))
        .join(counted(asked, n_items), "item_id")
        .withColumn("marks", marks)
        .withColumn("n_words", longest)
        .where(F.col("n_words") >= F.least(F.lit(STRETCH), size))
    )
    width = F.least(F.lit(WINDOW), size)
    agreed = F.filter(
        F.sequence(F.lit(0), size - width), lambda p: ~F.substr(F.col("marks"), p + 1, width).contains("0")
    )
    places = F.array_distinct(F.flatten(F.transform(agreed, lambda p: F.sequence(p, p + width - 1))))
    open_ = F.filter(places, lambda p: F.get(F.col("slots"), p).contains("<"))
    fills = F.transform(
        open_, lambda p: F.struct(F.get("asked", p).alias("old"), there("line.plain", p).alias("new"))
    )
    unchanged = F.regexp_extract_all("marks", F.lit("[23]+"), F.lit(0))
    copied = F.exists(unchanged, lambda r: F.length(r) >= STRETCH)
    pairs = pairs.select("doc", "item_id", "n_words", copied.alias("copied"), fills.alias("fills"))
    kinds = F.size(F.array_distinct("fills"))
    olds = F.size(F.array_distinct(F.transform("fills", lambda f: f["old"])))
    same = F.forall("fills", lambda f: f["old"].eqNullSafe(f["new"]))
    judged = pairs.select(
        "doc", "item_id", "n_words", (same | F.col("copied")).alias("verbatim"), (kinds == olds).alias("consistent")
    )
    found = judged.groupBy("doc", "item_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.bool_or("verbatim").alias("verbatim"),
        F.bool_or("consistent").alias("consistent"),
        F.bool_or(F.col("verbatim") | F.col("consistent")).alias("contaminated"),
    )
    return found.select("doc.doc_id", "item_id", "n_words", "verbatim", "consistent", "contaminated", F.col("doc.mark").alias("text_mark"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows; all columns stay. Rows that share an id, or have none, are judged each for itself."""
    names = docs.columns
    gone = leaks(docs, benchmark).where("contaminated").select(F.struct("doc_id", F.col("text_mark").alias("mark")).alias("gone"))
    gone = staged(gone.distinct(), "leaking")
    gone = counted(gone, gone.count())
    packed = docs.select(_document().alias("doc"), F.struct(*names).alias("row"))
    return packed.join(gone, F.col("doc") == F.col("gone"), "left_anti").select("row.*")
