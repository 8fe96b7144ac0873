"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import counted, staged, word_count

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Rows a bucket of the key order is meant to hold.
BUCKET_ROWS = 10_000
#: Buckets whose sums are added up in one go.
BUCKET_RUN = 4096


def quality_weight(text: Column) -> Column:
    """A positive weight: the share of ASCII letters, smoothed; 1 for null or empty text."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.coalesce((letters + 1) / (F.length(text) + 1), F.lit(1.0))


def exponential_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """``-ln(u) / weight``: ascending, an Efraimidis-Spirakis order; u comes from the id."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: int = MOST_EPOCHS) -> dict:
    """Words each source is to give. ``sizes`` holds (source, words), one per source.

    The sum of all sizes is shared by weight; a share stops at ``most`` times its source's size
    and the excess goes to the rest by weight: sources are capped in the order of
    size over weight until the next share fits.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    rows = [(most * n / weights[i % len(weights)], i, s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(order)]
    left, weight, out = sum(n for _, n in order), sum(r[4] for r in rows), {}
    for level, _, source, n, w in sorted(rows, key=lambda r: r[:2]):
        if level < left / weight:
            out[source] = float(most * n)
            left, weight = left - most * n, weight - w
        else:
            out[source] = left / weight * w
    return out


def _cut_bucket(sums: DataFrame) -> DataFrame:
    """``_source, _bucket, _before``: of each source the bucket of the key order in which its target falls.

    ``sums`` has ``_source, _rest, _bucket, words``. Running sums go over stretches of ``BUCKET_RUN`` buckets first and
    then over the buckets of one stretch, so no task meets all buckets of a large source.
    """
    run = F.expr(f"_bucket div {BUCKET_RUN}")
    at = {}
    for level, rows in (("_run", sums.withColumn("_run", run)), ("_bucket", None)):
        if rows is None:
            rows = sums.withColumn("_run", run).join(
                at["_run"].toDF("_s", "_r", "_base"), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_run") == F.col("_r"))
            )
        base = F.col("_base") if "_base" in rows.columns else F.lit(0)
        each = rows.groupBy("_source", "_rest", level).agg(F.sum("words").alias("words"), F.max(base).alias("base"))
        running = F.sum("words").over(Window.partitionBy("_source").orderBy(level)) + F.col("base")
        reached = each.withColumn("upto", running).where("upto > _rest").groupBy("_source")
        first = F.min(F.struct(level, (F.col("upto") - F.col("words")).alias("before"))).alias("f")
        at[level] = staged(reached.agg(first).select("_source", f"f.{level}", "f.before"), "mix-cut")
    return at["_bucket"].toDF("_source", "_bucket", "_before")


def mix(docs: DataFrame, seed: str = "mix:", weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``docs`` plus ``size, source_size, target, epochs, chosen, taken``; needs ``doc_id, source,
    size, weight``, of which ``weight`` (positive) sets the chance of a fractional choice.

    A source gives ``floor(target / source_size)`` complete epochs, then documents in the order of
    their exponential keys until their sizes reach the rest of the target; the document
    that crosses it is chosen if that brings the sum nearer. Documents are taken
    whole, at most ``most`` times. Sizes of null are 0. Ties of the key go by ``doc_id``, then size; rows that
    repeat an id with one size are interchangeable. Existing columns of the result's names
    are replaced. A source without words has target 0.

    The choice is made on ids, keys and sizes alone. Keys are cut into buckets of about ``BUCKET_ROWS`` rows, running sums
    find the bucket in which a source's target falls, and only that one is sorted: it gives the last document chosen.
    What comes before that in key order is chosen, so whole rows are read once more and never shuffled, but for the rows
    that repeat that last document where not all of them are chosen. Two summary rows per source come to the driver.
    """
    docs = docs.drop("source_size", "target", "epochs", "chosen", "taken")
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)).cast("long"), F.lit(0))
    key = exponential_key(F.col("doc_id"), F.col("weight"), seed)
    narrow = staged(docs.select("doc_id", "source", size.alias("size"), key.alias("_key")), "mix-keys")
    found = narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
    goal = targets([(r["source"], r["words"]) for r in found], weights, most)
    plan = {}
    for r in found:
        want = goal[r["source"]]
        epochs = int(want // r["words"]) if r["words"] else 0
        plan[r["source"]] = (r["words"], want, epochs, float(want - epochs * r["words"]), -(-r["rows"] // BUCKET_ROWS))
    spark, source_type, id_type = docs.sparkSession, docs.schema["source"].dataType, docs.schema["doc_id"].dataType

    def per_source(rows: list[tuple], *fields: tuple) -> DataFrame:
        kinds = [T.StructField("_source", source_type), *[T.StructField(*f) for f in fields]]
        return counted(spark.createDataFrame(rows, T.StructType(kinds)), len(rows))

    mine = F.col("source").eqNullSafe(F.col("_source"))
    aims = per_source([(s, p[3], p[4]) for s, p in plan.items()], ("_rest", T.DoubleType()), ("_buckets", T.LongType()))
    place = F.floor(F.col("_key") / (1 + F.col("_key")) * F.col("_buckets"))
    dealt = narrow.join(aims, mine).withColumn("_bucket", F.least(place, F.col("_buckets") - 1).cast("long"))
    cut = _cut_bucket(dealt.groupBy("_source", "_rest", "_bucket").agg(F.sum("size").alias("words")))
    cut = cut.toDF("_cut_source", "_cut", "_before")
    inside = dealt.join(cut, F.col("_source").eqNullSafe(F.col("_cut_source")) & (F.col("_bucket") == F.col("_cut")))
    order = Window.partitionBy("_source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("size").over(order) + F.col("_before")
    inside = inside.withColumn("_taken", 2 * run - F.col("size") <= 2 * F.col("_rest"))
    tied = inside.groupBy("_source", "_cut", "_key", "doc_id", "size").agg(
        F.count_if("_taken").alias("n"), F.count("*").alias("of")
    )
    last = tied.where("n > 0").groupBy("_source").agg(F.max(F.struct("_key", F.col("doc_id").isNotNull().alias("_has"), "doc_id", "size", "n", "of")).alias("l"))
    last = {r["_source"]: r["l"] for r in last.collect()}
    cuts = {r["_cut_source"]: r["_cut"] for r in cut.select("_cut_source", "_cut").collect()}
    # Sources without a cut are chosen whole; a cut none of whose rows is chosen ends where its bucket begins.
    rows = [
        (s, p[0], float(p[1]), p[2], p[4], cuts.get(s), *((t["_key"], t["doc_id"], t["size"], t["n"], t["of"]) if (t := last.get(s)) else (None,) * 5))
        for s, p in plan.items()
    ]
    limits = per_source(
        rows, ("source_size", T.LongType()), ("target", T.DoubleType()), ("epochs", T.LongType()), ("_buckets", T.LongType()),
        ("_cut", T.LongType()), ("_k", T.DoubleType()), ("_id", id_type), ("_size", T.LongType()), ("_n", T.LongType()), ("_of", T.LongType()),
    )
    names = [F.col(c) for c in docs.columns if c != "size"]
    keyed = docs.select(
        F.struct(*names).alias("_row"), "doc_id", "source", size.alias("size"), key.alias("_key")
    ).join(limits, mine)  # packed, so that no name can clash
    bucket = F.least(place, F.col("_buckets") - 1).cast("long")
    here = F.struct("_key", F.col("doc_id").isNotNull(), "doc_id", "size")
    limit = F.struct(F.col("_k"), F.col("_id").isNotNull(), F.col("_id"), F.col("_size"))
    chosen = (
        F.when(F.col("_cut").isNull() | (bucket < F.col("_cut")), True)
        .when((bucket > F.col("_cut")) | F.col("_k").isNull(), False)
        .otherwise(here <= limit)
    )
    keyed = keyed.withColumn("chosen", chosen)
    if any(t["n"] < t["of"] for t in last.values()):
        some = F.coalesce((F.col("_n") < F.col("_of")) & (here == limit), F.lit(False))
        number = F.row_number().over(Window.partitionBy("source").orderBy("_key"))
        keyed = keyed.where(~some).unionByName(keyed.where(some).withColumn("chosen", number <= F.col("_n")))
    taken = F.col("size") * (F.col("epochs") + F.col("chosen").cast("long"))
    return keyed.select("_row.*", "size", "source_size", "target", "epochs", "chosen", taken.alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix:") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, zero times included.

    A document without words is taken as often as its source's complete epochs, and in the fractional
    part if its key comes before the cut. Columns are those of ``docs``.
    """
    names = docs.columns
    packed = docs.select(
        "doc_id", "source", F.struct(*names).alias("_row"), word_count(F.col("text")).alias("size"),
        quality_weight(F.col("text")).alias("weight"),
    )
    times = (F.col("epochs") + F.col("chosen").cast("long")).cast("int")
    return (
        mix(packed, seed)
        .withColumn("_time", F.explode(F.array_repeat(F.lit(1), times)))
        .select("_row.*")
    )
