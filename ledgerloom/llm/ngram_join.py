"""Similarity join of texts on word shingles by a grouped prefix join."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import counted, shingle_hashes, staged, total, word_hashes

#: Share of the hash space whose shingles are ordered by document frequency.
RANKED = 0.25
#: Earlier prefix members an index entry carries. A pair is passed over where these overlap, since it is found
#: there too; at its first common member nothing overlaps, so fewer only mean repeats.
_AHEAD = 6
_BITS = [f"b{i}" for i in range(8)]
#: Turns of other classes standing for a bucket, before the groups of different components are joined. They only
#: leave less to that join, which is exact after any number of turns.
_TURNS = 3


def _sketcher(width: int, threshold: Fraction):
    """Per text: set size, set hashes, the shingles that lead the global order, parity bits.

    The global order puts the shingles of a fixed part of the hash space first (rarest
    first, once their document frequencies are known), then all others by hash. A prefix
    filter is exact under any global order; this one needs frequencies for that part only.
    """
    cut = np.uint64(int(RANKED * 2**64))

    def one(text):
        hashes = shingle_hashes(word_hashes((text or "").encode("utf-8", "replace")), width)
        n = len(hashes)
        need = -(-n * threshold.numerator // threshold.denominator)
        keep = n - need + 1 if n else 0
        split = int(np.searchsorted(hashes, cut))
        bits = np.bincount((hashes >> np.uint64(3)).astype(np.int64) & 511, minlength=512) & 1
        once = np.uint64(0x9E3779B97F4A7C15)
        return (
            n,
            int(np.bitwise_xor.reduce(hashes * once, initial=np.uint64(n)).view(np.int64)),
            int(np.add.reduce(hashes * (hashes | np.uint64(1)), initial=np.uint64(n)).view(np.int64)),
            keep,
            hashes[:split].view(np.int64),
            hashes[split : split + max(0, keep - split)].view(np.int64),
            np.packbits(bits.astype(np.uint8)).view(np.int64),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column("text")]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            arrays = [batch.column("doc_id"), batch.column("mark")]
            arrays += [pa.array(cols[i], pa.int32() if i in (0, 3) else pa.int64()) for i in range(4)]
            for c in cols[4:6]:
                ends = np.cumsum([0, *map(len, c)], dtype=np.int32)
                flat = np.concatenate(c) if c else np.zeros(0, np.int64)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            bits = np.stack(cols[6]) if rows else np.zeros((0, 8), np.int64)
            arrays += [pa.array(bits[:, i]) for i in range(8)]
            names = ["doc_id", "mark", "n", "h1", "h2", "keep", "ranked", "rest", *_BITS]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [
                shingle_hashes(word_hashes((x.as_py() or "").encode("utf-8", "replace")), width).tobytes()
                for x in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), pa.array(sets, pa.binary())], ["rid", "tokens"]
            )

    return run


def _verifier(threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                x = np.frombuffer(left.as_buffer(), np.uint64)
                y = np.frombuffer(right.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * threshold.denominator >= threshold.numerator * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"]
            )

    return run


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, width: int, threshold: Fraction):
    """The staged candidate pairs whose exact similarity reaches the threshold."""
    rids = staged(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "wanted")
    n = rids.count()
    wanted = staged(
        sketches.select("rid", "doc_id", "mark").join(counted(rids, n), "rid", "left_semi"), "wanted"
    ).withColumnRenamed("doc_id", "wanted_id").withColumnRenamed("mark", "wanted_mark")
    texts = docs.join(
        counted(wanted, n),
        F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("mark") == F.col("wanted_mark")),
    ).select("rid", "text")
    sets = staged(
        texts.dropDuplicates(["rid"]).mapInArrow(_sets(width), "rid long, tokens binary"), "sets"
    )
    return (
        pairs.join(sets.toDF("a", "left"), "a")
        .join(sets.toDF("b", "right"), "b")
        .select("a", "b", "left", "right")
        .mapInArrow(_verifier(threshold), "a long, b long, linked boolean")
        .where("linked")
        .select("a", "b")
    )


def _sizes(threshold: Fraction) -> Column:
    """Sets so unequal in size that they cannot link fail this."""
    return F.least("n", "o_n") * threshold.denominator >= F.greatest("n", "o_n") * threshold.numerator


def _most_apart(threshold: Fraction) -> Column:
    """Shingles that only one of two linked sets can hold, at most."""
    p, q = threshold.numerator, threshold.denominator
    return F.floor((F.col("n") + F.col("o_n")) * (q - p) / F.lit(q + p) + F.lit(1e-6))


def jaccard_components(docs: DataFrame, width: int = 4, threshold: Fraction = Fraction(85, 100)) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs`` (``doc_id, text``).

    Texts link when the Jaccard similarity of their distinct ``width``-word shingles is
    ``threshold`` or more; ``component_id`` is the smallest ``doc_id`` reachable. A text with
    fewer words is one shingle; null or blank texts have an empty set and link with nothing.
    Repeated rows are texts like any other; rows without ``doc_id`` take part in links, and
    get the smallest other id of their component or null. Other columns are ignored.

    Texts with equal sets are one class. Classes are indexed by the members of their prefix
    that occur elsewhere. The first pass compares each class only with the class that stands
    for its bucket and size; what that joins is one component. In buckets that still hold several
    components, other classes stand for the bucket in turn. The second pass
    collapses classes of one size, prefix and component into groups, joins groups of
    different components on prefix members, filters the group pairs (size, position, no common
    member just before, distance of parity bits less the groups' radii), expands them and verifies
    members. So a large group of near copies never becomes all of its pairs.
    """
    return rows_with_component(docs, width, threshold).select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def rows_with_component(docs: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """``doc_id, mark`` (hash of the text)``, n, root, component_id`` per row; rows of one component have one ``root``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, n int, h1 long, h2 long, "
        "keep int, ranked array<long>, rest array<long>, " + ", ".join(f"{b} long" for b in _BITS)
    )
    sketches = staged(
        docs.mapInArrow(_sketcher(width, threshold), schema).withColumn(
            "rid", F.monotonically_increasing_id()
        ),
        "sketches",
    )
    filled = sketches.where("n > 0")

    tokens = filled.select("rid", F.explode("ranked").alias("tok"))
    often = tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    shared = (
        tokens.join(often, "tok")
        .groupBy("rid")
        .agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("shared"))
    )
    lone = F.col("ranks") - F.coalesce(F.size("shared"), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("keep") - lone, F.coalesce(F.size("shared"), F.lit(0))))
    head = F.when(taken > 0, F.slice("shared", 1, F.greatest(taken, F.lit(1)))["tok"]).otherwise(
        F.array().cast("array<long>")
    )
    classes = staged(
        filled.select("rid", "n", "h1", "h2", "keep", F.size("ranked").alias("ranks"), "rest", *_BITS)
        .join(shared, "rid", "left")
        .select(
            "rid", "n", "h1", "h2", lone.alias("lone"), F.concat(head, "rest").alias("prefix"),
            (F.coalesce(F.size("shared"), F.lit(0)) / F.col("n")).alias("common"), *_BITS,
        )
        .where(F.size("prefix") > 0)
        .groupBy("n", "h1", "h2", "lone", "prefix", "common", *_BITS)
        .agg(F.min("rid").alias("cid")),
        "classes",
    )

    # First pass: every class against the one that stands for its bucket and size class.
    index = classes.select(
        F.explode("prefix").alias("tok"),
        (F.log(F.col("n").cast("double")) / float(np.log(1 / float(threshold)))).alias("scale"),
        "cid", "common",
    )
    several = index.groupBy("tok").agg(F.count("*").alias("size")).where("size > 1").select("tok")
    buckets = staged(index.join(several, "tok", "left_semi"), "buckets")
    spanned = buckets.withColumn("span", F.floor("scale"))
    centre = spanned.groupBy("tok", "span").agg(F.max(F.struct("common", "cid")).alias("c"))
    stars = (
        spanned.join(centre.select("tok", "span", F.col("c.cid").alias("o_cid")), ["tok", "span"])
        .where("cid <> o_cid")
        .select("cid", "o_cid")
    )
    bits = classes.select("cid", "n", *_BITS)
    o_bits = bits.select(*[F.col(c).alias(f"o_{c}") for c in bits.columns])
    apart = total([F.bit_count(F.col(b).bitwiseXOR(F.col(f"o_{b}"))) for b in _BITS])

    def near(stars: DataFrame) -> DataFrame:
        """The class pairs that may link by size and parity bits."""
        return (
            stars.distinct().join(bits, "cid")
            .join(o_bits, "o_cid")
            .where(_sizes(threshold) & (apart <= _most_apart(threshold)))
            .select(F.least("cid", "o_cid").alias("a"), F.greatest("cid", "o_cid").alias("b"))
            .distinct()
        )

    def placing(known: DataFrame) -> DataFrame:
        """Every class with the component it has so far."""
        return staged(
            classes.join(known, classes["cid"] == known["node"], "left").withColumn(
                "comp", F.coalesce("component", "cid")
            ).drop("node", "component"),
            "placed",
        )

    tried = staged(near(stars), "tried")
    first = staged(_verified(tried, sketches, docs, width, threshold), "first")
    known = components(first)
    placed = placing(known)

    # A class of the largest component stands for each bucket that still holds several, while that joins some.
    # Size classes are shifted by half of one at every other turn, so near sizes meet in one at last.
    for turn in range(_TURNS):
        span = F.floor(F.col("scale") + (0.5 if turn % 2 == 0 else 0.0)).alias("span")
        sizes = placed.groupBy("comp").agg(F.count("*").alias("weight"))
        apiece = buckets.select("tok", span, "cid").join(placed.select("cid", "comp").join(sizes, "comp"), "cid")
        centre = apiece.groupBy("tok", "span").agg(
            F.max(F.struct("weight", F.xxhash64("cid", F.lit(turn)).alias("by"), "cid", "comp")).alias("c"),
            F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        )
        stars = (
            apiece.join(
                centre.where("lo < hi").select(
                    "tok", "span", F.col("c.cid").alias("o_cid"), F.col("c.comp").alias("o_comp")
                ),
                ["tok", "span"],
            )
            .where("comp <> o_comp")
            .select("cid", "o_cid")
        )
        fresh = staged(near(stars).join(tried, ["a", "b"], "left_anti"), "tried")
        found = staged(_verified(fresh, sketches, docs, width, threshold), "found")
        tried = tried.union(fresh)
        if found.isEmpty():
            break
        known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
        placed = placing(known)

    # Second pass: groups of one size, prefix and component against those of other components.
    grouping = ["n", "lone", "prefix", "comp"]
    groups = staged(placed.groupBy(*grouping).agg(F.min("cid").alias("gid")), "groups")
    members = staged(
        placed.join(groups, grouping).select("gid", "cid", "n", "lone", "prefix", "comp", *_BITS), "members"
    )
    heads = members.where("gid = cid").drop("cid")
    o_heads = heads.select("gid", *[F.col(b).alias(f"o_{b}") for b in _BITS])
    radius = members.join(o_heads, "gid").groupBy("gid").agg(F.max(apart).alias("radius"))
    heads = staged(heads.join(radius, "gid"), "heads")
    spots = heads.select("gid", "comp", F.explode("prefix").alias("tok"))
    mixed = (
        spots.groupBy("tok")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .where("lo < hi")
        .select("tok")
    )
    entries = (
        heads.select("*", F.posexplode("prefix").alias("place", "tok"))
        .withColumn("ahead", F.slice("prefix", F.greatest(F.lit(1), F.col("place") - _AHEAD + 1), F.least(F.col("place"), F.lit(_AHEAD))))
        .withColumn("at", F.col("place") + F.col("lone"))
        .drop("prefix", "lone", "place")
        .join(mixed, "tok", "left_semi")
    )
    other = entries.select("tok", *[F.col(c).alias(f"o_{c}") for c in entries.columns if c != "tok"])
    p, q = threshold.numerator, threshold.denominator
    reach = F.least("at", "o_at") + F.lit(1) + F.least(F.col("n") - F.col("at") - 1, F.col("o_n") - F.col("o_at") - 1)
    pairs = staged(
        entries.join(other, "tok")
        .where(
            (F.col("gid") < F.col("o_gid")) & (F.col("comp") != F.col("o_comp")) & _sizes(threshold)
            & (apart - F.col("radius") - F.col("o_radius") <= _most_apart(threshold))
            & (reach * (p + q) >= (F.col("n") + F.col("o_n")) * p)
            & ~F.arrays_overlap("ahead", "o_ahead")
        )
        .select("gid", "o_gid")
        .distinct(),
        "group-pairs",
    )
    members = members.select("gid", "cid", "n", *_BITS)
    others = members.select(*[F.col(c).alias(f"o_{c}") for c in members.columns])
    across = heads.select(
        F.col("gid").alias("o_gid"), F.col("n").alias("o_n"), F.col("radius").alias("o_radius"),
        *[F.col(b).alias(f"o_{b}") for b in _BITS],
    )
    # Members far from the other group's head go before the other group is expanded.
    expanded = (
        pairs.join(across, "o_gid")
        .join(members, "gid")
        .where(apart - F.col("o_radius") <= _most_apart(threshold))
        .select("o_gid", "cid", "n", *_BITS)
        .join(others, "o_gid")
        .where(apart <= _most_apart(threshold))
        .select(F.least("cid", "o_cid").alias("a"), F.greatest("cid", "o_cid").alias("b"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    expanded = staged(expanded, "expanded")
    second = staged(_verified(expanded, sketches, docs, width, threshold), "second")

    joined = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second))
    rows = sketches.select("rid", "doc_id", "mark", "n", "h1", "h2")
    names = rows.where("n > 0").groupBy("n", "h1", "h2").agg(
        F.min("rid").alias("cid"), F.min("doc_id").alias("low")
    )
    named = names.join(joined, names["cid"] == joined["node"], "left").withColumn(
        "root", F.coalesce("component", "cid")
    )
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    found = named.join(lowest, "root").select("n", "h1", "h2", "root", "component_id")
    return rows.join(found, ["n", "h1", "h2"], "left").select("doc_id", "mark", "n", "root", "component_id")


def one_per_component(docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """``docs`` without near copies: one row of each component stays, all columns kept.

    The row with the smallest ``doc_id`` stays, one with an id before one without, then the one whose text has the smallest
    hash. Decisions are by row: texts that share an id, or have none, go or stay each for itself. Of rows equal in
    id and text one stays. Null and blank texts link with nothing; those without id all stay.
    """
    rows = staged(rows_with_component(docs, width, threshold).select("doc_id", "mark", "n", "root"), "by-row")
    found = rows.where("n > 0")
    blank = rows.where("n = 0 AND doc_id IS NOT NULL").groupBy("doc_id", "mark").agg(F.lit(True).alias("stays"), F.count("*").alias("times"))
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "mark")
    first = found.groupBy("root").agg(F.min(row).alias("first"), F.count("*").alias("size"))
    several = found.join(first.where("size > 1"), "root").select("doc_id", "mark", "first")
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    judged = several.groupBy("doc_id", "mark").agg(F.bool_or(mine).alias("stays"), F.count("*").alias("times"))
    judged = staged(judged.union(blank).where("NOT stays OR times > 1").toDF("_id", "_text_mark", "_stays", "_times"), "judged")
    names = docs.columns
    packed = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.struct(*names).alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_text_mark"))
    kept = packed.join(judged.where("NOT _stays"), same, "left_anti")
    repeated = judged.where("_stays")
    if repeated.isEmpty():
        return kept.select("row.*")
    again = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "mark"])
    return kept.join(repeated, same, "left_anti").unionByName(again).select("row.*")
