"""Payment / not-a-payment classifier: features, score, training, re-score.

One feature list serves scoring and training. Scoring is a plain arithmetic column,
so it works the same in batch and in a stream and needs no model object on the
executors; training is ``spark.ml`` on the same columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions.text import blank_to_null

FEATURE_NAMES = [name for name, _, _ in V.CLASSIFIER_FEATURES]

#: Texts of which every match of a feature's pattern holds one; a pattern that is plain words is its own.
NEEDED = {
    "ref_utr": ("ref", "utr", "rrn", "txn"), "account_mask": ("xx", "x*", "*x", "**"), "available_limit": ("lim",),
    "remaining_limit": ("limit",), "avl_bal": ("bal",), "due": ("due",), "reward_points": ("reward",),
    "offer": ("voucher", "coupon", "promo", "offer"), "pre_approved": ("approved",), "inr_rs": ("inr", "rs", "₹"),
    "two_amounts": ("rs", "inr", "₹", "usd"), "upi_path": ("upi/",), "expiry_offer": ("till", "until", "valid", "expir"),
    "limit_changed": ("limit",), "usd": ("usd", "dollar"), "unlock_win": ("unlock", "win", "grab", "hurry"),
} | {name: (m[1],) for name, pattern, _ in V.CLASSIFIER_FEATURES if (m := re.fullmatch(r"\\b([a-z ]+)\\b", pattern))}


def feature_flags(body: Column, address: Column) -> dict[str, Column]:
    """Boolean column per feature, over lower-case text; a pattern is tried only where its needed text occurs."""
    lowered, sender = F.lower(body), F.lower(F.coalesce(address, F.lit("")))

    def flag(name: str, pattern: str) -> Column:
        if name == "sender_bank":
            return sender.rlike(pattern) | lowered.rlike(pattern)
        may_match = reduce(lambda a, b: a | b, [lowered.contains(t) for t in NEEDED[name]])
        if name == "two_amounts":
            return may_match & (F.regexp_count(lowered, F.lit(pattern)) >= 2)
        return may_match & lowered.rlike(pattern)

    return {name: flag(name, pattern) for name, pattern, _ in V.CLASSIFIER_FEATURES}


@dataclass(frozen=True)
class Coefficients:
    weights: dict[str, float]
    bias: float
    threshold: float = V.NOT_A_PAYMENT_THRESHOLD


BUILT_IN = Coefficients(
    {name: weight for name, _, weight in V.CLASSIFIER_FEATURES}, V.NOT_A_PAYMENT_BIAS
)


def probability(body: Column, address: Column, model: Coefficients = BUILT_IN) -> Column:
    return _probability(feature_flags(body, address), model)


def _probability(flags: dict[str, Column], model: Coefficients) -> Column:
    terms = [
        F.when(flag, model.weights[name]).otherwise(0.0)
        for name, flag in flags.items()
        if model.weights[name] != 0.0
    ]
    logit = reduce(lambda a, b: a + b, terms, F.lit(model.bias))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def is_not_a_payment(body: Column, address: Column, model: Coefficients = BUILT_IN) -> Column:
    return probability(body, address, model) >= model.threshold


def with_features(messages: DataFrame) -> DataFrame:
    flags = feature_flags(F.col("body"), F.col("address"))
    return messages.withColumns({name: flag.cast("double") for name, flag in flags.items()})


def score(messages: DataFrame, model: Coefficients = BUILT_IN) -> DataFrame:
    p = probability(F.col("body"), F.col("address"), model)
    return messages.withColumn("probability", p).withColumn(
        "not_a_payment", F.col("probability") >= model.threshold
    )


def augment(training: DataFrame) -> DataFrame:
    """Every row plus a copy with the currency word swapped, in one scan."""
    real = F.regexp_replace("body", "INR", "Rs.")
    alert = F.regexp_replace(F.regexp_replace("body", "Rs ", "INR "), r"Rs\.", "INR ")
    swapped = F.when(F.col("label") == 0, real).otherwise(alert)
    return training.withColumn("body", F.explode(F.array("body", swapped)))


def is_held_out(share: float = 0.25, seed: int = 7) -> Column:
    """Stratified hold-out decided by a hash of the row, stable under retries.

    The hash is independent of the class, so each class gives the same share. It is MD5, so any engine can tell
    which rows were held out.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("label").cast("string"), "address", "body"))
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint") / float(1 << 32) < share


def split_holdout(training: DataFrame, share: float = 0.25, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Rows to fit on and rows held out, by ``held`` where the rows tell it."""
    held = F.col("held") if "held" in training.columns else is_held_out(share, seed)
    return training.filter(~held), training.filter(held)


def profiles(labelled: DataFrame) -> DataFrame:
    """``label, flags, texted, n`` (and ``held``, if given): rows alike in these, counted in one scan of the texts.

    A classifier sees nothing of a message but its flags (bit ``i`` of ``flags`` is feature ``i``), so fitting
    and evaluating need the counts alone. Rows without a body have no flags (``texted`` is false).
    """
    if "flags" in labelled.columns:
        return labelled
    found = feature_flags(F.col("body"), F.col("address"))
    bits = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(flag, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, flag in enumerate(found.values())],
    )
    rows = labelled.withColumns({"flags": bits, "texted": F.col("body").isNotNull()})
    return rows.groupBy(*[c for c in ("held",) if c in rows.columns], "label", "flags", "texted").agg(
        F.count("*").alias("n")
    )


def _profile_flags() -> dict[str, Column]:
    return {name: F.getbit("flags", F.lit(i)) == 1 for i, name in enumerate(FEATURE_NAMES)}


def train(
    training: DataFrame, c: float = 1.5, iterations: int = 400, threshold: float = V.NOT_A_PAYMENT_THRESHOLD
) -> Coefficients:
    """L2 logistic regression; ``c`` is the inverse strength over the summed loss."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    # Equal rows weigh as many; rows without a body have null features, which raise.
    flags = {name: F.when(F.col("texted"), flag).cast("double") for name, flag in _profile_flags().items()}
    table = profiles(training).withColumns(flags)
    rows = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    vectors = VectorAssembler(inputCols=FEATURE_NAMES, outputCol="features").transform(table)
    fitted = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="n", maxIter=iterations, elasticNetParam=0.0,
        regParam=1.0 / (c * rows), standardization=False, tol=1e-8,
    ).fit(vectors.select("features", F.col("label").cast("double").alias("label"), F.col("n").cast("double").alias("n")))
    weights = dict(zip(FEATURE_NAMES, (float(w) for w in fitted.coefficients), strict=True))
    return Coefficients(weights, float(fitted.intercept), threshold)


def evaluate(labelled: DataFrame, model: Coefficients) -> DataFrame:
    """Per class: precision, recall, f1, support; plus overall accuracy."""
    predicted = (_probability(_profile_flags(), model) >= 0.5).cast("int")
    cells = profiles(labelled).withColumn("predicted", predicted).groupBy("label", "predicted").agg(
        F.sum("n").alias("n")
    )
    per_class = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.lit("true").alias("side")),
                F.struct(F.col("predicted").alias("class"), F.lit("predicted").alias("side")),
            )
        ).alias("s"), "n", (F.col("label") == F.col("predicted")).alias("hit"),
    ).groupBy("s.class").agg(
        F.sum(F.when(F.col("s.side") == "true", F.col("n"))).alias("support"),
        F.sum(F.when(F.col("s.side") == "predicted", F.col("n"))).alias("predicted"),
        F.sum(F.when((F.col("s.side") == "true") & F.col("hit"), F.col("n"))).alias("hits"),
    )
    hits = F.coalesce("hits", F.lit(0)).cast("double")
    scored = per_class.select(
        F.col("class").cast("string").alias("class"),
        F.round(F.try_divide(hits, F.col("predicted").cast("double")), 6).alias("precision"),
        F.round(F.try_divide(hits, F.col("support").cast("double")), 6).alias("recall"),
        F.col("support").cast("bigint").alias("support"),
    )
    overall = cells.agg(
        F.lit("accuracy").alias("class"),
        F.lit(None).cast("double").alias("precision"),
        F.round(
            F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).cast("double")
            / F.sum("n").cast("double"), 6,
        ).alias("recall"),
        F.sum("n").alias("support"),
    )
    return scored.unionByName(overall)


IMPORT_ORDER = ("imported_at", "source_identifier")


def message_sources(sources: DataFrame, key: str = "txn_id", order: tuple[str, ...] = IMPORT_ORDER) -> DataFrame:
    """Per transaction: first non-blank message text and first sender.

    A store's sources are keyed by ``fingerprint`` and ordered by their arrival number ``seq``.
    """
    order = F.struct(*order)
    payload = blank_to_null(F.col("raw_payload"))
    return sources.filter(F.col("source") == "SMS").groupBy(key).agg(
        F.min_by(payload, F.when(payload.isNotNull(), order)).alias("message"),
        F.min_by("origin_label", F.when(F.col("origin_label").isNotNull(), order)).alias("sender"),
    )


def rescore(
    candidates: DataFrame,
    sources: DataFrame,
    model: Coefficients = BUILT_IN,
    key: str = "txn_id",
    order: tuple[str, ...] = IMPORT_ORDER,
) -> DataFrame:
    """Candidate rows with ``hide`` set where the stored text is not a payment.

    Text: stored message, else description, else merchant + bank + notes; rows
    without any text are scanned but never hidden. Rows only ever become hidden.
    """
    joined = candidates.join(message_sources(sources, key, order), key, "left")
    fallback = F.concat_ws(" ", "merchant_name", "bank_name", "notes")
    body = F.coalesce("message", blank_to_null(F.col("description")), blank_to_null(fallback))
    texted = joined.withColumn("body", body)
    hide = F.col("body").isNotNull() & is_not_a_payment(F.col("body"), F.col("sender"), model)
    return texted.withColumn("hide", hide).drop("message")


def rescore_summary(rescored: DataFrame) -> DataFrame:
    return rescored.agg(
        F.count("*").alias("scanned_count"), F.count_if("hide").alias("hidden_count")
    )


def hide_rescored(ledger: DataFrame, rescored: DataFrame, key: str = "txn_id") -> DataFrame:
    """Apply the verdicts to the ledger."""
    hidden = rescored.filter("hide").select(key, F.lit(True).alias("_hide"))
    flag = F.col("is_promotional") | F.coalesce("_hide", F.lit(False))
    return ledger.join(hidden, key, "left").select(
        *[flag.alias(c) if c == "is_promotional" else F.col(c) for c in ledger.columns]
    )
