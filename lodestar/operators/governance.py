"""Scores, coverage, drift and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The vendor questionnaire and its weights; a yes to question 7
# (counted from 0) is bad.
VENDOR_QUESTIONS = (
    ("Does the vendor publish model cards or equivalent documentation for models used?", 5),
    ("Is training data provenance documented?", 5),
    ("Does the vendor support tenant-level data isolation?", 8),
    ("Is data encrypted at rest and in transit?", 6),
    ("Does the vendor have a documented incident response process?", 6),
    ("Is there a named security contact / responsible disclosure process?", 4),
    ("Does the vendor undergo third-party security audits (SOC2, ISO 27001, or equivalent)?", 8),
    ("Is customer data used for further model training without explicit consent?", 7),
    ("Does the vendor provide an SLA for uptime and support response?", 3),
    ("Is there a documented data retention and deletion policy?", 6),
    ("Does the vendor support GDPR Art. 28 processor obligations (DPA available)?", 7),
    ("Is there rate limiting / abuse protection on the vendor's API?", 3),
    ("Does the vendor disclose sub-processors?", 5),
    ("Is there a documented process for model version changes/deprecation notice?", 4),
    ("Does the vendor support audit logging of API usage?", 5),
    ("Is prompt injection / adversarial robustness testing documented?", 6),
    ("Does the vendor have a bug bounty or vulnerability disclosure program?", 4),
    ("Is there geographic data residency control?", 5),
    ("Does the vendor provide usage/cost transparency (token counts, per-request cost)?", 3),
    ("Is there a clear data processing agreement covering AI-specific risks?", 7),
)
VENDOR_WEIGHTS = tuple(weight for _, weight in VENDOR_QUESTIONS)
VENDOR_INVERTED = (7,)
# Safe-harbour identifiers and the entity types that cover them.
IDENTIFIERS = (
    ("Names", "PERSON"), ("Geographic subdivisions smaller than a state", "LOCATION"), ("All elements of dates (except year) directly related to an individual, and all ages over 89", "DATE_TIME"),
    ("Telephone numbers", "PHONE_NUMBER"), ("Fax numbers", None), ("Email addresses", "EMAIL_ADDRESS"), ("Social Security numbers", "US_SSN"),
    ("Medical record numbers", None), ("Health plan beneficiary numbers", None), ("Account numbers", "US_BANK_NUMBER"),
    ("Certificate/license numbers", "MEDICAL_LICENSE, US_DRIVER_LICENSE"), ("Vehicle identifiers and serial numbers", None),
    ("Device identifiers and serial numbers", None), ("URLs", "URL"), ("IP addresses", "IP_ADDRESS"), ("Biometric identifiers", None),
    ("Full-face photographs and comparable images", None), ("Any other unique identifying number, characteristic, or code", None),
)


def vendor_score(answers: Column) -> Column:
    """raw, normalised (to 100), tier and flagged (questions answered badly) of an
    array of 20 booleans; of another number it is an error."""
    answers = F.when(F.size(answers) == len(VENDOR_QUESTIONS), answers).otherwise(F.raise_error(F.lit(f"expected {len(VENDOR_QUESTIONS)} answers")))
    weights = F.array(*map(F.lit, VENDOR_WEIGHTS))
    good = F.transform(answers, lambda a, i: F.when(i.isin(*VENDOR_INVERTED), ~a).otherwise(a))
    raw = F.aggregate(F.zip_with(good, weights, lambda a, w: F.when(a, w).otherwise(0)), F.lit(0), lambda s, x: s + x)
    normal = F.round(raw * 100.0 / sum(VENDOR_WEIGHTS)).cast("int")
    tier = F.when(normal >= 80, "low_risk").when(normal >= 50, "medium_risk").otherwise("high_risk")
    questions = F.array(*(F.lit(q) for q, _ in VENDOR_QUESTIONS))
    flagged = F.array_compact(F.zip_with(good, questions, lambda a, q: F.when(~a, q)))
    return F.struct(raw.alias("raw"), normal.alias("normalised"), tier.alias("tier"), flagged.alias("flagged"))


def nearest_rank(df: DataFrame, group: str, value: str, percents: tuple[int, ...] = (50, 95), buckets: int = 64) -> DataFrame:
    """Per group the number of values and those at nearest rank: the ceil(p * n /
    100)-th smallest; nulls count for neither.

    Approximate quantiles cut a group into buckets; their counts tell which buckets
    hold the ranks asked for, and only those are ranked, by counts of equal values."""
    df = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("x"))
    cuts = df.groupBy(F.col("g").alias("of")).agg(F.percentile_approx("x", [i / buckets for i in range(1, buckets)], 10_000).alias("cuts"))
    bucket = F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col("x")))
    counted = df.join(cuts, F.col("g").eqNullSafe(F.col("of"))).groupBy("g", bucket.alias("bucket"), "x").agg(F.count("*").alias("n"))
    over = Window.partitionBy("g")
    sizes = counted.groupBy("g", "bucket").agg(F.sum("n").alias("size"))
    placed = sizes.withColumns({"upto": F.sum("size").over(over.orderBy("bucket")), "all": F.sum("size").over(over)})
    asked = placed.withColumn("p", F.explode(F.array(*map(F.lit, percents)))).withColumn("target", F.ceil(F.col("p") * F.col("all") / 100))
    asked = asked.filter((F.col("target") <= F.col("upto")) & (F.col("target") > F.col("upto") - F.col("size")))
    asked = asked.select(F.col("g").alias("of"), F.col("bucket").alias("__bucket"), "p", "all", (F.col("target") - F.col("upto") + F.col("size")).alias("place"))
    ranked = counted.withColumn("rank", F.sum("n").over(Window.partitionBy("g", "bucket").orderBy("x")))
    found = ranked.join(asked, F.col("g").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("__bucket"))).filter(F.col("rank") >= F.col("place"))
    at = [F.min(F.when(F.col("p") == p, F.col("x"))).alias(f"p{p}") for p in percents]
    return found.groupBy(F.col("g").alias(group)).agg(F.max("all").alias("n"), *at)


def drift(reference: DataFrame, current: DataFrame, bins: int = 10, least: float = 1e-4) -> DataFrame:
    """dim, psi: population stability index of every embedding dimension, over
    equal bins between -1 and 1. Columns: embedding."""

    def binned(df: DataFrame, name: str) -> DataFrame:
        each = df.select(F.posexplode("embedding").alias("dim", "x"))
        place = F.least(F.greatest(F.floor((F.col("x").cast("double") + 1) / 2 * bins), F.lit(0)), F.lit(bins - 1))
        return each.groupBy("dim", place.cast("int").alias("bin")).agg(F.count("*").alias(name))

    sizes = reference.agg(F.count("*").alias("n_reference")).join(current.agg(F.count("*").alias("n_current")))
    both = binned(reference, "a").join(binned(current, "b"), ["dim", "bin"], "full").join(F.broadcast(sizes))
    p = F.greatest(F.coalesce("a", F.lit(0)) / F.col("n_reference"), F.lit(least))
    q = F.greatest(F.coalesce("b", F.lit(0)) / F.col("n_current"), F.lit(least))
    return both.groupBy("dim").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


#: Words that put a system's description in a tier, strictest first.
RISK_TIERS = (
    ("prohibited", "(?i)social scoring|subliminal|real-time biometric|exploits? vulnerab"),
    ("high", "(?i)hiring|recruit|credit scor|medical|exam|law enforcement|border|infrastructure"),
    ("limited", "(?i)chatbot|deepfake|emotion|generated (text|image|content)"),
)
#: Decisions about people that carry duties, and these duties.
CONSEQUENTIAL = "(?i)hiring|recruit|credit|lending|insurance|housing|education|health|legal"
OBLIGATIONS = ("notice", "explanation", "correction", "human_review", "records")


def risk_tier(description: Column) -> Column:
    """The strictest tier whose words occur; minimal without any."""
    tier = F.lit("minimal")
    for name, pattern in reversed(RISK_TIERS):
        tier = F.when(description.rlike(pattern), name).otherwise(tier)
    return tier


def obligations(description: Column) -> Column:
    """The duties of a covered system; none for others."""
    return F.when(description.rlike(CONSEQUENTIAL), F.array(*map(F.lit, OBLIGATIONS))).otherwise(F.array().cast("array<string>"))
