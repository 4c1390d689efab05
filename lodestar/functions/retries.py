"""Schedules of attempts: what a call does after each outcome, by its policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Seconds to wait after an outcome, and how often each kind is tried again; a backoff of
    (first, factor, most) grows with every retry."""

    rate_limit: tuple[float, float, float]
    transient: tuple[float, float, float]
    rate_limit_retries: int
    transient_retries: int


# Batches are patient, questions are quick, descriptions are classified with growing waits.
INGESTION = Policy((25, 1, 25), (5, 1, 5), 3, 3)
QUERY = Policy((0, 1, 0), (3, 1, 3), 0, 1)
CLASSIFY = Policy((60, 1, 60), (2, 2, 30), 4, 4)
SCHEDULE = "struct<attempts:int,waited:double,result:string>"


def schedule(outcomes: Column, policy: Policy) -> Column:
    """A struct (attempts, waited, result) of a call whose attempts end as outcomes says, in
    order: ok, rate_limited or transient (anything else fails for good). result is ok, what the
    last allowed attempt ended with, or pending if another attempt is due."""
    rate, transient = F.lit(0), F.lit(0)
    begin = F.struct(rate.alias("rate"), transient.alias("transient"), F.lit(0).alias("attempts"), F.lit(0.0).alias("waited"), F.lit("pending").alias("result"))

    def wait(backoff: tuple[float, float, float], retries: Column) -> Column:
        first, factor, most = backoff
        return F.least(F.lit(float(most)), F.lit(float(first)) * F.pow(F.lit(float(factor)), retries))

    def step(s: Column, x: Column) -> Column:
        limited, hung = x == "rate_limited", x == "transient"
        again = (limited & (s.rate < policy.rate_limit_retries)) | (hung & (s.transient < policy.transient_retries))
        waited = F.when(~again, 0.0).when(limited, wait(policy.rate_limit, s.rate)).otherwise(wait(policy.transient, s.transient))
        return F.when(s.result != "pending", s).otherwise(F.struct(
            (s.rate + (limited & again).cast("int")).alias("rate"), (s.transient + (hung & again).cast("int")).alias("transient"), (s.attempts + 1).alias("attempts"),
            (s.waited + waited).alias("waited"), F.when(again, "pending").otherwise(x).alias("result"),
        ))

    told = F.aggregate(F.transform(outcomes, lambda x: F.coalesce(x, F.lit("failed"))), begin, step)
    return F.struct(told["attempts"].alias("attempts"), told["waited"].alias("waited"), told["result"].alias("result"))
