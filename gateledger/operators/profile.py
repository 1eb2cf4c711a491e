"""One person's record across surfaces: merge-time attempts and dev-time events.

The join key is the numeric user id; a null id never matches anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def surface_union(attempts: DataFrame, local_events: DataFrame) -> DataFrame:
    """One timeline over both surfaces, tagged ``merge`` or ``dev``."""
    merge = attempts.select(
        F.lit("merge").alias("surface"),
        F.col("reviewer_id").alias("github_id"),
        F.col("reviewer_login").alias("github_login"),
        F.col("grade_pass").alias("passed"),
        *(c for c in ("id", "checkpoint_id", "assisted", "ungraded", "overlap", "created_at") if c in attempts.columns),
    )
    kept = ("id", "github_id", "github_login", "email", "subsystem", "concept", "assisted", "told", "passed", "ungraded", "overlap", "created_at")
    dev = local_events.select(F.lit("dev").alias("surface"), *(c for c in kept if c in local_events.columns))
    return merge.unionByName(dev, allowMissingColumns=True)


def users_from_events(attempts: DataFrame, local_events: DataFrame) -> DataFrame:
    """Identities from whichever surface saw a person first; login and email are the latest known."""
    seen = surface_union(attempts, local_events).filter(F.col("github_id").isNotNull())
    if "email" not in seen.columns:
        seen = seen.withColumn("email", F.lit(None).cast("string"))

    def latest(name: str):
        # Ties on time fall to the greater id, so reruns agree.
        known = F.when(F.col(name).isNotNull(), F.struct("created_at", "id"))
        return F.max_by(name, known).alias(name)

    return seen.groupBy("github_id").agg(
        latest("github_login"),
        latest("email"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )


def profile_join(users: DataFrame, attempts: DataFrame, local_events: DataFrame) -> DataFrame:
    """Per person: attempts and passes at merge time, events and passes at dev time.

    Each side is summed per person before it is joined.
    """

    def summed(df: DataFrame, key: str, passed: str, names: tuple[str, str]) -> DataFrame:
        known = df.filter(F.col(key).isNotNull())
        hits = F.count_if(F.coalesce(F.col(passed), F.lit(False)))
        return known.groupBy(F.col(key).alias("github_id")).agg(
            F.count("*").alias(names[0]), hits.alias(names[1])
        )

    merge = summed(attempts, "reviewer_id", "grade_pass", ("attempts", "attempts_passed"))
    dev = summed(local_events, "github_id", "passed", ("local_events", "local_passed"))
    people = users.filter(F.col("github_id").isNotNull()).select("github_id", "github_login")
    joined = people.join(merge, "github_id", "full_outer").join(dev, "github_id", "full_outer")
    zero = F.lit(0)
    return joined.select(
        "github_id",
        "github_login",
        *(F.coalesce(c, zero).alias(c) for c in ("attempts", "attempts_passed", "local_events", "local_passed")),
    )
