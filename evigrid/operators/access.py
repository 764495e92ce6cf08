"""Who may see, start and stop what: jobs and shared rows, looked up by joins."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import dealt

ACTIVE = ("pending", "running")


def with_conflicts(requests: DataFrame, jobs: DataFrame, scope: list[str], job: str = "job") -> DataFrame:
    """requests with conflict: whether an active job, not the request's own, has its scope.

    jobs(job, status, scope...); columns of scope that are null on both sides are alike.
    """
    busy = jobs.where(F.col("status").isin(*ACTIVE)).groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"), F.min(job).alias("_one"))
    same = [requests[c].eqNullSafe(busy[c]) for c in scope]
    on = same[0]
    for x in same[1:]:
        on = on & x
    met = requests.join(busy, on, "left").drop(*[busy[c] for c in scope])
    others = F.coalesce("_n", F.lit(0)) - F.when(F.col("_one") == F.col(job), 1).otherwise(0)
    return met.withColumn("conflict", others > 0).drop("_n", "_one")


def job_answers(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """request, found, status_after, abort for requests(request, job, user, cancel) on jobs(job, user, status).

    A job of another user is not found. Cancelling an active job makes it cancelled, any other keeps its
    status. abort: a runner asking about the job, whoever owns it, should stop: it is cancelled now or gone.
    """
    met = requests.join(jobs.select("job", F.col("user").alias("_owner"), "status"), "job", "left")
    found = F.coalesce(F.col("_owner") == F.col("user"), F.lit(False))
    after = F.when(found, F.when(F.col("cancel") & F.col("status").isin(*ACTIVE), "cancelled").otherwise(F.col("status")))
    return met.select("request", found.alias("found"), after.alias("status_after"), (F.col("status").isNull() | (F.coalesce(after, F.col("status")) == "cancelled")).alias("abort"))


def visible(rows: DataFrame, members: DataFrame, id_: str) -> DataFrame:
    """user, row id, role: rows(id, owner, team) that each user may read: their own, and those of teams that
    members(team, user, role) puts them in. An owner's role is owner, whatever the team says.

    A team's rows times its members may be far more than either, so pairs are made where they are given out:
    each member is in a team once, and only pairs of ids that stand in several rows need to be brought together.
    """
    own = rows.where("owner is not null").select(F.col("owner").alias("user"), id_, F.lit("owner").alias("role"))
    of = members.where("team is not null").groupBy("team", "user").agg(F.min("role").alias("role"))
    shared = rows.where("team is not null").select(id_, "team", F.col("owner").alias("_owner"))
    sizes = shared.groupBy("team").agg(F.count(F.lit(1)).alias("r")).join(of.groupBy("team").agg(F.count(F.lit(1)).alias("m")), "team")
    pairs = sizes.agg(F.sum(F.col("r").cast("double") * F.col("m"))).first()[0] or 0.0
    again = shared.groupBy(id_).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_)

    def met(some):
        both = dealt(some, of, "team", pairs)
        return both.where(~F.col("user").eqNullSafe(F.col("_owner"))).select("user", id_, "role")

    if again.isEmpty():
        return own.unionByName(met(shared))
    several = met(shared.join(again, id_, "left_semi")).groupBy("user", id_).agg(F.min("role").alias("role"))
    return own.unionByName(met(shared.join(again, id_, "left_anti"))).unionByName(several)


def projected(rows: DataFrame, metadata: str, path: str, fields: dict[str, str]) -> DataFrame:
    """rows with the fields of one object inside a JSON column, typed; null where the text is no JSON, has no
    such object or no such field. Only the fields named are parsed."""
    kind = ", ".join(f"{name} {t}" for name, t in fields.items())
    inner = F.from_json(F.get_json_object(F.col(metadata), path), kind)
    return rows.withColumn("_j", inner).select(*rows.columns, *[F.col("_j")[name].alias(name) for name in fields]).drop(metadata)
