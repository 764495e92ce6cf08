"""Edits of uploaded datasets, and row-level changes of tables as joins."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: What an update may say of a column, and the attribute of the column that it sets.
ATTRIBUTES = {"deleted": "deleted", "dtype": "dtype", "role": "role", "new_name": "name"}


def settings(update: dict):
    """(attribute, value) of an update; a deletion says nothing else."""
    said = {"deleted": True} if update.get("deleted") else {k: v for k, v in update.items() if v}
    return [(attribute, said[field]) for field, attribute in ATTRIBUTES.items() if field in said]


def plan_updates(columns: list[dict], updates: list[dict]) -> dict:
    """What updates (name, new_name, dtype, role, deleted) make of the columns' metadata: the end state
    is folded first and then compared with the start. Updates of unknown columns do nothing; a rename
    onto a known name is an error; `applied` counts updates that changed something."""
    start = {c["name"]: {"deleted": False, **c} for c in columns}
    end = {name: dict(c) for name, c in start.items()}
    effective = set()
    for at, update in enumerate(u for u in updates if u["name"] in start):
        state = end[update["name"]]
        for attribute, value in settings(update):
            if attribute == "name" and value != update["name"] and value in start:
                raise ValueError(f"'{update['name']}' cannot take the name of column '{value}'")
            if state.get(attribute) != value:
                state[attribute] = value
                effective.add(at)
    changed = lambda attribute: {n: c[attribute] for n, c in end.items() if c.get(attribute) != start[n].get(attribute)}
    kept = [{k: v for k, v in c.items() if k != "deleted"} for c in end.values() if not c["deleted"]]
    return {"dropped": list(changed("deleted")), "renames": changed("name"), "dtypes": changed("dtype"), "applied": len(effective), "columns": kept}


def apply_plan(df: DataFrame, plan: dict) -> DataFrame:
    """Drops, renames, then retypes: numbers where they parse, else null; or text."""
    out = df.drop(*plan["dropped"]).withColumnsRenamed(plan["renames"])
    kinds = {plan["renames"].get(c, c): k for c, k in plan["dtypes"].items()}
    return out.withColumns({c: F.col(c).try_cast("double") if k == "numeric" else F.col(c).cast("string") for c, k in kinds.items() if c in out.columns})


def apply_edits(df: DataFrame, edits: DataFrame, row: str = "row_index", order: str = "ord") -> DataFrame:
    """Cell edits (row, column, value, order): the last of a cell counts. Unknown columns and rows raise,
    and so do edits without an order of which two are of one cell."""
    names = [c for c in df.columns if c != row]
    odd = edits.join(df.select(row, F.lit(True).alias("_there")), row, "left").where(F.col("_there").isNull() | ~F.col("column").isin(*names)).limit(1).collect()
    if odd:
        raise ValueError(f"no such cell: {odd[0].asDict()}")
    if order not in edits.columns:
        twice = edits.groupBy(row, "column").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"no order of the edits of a cell: {twice[0].asDict()}")
        edits = edits.withColumn(order, F.lit(0))
    cells = edits.groupBy(row, "column").agg(F.max_by("value", order).alias("value"))
    last = cells.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_e"))
    out = df.join(last, row, "left")
    new = lambda c, t: F.when(F.map_contains_key("_e", F.lit(c)), F.col("_e")[c].try_cast(t)).otherwise(F.col(c)) if c != row else F.col(c)
    return out.select([F.when(F.col("_e").isNull(), F.col(c)).otherwise(new(c, t)).alias(c) for c, t in df.dtypes])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose keys new lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def remove(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def refreshed_stats(df: DataFrame) -> DataFrame:
    from .stats import column_types

    return column_types(df).select("name", "missing_count", "unique_count")


def text_segments(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """segment_id, text: known values of the text columns, one row each."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("text")) for c in columns])
    return df.select(F.col(key), F.explode(pairs).alias("p")).where("p.text is not null").select(F.concat_ws(":", F.col(key).cast("string"), "p.c").alias("segment_id"), "p.text")


def failed_stale(jobs: DataFrame, cutoff, error: str = "timed out") -> DataFrame:
    """Active jobs last updated before cutoff become failed."""
    stale = F.col("status").isin("pending", "running") & (F.col("updated_at") < cutoff)
    return jobs.withColumns({"error": F.when(stale, error).otherwise(F.col("error")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def next_status(old, new):
    """A cancelled job stays cancelled."""
    return F.when(F.col(old) == "cancelled", "cancelled").otherwise(F.col(new))


def clipped(c, most: int = 500):
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(F.col(c))
