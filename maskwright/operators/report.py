"""Report queries: summaries, paging, hunks, chains, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.store import written


def hunks(lines: DataFrame, key: str, context: int = 3) -> DataFrame:
    """Gaps and islands. lines: key, n (1-based), changed, total (lines of that key). Rows key, hunk, start, end:
    changed lines at most 2 * context + 1 apart share a hunk, which has `context` lines around, clipped to the text."""
    own = Window.partitionBy(key).orderBy("n")
    rows = lines.filter("changed").withColumn("_gap", F.col("n") - F.lag("n").over(own))
    rows = rows.withColumn("hunk", F.sum(F.when(F.col("_gap") <= 2 * context + 1, 0).otherwise(1)).over(own))
    return rows.groupBy(key, "hunk").agg(
        F.greatest(F.lit(1), F.min("n") - context).cast("long").alias("start"),
        F.least(F.max("total"), F.max("n") + context).cast("long").alias("end"),
    )


def page(report: DataFrame, statuses: tuple[str, ...], path: str, offset: int, limit: int, order: str, path_col: str) -> DataFrame:
    """Rows with one of the statuses and the text in their path, in any case, ordered; `total` counts before paging."""
    rows = report.filter(F.col("status").isin(*statuses)) if statuses else report
    rows = rows.filter(F.lower(path_col).contains(path.lower())) if path else rows
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(order).offset(max(0, offset)).limit(min(max(limit, 1), 5000)).crossJoin(F.broadcast(total))


def tail(rows: DataFrame, order: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(min(max(k, 1), 5000))


def latest(rows: DataFrame, group: str, value: str, ts: str) -> DataFrame:
    """The value with the greatest ts of each group, ties to the greater value: one aggregation, no sort."""
    return rows.groupBy(group).agg(F.max(F.struct(ts, value)).alias("m")).select(group, F.col(f"m.{value}").alias(value))


def time_in_phase(rows: DataFrame, key: str, phase: str, ts: str, out: str) -> DataFrame:
    """Microseconds from each row of a key to its next one, summed by phase."""
    after = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, phase))
    spent = rows.withColumn("_us", F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")))
    return spent.groupBy(key, phase).agg(F.coalesce(F.sum("_us"), F.lit(0)).cast("long").alias(out))


def nearest_ancestor(rows: DataFrame, key: str, parent: str, good: Column, depth: int | None = None) -> DataFrame:
    """Rows key, ancestor, depth: the nearest ancestor for which `good` holds, within `depth` links if that is given.

    Pointers double: an open row takes over what its ancestor points to, so a chain of n links takes about log2 n
    rounds. A missing parent ends a walk. A chain has no more links than there are rows, so what is open beyond that
    is a cycle and ends. Without `depth` no row is its own ancestor.
    """
    links = rows.select(F.col(key).alias("_key"), F.col(parent).alias("_at"), good.alias("_good"))
    parents = links.select(F.col("_key").alias("_to"), F.coalesce("_good", F.lit(False)).alias("_done"))
    jump = links.join(parents, F.col("_at") == F.col("_to")).select("_key", "_at", F.lit(1).cast("long").alias("_n"), "_done")
    jump, reach, size = written(jump, "chains"), 1, rows.count()
    while reach <= size and not jump.filter("not _done").isEmpty():
        ahead = jump.select(F.col("_key").alias("_to"), F.col("_at").alias("_next"), F.col("_n").alias("_more"), F.col("_done").alias("_there"))
        step = jump.filter("not _done").join(ahead, F.col("_at") == F.col("_to"))
        step = step.select("_key", F.col("_next").alias("_at"), (F.col("_n") + F.col("_more")).alias("_n"), F.col("_there").alias("_done"))
        jump, reach = written(jump.filter("_done").unionByName(step), "chains"), reach * 2
    found = jump.filter("_done").filter(F.col("_at") != F.col("_key") if depth is None else F.col("_n") <= depth)
    return found.select(F.col("_key").alias(key), F.col("_at").alias("ancestor"), F.col("_n").alias("depth"))


def chain_clear(rows: DataFrame, key: str, parent: str, busy: Column, depth: int | None = None) -> DataFrame:
    """Rows key, clear: whether no ancestor (within `depth` links, if given) is busy; a missing ancestor is clear."""
    hit = nearest_ancestor(rows, key, parent, busy, depth).select(F.col(key).alias("_hit"))
    return rows.join(hit, F.col(key) == F.col("_hit"), "left").select(key, F.col("_hit").isNull().alias("clear"))


def status_summary(files: DataFrame) -> DataFrame:
    """One row of conditional counts over status, changed, unexplained and leaks."""
    count = lambda c: F.count_if(c).cast("long")
    return files.agg(
        F.count("*").cast("long").alias("files_total"),
        *[count(F.col("status") == s).alias(s) for s in ("identical", "anonymized", "warning", "error")],
        F.coalesce(F.sum("changed"), F.lit(0)).cast("long").alias("changed_lines"),
        F.coalesce(F.sum("leaks"), F.lit(0)).cast("long").alias("leaks_total"),
        count(F.col("leaks") > 0).alias("files_with_leaks"),
    )


def member_differences(before: DataFrame, after: DataFrame, key: str, compared: tuple[str, ...]) -> DataFrame:
    """Full outer join on the key: status missing, extra, changed or same."""
    left = before.select(F.col(key).alias("_b"), F.struct(*compared).alias("_was"))
    right = after.select(F.col(key).alias("_a"), F.struct(*compared).alias("_is"))
    both = left.join(right, F.col("_b") == F.col("_a"), "full_outer")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").when(F.col("_was").eqNullSafe(F.col("_is")), "same").otherwise("changed")
    return both.select(F.coalesce("_b", "_a").alias(key), status.alias("status"))


def interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs as a start finds them: what was queued or running is interrupted."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "interrupted").otherwise(F.col("status")))


def quiet_for(log: DataFrame, key: str, ts: str, now: Column) -> DataFrame:
    """Seconds from the last row of each key to `now`: how long a job has said nothing."""
    return log.groupBy(key).agg(F.max(ts).alias("_last")).select(key, ((F.unix_micros(now) - F.unix_micros(F.col("_last").cast("timestamp"))) / 1e6).alias("quiet"))


def startable(jobs: DataFrame, key: str = "id", parent: str = "seed_from", status: str = "status") -> DataFrame:
    """Queued jobs whose ancestors are all at rest, the oldest first: what a queue would start next."""
    clear = chain_clear(jobs, key, parent, F.col(status).isin("queued", "running")).filter("clear").select(F.col(key).alias("_key"))
    return jobs.filter(F.col(status) == "queued").join(clear, F.col(key) == F.col("_key"), "left_semi").orderBy("created_at", key)


def device_of(name: Column) -> Column:
    """The device part of an archive's name: without suffix, dates, times and generic words."""
    own = F.regexp_replace(name, r"(?i)(\.tar\.gz|\.tgz|\.tar)$", "")
    own = F.regexp_replace(own, r"(?i)(^|[_\-. ])(?:20[0-9]{2}[_\-]?[0-9]{2}[_\-]?[0-9]{2}|[0-9]{4,6}|tsf|techsupport|tech-support|anon)(?=$|[_\-. ])", "")
    return F.trim(F.regexp_replace(own, r"^[_\-. ]+|[_\-. ]+$", ""))
