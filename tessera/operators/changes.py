"""Change sets: what differs between two listings, and which agents it concerns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.substrings import pairs
from tessera.session import materialize

#: Other names of agents, agents for files that no module lists, and agents that follow any research agent.
AGENT_NAMES = {
    "Overview": ("Project Overview", "OverviewEditor"),
    "Architecture": ("Architecture Description", "ArchitectureEditor"),
    "Workflow": ("Core Workflows", "WorkflowEditor"),
    "Boundary": ("Boundary Interfaces", "BoundaryEditor"),
    "Database": ("Database Overview", "DatabaseEditor"),
}
UNLISTED = ("SystemContextResearcher", "DomainModulesDetector")
FOLLOWERS = ("Overview", "Architecture", "Workflow", "Boundary", "Database", "KeyModulesInsight")
RESEARCH = "Researcher|Detector|Analyzer|Insight"
REBUILD_RATIO = 0.3


def apply_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """The stored listing after a snapshot: rows that are gone go, the rest is as the snapshot has it."""
    kept = old.join(new.select("path"), "path", "left_semi").select("path").join(new, "path")
    return kept.unionByName(new.join(old.select("path"), "path", "left_anti"))


def symmetric_difference(cached: DataFrame, current: DataFrame) -> DataFrame:
    """(path, side) of what only one listing has."""
    joined = cached.select("path", F.lit(True).alias("c")).join(current.select("path", F.lit(True).alias("n")), "path", "full_outer")
    return joined.where("c IS NULL OR n IS NULL").select("path", F.when(F.col("n").isNull(), "cached").otherwise("current").alias("side"))


def name_status(lines: DataFrame) -> DataFrame:
    """(file, change) from lines of a name-status listing; a rename is a removal and an addition."""
    parts = F.transform(F.split("line", "\t"), lambda x: F.trim(x))
    rows = lines.select(parts.alias("p")).where(F.size("p") > 1)
    one = lambda i, change: F.struct(F.get("p", F.lit(i)).alias("file"), F.lit(change).alias("change"))
    status = F.get("p", F.lit(0))
    pairs = (
        F.when(F.startswith(status, F.lit("R")) & (F.size("p") > 2), F.array(one(1, "removed"), one(2, "added")))
        .when(status == "A", F.array(one(1, "added")))
        .when(status == "D", F.array(one(1, "removed")))
        .otherwise(F.array(one(1, "changed")))
    )
    return rows.select(F.explode(pairs).alias("x")).select("x.file", "x.change")


def agent_name(agent: Column) -> Column:
    name = F.when(F.contains(agent, F.lit("KeyModulesInsight")), "KeyModulesInsight")
    for to, names in AGENT_NAMES.items():
        name = name.when(agent.isin(*names), to)
    return name.otherwise(agent)


def affected_agents(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(agent): of modules (agent, input) whose input holds a changed file's name or is held by it, and those that follow."""
    names, inputs = files.select(F.col("file").alias("hay")), modules.select(F.col("input").alias("hay"))
    turned = lambda rows: rows.select(F.col("hay").alias("needle"))
    holds = pairs(turned(inputs), names).select(F.col("hay").alias("file"), F.col("needle").alias("input"))
    held = pairs(turned(names), inputs).select(F.col("needle").alias("file"), F.col("hay").alias("input"))
    met = materialize(holds.unionByName(held).distinct(), "met")
    hit = met.join(modules, "input").select("file", agent_name(F.col("agent")).alias("agent"))
    lost = files.join(hit.select("file"), "file", "left_anti").select(F.explode(F.array(*map(F.lit, UNLISTED))).alias("agent"))
    direct = hit.select("agent").unionByName(lost).distinct()
    after = direct.where(F.rlike("agent", F.lit(RESEARCH))).select(F.explode(F.array(*map(F.lit, FOLLOWERS))).alias("agent"))
    return direct.unionByName(after).distinct()


def rebuild(files: DataFrame, modules: DataFrame) -> DataFrame:
    """One row: changes, tracked files, and whether the share of changes asks for a full rebuild."""
    tracked = modules.agg(F.countDistinct("input").alias("tracked"))
    return files.agg(F.count("*").alias("changes")).join(F.broadcast(tracked)).select("changes", "tracked", F.coalesce(F.try_divide(F.col("changes"), F.col("tracked")) > REBUILD_RATIO, F.lit(False)).alias("full_rebuild"))


def module_digests(modules: DataFrame) -> DataFrame:
    """(agent, n, digest) over a module's inputs in order."""
    return modules.groupBy("agent").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("input")), "\n"), 256).alias("digest"))
