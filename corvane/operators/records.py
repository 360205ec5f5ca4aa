"""Stories with steps, agents, research sources, tags and patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import normalize_path
from ..naming import free_name


def with_steps(stories: DataFrame, steps: DataFrame, key: str, order: list[str]) -> DataFrame:
    """stories with their steps as an ordered array; an empty one without steps."""
    rest = [c for c in steps.columns if c != key and c not in order]
    nested = steps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("steps"))
    return stories.join(nested, key, "left").withColumn("steps", F.coalesce("steps", F.array().cast(nested.schema["steps"].dataType)))


def stories_of(stories: DataFrame, status: str | None = None, repository: str | None = None) -> DataFrame:
    """Stories by status and repository; stored paths are normalised too, and the given one may hold wildcards."""
    df = stories if status is None else stories.filter(F.col("status") == status)
    if repository is not None:
        df = df.filter(F.ilike(F.lower(F.replace("repository_path", F.lit("\\"), F.lit("/"))), normalize_path(F.lit(repository))))
    return df


def pending_steps(steps: DataFrame) -> DataFrame:
    return steps.filter((F.col("status") == "Pending") | F.coalesce(F.col("needs_rework"), F.lit(False)))


def wave_summary(steps: DataFrame) -> DataFrame:
    """Per story: its waves, the next order, and whether all steps are done."""
    done = F.col("status").isin("Completed", "Skipped")
    return steps.groupBy("story_id").agg(F.max("wave").alias("waves"), (F.max("order") + 1).alias("next_order"), F.every(done).alias("complete"))


def schedule_wave(stories: DataFrame, steps: DataFrame) -> DataFrame:
    """(story_id, wave, step_ids, prior_done, action): what a story's current wave has to run; one with nothing pending moves on by one wave."""
    s = steps.join(stories.select("story_id", "current_wave"), "story_id")
    pending = F.col("status") == "Pending"
    now = F.col("wave") == F.col("current_wave")
    df = s.groupBy("story_id", "current_wave").agg(
        F.sort_array(F.collect_list(F.when(now & pending, F.col("step_id")))).alias("step_ids"),
        F.every(F.when(F.col("wave") < F.col("current_wave"), F.col("status").isin("Completed", "Skipped")).otherwise(True)).alias("prior_done"),
        F.max("wave").alias("waves"),
    )
    empty = F.size("step_ids") == 0
    action = F.when(~F.col("prior_done"), "blocked").when(~empty, "run").when(F.col("current_wave") >= F.col("waves"), "finished").otherwise("advance")
    return df.select("story_id", F.when(action == "advance", F.col("current_wave") + 1).otherwise(F.col("current_wave")).alias("wave"), "step_ids", "prior_done", action.alias("action"))


def verification_summary(results: DataFrame) -> DataFrame:
    """(build, tests, style) failures and required failures of rows (step_type, success, required)."""
    bad = ~F.col("success")
    k = F.col("step_type")
    return results.agg(
        F.count_if(bad & (k == "build")).alias("build_failures"),
        F.count_if(bad & (k == "test")).alias("test_failures"),
        F.count_if(bad & k.isin("lint", "format")).alias("style_failures"),
        F.count_if(bad & F.col("required")).alias("required_failures"),
        F.count_if(F.col("success")).alias("passed"),
    )


def tagged(rows: DataFrame, tags: list[str], column: str = "tags", any_case: bool = False) -> DataFrame:
    """Rows that share a tag with the list; an empty list selects all."""
    if not tags:
        return rows
    own: Column = F.transform(column, lambda t: F.lower(t)) if any_case else F.col(column)
    return rows.filter(F.arrays_overlap(own, F.array(*[F.lit(t.lower() if any_case else t) for t in tags])))


def capable_agents(agents: DataFrame, capability: str, language: str | None = None) -> DataFrame:
    """Agents with a capability, in any case, that take a language or any, by priority."""
    df = agents.filter(F.exists("capabilities", lambda c: F.lower(c) == capability.lower()))
    if language is not None:
        takes = F.exists(F.coalesce("languages", F.array().cast("array<string>")), lambda x: F.lower(x) == language.lower())
        df = df.filter(F.col("languages").isNull() | (F.size("languages") == 0) | takes)
    return df.orderBy("priority", "agent_id")


def best_agent(agents: DataFrame, capability: str) -> DataFrame:
    """The best by tier: the capability itself, its `prefix:*`, its prefix; then by priority and id."""
    prefix = capability.lower().split(":")[0]
    tiers = [capability.lower(), *([f"{prefix}:*", prefix] if ":" in capability else [])]
    low = F.transform("capabilities", lambda c: F.lower(c))
    tier = F.coalesce(*[F.when(F.array_contains(low, t), k) for k, t in enumerate(tiers)])
    return agents.withColumn("tier", tier).filter("tier IS NOT NULL").orderBy("tier", "priority", "agent_id").limit(1)


def sources_with_excerpts(sources: DataFrame, excerpts: DataFrame, key: str = "source_id") -> DataFrame:
    return sources.join(excerpts, key, "left")


def excerpts_in_order(excerpts: DataFrame, source_id: Column | str) -> DataFrame:
    """A source's excerpts by page and time, those without a page last."""
    return excerpts.filter(F.col("source_id") == source_id).orderBy(F.asc_nulls_last("page"), F.asc_nulls_last("created_at"))


def filter_sources(sources: DataFrame, source_type: str | None = None, status: str | None = None, tags: list[str] | None = None) -> DataFrame:
    df = sources
    if source_type is not None:
        df = df.filter(F.col("source_type") == source_type)
    if status is not None:
        df = df.filter(F.col("status") == status)
    return tagged(df, tags or [])


def federated_search(results: list[DataFrame], limit: int) -> DataFrame:
    """All fetchers' rows together, repeats kept, by citations with none as 0."""
    return reduce(DataFrame.unionByName, results).orderBy(F.coalesce("citation_count", F.lit(0)).desc(), "title", "source_id").limit(limit)


def vanished(before: DataFrame, after: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """Ids that were there and no longer are, without fixed ones."""
    out = before.select("id").subtract(after.select("id"))
    return out if fixed is None else out.subtract(fixed.select("id"))


def resolve_overlays(base: DataFrame, overlays: DataFrame) -> DataFrame:
    """(name, languages, has_base): patterns with the languages that adapt them, and adaptions of none."""
    langs = overlays.groupBy("name").agg(F.sort_array(F.collect_set("language")).alias("languages"))
    with_base = base.select("name").distinct().join(langs, "name", "left").select("name", F.coalesce("languages", F.array().cast("array<string>")).alias("languages"), F.lit(True).alias("has_base"))
    alone = langs.join(base.select("name"), "name", "left_anti").select("name", "languages", F.lit(False).alias("has_base"))
    return with_base.unionByName(alone)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; null keys are one key."""
    place = free_name(rows, "place")
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(place) == 1).drop(place)


def latest(rows: DataFrame, keys: list[str], time_col: str, *ties: Column | str) -> DataFrame:
    """The latest row of each key; of equal times the first by ties."""
    return first_per_key(rows, keys, [F.desc(time_col), *ties])


def newest(rows: DataFrame, time_col: str, limit: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows by time, the newest first and those without a time before all, up to a limit if one is given."""
    df = rows.orderBy(F.desc_nulls_first(time_col), *ties)
    return df if limit is None else df.limit(limit)


def by_id(rows: DataFrame, key: str, value: object) -> DataFrame:
    return rows.filter(F.col(key) == value)


def token_estimate(rows: DataFrame, text_col: str) -> DataFrame:
    """One row: a quarter of all characters, rounded down, as the number of tokens."""
    return rows.agg(F.floor(F.coalesce(F.sum(F.length(text_col)), F.lit(0)) / 4).cast("long").alias("tokens"))


def kind_weight(kind: Column) -> Column:
    """How much a kind of symbol weighs in a search."""
    weights = {"Interface": 100, "Class": 90, "Enum": 85, "Record": 80, "Struct": 75, "Method": 50, "Property": 40}
    out = F.lit(0)
    for name, w in weights.items():
        out = F.when(kind == name, w).otherwise(out)
    return out
