"""Step definitions, document classes, keys and flags: predicates, orders and rollups over their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as true in a setting.
TRUE = ["true", "1", "yes", "on"]
# Statuses as the interface names them.
STATUS = {"PENDING": "PENDING", "COMPLETED": "COMPLETED", "FAILED": "ERROR", "SKIPPED": "ERROR"}


def json_list(column: Column) -> Column:
    """A JSON array of strings; null where there is none or it is none."""
    return F.from_json(column, "array<string>")


def requiring(steps: DataFrame, variable: str) -> DataFrame:
    """Steps whose required variables hold one."""
    return steps.where(F.array_contains(json_list(F.col("required_variables")), variable))


def keys_state(keys: DataFrame, now: str) -> DataFrame:
    """Per key: valid (active, not revoked, not expired; no date never expires), and expired though active."""
    at = F.lit(now).cast("timestamp_ntz")
    late = F.coalesce(F.col("expires_at") < at, F.lit(False))
    return keys.select("id", (F.col("is_active") & ~F.col("is_revoked") & ~late).alias("is_valid"), (F.col("is_active") & late).alias("is_expired"))


def access(members: DataFrame, now: str) -> DataFrame:
    """Per member: banned (for good, or until later than now) and locked."""
    at = F.lit(now).cast("timestamp_ntz")
    later = lambda c: F.coalesce(F.col(c) > at, F.lit(False))
    return members.select("id", (F.col("banned_for_good") | later("banned_until")).alias("is_banned"), later("locked_until").alias("is_locked"))


def flags(settings: DataFrame, environment: dict[str, str], config: dict[str, bool], defaults: dict[str, bool]) -> DataFrame:
    """(feature, enabled, origin): the environment before the settings before the configuration before the default."""
    names = sorted({*environment, *config, *defaults})
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(environment.get(n)).cast("string").alias("e"), F.lit(config.get(n)).cast("boolean").alias("c"), F.lit(defaults.get(n)).cast("boolean").alias("d")) for n in names]))
    known = settings.sparkSession.range(1).select(pairs.alias("x")).select("x.*")
    true = lambda c: F.lower(c).isin(*TRUE)
    stored = settings.where(F.col("key").isin(*names)).groupBy("key").agg(F.min("value").alias("value"))
    found = known.join(stored, F.col("feature") == F.col("key"), "left")
    origin = F.when(F.col("e").isNotNull(), "environment").when(F.col("value").isNotNull(), "settings").when(F.col("c").isNotNull(), "config").otherwise("default")
    return found.select("feature", F.coalesce(true(F.col("e")), true(F.col("value")), "c", "d", F.lit(False)).alias("enabled"), origin.alias("origin"))


def api_status(status: Column, progress: Column) -> Column:
    """A job's status as the interface names it; running ones by their progress."""
    running = F.when(progress < 20, "EXTRACTING_TEXT").when(progress < 70, "TRANSLATING").otherwise("LANGUAGE_TRANSLATING")
    known = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return F.when(status == "RUNNING", running).otherwise(F.coalesce(F.get(F.transform(F.array(status), lambda x: F.try_element_at(known, x)), F.lit(0)), F.lit("PENDING")))


def reordered(steps: DataFrame, ids: list[int]) -> DataFrame:
    """Steps with the place of their id in a list, from 1, as their order; unknown ids and other steps keep theirs."""
    places = steps.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("at", "listed"))
    # a later place of an id overrides an earlier one
    places = places.groupBy("listed").agg((F.max("at") + 1).alias("place"))
    return steps.join(F.broadcast(places), F.col("id") == F.col("listed"), "left").withColumn("step_order", F.coalesce("place", "step_order")).drop("listed", "place")


def duplicated(steps: DataFrame, which: int, name: str) -> DataFrame:
    """The copy of a step: disabled, not branching, after the last one."""
    last = steps.agg(F.coalesce(F.max("step_order"), F.lit(0)).alias("last"))
    return steps.where(F.col("id") == which).crossJoin(F.broadcast(last)).select(F.lit(name).alias("name"), (F.col("last") + 1).alias("step_order"), F.lit(False).alias("enabled"), F.lit(False).alias("is_branching"), "class_id", "post_branching", "required_variables")


def phase(steps: DataFrame) -> Column:
    """1 before branching, 2 of a class, 3 after branching."""
    return F.when(F.col("post_branching"), 3).when(F.col("class_id").isNotNull(), 2).otherwise(1)


def branches(classes: DataFrame, steps: DataFrame) -> DataFrame:
    """(class_key, n_steps, steps): enabled classes with the names of their enabled steps in order; none: an empty list."""
    named = steps.where("enabled").groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("step_order", "id", "name"))).alias("s"))
    found = classes.where("is_enabled").join(named, F.col("class_id") == classes["id"], "left")
    return found.select("class_key", F.coalesce(F.size("s"), F.lit(0)).alias("n_steps"), F.coalesce(F.array_join(F.transform("s", lambda x: x["name"]), "|"), F.lit("")).alias("steps"))


def with_steps(classes: DataFrame, steps: DataFrame) -> DataFrame:
    """Whether each class has steps, which forbids its deletion; system classes may never go."""
    used = classes.join(steps, F.col("class_id") == classes["id"], "left_semi").select("class_key", F.lit(True).alias("used"))
    return classes.select("class_key", "is_system").join(used, "class_key", "left").select("class_key", F.coalesce("used", F.lit(False)).alias("has_steps"), (~F.col("is_system") & F.col("used").isNull()).alias("may_go"))


def most_used(executions: DataFrame, steps: DataFrame) -> DataFrame:
    """The name of the step run most, the least id of several; N/A where it is unknown or nothing ran."""
    top = executions.where("step_id is not null").groupBy("step_id").count().agg(F.max(F.struct("count", -F.col("step_id"))).alias("t")).select((-F.col("t.col2")).alias("id"))
    return top.join(steps.select("id", "name"), "id", "left").select(F.coalesce("name", F.lit("N/A")).alias("most_used_step"))


def class_statistics(classes: DataFrame) -> DataFrame:
    filled = lambda c: F.count_if(F.coalesce(F.size(json_list(F.col(c))), F.lit(0)) > 0)
    return classes.agg(
        F.count("*").alias("total"), F.count_if("is_enabled").alias("enabled"), F.count_if(~F.col("is_enabled")).alias("disabled"), F.count_if("is_system").alias("system"),
        F.count_if(~F.col("is_system")).alias("user"), filled("examples").alias("with_examples"), filled("strong_indicators").alias("with_strong"), filled("weak_indicators").alias("with_weak"),
    )


def configuration(steps: DataFrame) -> DataFrame:
    """Counts, and the names of enabled and of disabled steps in order, hashed."""
    names = lambda which: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("step_order", "id", "name")))), lambda x: x["name"]), "|"))
    return steps.agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"), names(F.col("enabled")).alias("enabled_names"), names(~F.col("enabled")).alias("disabled_names"))


def health(settings: DataFrame, prefix: str = "enable_") -> DataFrame:
    """Flags by prefix (its underscore stands for any character), those that are true, and their share in percent."""
    some = settings.where(F.col("key").like(prefix + "%"))
    on = F.count_if(F.lower("value") == "true")
    return some.agg(on.alias("enabled"), F.count("*").alias("total"), F.when(F.count("*") > 0, F.round(on / F.count("*") * 100, 1)).otherwise(0.0).alias("adoption"))


def interactions(logs: DataFrame) -> DataFrame:
    """Per step and in all (null step): runs, successes, errors, and the share of successes from 0 to 1."""
    n, ok = F.count("*"), F.count_if(F.col("status") == "success")
    return logs.rollup("app_id").agg(n.alias("total"), ok.alias("success"), F.count_if(F.col("status") == "error").alias("error"), F.round(F.when(n > 0, ok / n).otherwise(0.0), 6).alias("success_rate"))


def cache_statistics(logs: DataFrame, since: str) -> DataFrame:
    recent = F.count_if(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return logs.agg(F.count("*").alias("total"), recent.alias("active"), F.greatest(F.count("*") - recent, F.lit(0)).alias("expired"))


def document_details(priced: DataFrame, which: str) -> DataFrame:
    """A document's calls, oldest first, and as last row (no id) their summary."""
    some = priced.where(F.col("processing_id") == which)
    calls = some.select("id", "step_name", "total_tokens", F.round(F.coalesce("total_cost", F.lit(0.0)), 6).alias("cost"), F.lit(1).cast("long").alias("calls"))
    total = some.agg(F.lit(None).cast("long").alias("id"), F.lit("total").alias("step_name"), F.sum("total_tokens").alias("total_tokens"), F.round(F.coalesce(F.sum("total_cost"), F.lit(0.0)), 6).alias("cost"), F.count("*").alias("calls"))
    return calls.unionByName(total)


def filled_prompts(steps: DataFrame, values: dict[str, str]) -> DataFrame:
    """(id, prompt, error): a template with its variables in place; one that is missing is the step's error."""
    text = F.col("prompt_template")
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.lit(value))
    missing = F.regexp_extract(text, r"\{(\w+)\}", 1)
    return steps.select("id", F.when(missing == "", text).alias("prompt"), F.when(missing != "", F.concat(F.lit("missing variable: "), missing)).alias("error"))


def remaining(events: DataFrame, key: str, limits: list[tuple[str, int]], now: str) -> DataFrame:
    """Per key and window what is left of its quota at a time: limits(interval, most)."""
    at = F.lit(now).cast("timestamp_ntz")
    left = [F.greatest(F.lit(most) - F.count_if((F.col("created_at") > at - F.expr(f"interval {interval}")) & (F.col("created_at") <= at)), F.lit(0)).alias("left_" + interval.split()[1]) for interval, most in limits]
    return events.groupBy(key).agg(*left)


def first_urls(links: DataFrame, key: str, url: str, at: str) -> DataFrame:
    """Each url once per key, in the order of its first place."""
    first = links.groupBy(key, url).agg(F.min(at).alias("first"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("first"))).select(key, "pos", url)
