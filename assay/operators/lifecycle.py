"""Check lifecycle and definitions: registry syncs, versions, recent changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.outcomes import known_state
from assay.functions.text import collapse_whitespace
from assay.operators.ordered import HOT_ROWS, hot_keys, numbered, running


class NothingToSync(ValueError):
    """A project without checks would retire every check it ever had."""


def registry_sync(registry: DataFrame, loaded: DataFrame, now: Column) -> DataFrame:
    """The registry after a sync with the loaded checks, and what it `changed`.

    One row per check either side knows. A loaded check is as its file says
    (`wanted`), any other is retired, and `state_since` moves only with the
    state. `changed` is NULL for a check left as it was. Loading nothing at all is
    refused, see `refuse_empty`.
    """
    refuse_empty(registry, loaded)
    have = registry.select("check_id", "name", "dataset", "datasource", "state", "state_since")
    want = loaded.select(
        "check_id",
        *[F.col(c).alias(f"_{c}") for c in ("name", "dataset", "datasource")],
        F.when(F.col("enabled"), "active").otherwise("disabled").alias("wanted"),
    )
    both = have.join(want, "check_id", "full_outer")
    was, wanted = F.col("state"), F.coalesce("wanted", F.lit("retired"))
    changed = (
        F.when(was.isNull(), "added")
        .when(was == wanted, F.lit(None).cast("string"))
        .when(wanted == "retired", "retired")
        .when(was == "retired", "returned")
        .otherwise(F.when(wanted == "active", "enabled").otherwise("disabled"))
    )
    return both.select(
        "check_id",
        *[F.coalesce(c, f"_{c}").alias(c) for c in ("name", "dataset", "datasource")],
        wanted.alias("state"),
        F.when(was == wanted, F.col("state_since")).otherwise(now).alias("state_since"),
        changed.alias("changed"),
    )


def refuse_empty(registry: DataFrame, loaded: DataFrame) -> None:
    """Raise `NothingToSync` when nothing is loaded but checks are not retired."""
    if loaded.isEmpty() and not registry.where(F.col("state") != "retired").isEmpty():
        raise NothingToSync("the project has no checks; a sync would retire them all")


def retire_set(registry: DataFrame, loaded: DataFrame) -> DataFrame:
    """Registered checks that are not loaded and not retired yet."""
    return registry.where(F.col("state") != "retired").join(
        loaded.select("check_id"), "check_id", "left_anti"
    )


def register_on_result(registry: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The registry after results: a check with a result is active, and added
    when it was not known."""
    seen = results.select("check_id", "name", "dataset", "datasource").groupBy("check_id").agg(
        *[F.max(c).alias(f"_{c}") for c in ("name", "dataset", "datasource")],
        F.lit(True).alias("ran"),
    )
    both = registry.join(seen, "check_id", "full_outer")
    ran = F.coalesce("ran", F.lit(False))
    moves = ran & ~F.col("state").eqNullSafe("active")
    return both.select(
        "check_id",
        *[F.coalesce(c, f"_{c}").alias(c) for c in ("name", "dataset", "datasource")],
        F.when(ran, "active").otherwise(F.col("state")).alias("state"),
        F.when(moves, now).otherwise(F.col("state_since")).alias("state_since"),
    )


CLAUSES = "array<struct<key:string,expression:string,where:string,options:map<string,string>,sql_options:array<string>>>"


def definition_fingerprint(clauses: Column) -> Column:
    """A definition's identity: its clauses in key order, options in name order.

    White space is collapsed in `where` and in the options that are SQL, and
    kept where it is part of a value.
    """

    def option(clause: Column):
        return lambda entry: F.struct(
            entry["key"].alias("name"),
            F.when(
                F.array_contains(clause["sql_options"], entry["key"]),
                collapse_whitespace(entry["value"]),
            )
            .otherwise(entry["value"])
            .alias("value"),
        )

    def normal(clause: Column) -> Column:
        return F.struct(
            clause["key"].alias("key"),
            clause["expression"].alias("expression"),
            collapse_whitespace(clause["where"]).alias("where"),
            F.array_sort(F.transform(F.map_entries(clause["options"]), option(clause))).alias("options"),
            F.array_sort(clause["sql_options"]).alias("sql_options"),
        )

    return F.sha2(F.to_json(F.array_sort(F.transform(clauses, normal))), 256)


def definition_versions(recorded: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The versions a stream of recorded definitions makes.

    `recorded` holds `check_id, fingerprint, started_at, run_id`. A version
    begins where the fingerprint differs from the one before; going back to an
    old definition is a new version.
    """
    order = ("started_at", "run_id")
    fingerprint = F.col("fingerprint")
    by = ["check_id"]
    hot = hot_keys(recorded, by, "started_at", hot_rows)
    seen = running(recorded, by, order, newest={"latest": fingerprint}, hot=hot)
    starts = seen.where(~F.col("latest").eqNullSafe(fingerprint)).drop("latest")
    return numbered(starts, by, order, "version", hot).select(
        "check_id", "version", "fingerprint", F.col("started_at").alias("recorded_at"), "run_id"
    )


def definition_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Clauses added, removed or changed between two versions, matched by key.

    Both hold `check_id` and `clauses`. A changed clause comes with both texts.
    """

    def exploded(side: DataFrame, name: str) -> DataFrame:
        clause = F.col("clause")
        same_as = F.struct(
            clause["expression"].alias("expression"),
            clause["where"].alias("where"),
            F.array_sort(F.map_entries(clause["options"])).alias("options"),
        )
        return side.select("check_id", F.explode("clauses").alias("clause")).select(
            "check_id", clause["key"].alias("key"), same_as.alias(name)
        )

    both = exploded(before, "before").join(
        exploded(after, "after"), ["check_id", "key"], "full_outer"
    )
    kind = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.col("before") != F.col("after"), "changed")
    )
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull())


# At one moment, the later step of a check's story comes first.
STORY = {"added": 0, "redefined": 1, "enabled": 2, "disabled": 3, "retired": 4}


def check_changes(registry: DataFrame, definitions: DataFrame, limit: int) -> DataFrame:
    """The newest changes to checks: added, redefined, and lifecycle, newest first.

    Each source is cut to `limit` before they are merged.
    """

    def newest(rows: DataFrame, kind: Column, at: str, version: Column) -> DataFrame:
        cut = rows.orderBy(F.desc(at), F.desc("check_id")).limit(limit)
        return cut.select(
            "check_id", kind.alias("kind"), F.col(at).alias("at"), version.alias("version")
        )

    state = known_state(F.col("state"))
    moved = registry.where(
        (F.col("state") != "active") | (F.col("state_since") > F.col("registered_at"))
    )
    redefined = definitions.where(F.col("version") >= 2).join(
        registry.select("check_id"), "check_id", "left_semi"
    )
    none = F.lit(None).cast("int")
    lifecycle = F.when(state == "active", "enabled").otherwise(state)
    merged = (
        newest(registry, F.lit("added"), "registered_at", none)
        .unionByName(newest(moved, lifecycle, "state_since", none))
        .unionByName(
            newest(redefined, F.lit("redefined"), "recorded_at", F.col("version").cast("int"))
        )
    )
    step = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for k, i in STORY.items()])
    return merged.orderBy(F.desc("at"), step.desc(), F.desc("check_id")).limit(limit)
