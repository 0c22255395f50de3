"""Model registry operators: champion, best-so-far, replay updates, pruning.

The registry holds one evaluation record per trigger. What runs over its
history (best so far, champion timeline) is a distributed prefix scan
(``sequence.running_max``), so a task with millions of records spreads over
partitions. Records carry ``task, version, avg_f1`` and an ordering ``key``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.sequence import running_max, seeded_hash


def best_so_far(reg: DataFrame, order: str = "key", value: str = "avg_f1",
                task: str | None = "task") -> DataFrame:
    """``is_update``: the value beats every earlier value (the first record never does)."""
    b = running_max(reg, order, F.col(value), "_best", [task] if task else [], inclusive=False)
    return b.withColumn("is_update", F.coalesce(F.col(value) > F.col("_best"), F.lit(False))).drop("_best")


def replay_updates(reg: DataFrame, m: int, order: str = "key", value: str = "avg_f1",
                   task: str | None = "task") -> DataFrame:
    """Flags of replay triggers and the split of updates into replay / ordinary.

    Version 1 is the start model; version v > 1 comes from trigger v - 1,
    which is a replay trigger when (v - 1) is a multiple of ``m``.
    """
    b = best_so_far(reg, order, value, task)
    is_replay = (F.col("version") > 1) & ((F.col("version") - 1) % m == 0)
    return (b.withColumn("is_replay", is_replay)
             .withColumn("replay_update", F.col("is_update") & F.col("is_replay"))
             .withColumn("ordinary_update", F.col("is_update") & ~F.col("is_replay")))


def version_sets(reg: DataFrame, m: int, order: str = "key", value: str = "avg_f1") -> DataFrame:
    """Set algebra of versions: updates that are replays, and the other updates.

    ``intersect`` and ``subtract`` have set semantics, as in the original.
    """
    r = replay_updates(reg, m, order, value)
    updates = r.where("is_update").select("task", "version")
    replays = r.where("is_replay").select("task", "version")
    both = updates.intersect(replays).withColumn("kind", F.lit("replay_update"))
    only = updates.subtract(replays).withColumn("kind", F.lit("ordinary_update"))
    rest = replays.subtract(updates).withColumn("kind", F.lit("replay_no_update"))
    return both.unionByName(only).unionByName(rest)


def champion_timeline(reg: DataFrame, order: str = "key", value: str = "avg_f1",
                      task: str | None = "task") -> DataFrame:
    """After each record: the version with the best value so far (ties -> lowest version)."""
    rank = F.struct(F.col(value).alias("value"), (-F.col("version")).alias("low"), F.col("version").alias("version"))
    b = running_max(reg, order, rank, "_best", [task] if task else [], inclusive=True)
    return b.withColumn("champion", F.col("_best.version")).drop("_best")


def best_version(reg: DataFrame, value: str = "avg_f1", task: str | None = "task") -> DataFrame:
    """Best record per task by ``value``; ties -> lowest version."""
    keys = [task] if task else []
    return reg.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in reg.columns]),
                 F.struct(F.col(value), -F.col("version"))).alias("r")).select("r.*")


def registry_history(reg: DataFrame, order: str = "key", task: str = "task") -> DataFrame:
    """Per task: record count, newest and oldest version, and the next version number."""
    return reg.groupBy(task).agg(
        F.count(F.lit(1)).alias("records"),
        F.max_by("version", order).alias("newest_version"),
        F.min_by("version", order).alias("oldest_version"),
        (F.max_by("version", order) + 1).alias("next_version"))


def next_version(reg: DataFrame, order: str = "key", task: str = "task") -> DataFrame:
    return registry_history(reg, order, task).select(task, "next_version")


def registry_prune(reg: DataFrame, artefacts: DataFrame, on=("task", "version")) -> tuple[DataFrame, DataFrame]:
    """Split records into (kept: with a saved artefact, removed: without one)."""
    on = list(on)
    return reg.join(artefacts, on, "left_semi"), reg.join(artefacts, on, "left_anti")


def best_servable_version(reg: DataFrame, artefacts: DataFrame, value: str = "avg_f1") -> DataFrame:
    """Best record per task among those whose artefact exists."""
    kept, _ = registry_prune(reg, artefacts)
    return best_version(kept, value)


def upsert_latest(base: DataFrame, changes: DataFrame, keys, order: str) -> DataFrame:
    """Keyed state after applying ``changes`` to ``base``: the latest row per key.

    ``max_by`` is a partial aggregate, so a key holding a large share of the
    rows is reduced on the map side before the shuffle.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    u = base.withColumn("_src", F.lit(0)).unionByName(changes.withColumn("_src", F.lit(1)))
    rest = [c for c in base.columns if c not in keys]
    # of equal order values the change wins
    latest = u.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("_src"))).alias("_r"))
    return latest.select(*keys, "_r.*")


def delete_keys(base: DataFrame, keys_df: DataFrame, on) -> DataFrame:
    """``base`` without the rows whose key appears in ``keys_df``."""
    return base.join(keys_df, on, "left_anti")


def early_stop(epochs: DataFrame, epoch: str = "epoch", loss: str = "loss", patience: int = 5) -> DataFrame:
    """Keep the epoch when its loss beats the best so far; stop after ``patience`` misses.

    Output per epoch: ``improved``, ``since_best`` (epochs since the last
    improvement) and ``stop`` (true on the first epoch where training ends).
    """
    w = Window.orderBy(epoch)
    prev_best = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = epochs.withColumn("improved", F.coalesce(F.col(loss) < prev_best, F.lit(True)))
    last_imp = F.max(F.when(F.col("improved"), F.col(epoch))).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    e = e.withColumn("since_best", (F.col(epoch) - last_imp).cast("int"))
    first_stop = F.min(F.when(F.col("since_best") >= patience, F.col(epoch))).over(Window.partitionBy())
    return e.withColumn("stop", F.coalesce(F.col(epoch) == first_stop, F.lit(False)))


def latest_epoch(names: DataFrame, name: str = "name", pattern: str = r"^(.*)_(\d+)\.[^.]+$",
                 prefix: str | None = None) -> DataFrame:
    """Newest epoch parsed out of checkpoint file names like ``model_12.pt``.

    Without ``prefix``: one row per name prefix. With ``prefix``: a single
    row for the files whose name starts with it (0 when there is none), the
    number being the digits after the last ``_`` and before the first ``.``.
    """
    if prefix is not None:
        last = F.element_at(F.split(F.col(name), "_"), -1)
        epoch = F.regexp_extract(last, r"^(\d+)\.", 1)
        hits = names.where(F.startswith(F.col(name), F.lit(prefix)) & (epoch != ""))
        return hits.agg(F.coalesce(F.max(epoch.cast("long")), F.lit(0).cast("long")).alias("latest_epoch")) \
                   .select(F.lit(prefix).alias("prefix"), "latest_epoch")
    parsed = names.select(F.regexp_extract(name, pattern, 1).alias("prefix"),
                          F.regexp_extract(name, pattern, 2).alias("epoch_text"))
    parsed = parsed.where(F.col("epoch_text") != "")
    return parsed.groupBy("prefix").agg(F.max(F.col("epoch_text").cast("long")).alias("latest_epoch"))


def sample_example(df: DataFrame, id_col: str, seed: int, k: int = 1) -> DataFrame:
    """``k`` rows chosen by a seeded hash of the id (repeatable random example)."""
    return df.orderBy(seeded_hash(id_col, seed), F.col(id_col)).limit(k)
