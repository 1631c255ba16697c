"""Training of student models: teacher targets, one split, one boosted regression for each target, and their registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import models, splits
from plumbline.operators.stats import train_only_z
from plumbline.plans.scoring import ALLOWED, COMPONENTS, derived, fill_position_group, targets, teacher_rating
from plumbline.sources.io import drop_empty
from plumbline.sources.scratch import materialise

#: The main target, columns that are categories, and what the registry says of the teacher.
MAIN_TARGET = "rating_pred"
CATEGORIES = ["position", "postion", "position_group", "league", "season"]
NOTES = {"teacher_system": "components->PCA->shrink->group_zscore"}


def features_of(target: str, components: Mapping[str, Sequence[tuple[str, float]]] = COMPONENTS) -> list[str]:
    """Numeric features of a target: its component's columns; those of all components for the rating."""
    if target == MAIN_TARGET:
        return sorted({c for parts in components.values() for c, _ in parts})
    return [c for c, _ in components.get(target, [])]


def teacher_targets(df: DataFrame, record: str, components: Mapping[str, Sequence[tuple[str, float]]] = COMPONENTS, allowed: Mapping[str, Sequence[str]] = ALLOWED, groups: Sequence[str] = ("season", "position_bucket"), minutes: str = "minutes_played_overall", positions: Sequence[str] = ("position", "postion", "position_group"), mode: str = "time", **split) -> DataFrame:
    """``df`` with derived columns, ``part`` (train, valid, unused), each component and the rating as z-scores of the
    training rows, and ``sample_weight``."""
    base = fill_position_group(drop_empty(derived(df, minutes), [record]))
    base = materialise(splits.hard_split(base, "season", record, mode, **split))
    scored = targets(base, components, allowed, groups, minutes, positions, z=False)
    rated = teacher_rating(base, components, allowed, groups, minutes, positions, z=False)
    rating = rated.select(F.col(record).alias("record_"), MAIN_TARGET)
    out = materialise(scored.join(rating, scored[record] == F.col("record_"), "left").drop("record_"))
    keys = [g for g in groups if g in out.columns]
    for t in [*components, MAIN_TARGET]:
        out = train_only_z(out, t, t, F.col("part") == "train", keys)
    games = "appearances_overall" if "appearances_overall" in out.columns else None
    weighted = splits.sample_weights(out, minutes, games, "position_group") if minutes in out.columns else out.withColumn("sample_weight", F.lit(1.0))
    return materialise(weighted)


def train(df: DataFrame, record: str, components: Mapping[str, Sequence[tuple[str, float]]] = COMPONENTS, allowed: Mapping[str, Sequence[str]] = ALLOWED, least: int = 300, trees: int = 200, seed: int = 42, **how) -> tuple[dict[str, DataFrame], DataFrame]:
    """Predictions by target (``record``, target, prediction, part), and the registry: a row a model with its features,
    categories, sizes and errors.  Targets with fewer than ``least`` values aren't trained, but for the rating."""
    ready = teacher_targets(df, record, components, allowed, **how)
    counts = ready.agg(*[F.count(c).alias(c) for c in components]).first()
    wanted = [MAIN_TARGET, *[c for c in components if counts[c] >= least]]
    rows = ready.where(F.col("part") != "unused").withColumn("is_valid_", F.col("part") == "valid")
    categories = [c for c in CATEGORIES if c in ready.columns]
    found, registry = {}, []
    for t in wanted:
        numeric = [c for c in features_of(t, components) if c in ready.columns]
        out, facts = models.boosted_regression(rows, t, numeric, categories, "is_valid_", "sample_weight", trees, seed=seed, record=record)
        out = materialise(out.select(record, F.col(t).cast("double").alias(t), "prediction", "part"))
        shuffled = models.shuffled_error(out.where("part = 'valid'"), record, t, "prediction", seed).first()[0]
        std = facts["std_valid"]
        registry.append((f"base_{t}", [*numeric, *categories], categories, facts["n_train"], facts["n_valid"], facts["rmse_valid"], std, facts["rmse_valid"] / std if std else None, shuffled))
        found[t] = out
    schema = "target string, feature_cols array<string>, cat_cols array<string>, n_train long, n_valid long, rmse_valid double, std_y_valid double, rmse_over_std double, rmse_valid_shuffled_y double"
    return found, df.sparkSession.createDataFrame(registry, schema)


def registry_document(registry: DataFrame, version: str = "base_v1", main: str = MAIN_TARGET) -> DataFrame:
    """One row: version, main target, names of the trained targets, the models as structs, and notes."""
    row = F.struct("target", "feature_cols", "cat_cols", F.struct("rmse_valid", "std_y_valid", "rmse_over_std", "rmse_valid_shuffled_y").alias("metrics"), "n_train", "n_valid")
    notes = F.create_map(*[F.lit(x) for kv in NOTES.items() for x in kv])
    return registry.agg(F.collect_list(row).alias("models")).select(F.lit(version).alias("version"), F.lit(main).alias("main_target"), F.transform("models", lambda m: m["target"]).alias("trained_targets"), "models", notes.alias("notes"))  # a row a model
