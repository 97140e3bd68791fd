"""Identities and their samples: registry updates, filters and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def active(identities: DataFrame) -> DataFrame:
    return identities.where("active")


def upsert(identities: DataFrame, incoming: DataFrame, key: str = "name") -> DataFrame:
    """The registry with a row for every incoming name that it lacks; known names keep theirs.

    Of incoming rows that repeat a name the first by their JSON text is taken.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in incoming.columns])
    fresh = incoming.groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*").join(identities.select(key), key, "left_anti")
    return identities.unionByName(fresh, allowMissingColumns=True)


def enrolled(rows: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    return rows.join(samples.select(key).distinct(), key, "left_semi")


def not_enrolled(rows: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    return rows.join(samples.select(key).distinct(), key, "left_anti")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Delete by key."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def updated(identities: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Set name, external_id and active where ``changes`` has a value; a blank name is ignored; updated_at moves only with a change."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in ("name", "external_id", "active")])
    out = identities.join(new, key, "left")
    name = F.nullif(F.trim("_name"), F.lit(""))
    touched = name.isNotNull() | F.col("_external_id").isNotNull() | F.col("_active").isNotNull()
    return out.select(*[{"name": F.coalesce(name, F.col("name")), "external_id": F.coalesce("_external_id", "external_id"), "active": F.coalesce("_active", "active"), "updated_at": F.when(touched, F.current_timestamp()).otherwise(F.col("updated_at"))}.get(c, F.col(c)).alias(c) for c in identities.columns])


def soft_delete(identities: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return identities.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")


def best_sample(samples: DataFrame, label: str, sample: str, quality: str) -> DataFrame:
    """The sample of highest quality of each label; of equal ones the first enrolled."""
    return samples.groupBy(label).agg(F.max_by(F.struct(F.col(sample).alias("sample"), F.col(quality).alias("quality")), F.struct(F.col(quality), -F.col(sample))).alias("b")).select(label, F.col("b.sample").alias(sample), F.col("b.quality").alias(quality))


def average_quality(samples: DataFrame, label: str, quality: str) -> DataFrame:
    return samples.groupBy(label).agg(F.coalesce(F.avg(quality), F.lit(0.0)).alias("avg_quality"))


def dataset_info(samples: DataFrame, label: str) -> DataFrame:
    """n_images, n_classes, images_per_class (integer division by at least one class)."""
    return samples.agg(F.count("*").alias("n_images"), F.count_distinct(label).alias("n_classes")).withColumn("images_per_class", F.floor(F.col("n_images") / F.greatest(F.lit(1), F.col("n_classes"))))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last by ``order``; of equal ones the largest by its JSON text."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(F.col(order), F.to_json(whole))).alias("_row")).select("_row.*")


def model_state(training: Column, failed: Column, trained: Column, samples: Column) -> Column:
    """The first that holds: training, error, ready, needs training; else not initialised."""
    return F.when(training, "TRAINING").when(failed, "ERROR").when(trained, "READY").when(samples > 0, "NEEDS_TRAINING").otherwise("NOT_INITIALIZED")


def identity_view(identities: DataFrame, samples: DataFrame) -> DataFrame:
    """Identity rows with their sample count, average quality and nested samples."""
    own = samples.groupBy("identity_id").agg(F.count("*").alias("sample_count"), F.avg("quality").alias("average_quality"), F.array_sort(F.collect_list(F.struct("sample_id", "quality", "source", F.size("features").alias("dimension")))).alias("samples"))
    return identities.join(own, identities["id"] == own["identity_id"], "left").drop("identity_id").withColumns({"sample_count": F.coalesce("sample_count", F.lit(0)), "average_quality": F.coalesce("average_quality", F.lit(0.0))})


def meets_quality(quality: Column, threshold: float) -> Column:
    """A sample without a quality meets no threshold."""
    return F.coalesce(quality >= F.lit(threshold), F.lit(False))


def identity_of(samples: DataFrame, identities: DataFrame, key: str = "identity") -> DataFrame:
    """Samples with the columns of their identity; those of unknown identities go."""
    return samples.join(identities, key)
