"""Tasks, labels, folds and label permutations. All randomness is the order of an md5 hash."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexistat.functions.ranks import hash_order, number_by_hash

# Other names of the task modes.
TASK_ALIASES = {"class": "classification", "classifier": "classification",
                "regress": "regression", "regressor": "regression"}
SIZE_DIGITS = 15


def detect_task(df: DataFrame, targets: Sequence[str], max_unique: int = 20) -> DataFrame:
    """(target, n_unique, task) for all targets in one pass."""
    counted = df.agg(*[F.count_distinct(_value(df, t)).alias(t) for t in targets])
    long = counted.unpivot([], list(targets), "target", "n_unique")
    texts = [t for t in targets if isinstance(df.schema[t].dataType, (T.StringType, T.BooleanType))]
    numbers = [t for t in targets if isinstance(df.schema[t].dataType, T.NumericType)]
    few = F.col("target").isin(*numbers) & (F.col("n_unique") <= max_unique) if numbers else F.lit(False)
    named = F.col("target").isin(*texts) if texts else F.lit(False)
    return long.withColumn("task", F.when(named | few, "classification").otherwise("regression"))


def _value(df: DataFrame, name: str) -> Column:
    """NaN is a missing value."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(name), F.col(name))
    return F.col(name)


def normalize_task_mode(mode: str | None) -> str:
    name = "auto" if mode is None else str(mode).strip().lower()
    name = TASK_ALIASES.get(name, name)
    if name not in ("auto", "classification", "regression"):
        raise ValueError("task_mode must be one of: auto, classification, regression")
    return name


def resolve_task(
    target: str, detected: str, mode: str | None = "auto", overrides: Mapping[str, str] | None = None
) -> str:
    """An override beats the global mode, which beats detection."""
    named = {str(k): normalize_task_mode(v) for k, v in (overrides or {}).items()}
    chosen = named.get(str(target), normalize_task_mode(mode))
    return detected if chosen == "auto" else chosen


def label_codes(df: DataFrame, target: str) -> DataFrame:
    """(label, code): the distinct values in sorted order from 0; one row per class."""
    order = Window.partitionBy(F.lit(0)).orderBy("label")
    return (
        df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("code", F.dense_rank().over(order) - 1)
    )


def encode_label(df: DataFrame, target: str, out: str = "y") -> DataFrame:
    codes = label_codes(df, target).select(F.col("label").alias(target), F.col("code").alias(out))
    return df.join(codes, target)


def fold_count(
    df: DataFrame, task: str, y: str, cv: int = 5, group: str | None = None
) -> DataFrame:
    """One row (requested, folds, reason): the folds the data allow, or why there are none."""
    reason = F.lit(None).cast("string")
    if group is not None:
        pairs = df.groupBy(y, group).agg(F.count(F.lit(1)).alias("n")) if task == "classification" else df
        groups = df.agg(F.count_distinct(group).alias("groups"), F.count(F.lit(1)).alias("rows"))
        if task == "classification":
            per_class = pairs.groupBy(y).agg(F.count(F.lit(1)).alias("g"))
            limits = per_class.agg(F.min("g").alias("room"), F.count(F.lit(1)).alias("classes"))
        else:
            limits = groups.select(F.col("groups").alias("room"), F.lit(2).cast("bigint").alias("classes"))
        facts = groups.join(limits)  # two one-row tables
        reason = (
            F.when(F.col("rows") < 2, "Not enough samples for cross validation")
            .when(F.col("classes") < 2, "Classification requires at least two classes after alignment with X")
            .when(F.col("groups") < 2, "Group CV requires at least two unique groups")
            .when(F.col("room") < 2, "Not enough groups per class for group-based CV")
        )
    elif task == "classification":
        sizes = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
        facts = sizes.agg(F.min("n").alias("room"), F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows"))
        reason = (
            F.when(F.coalesce("rows", F.lit(0)) < 2, "Not enough samples for cross validation")
            .when(F.col("classes") < 2, "Classification requires at least two classes after alignment with X")
            .when(F.col("room") < 2, "Classification CV requires at least 2 samples in each class. "
                  "Use regression or merge sparse classes.")
        )
    else:
        facts = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("room", F.floor(F.col("rows") / 2))
        reason = (
            F.when(F.col("rows") < 2, "Not enough samples for cross validation")
            .when(F.col("room") < 2, "Regression with R2 requires at least 4 samples after alignment "
                  "to ensure each test fold has at least 2 samples.")
        )
    folds = F.greatest(F.lit(2), F.least(F.lit(cv), F.col("room"))).cast("int")
    return facts.select(
        F.lit(cv).alias("requested"), F.when(reason.isNull(), folds).alias("folds"), reason.alias("reason")
    )


def inner_fold_count(df: DataFrame, task: str, y: str, group: str | None = None) -> int | None:
    """2 or 3 folds for tuning; None when the data are too sparse."""
    row = fold_count(df, task, y, 3, group).first()
    return row["folds"]


def kfold(df: DataFrame, key: str, k: int, seed: object = 42) -> DataFrame:
    return _dealt(df, key, k, seed, [])


def stratified_kfold(df: DataFrame, key: str, y: str, k: int, seed: object = 42) -> DataFrame:
    return _dealt(df, key, k, seed, [y])


def _dealt(df: DataFrame, key: str, k: int, seed: object, groups: Sequence[str]) -> DataFrame:
    hashed = df.withColumn("_hash", hash_order(seed, F.col(key)))
    ranked = number_by_hash(hashed, "_hash", [key], groups, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_hash", "_rank")


def _snake(rank: Column, k: int) -> Column:
    """0..k-1, then k-1..0, and so on: sizes in falling order end up balanced."""
    at = rank - 1
    place = at % k
    return F.when(F.floor(at / k) % 2 == 0, place).otherwise(k - 1 - place).cast("int")


def _by_size(groups: DataFrame, group: str, size: str, within: Sequence[str]) -> DataFrame:
    """Number groups by falling size without one task for all: sizes and hashes form the slices."""
    falling = F.lpad((F.lit(10**SIZE_DIGITS - 1) - F.col(size)).cast("string"), SIZE_DIGITS, "0")
    keyed = groups.withColumn("_order", F.concat(falling, F.md5(F.col(group).cast("string"))))
    return number_by_hash(keyed, "_order", [group], within, "_rank", SIZE_DIGITS + 3)


def group_kfold(df: DataFrame, group: str, k: int) -> DataFrame:
    """Groups never split; their sizes are balanced over the folds."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    folds = _by_size(sizes, group, "_size", []).select(group, _snake(F.col("_rank"), k).alias("fold"))
    return df.join(folds, group)


def stratified_group_kfold(df: DataFrame, group: str, y: str, k: int) -> DataFrame:
    """Groups never split; groups with the same main class are spread over the folds."""
    parts = df.groupBy(group, y).agg(F.count(F.lit(1)).alias("_n"))
    sizes = parts.groupBy(group).agg(
        F.sum("_n").alias("_size"),
        F.max_by(y, F.struct(F.col("_n"), -F.col(y))).alias("_main"),
    )
    folds = _by_size(sizes, group, "_size", ["_main"]).select(
        group, _snake(F.col("_rank"), k).alias("fold")
    )
    return df.join(folds, group)


def assign_folds(
    df: DataFrame, key: str, task: str, y: str, k: int, seed: object = 42, group: str | None = None
) -> DataFrame:
    if group is not None:
        return stratified_group_kfold(df, group, y, k) if task == "classification" else group_kfold(df, group, k)
    return stratified_kfold(df, key, y, k, seed) if task == "classification" else kfold(df, key, k, seed)


def inner_folds(
    df: DataFrame, key: str, task: str, y: str, outer_k: int, inner_k: int, seed: object = 42,
    group: str | None = None,
) -> DataFrame:
    """Add `inner`: per outer fold the fold of the row inside its training rows, -1 where it is test.

    One numbering for all outer folds, with the outer fold as part of the group.
    """
    outers = F.explode(F.sequence(F.lit(0), F.lit(outer_k - 1)))
    train = df.select(key, y, "fold", *([group] if group else []), outers.alias("outer")).where("fold <> outer")
    if group is None:
        hashed = train.withColumn("_hash", hash_order(f"{seed}:inner", F.col("outer"), F.col(key)))
        strata = ["outer", y] if task == "classification" else ["outer"]
        ranked = number_by_hash(hashed, "_hash", [key], strata, "_rank")
        placed = ranked.withColumn("g", ((F.col("_rank") - 1) % inner_k).cast("int"))
    else:
        sizes = train.groupBy("outer", group).agg(F.count(F.lit(1)).alias("_size"), F.max(y).alias("_main"))
        within = ["outer", "_main"] if task == "classification" else ["outer"]
        folds = _by_size(sizes, group, "_size", within).select(
            "outer", group, _snake(F.col("_rank"), inner_k).alias("g")
        )
        placed = train.join(folds, ["outer", group])
    per_row = placed.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("outer", "g"))).alias("_g")
    )
    listed = F.transform(
        F.sequence(F.lit(0), F.lit(outer_k - 1)),
        lambda o: F.coalesce(F.try_element_at(F.col("_g"), o), F.lit(-1)),
    )
    return df.join(per_row, key).withColumn("inner", listed).drop("_g")


def permute_labels(
    df: DataFrame, key: str, y: str, n_perm: int, seed: object = 42, first: int = 1
) -> DataFrame:
    """(key, perm, y): the labels in another order for each permutation.

    Rows are numbered by the hash of seed:0:key, and for permutation p by the hash of seed:p:key; a
    row takes the label of the row with its number.
    """
    base = number_by_hash(
        df.select(key, y).withColumn("_hash", hash_order(seed, F.lit(0), F.col(key))),
        "_hash", [key], (), "_rank",
    ).select("_rank", y)
    perms = F.explode(F.sequence(F.lit(first), F.lit(first + n_perm - 1)))
    many = df.select(key, perms.alias("perm")).withColumn("_hash", hash_order(seed, F.col("perm"), F.col(key)))
    ranked = number_by_hash(many, "_hash", [key], ["perm"], "_rank")
    return ranked.join(base, "_rank").select(key, "perm", y)


def fold_reduction_report(results: DataFrame, requested: int) -> DataFrame:
    return results.where(F.col("cv_folds_used") < requested).select(
        "target", F.lit(requested).alias("requested"), "cv_folds_used"
    )
