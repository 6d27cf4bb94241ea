"""B5-B7 text extraction and train/val assignment, A5 split sources, D11."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import SplitConfig
from millrace.functions.hashing import unit_interval
from millrace.functions.text import extract_text, stable_key


def with_text(df: DataFrame, text_fields: Sequence[str] = ("text",), out: str = "text_x") -> DataFrame:
    """Adds the extracted text (null when no field has content)."""
    present = [f for f in text_fields if f in df.columns]
    if not present:
        return df.withColumn(out, F.lit(None).cast("string"))
    return df.withColumn(out, extract_text(present))


def with_split(df: DataFrame, cfg: SplitConfig = SplitConfig(), text_col: str = "text_x",
               key_col: str | None = None) -> DataFrame:
    """B6 + B7: ``key`` (first id column present, else text, else "") and
    ``split`` = ``val`` iff ``fraction > 0 and u < fraction`` else ``train``."""
    key = F.col(key_col).cast("string") if key_col else stable_key(df.columns, F.col(text_col))
    u = unit_interval(key, cfg.seed)
    is_val = F.lit(cfg.val_fraction > 0) & (u < F.lit(float(cfg.val_fraction)))
    return (df.withColumn("split_key", key).withColumn("u", u)
              .withColumn("split", F.when(is_val, "val").otherwise("train")))


def split_texts(df: DataFrame, cfg: SplitConfig = SplitConfig(), text_fields: Sequence[str] = ("text",),
                key_col: str | None = None) -> DataFrame:
    """One pass: extract text, drop rows without text, assign the split."""
    t = with_text(df, text_fields)
    return with_split(t, cfg, "text_x", key_col).where(F.col("text_x").isNotNull())


def resolve_split_source(role: str, train: DataFrame, val: DataFrame | None = None,
                         test: DataFrame | None = None, cfg: SplitConfig = SplitConfig(),
                         text_fields: Sequence[str] = ("text",)) -> DataFrame | None:
    """A5: val uses an explicit val source when given, else the synthetic
    split of train; test exists only when a test source is named."""
    if role not in ("train", "val", "test"):
        raise ValueError(f"unknown role {role!r}")
    if role == "test":
        return None if test is None else with_text(test, text_fields).where(F.col("text_x").isNotNull())
    if role == "val" and val is not None:
        return with_text(val, text_fields).where(F.col("text_x").isNotNull())
    t = with_text(train, text_fields).where(F.col("text_x").isNotNull())
    if val is not None:            # explicit val split: all train rows are train
        return t
    return with_split(t, cfg).where(F.col("split") == role)


def split_path(paths: dict[str, str], name: str) -> str:
    """Q14: the path a split name is mapped to; an unmapped name is an error,
    never a silent reread of the train files."""
    if name not in paths:
        raise ValueError(f"split {name!r} has no path; mapped: {sorted(paths)}")
    return paths[name]


def check_split_plan(cfg: SplitConfig, has_val: bool, val_target: int | None) -> None:
    """Q15: validation tokens are asked for, so there must be validation rows."""
    if val_target and val_target > 0 and not has_val and cfg.val_fraction <= 0:
        raise ValueError("a validation target needs a validation split or val_fraction > 0")


def split_sources(train: DataFrame, val: DataFrame | None = None, test: DataFrame | None = None,
                  cfg: SplitConfig = SplitConfig(), text_fields: Sequence[str] = ("text",),
                  key_col: str | None = None) -> DataFrame:
    """A5 for all roles: ``(split_key, split, text_x)`` of every row with text.
    Without a validation source one pass over train deals both splits."""
    def role(df: DataFrame, name: str) -> DataFrame:
        t = with_text(df, text_fields).where(F.col("text_x").isNotNull())
        key = F.col(key_col).cast("string") if key_col and key_col in t.columns else stable_key(t.columns, F.col("text_x"))
        return t.select(key.alias("split_key"), F.lit(name).alias("split"), "text_x")

    if val is None:
        out = split_texts(train, cfg, text_fields, key_col).select("split_key", "split", "text_x")
    else:
        out = role(train, "train").unionByName(role(val, "val"))
    return out if test is None else out.unionByName(role(test, "test"))


def final_split(snapshot: DataFrame, cfg: SplitConfig = SplitConfig(), key_col: str = "id") -> DataFrame:
    """Split the deduplicated snapshot; write it partitioned by split."""
    return with_split(snapshot, cfg, key_col=key_col).drop("split_key", "u")
