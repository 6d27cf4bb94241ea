"""Frozen configuration objects passed to the DataFrame functions.

The defaults are fixed values: the parameters a user of the pipeline knows.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MinHashConfig:
    shingle_n: int = 5
    num_perm: int = 128
    seed0: int = 1337
    hash_family: str = "universal31"   # universal31 | xxhash64


@dataclass(frozen=True)
class LSHConfig:
    k: int = 128
    b: int = 32


@dataclass(frozen=True)
class ComponentsConfig:
    max_rounds: int = 64


@dataclass(frozen=True)
class SnapshotConfig:
    mode: str = "cluster"            # cluster | exact
    key_col: str | None = None
    keep_cols: tuple[str, ...] = ("dataset", "id", "instruction", "code_ref",
                                  "language", "has_code", "cluster_id")


@dataclass(frozen=True)
class SplitConfig:
    val_fraction: float = 0.05
    seed: int = 42


@dataclass(frozen=True)
class BPEConfig:
    vocab_size: int = 16_000
    special_tokens: tuple[str, ...] = ("<pad>", "<unk>", "<bos>", "<eos>")
    unk_token: str = "<unk>"
    eos_token: str = "<eos>"
    pad_token: str | None = "<pad>"
    min_frequency: int = 2
    add_prefix_space: bool = True
    merges_per_round: int = 256  # ranked pairs looked at in the first round; later ones adapt


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    min_alpha_per_mille: int = 600
    max_dup_line_per_mille: int = 300
