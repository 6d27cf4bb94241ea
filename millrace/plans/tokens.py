"""Token-stream plans over ``documents``: split, token ids, budget, shards,
batches, packed blocks and windows.

Token ids here come from a hash vocabulary over words
(``4 + int(md5(word)[:3], 16)``, ids 0-3 reserved for pad/unk/bos/eos), so
every step is checkable in SQL; the BPE plan swaps in learned ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import SplitConfig
from millrace.functions.text import words
from millrace.operators.split import split_texts
from millrace.session import spread

PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
EOS_TOKEN = "<eos>"
HASH_VOCAB = 4 + 16 ** 3


def _hashed(found: pa.Array) -> pa.Array:
    """Ids of word lists; a word is hashed once a batch, however often it occurs."""
    n = pc.list_value_length(found)
    coded = found.flatten().dictionary_encode()
    ids = np.array([int(hashlib.md5(w.encode()).hexdigest()[:3], 16) + 4 for w in coded.dictionary.to_pylist()], np.int32)
    ends = np.r_[0, np.cumsum(n.fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[coded.indices.to_numpy(zero_copy_only=False)]), mask=n.is_null())


def word_ids(text: str = "text_x"):
    return F.arrow_udf(_hashed, "array<int>").asNondeterministic()(words(text))      # only so that no filter copies the call


def encode_words(text: str = "text_x", append_eos: bool = True, max_len: int | None = None):
    """E4 for the hash vocabulary: ids, cut to ``max_len - 1`` then eos when
    appending, else cut to ``max_len``."""
    ids = word_ids(text)
    if append_eos:
        if max_len is not None and max_len > 0:
            ids = F.slice(ids, 1, max_len - 1)
        return F.concat(ids, F.array(F.lit(EOS_ID)))
    if max_len is not None:
        ids = F.slice(ids, 1, max_len)
    return ids


def split_docs(docs: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """``(doc_id, split, text_x)`` for documents with text."""
    d = spread(docs.select("doc_id", "text"))
    return split_texts(d, cfg, ("text",), key_col="doc_id").select("doc_id", "split", "text_x")


def encoded_docs(docs: DataFrame, cfg: SplitConfig = SplitConfig(), max_len: int | None = None) -> DataFrame:
    """``(doc_id, split, text_x, ids)``; ids end with eos, so none is empty
    (the writer skips empty id lists)."""
    s = split_docs(docs, cfg)
    # With eos appended an id list is never empty, so no filter is needed (a
    # filter on ``ids`` would be pushed below and hash every word twice).
    return s.withColumn("ids", encode_words("text_x", True, max_len))
