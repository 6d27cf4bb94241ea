"""Token counts by a SentencePiece model, huge documents in overlapping chunks.

A document up to ``chunk_chars`` characters is encoded whole. A longer one is encoded
in chunks that overlap, and the counts are spliced at a place both chunks have as a
boundary between tokens and that is *proven stable*: no vocabulary entry holds the two
characters around it side by side, so no merge crosses it and the tokens on one side do
not depend on the other side. A chunk without such a place is widened (doubled), in the
end up to the whole document; a chunk whose tokens do not meet the splice point gets a
wider overlap. So the count is the library's count of the whole text.

Offsets follow from the ids: an entry spans as many code points as it has characters, a
byte entry one code point unless it continues one. They hold for models that do not
rewrite text; where the offsets do not add up the document is encoded whole.

Rows: one per input row; null text counts as empty; repeated rows give repeated results;
other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_text, text_slices, worker_state

CHUNK_CHARS = 16_384
OVERLAP = 256
SPACE = "▁"  # how the model writes a space


class ChunkCounter:
    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk_chars, self.overlap = chunk_chars, overlap
        spans, pairs = [], set()
        for i in range(len(self.model)):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                spans.append(0 if 0x80 <= int(piece[3:5], 16) < 0xC0 else 1)
            else:
                spans.append(len(piece))
                pairs.update(zip(piece, piece[1:]))
        self.spans, self.pairs = np.array(spans, np.int64), pairs

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def ends(self, text: str) -> np.ndarray | None:
        """The code point at which each token of the text ends; None if they do not add up.
        The space that the model puts before a text is taken off."""
        at = np.cumsum(self.spans[self.model.encode(text)]) - 1
        return at if len(at) and at[-1] == len(text) else None

    def stable(self, text: str, at: int) -> bool:
        a, b = text[at - 1:at + 1].replace(" ", SPACE)
        return (a, b) not in self.pairs

    def count(self, text: str) -> int:
        n = len(text)
        total = start = 0
        size, overlap = self.chunk_chars, self.overlap
        while True:
            lo, hi = max(0, start - overlap), min(n, start + size)
            ends = self.ends(text[lo:hi])
            if ends is None:
                return self.whole([text])[0]
            before = int(np.searchsorted(ends, start - lo, "right")) if start else 0
            if start and (not before or ends[before - 1] != start - lo):  # the chunks don't meet at the splice point
                if lo == 0:
                    return self.whole([text])[0]
                overlap *= 2
                continue
            if hi == n:
                return total + len(ends) - before
            marks = set((ends + lo).tolist())
            cut = next((p for p in range(hi - 1, start, -1) if p in marks and self.stable(text, p)), None)
            if cut is None:
                size *= 2
                continue
            total += int(np.searchsorted(ends, cut - lo, "right")) - before
            start, size, overlap = cut, self.chunk_chars, self.overlap

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk_chars]
        for i, n in zip(short, self.whole([texts[i] for i in short]), strict=True):
            out[i] = n
        for i, t in enumerate(texts):
            if len(t) > self.chunk_chars:
                out[i] = self.count(t)
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 4096, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)``."""
    rows = docs.select(F.col(id_col), as_text(text_col).alias("text"))

    def run(batches):
        counter = worker_state(("chunk_counter", path, chunk_chars, overlap), lambda: ChunkCounter(path, chunk_chars, overlap))
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                n = pa.array(counter.counts(part.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.compute.binary_length(part.column(1)).cast(pa.int64()), n],
                                                 names=[id_col, "n_bytes", "n_tokens"])

    kind = rows.schema[0].dataType.simpleString()
    return (rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
                .withColumn("over_limit", F.col("n_tokens") > limit))
