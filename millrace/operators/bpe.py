"""Byte-level BPE as DataFrame jobs.

* E1 ``pretoken_counts``: prefix space, the GPT-2 split pattern (Java regex,
  Unicode classes) and one ``groupBy(piece)``; the corpus pass is fully
  distributed and everything after it works on *distinct* pieces.
* E2 ``train_bpe``: a pair-count table kept by differences. A round ranks the
  pairs (count desc, then ids asc) and takes the best ``k``; the maximal runs
  of symbols that those pairs chain together hold every occurrence of them and
  of any pair merged from them, so the distinct runs with their counts (at
  most ``CHAINS`` of them, else ``k`` is halved) tell exactly which merges come
  next, until a pair ranks behind the best one not taken. One pass then
  rewrites the runs; only pieces that hold one send differences to the table.
  16,000 merges take some tens of rounds, not 16,000.
* E4 ``encode``: no shuffle. A batch's pieces go to an Arrow batch UDF that
  applies the merges by rank, once per distinct piece of the batch that it has
  not met before, and takes the ids of all pieces from those (merge table
  bounded by the vocabulary size, memo bounded by ``MEMO``).
* E5 ``decode``: no shuffle. Ids -> token bytes -> UTF-8 in an Arrow batch UDF
  with the vocabulary (bounded by its size).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import BPEConfig
from millrace.session import cut_lineage

# The GPT-2 pre-tokenization pattern used by byte-level BPE.
GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """GPT-2 byte-to-character table (index = byte value): printable Latin-1
    bytes map to themselves, the other 68 to U+0100 onwards, in byte order."""
    keep = set(range(ord("!"), ord("~") + 1)) | set(range(ord("¡"), ord("¬") + 1)) | set(range(ord("®"), ord("ÿ") + 1))
    table, extra = [], 0
    for b in range(256):
        if b in keep:
            table.append(chr(b))
        else:
            table.append(chr(256 + extra))
            extra += 1
    return table


BYTE_CHARS = byte_alphabet()


def pretokens(text: Column, add_prefix_space: bool = True) -> Column:
    """Pre-token strings of a text (before the byte mapping)."""
    t = F.coalesce(text, F.lit(""))
    if add_prefix_space:
        t = F.when(t.startswith(" ") | (t == ""), t).otherwise(F.concat(F.lit(" "), t))
    return F.regexp_extract_all(t, F.lit("(?U)" + GPT2_PATTERN), 0)


def byte_level(piece: Column) -> Column:
    """UTF-8 bytes of a piece mapped to the byte-level alphabet."""
    alpha = F.array(*[F.lit(c) for c in BYTE_CHARS])
    hexed = F.hex(F.encode(piece, "UTF-8"))
    return F.array_join(F.transform(
        F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int")),
        lambda i: F.element_at(alpha, (F.conv(F.substring(hexed, i * 2 + 1, 2), 16, 10).cast("int") + 1))), "")


def pretoken_counts(texts: DataFrame, text_col: str = "text", cfg: BPEConfig = BPEConfig()) -> DataFrame:
    """``(piece, cnt)`` over byte-level pieces (map-side combined)."""
    raw = texts.select(F.explode(pretokens(F.col(text_col), cfg.add_prefix_space)).alias("raw"))
    counts = raw.groupBy("raw").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select(byte_level(F.col("raw")).alias("piece"), "cnt") \
                 .groupBy("piece").agg(F.sum("cnt").cast("bigint").alias("cnt"))


@dataclass
class BPEModel:
    vocab: DataFrame     # (token STRING, id INT, special BOOLEAN)
    merges: DataFrame    # (rank INT, left STRING, right STRING, token STRING, count BIGINT)


# Distinct runs of ranked pairs that the driver takes in a round, and ranked pairs at most.
CHAINS, MOST_PAIRS = 200_000, 8_192


def train_bpe(counts: DataFrame, cfg: BPEConfig = BPEConfig()) -> BPEModel:
    """Specials first, then the sorted alphabet seen in training, then
    merges by pair frequency until the vocabulary is full or the best pair is
    below ``min_frequency``. Zero training pieces is an error."""
    spark = counts.sparkSession
    counts = cut_lineage(counts)           # read three times below; what it is made from is the corpus
    if counts.limit(1).count() == 0:
        raise ValueError("tokenizer training saw zero text samples")
    chars = sorted(r[0] for r in counts.select(F.explode(F.split("piece", "")).alias("c"))
                   .where(F.col("c") != "").distinct().collect())      # the alphabet: <= a few thousand chars
    specials = [s for s in cfg.special_tokens]
    tokens = specials + [c for c in chars if c not in specials]
    ids = {t: i for i, t in enumerate(tokens)}
    char_map = F.create_map(*[x for c in chars for x in (F.lit(c), F.lit(ids[c]))])
    symbols = F.transform(F.split("piece", ""), lambda c: char_map[c])
    words = counts.where(F.col("piece") != "").select(symbols.alias("s"), F.col("cnt").cast("bigint").alias("cnt"))
    words = cut_lineage(words.groupBy("s").agg(F.sum("cnt").alias("cnt")))
    pairs = cut_lineage(_pair_counts(words))
    merges: list[tuple] = []
    k = cfg.merges_per_round
    while len(tokens) < cfg.vocab_size:
        top = (pairs.where(F.col("c") >= cfg.min_frequency).orderBy(F.desc("c"), "p").limit(k + 1)
                    .select("p", "c").toArrow())
        if not top.num_rows:
            break
        ranked, bound = top["p"].to_numpy()[:k], None
        if top.num_rows > k:
            bound = (-top["c"][k].as_py(), top["p"][k].as_py())
        held = spark.sparkContext.broadcast(np.sort(ranked))
        runs = _runs(words, held).groupBy("run").agg(F.sum("cnt").alias("cnt")).limit(CHAINS + 1).toArrow()
        if runs.num_rows > CHAINS and k > 1:
            k //= 2
            continue
        chains = [np.frombuffer(x.as_buffer(), "<i4").tolist() for x in runs["run"]]
        _merge_in_order(chains, runs["cnt"].to_pylist(), bound, cfg, tokens, ids, merges)
        new = spark.sparkContext.broadcast({run.as_py(): np.array(c, "<i4") for run, c in zip(runs["run"], chains)})
        rewritten = cut_lineage(_rewritten(words, held, new))
        pairs = cut_lineage(pairs.unionByName(_differences(rewritten)).groupBy("p").agg(F.sum("c").alias("c")).where("c > 0"))
        words = rewritten.select("s", "cnt")
        if runs.num_rows < CHAINS // 4:
            k = min(2 * k, MOST_PAIRS)
    vocab = spark.createDataFrame([(t, i, i < len(specials)) for i, t in enumerate(tokens)],
                                  "token string, id int, special boolean")
    mdf = spark.createDataFrame(merges, "rank int, left string, right string, token string, count bigint")
    return BPEModel(vocab, mdf)


def _merge_in_order(chains: list[list[int]], counts: list[int], bound: tuple[int, int] | None, cfg: BPEConfig,
                    tokens: list[str], ids: dict, merges: list[tuple]) -> None:
    """Merges in exact order on the runs (rewritten in place) until a pair ranks behind ``bound``, the
    best pair that was not taken.

    A pair outside the runs counts no more than that and only shrinks. A pair
    that a merge makes across the end of a run replaces a pair that was not
    taken, so it counts no more either, and on equal counts its new id ranks it
    behind. The round ends at a merge whose string already has an id, where
    that does not hold."""
    total: dict[tuple[int, int], int] = {}
    where: dict[tuple[int, int], set[int]] = {}
    for i, (chain, n) in enumerate(zip(chains, counts)):
        for p in zip(chain, chain[1:]):
            total[p] = total.get(p, 0) + n
            where.setdefault(p, set()).add(i)
    heap = [(-c, *p) for p, c in total.items()]
    heapq.heapify(heap)
    while heap and len(tokens) < cfg.vocab_size:
        c, a, b = heapq.heappop(heap)
        now = total.get((a, b), 0)
        if now != -c:
            if now > 0:
                heapq.heappush(heap, (-now, a, b))
            continue
        if now < cfg.min_frequency or (bound is not None and (c, a << 32 | b) >= bound):
            break
        merged = tokens[a] + tokens[b]
        known = merged in ids
        if not known:                      # a string made by two merges keeps one id
            ids[merged] = len(tokens)
            tokens.append(merged)
        new = ids[merged]
        merges.append((len(merges), tokens[a], tokens[b], merged, now))
        grown = set()
        for i in where.pop((a, b)):
            chain, n, out, k = chains[i], counts[i], [], 0
            while k < len(chain):
                hit = k + 1 < len(chain) and chain[k] == a and chain[k + 1] == b
                out.append(new if hit else chain[k])
                k += 1 + hit
            if len(out) == len(chain):
                continue
            for p in zip(chain, chain[1:]):
                total[p] -= n
            for p in zip(out, out[1:]):
                total[p] = total.get(p, 0) + n
                where.setdefault(p, set()).add(i)
                grown.add(p)
            chains[i] = out
        for p in grown:
            heapq.heappush(heap, (-total[p], *p))
        if known:
            break


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the offsets of its rows."""
    n = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(n)]


def _adjacent(column: pa.Array, cnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every adjacent pair of symbols as one number, and its piece's count."""
    flat, at = _flat(column)
    inner = np.ones(len(flat), bool)
    inner[at[1:][at[1:] > at[:-1]] - 1] = False
    first = np.flatnonzero(inner)
    return flat[first].astype(np.int64) << 32 | flat[np.minimum(first + 1, len(flat) - 1)], np.repeat(cnt, np.diff(at))[first]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else np.zeros(0, np.int64)


def _pair_counts(words: DataFrame) -> DataFrame:
    """``(p, c)``: adjacent pairs, left id * 2^32 + right id, with their counts."""

    def run(batches):
        for batch in batches:
            p, c = _summed(*_adjacent(batch.column(0), batch.column(1).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(c, pa.int64())], names=["p", "c"])

    return words.select("s", "cnt").mapInArrow(run, "p bigint, c bigint").groupBy("p").agg(F.sum("c").alias("c"))


def _differences(rewritten: DataFrame) -> DataFrame:
    """``(p, c)``: what the rewritten pieces add to the pair counts and take from them."""

    def run(batches):
        for batch in batches:
            cnt = batch.column(1).to_numpy()
            come, gone = _adjacent(batch.column(0), cnt), _adjacent(batch.column(2), -cnt)
            p, c = _summed(np.r_[come[0], gone[0]], np.r_[come[1], gone[1]])
            yield pa.RecordBatch.from_arrays([pa.array(p[c != 0], pa.int64()), pa.array(c[c != 0], pa.int64())], names=["p", "c"])

    return rewritten.where("was is not null").select("s", "cnt", "was").mapInArrow(run, "p bigint, c bigint")


def _found_runs(flat: np.ndarray, at: np.ndarray, ranked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Maximal runs of symbols chained by ranked pairs, by length: (places of each run, its symbols)."""
    if len(flat) < 2:
        return []
    key = flat[:-1].astype(np.int64) << 32 | flat[1:]
    chained = ranked[np.searchsorted(ranked, key).clip(max=len(ranked) - 1)] == key
    ends = at[1:-1]
    chained[ends[(ends > 0) & (ends < len(flat))] - 1] = False
    edge = np.diff(np.r_[False, chained, False].astype(np.int8))
    starts, n = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1) + 1
    out = []
    for length in np.unique(n).tolist():
        places = starts[n == length][:, None] + np.arange(length)
        out.append((places, np.ascontiguousarray(flat[places].astype("<i4"))))
    return out


def _distinct(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows as raw bytes, and each row's number among them."""
    return np.unique(symbols.view(f"V{symbols.shape[1] * 4}").ravel(), return_inverse=True)


def _runs(words: DataFrame, held) -> DataFrame:
    """``(run, cnt)``: the runs of ranked pairs as bytes, pre-aggregated per batch."""

    def run(batches):
        for batch in batches:
            flat, at = _flat(batch.column(0))
            cnt = np.repeat(batch.column(1).to_numpy(), np.diff(at))
            for places, symbols in _found_runs(flat, at, held.value):
                found, number = _distinct(symbols)
                _, c = _summed(number, cnt[places[:, 0]])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), pa.array(c, pa.int64())], names=["run", "cnt"])

    return words.select("s", "cnt").mapInArrow(run, "run binary, cnt bigint")


def _rewritten(words: DataFrame, held, new) -> DataFrame:
    """``(s, cnt, was)``: pieces with their runs rewritten; ``was``: the symbols before, where they differ."""

    def run(batches):
        for batch in batches:
            flat, at = _flat(batch.column(0))
            out = flat.astype(np.int32)
            for places, symbols in _found_runs(flat, at, held.value):
                found, number = _distinct(symbols)
                table = np.full((len(found), symbols.shape[1]), -1, np.int32)
                for i, x in enumerate(found):
                    r = new.value[x.tobytes()]
                    table[i, :len(r)] = r
                out[places] = table[number]
            kept = np.r_[0, np.cumsum(out >= 0)][at]
            touched = np.diff(kept) != np.diff(at)
            s = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(out[out >= 0], pa.int32()))
            yield pa.RecordBatch.from_arrays([s, batch.column(1), pa.compute.if_else(pa.array(touched), batch.column(0), None)], names=["s", "cnt", "was"])

    return words.select("s", "cnt").mapInArrow(run, "s array<int>, cnt bigint, was array<int>")


def save_model(model: BPEModel, path: str, mode: str = "overwrite") -> None:
    """Vocabulary and merges as Parquet under ``path``."""
    model.vocab.write.mode(mode).parquet(f"{path}/vocab")
    model.merges.write.mode(mode).parquet(f"{path}/merges")


def load_or_train(spark: SparkSession, path: str, counts: DataFrame | None, cfg: BPEConfig = BPEConfig(),
                  reuse: bool = True) -> BPEModel:
    """Reuse a saved model when allowed and present, else train and save."""
    from pyspark.errors import AnalysisException
    if reuse:
        try:
            return BPEModel(spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges"))
        except AnalysisException:      # nothing saved yet
            pass
    if counts is None:
        raise ValueError(f"no saved tokenizer at {path} and nothing to train on")
    model = train_bpe(counts, cfg)
    save_model(model, path)
    return BPEModel(spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges"))


# Distinct pieces a worker keeps encoded before it starts anew (memory bound).
MEMO = 500_000


def _tables(model: BPEModel, cfg: BPEConfig) -> tuple[list, list]:
    """Vocabulary and merges on the driver; their size is checked before."""
    if model.vocab.count() > cfg.vocab_size:
        raise ValueError("vocabulary larger than configured")
    return ([(r["token"], r["id"], r["special"]) for r in model.vocab.collect()],
            [(r["rank"], r["left"], r["right"]) for r in model.merges.collect()])


def _encode_udf(vocab_rows: list, merge_rows: list, unk_id: int):
    ids = {t: i for t, i, _ in vocab_rows}
    ranks = {(ids[l], ids[r]): (rk, ids[l + r]) for rk, l, r in merge_rows}
    memo: dict[str, list[int]] = {}

    def encode_piece(piece: str) -> list[int]:
        sym = [ids.get(BYTE_CHARS[b], unk_id) for b in piece.encode()]
        while len(sym) > 1:
            best = min((ranks[p] for p in zip(sym, sym[1:]) if p in ranks), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(sym):
                if i + 1 < len(sym) and ranks.get((sym[i], sym[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(sym[i])
                    i += 1
            sym = out
        return sym

    def ids_of(piece: str) -> list[int]:
        known = memo.get(piece)
        if known is None:
            if len(memo) >= MEMO:
                memo.clear()
            known = memo[piece] = encode_piece(piece)
        return known

    @F.arrow_udf("array<int>")
    def encode(pieces: pa.Array) -> pa.Array:
        n = pa.compute.list_value_length(pieces).fill_null(0).to_numpy()
        coded = pieces.flatten().dictionary_encode()
        known = [ids_of(p) for p in coded.dictionary.to_pylist()]
        lengths = np.array([len(x) for x in known], np.int64)
        flat = np.array([i for x in known for i in x], np.int32)
        code = coded.indices.to_numpy(zero_copy_only=False)
        # The ids of occurrence k are those of its distinct piece, from ``starts`` on.
        starts, each = (np.cumsum(lengths) - lengths)[code], lengths[code]
        ends = np.r_[0, np.cumsum(each)]
        values = flat[np.repeat(starts - ends[:-1], each) + np.arange(ends[-1])]
        return pa.ListArray.from_arrays(pa.array(ends[np.r_[0, np.cumsum(n)]], pa.int32()), pa.array(values, pa.int32()))

    return encode.asNondeterministic()


def encode(docs: DataFrame, model: BPEModel, cfg: BPEConfig = BPEConfig(), text_col: str = "text",
           key_cols: tuple[str, ...] = ("doc_id",), append_eos: bool = True,
           max_len: int | None = None) -> DataFrame:
    """``key_cols + ids``, one row per input row; ids with eos are cut to
    ``max_len - 1`` before eos, without eos to ``max_len``."""
    vocab_rows, merge_rows = _tables(model, cfg)
    ids = {t: i for t, i, _ in vocab_rows}
    pieces = pretokens(F.col(text_col), cfg.add_prefix_space)
    out = docs.select(*key_cols, _encode_udf(vocab_rows, merge_rows, ids.get(cfg.unk_token, 0))(pieces).alias("ids"))
    if append_eos and cfg.eos_token in ids:
        body = F.col("ids") if not max_len else F.slice("ids", 1, max_len - 1)
        return out.withColumn("ids", F.concat(body, F.array(F.lit(ids[cfg.eos_token]))))
    if max_len:
        return out.withColumn("ids", F.slice("ids", 1, max_len))
    return out


def decode(encoded: DataFrame, model: BPEModel, key_cols: tuple[str, ...] = ("doc_id",),
           ids_col: str = "ids", cfg: BPEConfig = BPEConfig()) -> DataFrame:
    """E5: ``key_cols + text``, one row per input row. Special tokens are
    skipped; ids cut inside a character decode with the replacement character;
    an id outside the vocabulary fails the job; null ids give null."""
    code = {c: b for b, c in enumerate(BYTE_CHARS)}
    data = {i: b"" if special else bytes(code[c] for c in t) for t, i, special in _tables(model, cfg)[0]}

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        out = []
        for doc in ids.to_pylist():
            if doc is None:
                out.append(None)
                continue
            unknown = next((i for i in doc if i not in data), None)
            if unknown is not None:
                raise ValueError(f"unknown token id {unknown}")
            out.append(b"".join(map(data.__getitem__, doc)).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return encoded.select(*key_cols, text.asNondeterministic()(F.col(ids_col).cast("array<int>")).alias("text"))
