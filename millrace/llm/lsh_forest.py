"""Near-duplicate documents by an LSH forest over word shingle sets.

1. One pass gives each distinct set a digest, ``TREES`` labels of ``LEVELS`` MinHash values and a sketch
   of one bit of 128 of them.
2. Each tree is a sorted order of the labels: all (tree, label) rows are sorted by range, so a region of
   equal beginnings spans partitions where it is large. Sets that share ``DEPTH`` values stand next to
   each other. Depth adapts to the region: one of more than ``REGION`` sets goes a level deeper, where the
   longer common beginning of near copies keeps them together. Within a region, sets whose sketches rule
   out a link are kept apart (six standard deviations below the similarity asked for), the others are
   candidates: no pairs come out but a star per family. The region at a partition's border counts as one
   family and meets its other part under the region's name.
3. Links of a family are confirmed on the full sets: leaders are counted against the family from its
   index lists, and every set outside the largest component so far is searched through the lists of its
   rarest shingles (a link must hold one of ``n - ceil(t n) + 1`` of them). Only links that join
   components come out. A family above ``BLOCK_SHINGLES`` is dealt into blocks; its leader goes to every
   block, then the sets outside the largest component go to the blocks of the others.

A pair at the similarity asked for is missed by all trees with a probability below ``MISS`` (at depth 4;
trees are counted for it); candidates are confirmed exactly, but for equal 64-bit shingle hashes.

A null or empty text has an empty set, links with nothing and is its own component; a row without an id
counts for links but not for ``component_id``; repeated rows are one set, rows of one id with different
texts different sets; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, n_buckets, text_slices
from millrace.llm.shingle_sets import mix, shingle_sets
from millrace.operators.components import component_roots

DEPTH, LEVELS, MISS = 4, 6, 1e-6
#: Bits of a value in the first ``DEPTH`` levels of a label, and in the others.
NEAR_BITS, FAR_BITS = 14, 32
REGION = 16_384
SKETCH_BITS = 128
SLICE_BYTES = 1 << 20
#: Shingles of a family that one task holds, and sets whose family is broadcast at most.
BLOCK_SHINGLES, BROADCAST_SETS = 4_000_000, 300_000
LEADERS = 8


def trees(num: int, den: int) -> int:
    """Trees for a miss below ``MISS`` at similarity ``num / den``."""
    n = math.ceil(math.log(MISS) / math.log(1 - (num / den) ** DEPTH))
    if n > 127:
        raise ValueError(f"similarity {num}/{den} needs {n} trees; the order holds 127")
    return max(n, math.ceil(SKETCH_BITS / LEVELS))


def least_agreement(num: int, den: int) -> int:
    """Sketch bits that two sets of the similarity share but for a chance of six standard deviations."""
    p = (1 + num / den) / 2
    return math.floor(SKETCH_BITS * p - 6 * math.sqrt(SKETCH_BITS * p * (1 - p)))


def signatures(sets: list[np.ndarray], n_trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets that are not empty: label beginnings and ends by tree, and sketches of two words."""
    r = np.random.default_rng(11)
    turn = r.integers(0, 1 << 63, (n_trees * LEVELS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    values = np.empty((n_trees * LEVELS, len(sets)), np.uint64)
    held = np.empty_like(flat)
    for k, (xor, odd) in enumerate(turn):
        np.bitwise_xor(flat, xor, out=held)
        np.multiply(held, odd, out=held)
        np.minimum.reduceat(held, starts, out=values[k])
    values = mix(values)
    near, far, sketch = np.zeros((n_trees, len(sets)), np.uint64), np.zeros((n_trees, len(sets)), np.uint64), np.zeros((2, len(sets)), np.uint64)
    for t in range(n_trees):
        near[t] = t
        for x in values[t * LEVELS:t * LEVELS + DEPTH]:
            near[t] = near[t] << np.uint64(NEAR_BITS) | x & np.uint64((1 << NEAR_BITS) - 1)
        for x in values[t * LEVELS + DEPTH:(t + 1) * LEVELS]:
            far[t] = far[t] << np.uint64(FAR_BITS) | x & np.uint64((1 << FAR_BITS) - 1)
    for k in range(SKETCH_BITS):
        sketch[k // 64] |= (values[k] >> np.uint64(63)) << np.uint64(k % 64)
    return near, far, sketch


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def scan(texts: DataFrame, width: int, n_trees: int) -> DataFrame:
    """``(doc_id, n, sid, labels, sketch)``; the last two only where a task first sees a set."""

    def run(batches):
        seen = set()
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(part.column(1), width)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                fresh = [k for k, d in enumerate(digests) if len(sets[k]) and not (d in seen or seen.add(d))]
                labels, sketches = [None] * len(sets), [None] * len(sets)
                if fresh:
                    near, far, sketch = signatures([sets[k] for k in fresh], n_trees)
                    label = np.stack([near, far], axis=2)
                    for i, k in enumerate(fresh):
                        labels[k], sketches[k] = label[:, i].tobytes(), sketch[:, i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(labels, pa.binary()), pa.array(sketches, pa.binary())],
                    names=["doc_id", "n", "sid", "labels", "sketch"])

    return materialise(texts.mapInArrow(run, "doc_id bigint, n bigint, sid binary, labels binary, sketch binary"), "forest-scan")


ORDER = ["near", "far", "s0", "s1", "i0", "i1"]


def orders(scanned: DataFrame) -> DataFrame:
    """A row per tree and set, sorted by label: the label, the sketch and the digest as whole numbers."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(n, -1, 2)
            sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(n, 2)
            sid = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">i8").astype(np.int64).reshape(n, 2)
            for t in range(label.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (label[:, t, 0], label[:, t, 1], sketch[:, 0], sketch[:, 1], sid[:, 0], sid[:, 1])], names=ORDER)

    rows = scanned.where("labels is not null").select("sid", "labels", "sketch").mapInArrow(run, ", ".join(f"{c} bigint" for c in ORDER))
    by = ["near", "far", "i0", "i1"]
    return rows.repartitionByRange(n_buckets(scanned), *by).sortWithinPartitions(*by)


def _alike(sketch: np.ndarray, k: int, others: np.ndarray, least: int) -> np.ndarray:
    differ = np.bitwise_count(sketch[others] ^ sketch[k]).sum(axis=1, dtype=np.int64)
    return others[SKETCH_BITS - differ >= least]


def region_families(far: np.ndarray, sketch: np.ndarray, least: int, level: int = DEPTH) -> list[np.ndarray]:
    """The families (places) of a region: sets that sketches do not keep apart; one of more than
    ``REGION`` sets by the next level of its labels."""
    n = len(far)
    if n > REGION and level < LEVELS:
        value = far >> np.uint64(FAR_BITS * (LEVELS - 1 - level))
        cuts = np.flatnonzero(np.r_[True, value[1:] != value[:-1], True])
        if len(cuts) > 2:
            return [a + f for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1 for f in region_families(far[a:b], sketch[a:b], least, level + 1)]
        return region_families(far, sketch, least, level + 1)
    left, out = np.arange(n), []
    while len(left) > 1:
        family, queue, left = [left[:1]], [int(left[0])], left[1:]
        while queue and len(left):
            found = _alike(sketch, queue.pop(), left, least)
            if len(found):
                left = np.setdiff1d(left, found, assume_unique=True)
                family.append(found)
                queue += found.tolist()
        if len(family) > 1:
            out.append(np.concatenate(family))
    return out


def families(ordered: DataFrame, least: int) -> DataFrame:
    """``(id, root)``: hex digests of sets that may link with another, by family."""

    def region(near: int, rows: np.ndarray, border: bool):
        rows = rows[np.r_[True, (rows[1:, 4:] != rows[:-1, 4:]).any(axis=1)]]  # a set that several tasks saw
        ids = [x.hex() for x in rows[:, 4:].astype(">i8").view("V16").ravel().tolist()] if border or len(rows) > 1 else []
        if border:
            return [(f"~{near:x}", x) for x in ids]
        out = []
        for f in region_families(rows[:, 1].astype(np.uint64), rows[:, 2:4].astype(np.uint64), least) if len(rows) > 1 else []:
            members = sorted(ids[k] for k in f.tolist())
            out += [(members[0], x) for x in members[1:] if x != members[0]]
        return out

    def run(batches):
        edges, held, first = [], [], True

        def out(done: bool = False):
            while edges and (done or len(edges) > 50_000):
                a, b = zip(*edges[:50_000])
                del edges[:50_000]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            cuts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0], True])
            start = 0
            if held and held[0][0, 0] == rows[0, 0]:
                held.append(rows[:cuts[1]])
                start = 1
            if start < len(cuts) - 1:
                if held:
                    edges += region(int(held[0][0, 0]), np.concatenate(held), first)
                    first = False
                lone = np.diff(cuts)[start:-1] == 1
                for a, b in zip(cuts[start:-2][~lone | first].tolist(), cuts[start + 1:-1][~lone | first].tolist()):
                    edges += region(int(rows[a, 0]), rows[a:b], first)
                    first = False
                held = [rows[cuts[-2]:]]
            yield from out()
        if held:
            edges += region(int(held[0][0, 0]), np.concatenate(held), True)
        yield from out(True)

    pairs = ordered.mapInArrow(run, "a string, b string").distinct()
    return component_roots(pairs, a="a", b="b").where("id not like '~%'")


class Index:
    """Sets of a family, their index lists, and the components that links join."""

    def __init__(self, sets: list[np.ndarray], labels: list, num: int, den: int):
        self.num, self.den, m = num, den, len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(m), self.sizes)
        order = np.argsort(flat, kind="stable")
        token = np.cumsum(np.r_[True, flat[order][1:] != flat[order][:-1]]) - 1
        self.lists, self.starts = owner[order], np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        self.lengths = np.diff(np.r_[self.starts, len(token)])
        numbered = np.empty(len(flat), np.int64)
        numbered[order] = token
        self.tokens = np.split(numbered, np.cumsum(self.sizes)[:-1])
        named: dict = {}
        self.label = np.array([named.setdefault(x, k) for k, x in enumerate(labels)])
        self.links: list[tuple[int, int]] = []

    def postings(self, ts: np.ndarray) -> np.ndarray:
        n = self.lengths[ts]
        return self.lists[np.repeat(self.starts[ts] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]

    def search(self, k: int) -> None:
        """Joins the components that set ``k`` links with."""
        n, ts = int(self.sizes[k]), self.tokens[k]
        rare = ts[np.argsort(self.lengths[ts], kind="stable")[:n - -(-self.num * n // self.den) + 1]]
        other = np.zeros(len(self.sizes), bool)
        other[self.postings(rare)] = True
        other &= self.label != self.label[k]
        other &= (self.den * self.sizes >= self.num * n) & (self.num * self.sizes <= self.den * n)
        if not other.any():
            return
        overlap = np.bincount(self.postings(ts), minlength=len(self.sizes))
        other &= self.den * overlap >= self.num * (n + self.sizes - overlap)
        for z in np.flatnonzero(other).tolist():
            if self.label[z] != self.label[k]:
                self.links.append((k, z))
                self.label[self.label == self.label[z]] = self.label[k]

    def close(self) -> None:
        """All links that join components: some leaders first, then every set outside the largest component."""
        asked = np.zeros(len(self.sizes), bool)
        for _ in range(LEADERS):
            names, first, counts = np.unique(self.label, return_index=True, return_counts=True)
            fresh = first[~asked[first]]
            if len(names) == 1 or not len(fresh):
                break
            asked[fresh[0]] = True
            self.search(int(fresh[0]))
        names, counts = np.unique(self.label, return_counts=True)
        outside = self.label != names[np.argmax(counts)]
        for k in np.flatnonzero(outside & ~asked).tolist():
            self.search(k)


def _confirmed(num: int, den: int):
    """For applyInArrow: links among the sets of a group; where some are ``sought`` only those are searched."""

    def run(table: pa.Table) -> pa.Table:
        sid, label, sought = (table.column(c).to_pylist() for c in ("sid", "label", "sought"))
        at = sorted({s: k for k, s in reversed(list(enumerate(sid)))}.values())  # several tasks may send a set
        index = Index([np.frombuffer(table.column("items")[k].as_py(), np.uint64) for k in at], [label[k] for k in at], num, den)
        if any(sought):
            for i, k in enumerate(at):
                if sought[k]:
                    index.search(i)
        else:
            index.close()
        return pa.table({"a": pa.array([sid[at[i]] for i, _ in index.links], pa.string()), "b": pa.array([sid[at[j]] for _, j in index.links], pa.string())})

    return run


def links(texts: DataFrame, members: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``(a, b)``: hex digests of linked sets, spanning each component. ``members``: ``(id, root, n)``."""
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("nb"), F.count("*").alias("m")).where("m > 1").drop("m")
    dealt = materialise(members.join(blocks, "root").select("id", "root", "nb", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("block")), "forest-members")

    def run(batches):
        seen = set()
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(part.column(1), width)
                found = [(d, s) for s in sets if len(s) and (d := xxhash.xxh3_128_hexdigest(s.tobytes())) not in seen and not seen.add(d)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found]), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["sid", "items"])

    held = texts.mapInArrow(run, "sid string, items binary")
    small = dealt.count() <= BROADCAST_SETS
    found = held.join(F.broadcast(dealt) if small else dealt, F.col("sid") == F.col("id")).drop("id")
    large = dealt.where("nb > 1").limit(1).count() > 0
    if large:
        found = materialise(found, "forest-sets")
    everywhere = F.when(F.col("sid") == F.col("root"), F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array("block"))
    inside = found.select("root", "sid", "items", F.col("sid").alias("label"), F.lit(False).alias("sought"), F.explode(everywhere).alias("block"))
    joined = inside.groupBy("root", "block").applyInArrow(_confirmed(num, den), "a string, b string")
    if not large:
        return joined
    joined = materialise(joined, "forest-links")
    merged = component_roots(joined, a="a", b="b").select(F.col("id").alias("m_id"), F.col("root").alias("m_root"))
    many = dealt.where("nb > 1").join(merged, F.col("id") == F.col("m_id"), "left").select("id", "root", F.coalesce("m_root", "id").alias("label"))
    sizes = many.groupBy("root", "label").count()
    main = sizes.groupBy(F.col("root").alias("f_root")).agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    labelled = materialise(many.join(main, F.col("root") == F.col("f_root")).select(F.col("id").alias("l_id"), "label", (F.col("label") != F.col("main")).alias("outside")), "forest-labels")
    sets = found.where("nb > 1").join(labelled, F.col("sid") == F.col("l_id")).drop("l_id")
    shares = sets.where("outside").groupBy(F.col("root").alias("q_root")).agg(F.ceil(F.sum(F.length("items") / 8) / BLOCK_SHINGLES).cast("int").alias("nq"))
    sets = sets.join(shares, F.col("root") == F.col("q_root")).drop("q_root")
    share = F.pmod(F.xxhash64("sid", F.lit(1)), F.col("nq")).cast("int")
    listed = sets.withColumn("sought", F.lit(False)).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    asked = (sets.where("outside").withColumn("own", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).where("block != own")
                 .withColumn("sought", F.lit(True)).withColumn("share", share))
    columns = ["root", "block", "share", "sid", "items", "label", "sought"]
    across = listed.select(columns).unionByName(asked.select(columns)).groupBy("root", "block", "share").applyInArrow(_confirmed_asked(num, den), "a string, b string")
    return joined.unionByName(across)


def _confirmed_asked(num: int, den: int):
    """As ``_confirmed``, for a block that sets of other blocks may or may not ask."""
    confirmed = _confirmed(num, den)

    def run(table: pa.Table) -> pa.Table:
        if not pa.compute.any(table.column("sought")).as_py():
            return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string())})
        return confirmed(table)

    return run


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``; sets link when den * intersection >= num * union."""
    texts = _texts(docs, id_col, text_col)
    scanned = scan(texts, width, trees(num, den))
    rows = scanned.select("doc_id", "n", F.lower(F.hex("sid")).alias("sid"))
    family = families(orders(scanned), least_agreement(num, den))
    classes = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"))
    members = family.join(classes, F.col("id") == F.col("sid")).select("id", "root", "n")
    roots = component_roots(links(texts, members, width, num, den), a="a", b="b")
    roots = materialise(roots.select(F.col("id").alias("r_id"), F.col("root").alias("r_root")), "forest-components")
    placed = classes.join(roots, F.col("sid") == F.col("r_id"), "left").select("sid", "least", F.coalesce("r_root", "sid").alias("root"))
    component = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(component, "root").select(F.col("sid").alias("c_sid"), "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (rows.join(placed, F.col("sid") == F.col("c_sid"), "left")
                .select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")))
