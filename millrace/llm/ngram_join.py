"""Jaccard join of word n-gram sets with index skipping and derived answers.

1. One pass gives each document's set size and a 128-bit digest of its set, and counts shingles in
   a sketch of fixed size (``SKETCH`` counters). Equal sets are one from here on.
2. A set is cut into classes of shingles by their hashes, as many as its size asks for (``_grades``).
   Two sets that link differ in ``d = n + m - 2 a`` shingles at most, with a the overlap they need, so
   in d classes at most. Any order that depends on a class's content alone gives an exact prefix
   filter: of the classes that are equal, the first stands behind d others at most in either set. The
   order puts classes of many and rare (by the sketch) shingles first. Each set is indexed under its
   first ``d + 1`` classes with its size and their positions. One shared shingle does not make two
   sets candidates, so candidates do not grow with the square of the input as chance meetings do.
   Sets with too few classes that hold a shingle meet by prefixes of single shingles as well.
3. Index lists come sorted by (size, position): a list is a row of blocks of equal size. Two sets of
   sizes n <= m that share the class at positions i and j can only link when ``t m <= n`` and neither
   i nor j is above their d. The sets of a block are chained when it is read; so an entry meets one
   entry of each block, not each entry, and the rest of the block is skipped.
   What comes out is not pairs but families: sets connected by possible links.
4. Within a family, links are found by a search from set to set. The overlaps of the first set with
   the family are counted from the family's lists; those of a set similar to one already counted are
   derived from it by the lists of the shingles in which the two differ. A set is passed over when
   the derived bound rules out every set not yet reached. Only the links of a spanning forest come
   out, so a group of any size gives a row per member.
   A family above ``BLOCK_SHINGLES`` is dealt into blocks: first each block by itself, then each
   pair of blocks, in which what is connected already is not searched again.
   Only sets of families leave the task that makes them (``member_marks``).

All decisions are exact but for the equality of 64-bit shingle hashes and 128-bit digests.

Rows: one per input row. Null or blank text has size 0 and is linked with nothing. ``component_id``
is the smallest doc_id reachable, a row's own for size 0 (null when there is none). Repeated rows
are one set; rows of the same id with different texts are different sets. An empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, materialise, text_slices
from millrace.llm.shingle_sets import mix, shingle_sets
from millrace.operators.components import component_roots

SKETCH = 1 << 22
SKETCH_BLOCK = 1 << 12
#: Classes of a set that are at hand for each one it is indexed under, where it is smallest in its grade.
CLASSES = 7
#: Bits that mark the sets of families, and those of a part.
MARKS, MARKS_PART = 1 << 27, 1 << 15
#: Shingles of a family that one task holds (eight bytes each, some copies).
BLOCK_SHINGLES = 4_000_000
#: Sets whose ids are broadcast at most; more of them are joined by shuffle.
BROADCAST_SETS = 300_000


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return bounded_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def scan(docs: DataFrame, width: int) -> DataFrame:
    """Rows of documents ``(doc_id, n, sid)`` and of sketch parts ``(block, counts)`` in one table."""

    def run(batches):
        counts = np.zeros(SKETCH, np.int64)
        names = ["doc_id", "n", "sid", "block", "counts"]
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingle_sets(part.column(1), width)
                if any(map(len, sets)):
                    counts += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
                     pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names)
        # The level decides an order only, so a part's counts may saturate.
        parts = np.minimum(counts, 65_535).astype("<u2").reshape(-1, SKETCH_BLOCK)
        hit = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(hit), pa.int64()), pa.nulls(len(hit), pa.int64()), pa.nulls(len(hit), pa.binary()), pa.array(hit, pa.int32()),
             pa.array([parts[i].tobytes() for i in hit], pa.binary())], names=names)

    return materialise(_texts(docs).mapInArrow(run, "doc_id bigint, n bigint, sid binary, block int, counts binary"), "ngram-scan")


def sketch_levels(scanned: DataFrame) -> np.ndarray:
    """log2 of the counters as one byte each: SKETCH bytes, whatever the input."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), "<u2")
        levels = np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.table({"block": table.column("block")[:1], "levels": pa.array([levels.tobytes()], pa.binary())})

    out = np.zeros(SKETCH, np.uint8)
    added = scanned.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, levels binary")
    for block, levels in materialise(added, "ngram-levels").collect():
        out[block * SKETCH_BLOCK:(block + 1) * SKETCH_BLOCK] = np.frombuffer(levels, np.uint8)
    return out


def _distinct_sets(batches, width: int):
    """Each set of the task once, with its digest. Sets without shingles are left out."""
    seen = set()
    for batch in batches:
        for part in text_slices(batch, "text", 2 << 20):
            found = []
            for s in shingle_sets(part.column(1), width):
                if len(s) and (d := _digest(s)) not in seen:
                    seen.add(d)
                    found.append((d, s))
            if found:
                yield found


def _grades(n: np.ndarray, num: int, den: int):
    """``(grade, most)`` for sets of sizes ``n``: a grade is the sizes from 4^g to 4^(g+1), two sets meet in
    that of the smaller one, where they differ in ``most`` shingles at most. Grade -1: not met there."""
    of = lambda x: (np.frexp(x.astype(np.float64))[1] - 1) // 2
    own, least = of(n), of(np.maximum(-(-num * n // den), 1))
    for down in range(int((own - least).max(initial=0)) + 1):
        grade = own - down
        largest = np.int64(4) ** np.maximum(grade + 1, 0) - 1 if down else den * n // num
        most = (den - num) * (n + largest) // (den + num)
        yield np.where((grade >= least) & (most > 0), grade, -1), most     # sets that differ in nothing are one already


def _ranked_classes(sets: list[np.ndarray], grade: int, most: np.ndarray, rarity: np.ndarray, num: int, den: int):
    """``(place, key, rank, poor)``: the first ``most + 1`` classes of each set, by place in ``sets``, and
    whether a set has no more than ``most`` of them. Order and keys depend on a class's shingles only."""
    k = max(8, min(-(-CLASSES * (den - num) * 4 ** grade // num), 4 ** (grade + 2)))
    flat = np.concatenate(sets)
    at = np.repeat(np.arange(len(sets)) * k, [len(s) for s in sets]) + ((flat >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    weight = np.bincount(at, rarity[(flat & np.uint64(SKETCH - 1)).astype(np.int64)], len(sets) * k).astype(np.int64)
    digest = np.zeros(len(sets) * k, np.uint64)
    np.add.at(digest, at, mix(flat))
    held = np.flatnonzero(weight)
    place = held // k
    last = (1 << 20) - 1
    order = np.argsort((place << 40) | ((last - np.minimum(weight[held], last)) << 20) | (digest[held] >> np.uint64(44)).astype(np.int64), kind="stable")
    n_held = np.bincount(place, minlength=len(sets))
    rank = np.arange(len(held)) - np.repeat(np.r_[0, np.cumsum(n_held)[:-1]], n_held)
    first = rank <= most[place]
    return place[first], mix(digest[held[order[first]]] ^ np.uint64(grade + 1)), rank[first], n_held <= most


def index_keys(sets: list[np.ndarray], levels: np.ndarray, rarity: np.ndarray, num: int, den: int):
    """``(place, key, rank)`` of the index entries of sets, which are not empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    poor, out = np.zeros(len(sets), bool), []
    for grades, most in _grades(sizes, num, den):
        for grade in np.unique(grades[grades >= 0]).tolist():
            of = np.flatnonzero(grades == grade)
            place, key, rank, few = _ranked_classes([sets[i] for i in of], grade, most[of], rarity, num, den)
            poor[of] |= few
            out.append((of[place], key, rank))
    for i in np.flatnonzero(poor).tolist():
        s = sets[i]
        order = np.argsort(levels[(s & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")
        prefix = s[order[:len(s) - -(-num * len(s) // den) + 1]]
        out.append((np.full(len(prefix), i), mix(~prefix), np.zeros(len(prefix), np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*out)))


def postings(docs: DataFrame, width: int, levels: np.ndarray, num: int, den: int) -> DataFrame:
    """``(token, at, sid)``: the index, ``at`` = size * 2^32 + position, ``sid`` half of a set's digest: sets that
    it confuses are in one family, no more. A set occurs once per task that saw it."""
    held = docs.sparkSession.sparkContext.broadcast(levels.tobytes())  # SKETCH bytes

    def run(batches):
        level = np.frombuffer(held.value, np.uint8)
        rarity = (int(level.max()) + 1 - level).astype(np.uint8)
        for found in _distinct_sets(batches, width):
            sets = [s for _, s in found]
            place, key, rank = index_keys(sets, level, rarity, num, den)
            sizes = np.array([len(s) for s in sets], np.int64)
            sids = np.frombuffer(b"".join(d[:8] for d, _ in found), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array((sizes[place] << 32) + rank), pa.array(sids[place])],
                                             names=["token", "at", "sid"])

    return _texts(docs).mapInArrow(run, "token bigint, at bigint, sid bigint")


class Forest:
    """Union-find over numbers; the root of a tree is its smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.setdefault(r, r)) != r:
            r = p
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class ListReader:
    """Reads index entries in order of (token, size, position) and joins sets that may link.

    Of the current list it keeps the first entry of each block within reach, nothing more."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.forest, self.token = num, den, Forest(), None

    def most(self, n, m):
        """The shingles in which sets of sizes n and m that link may differ."""
        return n + m + 2 * (-self.num * (n + m) // (self.num + self.den))

    def entry(self, token: int, n: int, i: int, sid: int) -> None:
        if token != self.token:
            self.token, self.blocks = token, []
            self.last = None
        while self.blocks and self.den * self.blocks[0][0] < self.num * n:
            self.blocks.pop(0)
        if self.last is not None and self.last[0] == n:
            # Within a block entries are chained.
            if sid != self.last[1]:
                self.forest.join(self.last[1], sid)
        for m, j, first in self.blocks:
            if m < n and max(i, j) <= self.most(m, n) and first != sid:
                self.forest.join(first, sid)
        if self.last is None or self.last[0] != n:
            self.blocks.append((n, i, sid))
        self.last = (n, sid)

    def batch(self, token: np.ndarray, at: np.ndarray, sids: np.ndarray, carry: tuple | None):
        """Entries of a batch; lists of one entry are passed over. Returns the batch's last entry,
        which may open a list that goes on in the next batch."""
        if carry is not None:
            token, at, sids = np.r_[carry[0], token], np.r_[carry[1], at], np.r_[carry[2], sids]
        same = token[1:] == token[:-1]
        live = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        for k, t, x, sid in zip(live.tolist(), token[live].tolist(), at[live].tolist(), sids[live].tolist()):
            if carry is not None and k == 0 and carry[3]:
                continue  # read with its own batch
            self.entry(t, x >> 32, x & 0xFFFFFFFF, sid)
        k = len(token) - 1
        return int(token[k]), int(at[k]), int(sids[k]), bool(len(live) and live[-1] == k)


def families(index: DataFrame, num: int, den: int) -> DataFrame:
    """``(id, root)``: the first half of the hex digests of sets that may link with another, by family."""

    def run(batches):
        reader, carry = ListReader(num, den), None
        for batch in batches:
            if batch.num_rows:
                carry = reader.batch(*(batch.column(k).to_numpy() for k in range(3)), carry)
        forest = reader.forest
        name = lambda x: f"{x & 0xFFFFFFFFFFFFFFFF:016x}"
        star = [(name(r), name(x)) for x in forest.up if (r := forest.root(x)) != x]
        for k in range(0, len(star), 50_000):
            a, b = zip(*star[k:k + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    lists = index.repartition("token").sortWithinPartitions("token", "at", "sid")
    stars = materialise(lists.mapInArrow(run, "a string, b string"), "ngram-stars")     # the lists' files go at its end
    return component_roots(stars.distinct(), a="a", b="b")


def spanning_links(sets: list[np.ndarray], num: int, den: int, known: list | None = None) -> list[tuple[int, int]]:
    """Links (pairs of places in ``sets``) that connect what links connect. ``known``: labels of
    sets that are connected already; their links are not sought again."""
    m = len(sets)
    if m < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    token = np.cumsum(np.r_[True, flat[order][1:] != flat[order][:-1]]) - 1
    lists, starts = owner[order], np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    ends = np.r_[starts[1:], len(token)]
    numbered = np.empty(len(flat), np.int64)
    numbered[order] = token
    cut = np.r_[0, np.cumsum(sizes)]
    tokens = [numbered[cut[k]:cut[k + 1]] for k in range(m)]

    def counted(ts: np.ndarray) -> np.ndarray:
        """How many of these tokens each set has, from the index lists."""
        n = ends[ts] - starts[ts]
        at = np.repeat(starts[ts] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.bincount(lists[at], minlength=m)

    labels: dict = {}
    for k, x in enumerate(known or []):
        labels.setdefault(x, []).append(k)
    open_ = np.ones(m, bool)
    links: list[tuple[int, int]] = []

    def reach(k: int, parent: int) -> list[tuple[int, int]]:
        group = labels[known[k]] if known else [k]
        open_[group] = False
        return [(g, parent) for g in group]

    for leader in range(m):
        if not open_[leader]:
            continue
        # Answers that queued sets may be derived from, and how many of those are left; the queue goes deep first.
        answers: dict[int, np.ndarray] = {}
        pending: dict[int, int] = {}
        queue = reach(leader, -1)
        while queue and open_.any():
            y, parent = queue.pop()
            left = np.flatnonzero(open_)
            need = -(-num * (sizes[y] + sizes[left]) // (num + den))
            if parent in answers:
                x = answers[parent]
                pending[parent] -= 1
                if not pending[parent]:
                    del answers[parent], pending[parent]
                gone, come = np.setdiff1d(tokens[parent], tokens[y], assume_unique=True), np.setdiff1d(tokens[y], tokens[parent], assume_unique=True)
                if not np.any(x[left] + len(come) >= need):
                    continue  # the parent's answers rule out all that is left
                if len(gone) + len(come) < sizes[y]:
                    overlap = x - counted(gone) + counted(come)
                else:
                    overlap = counted(tokens[y])
            else:
                overlap = counted(tokens[y])
            found = left[den * overlap[left] >= num * (sizes[y] + sizes[left] - overlap[left])]
            children = []
            for z in found.tolist():
                if open_[z]:
                    links.append((y, z))
                    children += reach(z, y)
            if children:
                answers[y], pending[y] = overlap, len(children)
                queue += children
    return links


def _links_in(keys: list[str], num: int, den: int):
    """For applyInArrow: the spanning links of one group of sets."""

    def run(table: pa.Table) -> pa.Table:
        sid, label = table.column("sid").to_pylist(), table.column("label").to_pylist()
        first = {s: k for k, s in reversed(list(enumerate(sid)))}  # tasks that saw equal sets each sent one
        at = sorted(first.values())
        sets = [np.frombuffer(table.column("items")[k].as_py(), np.uint64) for k in at]
        known = [label[k] for k in at]
        links = spanning_links(sets, num, den, known if all(x is not None for x in known) else None)
        return pa.table({"a": pa.array([sid[at[i]] for i, _ in links], pa.string()), "b": pa.array([sid[at[j]] for _, j in links], pa.string())})

    return run


def member_marks(members: DataFrame) -> bytes:
    """A bit for each value of the first 27 bits of ``id`` that occurs: at most ``MARKS`` bits, whatever the input."""

    def add(table: pa.Table) -> pa.Table:
        bits = np.zeros(MARKS_PART, np.uint8)
        bits[table.column("bit").to_numpy() % MARKS_PART] = 1
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    bit = F.shiftright(F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint"), 32 - (MARKS.bit_length() - 1))
    marked = members.select(bit.alias("bit")).distinct().withColumn("part", F.shiftright("bit", MARKS_PART.bit_length() - 1).cast("int"))
    out = bytearray(MARKS // 8)
    step = MARKS_PART // 8
    for part, bits in marked.groupBy("part").applyInArrow(add, "part int, bits binary").collect():
        out[part * step:(part + 1) * step] = bits
    return bytes(out)


def member_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``(sid, items)``: the sets of ``members`` (id), and few others; the rest stays where it is made."""
    held = docs.sparkSession.sparkContext.broadcast(member_marks(members))

    def run(batches):
        marks = np.frombuffer(held.value, np.uint8)
        for found in _distinct_sets(batches, width):
            bit = np.frombuffer(b"".join(d[:4] for d, _ in found), ">u4").astype(np.int64) >> (32 - (MARKS.bit_length() - 1))
            kept = [found[k] for k in np.flatnonzero(marks[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).tolist()]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([d.hex() for d, _ in kept]), pa.array([s.tobytes() for _, s in kept], pa.binary())], names=["sid", "items"])

    return _texts(docs).mapInArrow(run, "sid string, items binary")


def links(docs: DataFrame, members: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``(a, b)``: hex digests of linked sets, spanning each component. ``members``: ``(id, root, n)``."""
    total = F.sum("n").alias("total")
    blocks = members.groupBy("root").agg(total).select("root", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("nb"))
    dealt = materialise(members.join(blocks, "root").select("id", "root", "nb", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("block")), "ngram-members")
    held = member_sets(docs, dealt, width)
    small = dealt.count() <= BROADCAST_SETS
    found = held.join(F.broadcast(dealt) if small else dealt.hint("shuffle_hash"), F.col("sid") == F.col("id")).drop("id")
    large = dealt.where("nb > 1").limit(1).count() > 0
    if large:
        found = materialise(found, "ngram-sets")
    inside = (found.withColumn("label", F.lit(None).cast("string")).groupBy("root", "block")
                   .applyInArrow(_links_in(["root", "block"], num, den), "a string, b string"))
    inside = materialise(inside, "ngram-links")     # the sets' files go at its end
    if not large:
        return inside
    merged = component_roots(inside, a="a", b="b").select(F.col("id").alias("m_id"), F.col("root").alias("label"))
    both = (found.where("nb > 1").join(merged, F.col("sid") == F.col("m_id"), "left").drop("m_id")
                 .withColumn("label", F.coalesce("label", "sid"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).where("other != block")
                 .withColumn("pair", F.concat_ws("-", F.least("block", "other"), F.greatest("block", "other"))))
    across = both.groupBy("root", "pair").applyInArrow(_links_in(["root", "pair"], num, den), "a string, b string")
    return inside.unionByName(materialise(across, "ngram-links"))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``; sets link when den * intersection >= num * union."""
    scanned = scan(docs, width)
    index = postings(docs, width, sketch_levels(scanned), num, den)
    rows = materialise(scanned.where("block is null").select("doc_id", "n", F.lower(F.hex("sid")).alias("sid")), "ngram-rows", last_use_of=(scanned,))
    family = families(index, num, den)
    classes = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"))
    members = family.join(classes, F.col("id") == F.substring("sid", 1, 16)).select(F.col("sid").alias("id"), "root", "n")
    roots = component_roots(links(docs, members, width, num, den), a="a", b="b")
    roots = materialise(roots.select(F.col("id").alias("r_id"), F.col("root").alias("r_root")), "ngram-components")
    least = (classes.join(roots, F.col("sid") == F.col("r_id"), "left").select("sid", "least", F.coalesce("r_root", "sid").alias("root")))
    component = least.groupBy("root").agg(F.min("least").alias("component_id"))
    least = least.join(component, "root").select(F.col("sid").alias("c_sid"), "component_id")
    return (rows.join(least, F.col("sid") == F.col("c_sid"), "left")
                .select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, broadcast_rows: int = BROADCAST_SETS) -> DataFrame:
    """The documents without those that are linked to one of a smaller id; columns of ``docs``.
    Rows that share an id go or stay together; rows without an id stay."""
    near = near_duplicates(docs, width, num, den)
    gone = materialise(near.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct(), "ngram-gone")
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
