"""Jaccard join of documents as sets of word n-grams, by pivots and triangle-inequality windows.

Jaccard distance is a metric, but almost all pairs of unrelated documents are at distance 1, where a
document as pivot says nothing. So the outermost pivots are single n-grams: a document is nearest to the
n-grams that it holds, and two documents within the radius share at least l of the first n - ceil(t n) + l
of their n-grams in any common order (here: frequent ones last, else by hash; l is SHARED of n). Documents
with fewer than l shared n-grams among their first have no link and leave. Of those that are left all
n-grams are counted, so that the order is now by how many of them hold an n-gram: each n-gram is a region of
the documents that hold it, cut where sizes differ too much. Two linked documents share at least 1 - t of
either's n-grams, so a document stays only in its rarest regions, all but the most crowded ones that together
have fewer n-grams than that; the order is common, so this parts no pair. Documents that only have lines
or passages in common, however many hold them, so meet in no region. Overlapping regions are united.

Inside a region, documents are pivots. A document within the radius r of its nearest pivot is linked to
it, and so to all others there: that is the pivot's cell. What remains to be found are links that cross
a cell's rim; by the triangle inequality they lead from a cell to documents within 2 r of its pivot. Those
not yet connected to it are replicated to the cell as its boundary, and the two sides are compared where
their distances to the pivot differ by at most r. Documents in no cell form a new region and are joined
recursively, until a region fits in memory; there the same windows steer an exact search. Regions that
pivots hardly split are joined block by block. Equal sets are one node throughout.

Sizes: sets travel only to regions that hold a candidate; regions over REGION_TOKENS (some hundred short
texts) are split as above, so that no task gathers one. The list of frequent n-grams, which only steers
the order, is bounded by the mean size of a set over FREQUENT.

Words, n-grams and sets are compared by 64-bit hashes that aren't linear in their bytes; apart from their
collisions the join is exact. Of N different sets two are taken for one with a probability of N * N / 2**65.

Cases: null or empty texts, and texts without words, have no n-grams and link to nothing; texts of fewer
words than n are one n-gram; rows that repeat an id are kept; a null id counts as the smallest; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm.bytekit import mix, pieces, raw, release, word_hash
from lodestone.llm.components import components
from lodestone.llm.store import drop, join_small, lasting, passing, small_batches, written

WORDS, PERCENT = 5, 80
#: Share of documents from which on an n-gram counts as frequent (and stands last in the order).
FREQUENT = 0.001
#: Documents with candidates up to which their ids (32 bytes each) are broadcast to the texts; more are joined by a shuffle.
ASKED_ROWS = 1_000_000
#: Share of a set's n-grams that must be found shared among its first ones.
SHARED = 0.2
#: Weight of a region that is joined at once (its n-grams, and SET_WEIGHT for each set), pivots of a larger one, and weight of what one group of regions holds.
REGION_TOKENS, SET_WEIGHT = 1 << 16, 100
PIVOTS = 8
BIN_TOKENS = 1_000_000
UNIT = 12 << 20
LEAST_BLOCKS, BLOCK_BYTES = 128, 16 << 20
WORD_KEY = 0x51ED270B9A3C6F1D
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
FACTORS = np.random.default_rng(202).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NO_ID = -(1 << 63)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, one row after the other, and the rows' bounds."""
    rows = len(offsets) - 1
    text = ~IS_SPACE[data]
    left, right = np.zeros(len(data), bool), np.zeros(len(data), bool)
    left[1:], right[:-1] = text[:-1], text[1:]
    inner = offsets[:-1][np.diff(offsets) > 0]
    left[inner] = False
    right[offsets[1:][np.diff(offsets) > 0] - 1] = False
    start, end = np.flatnonzero(text & ~left), np.flatnonzero(text & ~right) + 1
    word = word_hash(FOLD[data], start, end, WORD_KEY)
    row = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    n = max(0, len(word) - words + 1)
    gram = np.zeros(n, np.uint64)
    for k in range(words):
        gram += word[k : k + n] * FACTORS[k]
    gram = mix(gram)
    out, bounds = [], np.zeros(rows + 1, np.int64)
    for r in range(rows):
        c, a = count[r], first[r]
        if c >= words:
            own = np.unique(gram[a : a + c - words + 1])
        elif c:
            own = mix((word[a : a + c] * FACTORS[8 : 8 + c]).sum(keepdims=True) + FACTORS[32 + c])
        else:
            own = gram[:0]
        out.append(own)
        bounds[r + 1] = bounds[r] + len(own)
    return (np.concatenate(out) if out else gram[:0]), bounds


def set_hash(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash of each row's set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ FACTORS[50]))])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + FACTORS[51] * np.diff(bounds).astype(np.uint64)).view(np.int64)


def rows_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Pieces of batches with their sets and bytes."""
    for batch in batches:
        data, offsets = raw(batch.column("text"))
        for i, j in pieces(offsets, 1 << 20):
            yield batch.slice(i, j - i), *shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words), int(offsets[j] - offsets[i])


META = "id bigint, n bigint, node bigint, token bigint, seen bigint"


def measure(words: int, frequent: float) -> Callable:
    """Size and set hash of each document; n-grams that are frequent among a task's documents, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs = [], 0, 0

        def common() -> pa.RecordBatch:
            token, seen = np.unique(np.concatenate(held), return_counts=True)
            often = seen >= max(3, frequent * docs)
            t, s = token[often].view(np.int64), seen[often].astype(np.int64)
            none = pa.nulls(len(t), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(t), pa.array(s)], names=["id", "n", "node", "token", "seen"])

        for part, tokens, bounds, nbytes in rows_of(batches, words):
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(bounds)), pa.array(set_hash(tokens, bounds)), none, none], names=["id", "n", "node", "token", "seen"])
            held.append(tokens)
            size, docs = size + nbytes, docs + part.num_rows
            if size >= UNIT:
                yield common()
                held, size, docs = [], 0, 0
        if held:
            yield common()
        del held
        release()

    return run


def least_shared(n: np.ndarray | int) -> np.ndarray | int:
    """l for a set of n n-grams; it never falls as n grows."""
    return np.maximum(1, (np.asarray(n) * SHARED).astype(np.int64))


def prefix_size(n: int, percent: int) -> int:
    """How many first n-grams of a set of n hold l of those that it shares with a set within the radius."""
    return n - -(-percent * n // 100) + int(least_shared(n))


POSTINGS = "block int, body binary"


def packed(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], blocks: int, short: int = 0) -> pa.RecordBatch:
    """(n-gram less its `short` last bits, set, size) packed by n-gram."""
    from lodestone.llm.suffixdedup import by_block, pack

    token, node, n = (np.concatenate(c) for c in zip(*found))
    rows = []
    for b, at in by_block(((token >> np.uint64(16)) % np.uint64(blocks)).astype(np.int64)):
        rows.append((b, pack((token[at] >> np.uint64(short)).astype("<u8"), node[at].astype("<i8"), n[at].astype("<i4"))))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "body"])


def postings(words: int, percent: int, frequent: np.ndarray, blocks: int) -> Callable:
    """The first n-grams of each set, packed by n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, met = [], 0, set()
        for part, tokens, bounds, nbytes in rows_of(batches, words):
            nodes = set_hash(tokens, bounds)
            late = frequent[np.searchsorted(frequent, tokens).clip(max=len(frequent) - 1)] == tokens if len(frequent) else np.zeros(len(tokens), bool)
            for r, node in enumerate(nodes.tolist()):
                own = tokens[bounds[r] : bounds[r + 1]]
                if not len(own) or node in met:
                    continue
                met.add(node)
                p, rare = prefix_size(len(own), percent), own[~late[bounds[r] : bounds[r + 1]]]
                first = rare[:p]
                if len(first) < p:
                    first = np.concatenate([first, own[late[bounds[r] : bounds[r + 1]]][: p - len(first)]])
                found.append((first, np.full(len(first), node), np.full(len(first), len(own), np.int32)))
            size += nbytes
            if size >= UNIT:
                if found:
                    yield packed(found, blocks, 16)
                found, size, met = [], 0, set()
        if found:
            yield packed(found, blocks, 16)
        del found, met
        release()

    return run


def all_postings(blocks: int) -> Callable:
    """All n-grams of each set, packed by n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for node, body in zip(batch.column("node").to_pylist(), batch.column("tokens").to_pylist()):
                own = np.frombuffer(body, "<u8")
                found.append((own, np.full(len(own), node), np.full(len(own), len(own), np.int32)))
                size += len(body)
                if size >= UNIT:
                    yield packed(found, blocks)
                    found, size = [], 0
        if found:
            yield packed(found, blocks)
        del found
        release()

    return run


def shared_in(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, set, size) of all n-grams in a group that several sets hold whose sizes leave no gap."""
    from lodestone.llm.suffixdedup import gathered

    token, node, n = gathered(group.column("body").to_pylist(), "<u8", "<i8", "<i4")
    order = np.lexsort((node, n, token))
    token, node, n = token[order], node[order], n[order].astype(np.int64)
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, n = token[fresh], node[fresh], n[fresh]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])
    number = np.cumsum(new) - 1
    many = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
    return mix(token * FACTORS[60] + number.astype(np.uint64)).view(np.int64)[many], node[many], n[many]


SEEN = "node bigint, n bigint, seen bigint"


def shared_counts(percent: int) -> Callable:
    """Where all first n-grams of a kind meet: how many of them each set shares."""

    def run(group: pa.Table) -> pa.Table:
        _, node, n = shared_in(group, percent)
        who, at, seen = np.unique(node, return_index=True, return_counts=True)
        return pa.table({"node": pa.array(who), "n": pa.array(n[at]), "seen": pa.array(seen.astype(np.int64))})

    return run


SHARES = "gram bigint, node bigint, n bigint, weight bigint, sets bigint"


def shared_grams(percent: int) -> Callable:
    """Where all n-grams of a kind meet: (region of an n-gram, set).

    N-grams that exactly the same sets share are one region, with their number as its weight.
    """

    def run(group: pa.Table) -> pa.Table:
        gram, node, n = shared_in(group, percent)
        heads = np.flatnonzero(np.diff(gram, prepend=gram[:1] + 1)) if len(gram) else np.zeros(0, np.int64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(node.view(np.uint64)))])
        ends = np.append(heads[1:], len(gram)).astype(np.int64)
        _, first, alike = np.unique(np.stack([total[ends] - total[heads], (ends - heads).astype(np.uint64)], 1), axis=0, return_index=True, return_counts=True)
        keep = np.concatenate([np.arange(heads[k], ends[k]) for k in first]) if len(first) else heads
        size = ends[first] - heads[first]
        weight, sets = np.repeat(alike, size), np.repeat(size, size)
        return pa.table({"gram": pa.array(gram[keep]), "node": pa.array(node[keep]), "n": pa.array(n[keep]), "weight": pa.array(weight.astype(np.int64)), "sets": pa.array(sets.astype(np.int64))})

    return run


SETS = "node bigint, n bigint, tokens binary"


def fetch_sets(words: int) -> Callable:
    """The sets of documents that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokens, bounds, _ in rows_of(batches, words):
            ask = part.column("node").to_numpy()
            at = np.flatnonzero(set_hash(tokens, bounds) == ask)  # another text of the same id isn't meant
            body = [tokens[bounds[r] : bounds[r + 1]].tobytes() for r in at]
            yield pa.RecordBatch.from_arrays([pa.array(ask[at]), pa.array(np.diff(bounds)[at]), pa.array(body, pa.binary())], names=["node", "n", "tokens"])
        release()

    return run


class Sets:
    """Sets in memory: their tokens as small numbers, one after the other."""

    def __init__(self, nodes: np.ndarray, bodies: list[bytes]):
        _, keep = np.unique(nodes, return_index=True)
        self.nodes = nodes[keep]
        parts = [np.frombuffer(bodies[k], "<u8") for k in keep]
        self.n = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        values = np.unique(flat)
        self.tokens = np.searchsorted(values, flat).astype(np.int32)
        self.flag = np.zeros(len(values) + 1, np.uint8)

    def shared(self, one: int, others: np.ndarray) -> np.ndarray:
        """Tokens that a set shares with each of others."""
        own = self.tokens[self.start[one] : self.start[one + 1]]
        self.flag[own] = 1
        out = np.empty(len(others), np.int64)
        for i, j in pieces(np.concatenate([[0], np.cumsum(self.n[others])]), 1 << 18):
            n = self.n[others[i:j]]
            at = np.concatenate([[0], np.cumsum(n)])
            where = np.repeat(self.start[others[i:j]] - at[:-1], n) + np.arange(at[-1])
            total = np.concatenate([[0], np.cumsum(self.flag[self.tokens[where]], dtype=np.int64)])
            out[i:j] = total[at[1:]] - total[at[:-1]]
        self.flag[own] = 0
        return out

    def sized(self, one: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of others whose size allows a link."""
        m, n = self.n[one], self.n[others]
        return others[(100 * np.minimum(m, n) >= percent * np.maximum(m, n))]

    def linked(self, one: int, others: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether a set links to each of others, and their distances."""
        both = self.shared(one, others)
        union = self.n[one] + self.n[others] - both
        return 100 * both >= percent * union, 1 - both / union


def search(sets: Sets, percent: int) -> list[tuple[int, int]]:
    """Links that connect exactly what all links connect.

    Each component is grown from a seed, whose distances to all sets left are its pivot distances: a later
    member is compared only to sets whose pivot distance differs from its own by the radius at most.
    """
    radius = 1 - percent / 100 + 1e-9
    left = np.argsort(sets.n, kind="stable")
    edges = []
    while len(left) > 1:
        seed, left = int(left[0]), left[1:]
        hit, far = sets.linked(seed, left, percent)
        if not hit.any():
            continue
        distance = np.ones(len(sets.n))
        distance[left], distance[seed] = far, 0
        queue = left[hit].tolist()
        edges += [(seed, y) for y in queue]
        left = left[~hit]
        while queue and len(left):
            x = queue.pop()
            near = sets.sized(x, left[np.abs(distance[left] - distance[x]) <= radius], percent)
            if len(near):
                hit, _ = sets.linked(x, near, percent)
                found = near[hit]
                edges += [(x, y) for y in found.tolist()]
                queue += found.tolist()
                left = left[~np.isin(left, found)]
    return edges


def edge_table(edges: list[tuple[int, int]], nodes: np.ndarray) -> pa.Table:
    e = np.array(edges, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(nodes[e[:, 0]]), "b": pa.array(nodes[e[:, 1]])})


def join_regions(percent: int) -> Callable:
    """Exact join of the regions that share a task."""

    def run(group: pa.Table) -> pa.Table:
        out = []
        region = group.column("region").to_numpy()
        nodes, bodies = group.column("node").to_numpy(), group.column("tokens").to_pylist()
        order = np.argsort(region, kind="stable")
        sorted_region = region[order]
        heads = np.flatnonzero(np.concatenate([[True], sorted_region[1:] != sorted_region[:-1]])) if len(order) else []
        for a, b in zip(heads, [*heads[1:], len(order)]):
            at = order[a:b]
            sets = Sets(nodes[at], [bodies[k] for k in at])
            out.append(edge_table(search(sets, percent), sets.nodes))
        return pa.concat_tables(out) if out else edge_table([], np.zeros(0, np.int64))

    return run


ROUND = "region bigint, node bigint, n bigint, pivots array<bigint>, distances array<double>, linked array<boolean>"


def to_pivots(percent: int) -> Callable:
    """Members of a region against its pivots: the pivots within 2 r, their distances, and whether they are linked."""
    radius = 1 - percent / 100 + 1e-9

    def run(group: pa.Table) -> pa.Table:
        nodes, pivot = group.column("node").to_numpy(), group.column("pivot").to_numpy(zero_copy_only=False)
        sets = Sets(nodes, group.column("tokens").to_pylist())
        pivots = np.searchsorted(sets.nodes, np.unique(nodes[pivot]))
        members = np.searchsorted(sets.nodes, np.unique(nodes[~pivot]))
        near, far, tied = [[] for _ in members], [[] for _ in members], [[] for _ in members]
        for p in pivots.tolist():
            hit, distance = sets.linked(p, members, percent)
            for k in np.flatnonzero(distance <= 2 * radius).tolist():
                near[k].append(int(sets.nodes[p]))
                far[k].append(float(distance[k]))
                tied[k].append(bool(hit[k]))
        region = pa.array([group.column("region")[0].as_py()] * len(members), pa.int64())
        return pa.Table.from_arrays([region, pa.array(sets.nodes[members]), pa.array(sets.n[members]), pa.array(near, pa.list_(pa.int64())), pa.array(far, pa.list_(pa.float64())), pa.array(tied, pa.list_(pa.bool_()))], names=["region", "node", "n", "pivots", "distances", "linked"])

    return run


def across_rim(percent: int) -> Callable:
    """A cell's inside against its boundary: one link for each boundary set that has any."""
    radius = 1 - percent / 100 + 1e-9

    def run(group: pa.Table) -> pa.Table:
        nodes, bodies, inside, far = group.column("node").to_numpy(), group.column("tokens").to_pylist(), group.column("inside").to_numpy(zero_copy_only=False), group.column("distance").to_numpy()
        sets = Sets(nodes, bodies)
        number = np.searchsorted(sets.nodes, nodes)
        distance, within = np.zeros(len(sets.nodes)), np.zeros(len(sets.nodes), bool)
        distance[number], within[number] = far, inside
        core, edges = np.flatnonzero(within), []
        for y in np.flatnonzero(~within).tolist():
            near = sets.sized(y, core[np.abs(distance[core] - distance[y]) <= radius], percent)
            if len(near):
                hit, _ = sets.linked(y, near, percent)
                edges += [(y, int(near[hit.argmax()]))] if hit.any() else []
        return edge_table(edges, sets.nodes)

    return run


EDGES = "a bigint, b bigint"


def with_bins(regions: DataFrame, most: int) -> DataFrame:
    """regions (region, node, n) with the bin of each region that fits in a task; larger ones have none."""
    sizes = written(regions.groupBy("region").agg(F.sum(F.col("n") + SET_WEIGHT).alias("size")), "regions")
    total = sizes.agg(F.sum(F.when(F.col("size") <= most, F.col("size")))).first()[0] or 0
    bins = 64 + int(4 * total // BIN_TOKENS)
    return regions.join(sizes, "region").withColumn("bin", F.when(F.col("size") <= most, F.pmod(F.xxhash64("region"), F.lit(bins))).cast("int"))


def split_regions(sets: DataFrame, percent: int, most: int, pivots: int) -> DataFrame:
    """Links inside regions that are too large for a task; sets: (region, node, n, tokens)."""
    radius = 1 - percent / 100 + 1e-9
    edges: list[DataFrame] = []
    turn, before = 0, None
    part = lambda c, salt, parts: F.pmod(F.xxhash64(c, F.lit(salt)), parts).cast("int")
    while True:
        sizes = written(sets.groupBy("region").agg(F.sum(F.col("n") + SET_WEIGHT).alias("size")), "large")
        if not sizes.limit(1).count():
            break
        plan = sizes.withColumn("was", F.lit(None).cast("long")) if before is None else sizes.join(before, "region", "left")
        stuck = (F.col("size") > most) & F.coalesce(F.col("size") > 0.7 * F.col("was"), F.lit(False))
        plan = written(plan.select("region", "size", (F.col("size") <= most).alias("fits"), stuck.alias("stuck")), "plan")
        small = join_small(sets, plan.where("fits").select("region"), ["region"], "left_semi")
        edges.append(small.groupBy("region").applyInArrow(join_regions(percent), EDGES))
        blocks = join_small(sets, plan.where("stuck").select("region", F.ceil(2 * F.col("size") / most).cast("int").alias("parts")), ["region"], "inner")
        blocks = blocks.withColumn("own", part("node", 5, F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        blocks = blocks.select("region", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "tokens")
        edges.append(blocks.groupBy("region", "low", "high").applyInArrow(join_regions(percent), EDGES))
        large = plan.where("not fits and not stuck").select("region", "size", F.ceil(F.col("size") / most).cast("int").alias("salts"))
        if not large.limit(1).count():
            break
        active = join_small(sets, large, ["region"], "inner")
        rank = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(turn)), "node"))
        chosen = written(active.select("region", "node").withColumn("rank", rank).where(F.col("rank") <= pivots).select("region", "node", F.lit(True).alias("chosen")), "pivots")
        marked = join_small(active, chosen, ["region", "node"])
        copies = F.array(F.struct(part("node", 3, F.col("salts")).alias("salt"), F.lit(False).alias("pivot")))
        as_pivot = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda k: F.struct(k.alias("salt"), F.lit(True).alias("pivot")))
        dealt = marked.select("region", "node", "n", "tokens", F.explode(F.when(F.col("chosen"), F.concat(copies, as_pivot)).otherwise(copies)).alias("c")).select("region", "node", "n", "tokens", "c.*")
        found = written(dealt.groupBy("region", "salt").applyInArrow(to_pivots(percent), ROUND), "round")
        each = found.select("region", "node", "n", F.explode(F.arrays_zip("pivots", "distances", "linked")).alias("p")).select("region", "node", "n", F.col("p.pivots").alias("pivot"), F.col("p.distances").alias("distance"), F.col("p.linked").alias("linked"))
        links = written(each.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")), "links")
        edges.append(links)
        known = components(links)
        whose = lambda t, c, out: t.join(known.select(F.col("node").alias(c), F.col("component").alias(out)), c, "left").withColumn(out, F.coalesce(out, c))
        apart = whose(whose(each.where(~F.col("linked") & (F.col("distance") <= 2 * radius)), "node", "__y"), "pivot", "__p").where(F.col("__y") != F.col("__p"))
        rim = written(apart.select(F.col("pivot").alias("cell"), "node", "n", "distance"), "rim")
        if rim.limit(1).count():
            home = each.where("linked").groupBy("node").agg(F.min(F.struct("distance", F.col("pivot").alias("cell"), "n")).alias("h")).select("node", "h.*")
            core = home.join(rim.select("cell").distinct(), "cell", "left_semi")
            both = written(rim.withColumn("inside", F.lit(False)).unionByName(core.withColumn("inside", F.lit(True))), "cells")
            shape = both.groupBy("cell").agg(*(F.greatest(F.lit(1), F.ceil(2 * F.sum(F.when(F.col("inside") == i, F.col("n") + SET_WEIGHT)) / most)).cast("int").alias(c) for i, c in ((True, "cores"), (False, "rims"))))
            grid = both.join(shape, "cell").join(sets.select("node", "tokens"), "node")
            own = part("node", 9, F.when(F.col("inside"), F.col("cores")).otherwise(F.col("rims")))
            grid = grid.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("rims")).otherwise(F.col("cores")) - 1)))
            x, y = F.when(F.col("inside"), F.col("own")).otherwise(F.col("other")), F.when(F.col("inside"), F.col("other")).otherwise(F.col("own"))
            grid = grid.select("cell", x.alias("x"), y.alias("y"), "node", "tokens", "inside", "distance")
            edges.append(grid.groupBy("cell", "x", "y").applyInArrow(across_rim(percent), EDGES))
        rest = found.where(~F.exists("linked", lambda v: v)).select("node")
        sets = written(active.select("region", "node", "n", "tokens").join(rest, "node", "left_semi"), "rest")
        before, turn = large.select("region", F.col("size").alias("was")), turn + 1
    out = edges[0] if edges else sets.sparkSession.createDataFrame([], EDGES)
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT, frequent: float = FREQUENT, region_tokens: int = REGION_TOKENS, pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id that links reach from each document."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = small_batches(rows)
    meta = written(rows.mapInArrow(measure(words, frequent), META), "sizes")
    docs_of = meta.where(F.col("token").isNull()).select("id", "n", "node")
    with passing():
        facts = docs_of.agg(F.count(F.lit(1)), F.sum("n")).first()
        count, tokens = facts[0] or 0, facts[1] or 0
        most = int(min(1_000_000, tokens / max(1, count) / frequent + 1))
        often = meta.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= frequent * count)
        listed = often.orderBy(F.desc("seen"), "token").limit(most).select("token").collect()
        common = np.sort(np.array([r[0] for r in listed], np.int64).view(np.uint64))
        blocks = LEAST_BLOCKS + int(8 * tokens) // BLOCK_BYTES
        # a partner has at least percent of a set's n-grams, so it asks for l of that many at least
        needed = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) * SHARED).cast("long"))
        met_first = rows.mapInArrow(postings(words, percent, common, blocks), POSTINGS).groupBy("block").applyInArrow(shared_counts(percent), SEEN)
        able = written(met_first.groupBy("node").agg(F.sum("seen").alias("seen"), F.first("n").alias("n")).where(F.col("seen") >= needed).select("node"), "able")
        nodes = written(docs_of.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n")), "nodes")
        asked = written(nodes.join(able, "node", "left_semi").select("id", "node"), "asked")
        left = written(join_small(rows, asked, ["id"], "inner", ASKED_ROWS).select("text", "node").mapInArrow(fetch_sets(words), SETS).dropDuplicates(["node"]), "left")
        # now all n-grams of the sets left: partners share at least percent of either's, so of each set's, rarest first in an
        # order that all sets have in common, the first that they share stands before the last (least - 1)
        blocks = LEAST_BLOCKS + int(8 * (left.agg(F.sum("n")).first()[0] or 0)) // (BLOCK_BYTES // 4)
        near = written(left.mapInArrow(all_postings(blocks), POSTINGS).groupBy("block").applyInArrow(shared_grams(percent), SHARES), "shared")
        least = F.ceil(F.col("n") * percent / 100)
        upto = F.sum("weight").over(Window.partitionBy("node").orderBy(F.desc("sets"), "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        held = written(near.withColumn("upto", upto).where(F.col("upto") >= least).select("gram", "node"), "held")
        heads = held.groupBy("gram").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("gram", "a")
        regions = components(held.join(heads, "gram").select("a", F.col("node").alias("b")))
        drop(near)
        drop(held)
        regions = written(with_bins(left.select("node", "n").join(regions, "node").select("node", "n", F.col("component").alias("region")), region_tokens).select("node", "region", "bin"), "regions")
        sets = written(join_small(left, regions, ["node"], "inner", ASKED_ROWS), "sets")
        drop(left)
        links = sets.where(F.col("bin").isNotNull()).groupBy("bin").applyInArrow(join_regions(percent), EDGES)
        links = links.unionByName(split_regions(sets.where(F.col("bin").isNull()).drop("bin"), percent, region_tokens, pivots))
        linked = components(links)
        named = nodes.join(linked, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
        least = named.groupBy("component").agg(F.min("id").alias("least"))
        table = lasting(named.join(least, "component").select("node", "least"), "components")
    out = docs_of.join(table, "node", "left").select("id", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("least"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("least").alias("component_id"))


def join_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return join(docs.select("doc_id", "text"))
