"""N-gram Jaccard self-join with token-combination prefixes.

A document is the set of its word shingles. Documents with one set are one node. Tokens (shingle hashes)
are ordered rare first; frequent tokens, a bounded table found by counting, come last. Two similar sets
share their first common token inside their prefixes; if that token is rare, single tokens of the prefix
find the pair. If all they share there is frequent, the prefix is extended by one and they share two of
its frequent tokens: the index holds the pairs of those. Sets with so many frequent tokens in the prefix
that the combinations explode index them singly, against all sets with such tokens.

Candidate pairs that even their bit maps tell apart are dropped; the others are verified on the whole
sets. First every node is compared with one hub it shares most index keys with; then, in a few rounds, with the set
of another component that its bit map is nearest to; then all pairs of different components that share a key. The sets
of a key meet in one task for that, and only pairs that may be similar leave it. So a group of thousands of near
copies costs a few pairs each, while no link between two components is lost.

The links of every set are counted afterwards, as all of them are inside components: a component of more than
two sets is dealt to blocks by size and hash, every two blocks that may hold similar sets are compared in one
step, and only a count for each set leaves it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.common import BROADCAST_IDS, FOLD_BYTES, keep_rows, tasks_for, text_rows, tidy
from usagelens.llm.components import connected
from usagelens.llm.scratch import Scratch
from usagelens.llm.shingles import shingle_sets, slices
from usagelens.operators.skew import salted_join

SHINGLE = 5
#: similar from 100 * intersection >= PERCENT * union on
PERCENT = 75
#: a token in more sets than this is frequent, as far as the table has room
FREQUENT_FROM = 64
FREQUENT_TOKENS = 500_000
#: tokens that a task counts at once
TASK_TOKENS = 3_000_000
#: frequent tokens of a prefix that are combined in pairs; sets with more of them use single tokens
COMBINED = 24

#: rounds of comparing nodes with one hub each, and then with the set nearest by bit map, before all open pairs are compared
STAR_ROUNDS = 1
NEAREST_ROUNDS = 2
#: tasks of the index for each of the session's: a set has about a hundred entries, which a task sorts in memory
ENTRY_TASKS = 4
#: sets under one key that are all looked at
NEAR_SETS = 32

#: sets of a key that meet in one task, or half as many pairs of two blocks; pairs of them that are looked at together
KEY_SETS = 8192
KEY_PAIRS = 1 << 16
#: sets of a key from which on it is compared by itself; those of fewer are compared together, so many rows at once
LARGE_KEY = 64
KEY_ROWS = 50_000
#: nodes whose nearest ones a task holds
TASK_NODES = 100_000

#: sets and tokens of a block, two of which are compared at once
BLOCK_SETS = 256
BLOCK_TOKENS = 1 << 22
#: tokens that are compared at once
BLOCK_COLUMNS = 4096

_RARE, _PAIR, _SINGLE, _SINGLE_BIG = range(4)


def least_overlap(n: int) -> int:
    """Tokens that a set of n shares at least with any similar one."""
    return -(-PERCENT * n // 100)


def prefix_length(n: int, shared: int = 1) -> int:
    """So many first tokens hold at least ``shared`` common ones."""
    return min(n, n - least_overlap(n) + shared)


def _nodes(batches: Iterator[pa.RecordBatch], size: int):
    """(ids, node ids, sets) for slices of the rows; equal sets have equal node ids."""
    for batch in batches:
        rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
        for part in slices((doc_id, text.translate(FOLD_BYTES)) for doc_id, text in rows):
            sets = shingle_sets([text for _, text in part], size)
            nodes = [
                int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets
            ]
            yield [doc_id for doc_id, _ in part], nodes, sets


def signature(tokens: np.ndarray) -> bytes:
    """Bit map of a set: at least two bits a token, their number a power of two. A bit is set for an odd number of tokens."""
    bits = max(256, 1 << int(2 * len(tokens)).bit_length())
    marks = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(marks.astype(np.uint8), bitorder="little").tobytes()


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Maps, a row each, as those of fewer bits."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits maps differ, row by row: each is a token that only one of the two sets has, at least."""
    width = min(x.shape[1], y.shape[1])
    return np.bitwise_count(folded(x, width) ^ folded(y, width)).sum(axis=1, dtype=np.int64)


def most_common(x: bytes, y: bytes, n: int, m: int) -> int:
    """Upper bound of the tokens two sets share."""
    apart = bits_apart(np.frombuffer(x, np.uint64)[None], np.frombuffer(y, np.uint64)[None])
    return (n + m - int(apart[0])) // 2


def set_nodes(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, node, n, map: the node of each row's set, the set's size and bit map."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, nodes, sets in _nodes(batches, size):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([signature(s) for s in sets], pa.binary()),
                ],
                names=["doc_id", "node", "n", "map"],
            )

    return rows.mapInArrow(tidy(describe), "doc_id long, node long, n int, map binary")


def repeated(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that occur more than once, and how often. Sorts in place: a task's tokens are held once."""
    tokens.sort()
    again = np.concatenate([[False], tokens[1:] == tokens[:-1], [False]])
    turns = np.flatnonzero(again[1:] != again[:-1])
    begin, end = turns[::2], turns[1::2]
    return tokens[begin], end - begin + 1


def frequent_tokens(rows: DataFrame, size: int = SHINGLE, least: int = FREQUENT_FROM, room: int = FREQUENT_TOKENS):
    """The most frequent tokens of the sets, at most ``room``.

    Tokens that a task sees once are not sent. The join is exact under any choice: the table only decides
    which tokens come last in the order.
    """

    def tally(tokens: np.ndarray) -> pa.RecordBatch:
        tokens, counts = repeated(tokens)
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], names=["token", "seen"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = np.empty(TASK_TOKENS, np.uint64), 0, set()
        for _, nodes, sets in _nodes(batches, size):
            for node, s in zip(nodes, sets):
                if node in seen:
                    continue
                if total + len(s) > len(held):
                    yield tally(held[:total])
                    held, total, seen = held if len(s) <= len(held) else np.empty(len(s), np.uint64), 0, set()
                seen.add(node)
                held[total : total + len(s)] = s
                total += len(s)
        if total:
            yield tally(held[:total])

    counted = rows.mapInArrow(tidy(count), "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen"))
    found = counted.filter(F.col("seen") > least).orderBy(F.desc("seen"), "token").limit(room)
    # most frequent first, so the rank from the end is the place in the order: rarer ones come earlier
    tokens = found.select("token").toArrow().column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - order).astype(np.int64)


def _ordered(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """A set in the order of all tokens, rare ones by hash and then frequent ones by count; how many are rare."""
    known, ranks = frequent
    if not len(known):
        return tokens, len(tokens)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    often = known[at] == tokens
    last = tokens[often][np.argsort(ranks[at[often]])]
    return np.concatenate([tokens[~often], last]), len(tokens) - len(last)


def _index_of(tokens: np.ndarray, frequent: tuple, combined: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, places of the first token, kinds) under which a set is indexed."""
    n = len(tokens)
    order, rare = _ordered(tokens, frequent)
    one, two = prefix_length(n), prefix_length(n, 2)
    keys, places, kinds = [order[: min(one, rare)]], [np.arange(min(one, rare))], [np.full(min(one, rare), _RARE)]
    tail = order[rare:two]
    if one > rare or len(tail) >= 2:
        salt = np.uint64(0xA0761D6478BD642F)
        with np.errstate(over="ignore"):
            big = len(tail) > combined
            if not big and len(tail) >= 2:
                i, j = np.triu_indices(len(tail), 1)
                keys.append((tail[i] * salt) ^ (tail[j] * np.uint64(0xE7037ED1A0B428DB) + np.uint64(1)))
                places.append(rare + i)
                kinds.append(np.full(len(i), _PAIR))
            elif not big and n == 1:
                big = True  # a set of one token has no pairs
            single = order[rare : max(one, rare)]
            keys.append(single * salt + np.uint64(3))
            places.append(rare + np.arange(len(single)))
            kinds.append(np.full(len(single), _SINGLE_BIG if big else _SINGLE))
    return np.concatenate(keys), np.concatenate(places), np.concatenate(kinds)


def index_entries(rows: DataFrame, frequent: tuple, size: int = SHINGLE, combined: int = COMBINED) -> DataFrame:
    """key, node, n, place, kind: the index keys under which a set may have a similar one."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT_TOKENS tokens with their ranks

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes, sets in _nodes(batches, size):
            own = {node: s for node, s in zip(nodes, sets) if len(s)}
            parts = [_index_of(s, shared.value, combined) for s in own.values()]
            if not parts:
                continue
            many = [len(keys) for keys, _, _ in parts]
            n = np.repeat(np.array([len(s) for s in own.values()], np.int64), many)
            place = np.concatenate([places for _, places, _ in parts]).astype(np.int64)
            kind = np.concatenate([kinds for _, _, kinds in parts]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([keys for keys, _, _ in parts]).view(np.int64)),
                    pa.array(np.repeat(np.array(list(own), np.int64), many)),
                    pa.array(n << 32 | place << 2 | kind),
                ],
                names=["key", "node", "facts"],
            )

    sent = rows.mapInArrow(tidy(entries), "key long, node long, facts long").repartition(ENTRY_TASKS * tasks_for(rows), "key")
    unpacked = sent.dropDuplicates(["key", "node"]).select(
        "key",
        "node",
        F.shiftright("facts", 32).cast("int").alias("n"),
        F.shiftright("facts", 2).bitwiseAND(F.lit((1 << 30) - 1)).cast("int").alias("place"),
        F.col("facts").bitwiseAND(F.lit(3)).cast("int").alias("kind"),
    )
    by_size = Window.partitionBy("key").orderBy("n", "node")
    # most keys are of one set: they go before anything is gathered around a row
    beside = unpacked.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("size > 1")
    for name, of in (("below", F.lag), ("above", F.lead)):
        beside = beside.withColumn(name, of("n").over(by_size))
    around = F.collect_list(F.struct("node", "n", "place")).over(by_size.rowsBetween(-NEAR_SETS, NEAR_SETS))
    beside = beside.withColumn("around", around)
    # A key is of use to a set only where another set under it may be similar. Of a key with few sets all
    # are looked at; of others the neighbours in size, as what follows this place limits the larger one's.
    most = (100 + PERCENT) * (F.col("n") - F.col("place")) - PERCENT * F.col("n")
    some = (100 * F.col("below") >= PERCENT * F.col("n")) | (PERCENT * F.col("above") <= most)
    any_similar = F.exists(
        "around",
        lambda o: (o["node"] != F.col("node"))
        & _similar_sizes(F.col("n"), o["n"])
        & _enough_room(F.col("n"), F.col("place"), o["n"], o["place"]),
    )
    fits = F.when(F.col("size") <= NEAR_SETS + 1, any_similar).otherwise(some)
    return beside.filter(fits).select("key", "node", "n", "place", "kind")


def _similar_sizes(a, b):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _enough_room(n, place, other_n, other_place):
    """Whether this first common token, and what may follow it, suffices."""
    return (100 + PERCENT) * F.least(n - place, other_n - other_place) >= PERCENT * (n + other_n)


def _hub_pairs(entries: DataFrame, tried: DataFrame | None) -> DataFrame:
    """(a, b): every node with the hub of another component it shares most keys with.

    The hub of a key is its node of least component. Pairs of ``tried`` are left out.
    """
    least = F.min(F.struct("label", "node", "n", "place")).alias("hub")
    hubs = entries.filter(F.col("kind") != _SINGLE).groupBy("key").agg(least)
    pairs = entries.join(hubs, "key").filter(
        (F.col("label") != F.col("hub.label"))
        & _similar_sizes(F.col("n"), F.col("hub.n"))
        & _enough_room(F.col("n"), F.col("place"), F.col("hub.n"), F.col("hub.place"))
    )
    counted = pairs.groupBy("node", F.col("hub.node").alias("hub_node")).agg(F.count(F.lit(1)).alias("keys"))
    ends = counted.select(
        "node", "keys", "hub_node", F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")
    )
    if tried is not None:
        ends = ends.join(tried, ["a", "b"], "left_anti")
    best = ends.groupBy("node").agg(F.max(F.struct("keys", "hub_node", "a", "b")).alias("best"))
    return best.select("best.a", "best.b").distinct()


def _open_keys(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Entries of the keys that sets of more than one component have, with the root of theirs, and how many sets a key has.

    A node that ``roots(node, root)`` hasn't is a component of its own.
    """
    if roots is None:
        labelled = entries.withColumn("label", F.col("node"))
    else:
        labelled = entries.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    by_key = Window.partitionBy("key")
    return (
        labelled.withColumn("least", F.min("label").over(by_key))
        .withColumn("most", F.max("label").over(by_key))
        .withColumn("many", F.count(F.lit(1)).over(by_key))
        .filter(F.col("least") != F.col("most"))
    )


def _may_be_similar(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs whose bit maps allow enough common tokens. ``maps``: node, n, map."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("x", "y", "n", "m"))
            keep = [(100 + PERCENT) * most_common(x, y, n, m) >= PERCENT * (n + m) for x, y, n, m in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(maps.select(F.col("node").alias("a"), F.col("n"), F.col("map").alias("x")), "a")
    second = first.join(maps.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("map").alias("y")), "b")
    return second.select("a", "b", "n", "m", "x", "y").mapInArrow(tidy(compare), "a long, b long")


class Maps:
    """The bit maps of some sets, those of one length together."""

    def __init__(self, maps: list[bytes]) -> None:
        self.width = np.array([len(m) for m in maps], np.int64)
        self.place, self.of = np.zeros(len(maps), np.int64), {}
        for width in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == width)
            self.place[at] = np.arange(len(at))
            self.of[width] = np.frombuffer(b"".join([maps[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits the map of each set of ``x`` differs from that of ``y`` at its place."""
        out = np.zeros(len(x), np.int64)
        both = self.width[x] << 32 | self.width[y]
        for widths in np.unique(both).tolist():
            at = np.flatnonzero(both == widths)
            left, right = self.of[widths >> 32], self.of[widths & 0xFFFFFFFF]
            out[at] = bits_apart(left[self.place[x[at]]], right[self.place[y[at]]])
        return out


def similar_under_keys(group, side, node, n, place, single, label, maps: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(x, y, share): places of the sets under one key that may be similar and are of different components.

    The rows are in the order of ``group``, which stands for the key, and then of n. A pair is of one set of side 1
    and one of side 2, or of two of side 0. ``share``: the most that their intersection can be of their union.
    """
    known = Maps(maps)

    def fit(i, j):
        most = np.minimum(n[i] - place[i], n[j] - place[j])
        fits = (100 * n[i] >= PERCENT * n[j]) & ((100 + PERCENT) * most >= PERCENT * (n[i] + n[j]))
        apart = (label[i] != label[j]) & (node[i] != node[j]) & ~(single[i] & single[j])
        return fits & apart & ((side[i] == 0) | (side[i] != side[j]))

    def judged(x, y):
        total = n[x] + n[y]
        common = (total - known.apart(x, y)) // 2
        may = (100 + PERCENT) * common >= PERCENT * total
        return x[may], y[may], common[may] / (total - common)[may]

    edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    sizes = np.diff(edges)
    # all small keys: each row and the one so many places after it
    small = np.flatnonzero(np.repeat(sizes < LARGE_KEY, sizes))
    after = np.repeat(edges[1:], sizes)[small]
    for distance in range(1, LARGE_KEY):
        inside = small + distance < after
        small, after = small[inside], after[inside]
        if not len(small):
            break
        fits = fit(small, small + distance)
        yield judged(small[fits], small[fits] + distance)
    for at in np.flatnonzero(sizes >= LARGE_KEY).tolist():
        begin, stop = int(edges[at]), int(edges[at + 1])
        while begin < stop:
            # as many rows at a time as keep the pairs looked at together bounded
            ahead = int(np.searchsorted(n[begin:stop], 100 * int(n[begin]) // PERCENT, "right"))
            end = min(stop, begin + max(1, KEY_PAIRS // ahead))
            last = begin + int(np.searchsorted(n[begin:stop], 100 * int(n[end - 1]) // PERCENT, "right"))
            i, j = np.ogrid[begin:end, begin:last]
            x, y = np.nonzero((i < j) & fit(i, j))
            yield judged(x + begin, y + begin)
            begin = end


class Nearest:
    """For each set the other one it may share most with."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[float, int]] = {}

    def add(self, a: np.ndarray, b: np.ndarray, share: np.ndarray) -> None:
        own, other, share = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([share, share])
        order = np.lexsort((other, share, own))
        last = order[np.append(own[order][1:] != own[order][:-1], True)] if len(order) else order
        for node, found in zip(own[last].tolist(), zip(share[last].tolist(), other[last].tolist())):
            if found > self.best.get(node, (-1.0, 0)):
                self.best[node] = found

    def take(self) -> pa.RecordBatch:
        rows, self.best = [(node, share, other) for node, (share, other) in self.best.items()], {}
        columns = list(zip(*rows)) or [(), (), ()]
        kinds = (pa.int64(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "share", "other"])


def _key_pairs(entries: DataFrame, maps: DataFrame, tasks: int, nearest: bool = False) -> DataFrame:
    """(a, b): all pairs of sets under one key that may be similar, by their bit maps too, and are of different components.

    With ``nearest``, of each set only the pair with the one it may share most with. The sets of a key meet in one
    task and are compared there, so that only such pairs become rows. A key of more than KEY_SETS is dealt to blocks
    by a hash of the set, and every two blocks meet.
    """
    blocks = F.ceil(F.col("many") / KEY_SETS).cast("int")
    own = F.pmod(F.xxhash64("node", "key"), blocks.cast("long")).cast("int")
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda j: F.struct(
            F.least(own, j).alias("i"),
            F.greatest(own, j).alias("j"),
            F.when(j == own, 0).when(own < j, 1).otherwise(2).alias("side"),
        ),
    )
    columns = ["key", "node", "n", "place", "kind", "label"]
    few = entries.select(*columns, F.explode(F.when(blocks > 1, pairs).otherwise(alone)).alias("at"))
    dealt = few.join(maps.select("node", "map"), "node").select(*columns, "map", "at.i", "at.j", "at.side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closest = Nearest()

        def pairs_of(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts)
            key, i, j, side, node, n, place, kind, label = (
                rows.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j", "side", "node", "n", "place", "kind", "label")
            )
            group = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            maps = rows.column("map").to_pylist()
            for x, y, share in similar_under_keys(group, side, node, n, place, kind == _SINGLE, label, maps):
                a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
                if nearest:
                    closest.add(a, b, share)
                elif len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            if len(closest.best) >= TASK_NODES:
                yield closest.take()

        held, total = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
            if total >= KEY_ROWS:
                # what is held ends with the rows of its last key
                last = [held[-1].column(c)[-1].as_py() for c in ("key", "i", "j")]
                other = np.flatnonzero(np.any([x != y for x, y in zip(ids, last)], axis=0))
                if len(other):
                    yield from pairs_of([*held, batch.slice(0, int(other[0]))])
                    batch, held, total = batch.slice(int(other[0])), [], 0
            held.append(batch)
            total += batch.num_rows
        if held:
            yield from pairs_of(held)
        if nearest:
            yield closest.take()

    met = dealt.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j", "n")
    if not nearest:
        return met.mapInArrow(tidy(compare), "a long, b long").distinct()
    found = met.mapInArrow(tidy(compare), "node long, share double, other long")
    best = found.groupBy("node").agg(F.max(F.struct("share", "other")).alias("best"))
    return best.select(F.least("node", "best.other").alias("a"), F.greatest("node", "best.other").alias("b")).distinct()


def node_sets(rows: DataFrame, seed: DataFrame, needed: DataFrame, size: int = SHINGLE, room: int = BROADCAST_IDS) -> DataFrame:
    """node, tokens (sorted 64-bit hashes as binary) of the nodes in ``needed(node)``.

    ``seed``: node, label (an id of a document with that set, null if none has one). The texts of these ids are read
    again; sets without an id are found among the rows of a null id. Few ids, by count, are sent to all tasks; else
    texts and ids are shuffled together.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes, sets in _nodes(batches, size):
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"]
            )

    members = needed.join(seed, "node")
    ids = members.filter("label IS NOT NULL").select(F.col("label").alias("doc_id"))
    wanted = F.broadcast(ids) if ids.limit(room + 1).count() <= room else ids
    chosen = rows.join(wanted, "doc_id", "left_semi").select("doc_id", "text")
    found = chosen.mapInArrow(tidy(collect), "node long, tokens binary")
    nameless = members.filter("label IS NULL").select("node")
    if nameless.isEmpty():
        return found
    others = rows.filter("doc_id IS NULL").select("doc_id", "text").mapInArrow(tidy(collect), "node long, tokens binary")
    # many rows may share a set
    one_each = others.join(nameless, "node", "left_semi").groupBy("node").agg(F.min("tokens").alias("tokens"))
    return found.unionByName(one_each)


def verify_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append((100 + PERCENT) * both >= PERCENT * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    second = first.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return second.select("a", "b", "x", "y").mapInArrow(tidy(compare), "a long, b long").distinct()


def similar_counts(sets: list[np.ndarray], left: int) -> np.ndarray:
    """For each set with how many others it is similar.

    If ``left`` is less than their number, only pairs of one of the first ``left`` sets and one of the others count.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # tokens of one set are common to none
    often = (held > 1)[column]
    owner, column = np.repeat(np.arange(len(sets)), sizes)[often], (np.cumsum(held > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    alone = left == len(sets)
    right = slice(0 if alone else left, None)
    both = np.zeros((left, len(sizes[right])))
    width = min(BLOCK_COLUMNS, int((held > 1).sum()))
    for start in range(0, int((held > 1).sum()), BLOCK_COLUMNS):
        begin, end = np.searchsorted(column, [start, start + width])
        marks = np.zeros((len(sets), width), np.float32)
        marks[owner[begin:end], column[begin:end] - start] = 1
        both += marks[:left] @ marks[right].T
    similar = (100 + PERCENT) * both >= PERCENT * (sizes[:left, None] + sizes[None, right])
    if alone:
        np.fill_diagonal(similar, False)
        return similar.sum(axis=1)
    return np.concatenate([similar.sum(axis=1), similar.sum(axis=0)])


def link_counts(
    rows: DataFrame, labels: DataFrame, seed: DataFrame, sizes: DataFrame, scratch: Scratch, size: int = SHINGLE
) -> DataFrame:
    """node, n_links: with how many other sets each set of ``labels(node, label)`` is similar.

    ``seed``: node, label (an id of the set, or null); ``sizes``: node, n. Two sets of one component are linked. Those of
    a larger one are dealt to blocks; a class of sizes, their number of binary digits, has as many as its count
    asks for, by a hash of the set, and sets of classes further apart than one are not similar.
    """
    members = labels.groupBy("label").agg(F.count(F.lit(1)).alias("sets"))
    counted = labels.join(members, "label")
    two = counted.filter("sets = 2").select("node", F.lit(1).cast("long").alias("n_links"))
    digits = F.length(F.bin(F.col("n").cast("long"))).alias("class")
    many = scratch.save(counted.filter("sets > 2").join(sizes, "node").select("node", "label", digits), "many")
    if many.isEmpty():
        return two
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_TOKENS) / F.pow(F.lit(2.0), F.col("class")))))
    classes = many.groupBy("label", "class").agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias("blocks"))
    by_label = classes.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("class", "blocks"))).alias("blocks"))

    def blocks_of(distance: int):
        return F.coalesce(F.try_element_at("blocks", F.col("class") + distance), F.lit(0))

    def others(distance: int, group):
        return F.transform(F.filter(F.sequence(F.lit(0), blocks_of(distance)), lambda j: j < blocks_of(distance)), group)

    own = F.pmod(F.xxhash64("node"), blocks_of(0).cast("long")).cast("int")
    known = F.col("class").cast("int")
    with_own = others(
        0,
        lambda j: F.struct(
            F.xxhash64("label", known, F.lit(0), F.least("own", j), F.greatest("own", j)).alias("group"),
            F.when(j == F.col("own"), 0).when(F.col("own") < j, 1).otherwise(2).alias("side"),
        ),
    )
    with_next = others(
        1,
        lambda j: F.struct(
            F.xxhash64("label", known, F.lit(1), F.col("own"), j).alias("group"), F.lit(1).alias("side")
        ),
    )
    with_last = others(
        -1,
        lambda j: F.struct(
            F.xxhash64("label", known - 1, F.lit(1), j, F.col("own")).alias("group"), F.lit(2).alias("side")
        ),
    )
    dealt = (
        many.join(by_label, "label")
        .withColumn("own", own)
        .select("node", F.explode(F.concat(with_own, with_next, with_last)).alias("at"))
        .select("node", "at.group", "at.side")
    )
    sets = node_sets(rows, seed, many.select("node"), size)
    placed = dealt.join(sets, "node").repartition(tasks_for(rows), "group").sortWithinPartitions("group", "side")

    def compare(held: dict[int, tuple[int, np.ndarray]]) -> np.ndarray:
        sides = [side for side, _ in held.values()]
        left = sum(side < 2 for side in sides)
        if sides[0] and left in (0, len(sides)):
            return np.zeros(len(sides), np.int64)  # the other block has no sets
        return similar_counts([tokens for _, tokens in held.values()], left)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, done = {}, None, []
        for batch in chain(batches, [None]):
            if batch is None:
                done += [(list(held), compare(held))] if held else []
            else:
                columns = (batch.column(c).to_pylist() for c in ("group", "side", "node", "tokens"))
                for name, side, node, tokens in zip(*columns):
                    if held and name != now:
                        done.append((list(held), compare(held)))
                        held = {}
                    now = name
                    held[node] = side, np.frombuffer(tokens, np.uint64)  # rows that repeat an id give a set twice
            if done:
                nodes, counts = (np.concatenate(column).astype(np.int64) for column in zip(*done))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(counts)], names=["node", "n_links"])
                done = []

    found = placed.select("group", "side", "node", "tokens").mapInArrow(tidy(count), "node long, n_links long")
    return two.union(found.groupBy("node").agg(F.sum("n_links").alias("n_links")))


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    frequent_from: int = FREQUENT_FROM,
    combined: int = COMBINED,
) -> DataFrame:
    """doc_id, n_shingles, n_links, component_id for every row.

    Words are split at ASCII white space after lower-casing A-Z. ``component_id`` is the smallest id
    reachable by links; ``n_links`` counts the other sets (not copies) that are similar. Texts without words, nulls among them, are
    linked with nothing. Rows that repeat an id are separate rows of the join; rows with a null id link others
    like any row, but never name a component: it is null where all its rows have none. An empty table gives no rows.

    Shingles and sets are compared as 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession)
    base = text_rows(docs, id_col, text_col)
    rows = base.withColumn("text", base["text"].cast("binary"))
    nodes = scratch.save(set_nodes(rows, size), "nodes")
    facts = nodes.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("label"), F.min("n").alias("n"), F.min("map").alias("map"))
    facts = scratch.save(facts, "sets")
    seed, maps = facts.select("node", "label"), facts.select("node", "n", "map")
    frequent = frequent_tokens(rows, size, frequent_from)
    entries = scratch.save(index_entries(rows, frequent, size, combined), "entries")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        likely = scratch.save(pairs, f"likely-{name}")
        needed = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
        return scratch.save(verify_pairs(likely, node_sets(rows, seed, needed, size)), f"links-{name}")

    # Stars: each round joins components; what they leave apart is compared pair by pair.
    links = roots = tried = None
    for turn in range(STAR_ROUNDS + NEAREST_ROUNDS):
        opened = entries.withColumn("label", F.col("node")) if not turn else _open_keys(entries, roots)
        if turn < STAR_ROUNDS:
            pairs = scratch.save(_hub_pairs(opened, tried), f"pairs-{turn}")
            new = verified(_may_be_similar(pairs, maps), str(turn))
        else:
            closest = _key_pairs(opened, maps, tasks_for(rows), nearest=True)
            pairs = scratch.save(closest if tried is None else closest.join(tried, ["a", "b"], "left_anti"), f"pairs-{turn}")
            new = verified(pairs, str(turn))
        tried = pairs if tried is None else tried.union(pairs)
        if new.isEmpty():
            if turn < STAR_ROUNDS:
                continue
            break
        links = new if links is None else links.union(new)
        roots = connected(links, scratch, f"components-{turn}")
    across = _key_pairs(_open_keys(entries, roots), maps, tasks_for(rows)).join(tried, ["a", "b"], "left_anti")
    rest = verified(across, "rest")
    if not rest.isEmpty():
        roots = connected(rest if links is None else links.union(rest), scratch)
    if roots is None:
        roots = rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = roots.join(seed, "node").groupBy("root").agg(F.min("label").alias("component"))

    degree = link_counts(rows, roots.withColumnRenamed("root", "label"), seed, maps.select("node", "n"), scratch, size)
    groups = seed.join(roots, "node", "left").join(named, "root", "left").join(degree, "node", "left")
    verdicts = groups.select(
        "node", F.coalesce("component", "label").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    # many rows may share a set
    return salted_join(nodes.select("doc_id", "node", "n"), verdicts, ["node"], "left", "doc_id").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component, with their columns; rows of a null id stay."""
    found = jaccard_components(docs, id_col, text_col)
    return keep_rows(docs, found.select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("kept")), id_col)
