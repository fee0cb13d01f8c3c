"""Exact Jaccard join of documents by their distinct word shingles, under several global token orders.

Two sets of similarity t or more share a token among their first n - ceil(t n) + 1 tokens under *every* global order
of the tokens. Candidates must share prefix tokens under each of several orders; only they are verified. The
orders put rare tokens first, so that passages which many documents share come last and link nobody.

1. Filter: under an order by hash, the first n - ceil(t n) + l tokens hold l tokens of any partner (l-prefix). Documents
   with fewer repeated tokens there have no partner; most end here. Tokens are counted by one range sort.
2. Orders: the tokens of the rest are counted and the prefixes under each order joined by token, as stars around
   the least document. Components of the stars, intersected over the orders, are clusters: linked documents are in one.
3. Verification inside clusters. Small ones go to one task. In large ones leaders are drawn and all documents of
   the cluster are held against them, by an index of their prefix tokens; documents in the cluster's largest component need no leader of their
   own. Leaders are drawn until every other document has been one, so no pair across components goes unseen and no
   pair inside a component has to be made. The price of exactness: a cluster of N documents that are no copies of one
   another, yet chained by prefix tokens under all orders, is verified pair by pair, in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .components import components, top_of
from .hashing import U, Words, distinct, mixed, runs, shingles

WIDTH = 5
#: Similarity, in hundredths.
LEAST = 75
ORDERS = 3
#: Clusters up to this size are verified by one task; larger ones by leaders, so many to a block, beside so many rows.
SMALL, BLOCK, ROWS = 256, 1024, 1024
#: Tokens that a task holds at most for one cluster, block or deal, but for a single set that has more.
WEIGHT = 1 << 21
#: Leaders drawn first; four times as many in each later turn.
FIRST_LEADERS = 512


def overlap_needed(n, least: int = LEAST):
    """ceil(t n): what a set of n tokens shares at least with any partner."""
    return -(-least * n // 100)


def _sets(least: int, width: int):
    """Task function: doc_id, n, two sums that name the set, and its l-prefix under the order of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in runs(batch.column(1)):
                text, h, other = distinct(*shingles(Words(data, offsets, lower=True, both=True), width))
                n = np.bincount(text, minlength=end - first)
                start = np.cumsum(n) - n
                one, two = _sums(mixed(h), start, n), _sums(mixed(other), start, n)
                take = np.minimum(n, n - overlap_needed(n, least) + np.maximum(1, n // 8))
                prefix = h[np.arange(len(h)) - start[text] < take[text]]
                ends = np.concatenate([[0], np.cumsum(take)]).astype("int32")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix.view("int64")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n.astype("int64")), pa.array(one), pa.array(two), lists], names=["doc_id", "n", "one", "two", "prefix"])

    return run


def _sums(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(h, dtype=U)])
    return (total[start + n] - total[start]).view("int64")


def _tokens(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in runs(batch.column(1)):
                text, h, _ = distinct(*shingles(Words(data, offsets, lower=True), width))
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=end - first))]).astype("int32")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view("int64")))], names=["doc", "tokens"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, hits of tokens that a sorted partition holds more than once. The rows at its two ends count as
    repeated, as their token may go on in the next partition: the filter may keep too many, never too few."""
    held_t, held_d, held_hit = np.zeros(0, "int64"), np.zeros(0, "int64"), np.ones(1, bool)
    for batch in batches:
        t = np.concatenate([held_t, batch.column(0).to_numpy(zero_copy_only=False)])
        d = np.concatenate([held_d, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(t):
            continue
        hit = np.zeros(len(t), bool)
        hit[0] = held_hit[0]
        same = t[1:] == t[:-1]
        hit[1:] |= same
        hit[:-1] |= same
        held_t, held_d, held_hit = t[-1:], d[-1:], hit[-1:]
        yield _hits(d[:-1][hit[:-1]])
    if len(held_t):
        yield _hits(held_d)


def _hits(d: np.ndarray) -> pa.RecordBatch:
    docs, hits = np.unique(d, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(hits.astype("int64"))], names=["doc", "hits"])


class _Group:
    """Documents' sets packed for tests of one set against some of them, in time by the tokens of those."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(x) for x in sets], "int64")
        self.start = np.cumsum(self.n) - self.n
        flat = np.concatenate(sets) if sets else np.zeros(0, "int64")
        self.values, self.at = np.unique(flat, return_inverse=True)
        self.on = np.zeros(len(self.values), bool)

    def where(self, other: np.ndarray) -> np.ndarray:
        """Numbers of the values that ``other`` holds."""
        at = np.searchsorted(self.values, other)
        some = at < len(self.values)
        at, other = at[some], other[some]
        return at[self.values[at] == other]

    def shared(self, other: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Tokens that each set of ``rows`` shares with ``other``."""
        where = self.where(other)
        self.on[where] = True
        hits = np.concatenate([[0], np.cumsum(self.on[self.at[_ranges(self.start[rows], self.n[rows])]])])
        self.on[where] = False
        ends = np.cumsum(self.n[rows])
        return hits[ends] - hits[ends - self.n[rows]]


class _Holders(_Group):
    """A group that also tells which sets hold a token."""

    def __init__(self, sets: list[np.ndarray]):
        super().__init__(sets)
        self.holder = np.repeat(np.arange(len(sets)), self.n)[np.argsort(self.at, kind="stable")]
        self.often = np.bincount(self.at, minlength=len(self.values))
        self.first = np.cumsum(self.often) - self.often

    def met(self, other: np.ndarray) -> np.ndarray:
        """Sets that share a token with ``other``, ascending."""
        where = self.where(other)
        return np.unique(self.holder[_ranges(self.first[where], self.often[where])])


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers from each ``first`` on, one behind the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _links(left: dict, right: dict, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``left`` the rows of ``right`` that share a prefix token under all orders and verify.

    Rows of ``right`` are found by their tokens under the first order, not read one by one.
    """
    full, index = _Group(list(right["tokens"])), _Holders([p[0] for p in right["prefixes"]])
    orders = [_Group([p[k] for p in right["prefixes"]]) for k in range(1, ORDERS)]
    for i, (tokens, prefixes) in enumerate(zip(left["tokens"], left["prefixes"])):
        rows = index.met(np.asarray(prefixes[0]))
        for k, group in enumerate(orders, 1):
            rows = rows[group.shared(np.asarray(prefixes[k]), rows) > 0] if len(rows) else rows
        if len(rows):
            both = full.shared(np.asarray(tokens), rows)
            yield i, rows[100 * both >= least * (len(tokens) + full.n[rows] - both)]


def _spanning(left: dict, right: dict, least: int) -> list[tuple[int, int]]:
    """Links found, as edges from each document to the least one that they connect it to."""
    ids, at = np.unique(np.concatenate([np.asarray(side["doc"], "int64") for side in (left, right)]), return_inverse=True)
    ours, theirs = at[: len(left["doc"])], at[len(left["doc"]) :]
    parent = np.arange(len(ids))
    for i, js in _links(left, right, least):
        met = np.append(theirs[js], ours[i])
        tops = top_of(parent, met)
        parent[tops] = parent[met] = tops.min()
    top = top_of(parent, np.arange(len(ids)))
    some = np.flatnonzero(top != np.arange(len(ids)))
    return list(zip(ids[some].tolist(), ids[top[some]].tolist()))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def _small(least: int):
    """Task function over rows (cluster, doc, tokens, prefixes) sorted by cluster: roots, one cluster in memory at a time."""

    def verified(rows: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
        docs, tokens, flat, out = rows.column(1).to_numpy(), _lists(rows.column(2)), _lists(rows.column(3).values), []
        outer = rows.column(3).offsets.to_numpy()
        for a, b in zip(cuts, cuts[1:]):
            if b - a == 2:  # most clusters are one pair
                both = len(np.intersect1d(tokens[a], tokens[a + 1], assume_unique=True))
                if 100 * both >= least * (len(tokens[a]) + len(tokens[a + 1]) - both) and docs[a] != docs[a + 1]:
                    out.append((max(docs[a], docs[a + 1]), min(docs[a], docs[a + 1])))
            elif b - a > 2:
                own = {"doc": docs[a:b], "tokens": tokens[a:b], "prefixes": [flat[outer[i] : outer[i + 1]] for i in range(a, b)]}
                out += _spanning(own, own, least)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cluster = batch.column(0).to_numpy()
            if not len(cluster):
                continue
            if held and held[0].column(0)[0].as_py() == cluster[0] == cluster[-1]:
                held.append(batch)
                continue
            rows = pa.concat_batches([*held, batch])
            cluster = rows.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
            yield verified(rows, cuts)  # all but the last cluster, which may go on
            held = [rows.slice(cuts[-1])]
        if held:
            rows = pa.concat_batches(held)
            yield verified(rows, np.array([0, rows.num_rows]))

    return run


def _against(least: int):
    def run(docs: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        few, many = sorted((docs, leaders), key=len)
        return pd.DataFrame(_spanning(few, many, least) if len(few) else [], columns=["a", "b"]).astype("int64")

    return run


def jaccard_components(docs: DataFrame, least: int = LEAST, width: int = WIDTH, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Documents link when 100 * shared >= ``least`` * union of their distinct shingles of ``width`` lower-cased (A-Z) words;
    with fewer words all of them are the one shingle. component_id is the least doc_id that links reach. Null and
    wordless texts have no shingles and no links: their component is their doc_id. Rows with a null doc_id are
    in no component (null). Rows that share a doc_id share a component; repeated rows repeat; other columns are
    not read. Shingles are 64-bit hashes of their words; equal sets are told by sums of two independent hashes of each.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "jaccard")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = space.save(held.mapInArrow(_sets(least, width), "doc_id bigint, n bigint, one bigint, two bigint, prefix array<bigint>"), "sets")
    named = space.save(every.drop("prefix"), "named")

    # 1. Documents with enough repeated tokens in their l-prefix; a partner may be smaller, so its l may be.
    rows = every.filter("doc_id is not null").select(F.explode("prefix").alias("token"), F.col("doc_id").alias("doc"))
    hits = rows.repartitionByRange("token", "doc").sortWithinPartitions("token", "doc").mapInArrow(_repeated, "doc bigint, hits bigint").groupBy("doc").agg(F.sum("hits").alias("hits"))
    needed = F.expr(f"greatest(1, (({least} * n + 99) div 100) div 8)")
    likely = space.save(named.join(hits, F.col("doc_id") == F.col("doc")).filter(F.col("hits") >= needed).select("doc_id", "n", "one", "two").distinct(), "likely")
    space.drop("sets")
    classes = space.save(likely.groupBy("one", "two", "n").agg(F.min("doc_id").alias("rep")), "classes")

    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    # A merge join at every size: what the representatives weigh beside all texts does not decide the plan.
    sets = space.save(held.join(reps.hint("merge"), "doc_id", "left_semi").mapInArrow(_tokens(width), "doc bigint, tokens array<bigint>"), "tokens")
    roots = linked(sets, space, least, small)
    rooted = classes.join(roots, "rep", "left").select(F.col("one").alias("_one"), F.col("two").alias("_two"), F.col("n").alias("_n"), F.coalesce("root", "rep").alias("root"))
    own = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("root", "doc_id"), "doc_id"))
    same = (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two")) & (F.col("n") == F.col("_n"))
    linkable = named.filter("n > 0").join(rooted, same, "left").select("doc_id", "n", own.alias("component_id"))
    # Rows without words share one empty set: they meet nothing, so they stay out of the join.
    return linkable.unionByName(named.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))).withColumnRenamed("n", "n_shingles")


def linked(sets: DataFrame, space: Workspace, least: int = LEAST, small: int = SMALL) -> DataFrame:
    """rep, root of every set (doc, tokens; tokens distinct) of a saved table that links connect to a smaller doc."""
    # 2. Prefixes of the sets under several orders: rare first, then by a hash of the order's own.
    flat = sets.select("doc", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = space.save(flat.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "often")  # a table, so that the join below has two plain shuffles and common tokens can be split
    ranked = flat.join(often.hint("merge"), "token").groupBy("doc", "n").agg(F.collect_list(F.struct("token", F.floor(F.log2("df")).alias("rare"))).alias("known"))
    first = F.expr(f"n - (({least} * n + 99) div 100) + 1 - (n - size(known))").cast("int")

    def order(k: int):
        """The first tokens under order k: by rarity (doublings of df), then by a hash of this order's own."""
        turned = F.transform("known", lambda x: F.struct(x["rare"].alias("rare"), F.xxhash64(x["token"], F.lit(k)).alias("turn"), x["token"].alias("token")))
        return F.transform(F.slice(F.sort_array(turned), 1, F.col("first")), lambda x: x["token"])

    orders = [order(k) for k in range(ORDERS)]
    prefixed = space.save(ranked.withColumn("first", first).filter("first > 0").select("doc", "n", F.array(*orders).alias("prefixes")), "prefixes")
    space.drop("often")

    entries = prefixed.select("doc", F.posexplode("prefixes").alias("part", "tokens")).select("doc", "part", F.explode("tokens").alias("token"))
    stars = space.save(entries.groupBy("part", "token").agg(F.min("doc").alias("b"), F.count("*").alias("members")).filter("members > 1"), "tokens_shared")
    edges = entries.join(stars.hint("merge"), ["part", "token"]).select("part", F.col("doc").alias("a"), "b")
    roots = components(edges, space, "stars")
    shared = roots.groupBy("node").agg(F.count("*").alias("orders"), F.xxhash64(F.sort_array(F.collect_list(F.struct("part", "root")))).alias("cluster"))
    clusters = space.save(shared.filter(F.col("orders") == ORDERS).select(F.col("node").alias("doc"), "cluster"), "clusters")
    sizes = clusters.join(prefixed.select("doc", "n"), "doc").groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("weight")).filter("members > 1")
    sizes = space.save(sizes, "sizes")
    members = space.save(clusters.join(sizes, "cluster").join(prefixed.drop("n"), "doc").join(sets, "doc"), "members")

    # 3. Verification. A small cluster's task already gives each document its root.
    fits = (F.col("members") <= small) & (F.col("weight") <= WEIGHT)
    few = members.filter(fits).select("cluster", "doc", "tokens", "prefixes").repartition("cluster").sortWithinPartitions("cluster")
    roots = space.save(few.mapInArrow(_small(least), "a bigint, b bigint"), "found").select(F.col("a").alias("rep"), F.col("b").alias("root"))
    large = members.filter(~fits)
    if not large.isEmpty():
        roots = roots.unionByName(_by_leaders(large, space, least))
    return roots


def _by_leaders(large: DataFrame, space: Workspace, least: int) -> DataFrame:
    """rep, root of documents in clusters that are too large for one task."""
    keys, columns = ["cluster", "block", "deal"], ["cluster", "block", "deal", "doc", "tokens", "prefixes"]
    each = (F.col("weight") / F.col("members")).alias("each")  # tokens of a set in the mean
    state = large.select("cluster", "doc", F.col("doc").alias("root"), each)
    found, led, roots, turn, wanted = None, None, None, 0, FIRST_LEADERS
    while True:
        # Documents that have led are settled; of the others those outside the cluster's largest component wait.
        per = state.groupBy("cluster", "root").agg(F.count("*").alias("size"))
        main = per.groupBy("cluster").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("most"))
        waiting = state.join(main, "cluster").filter((F.col("root") != F.col("main")) | (F.col("most") == 1)).select("cluster", "doc", "each")
        waiting = space.save(waiting, f"waiting{turn}")
        if waiting.isEmpty():
            return roots
        left = waiting.groupBy("cluster", "each").agg(F.count("*").alias("left"))
        draw = F.pmod(F.xxhash64("doc", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = F.least(F.col("left"), F.lit(wanted))
        blocks = F.greatest(F.lit(1), F.ceil(drawn / BLOCK), F.ceil(drawn * F.col("each") / WEIGHT))
        leaders = waiting.drop("each").join(left, "cluster").filter(draw * F.col("left") < wanted).withColumn("block", F.pmod(F.xxhash64("doc", F.lit("block")), blocks)).select("cluster", "doc", "block")
        leaders = space.save(leaders, f"leaders{turn}")
        # Each block of leaders meets each deal of its cluster's documents in a task of its own.
        deals = F.greatest(F.lit(1), F.ceil(F.col("members") / ROWS), F.ceil(F.col("weight") / WEIGHT))
        lists = large.join(leaders, ["cluster", "doc"]).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1))).select(*columns)
        asked = leaders.groupBy("cluster").agg(F.collect_set("block").alias("asked"))
        dealt = large.withColumn("deal", F.pmod(F.xxhash64("doc", F.lit("deal")), deals)).join(asked, "cluster").withColumn("block", F.explode("asked"))
        dealt = dealt.select(*[F.col(c).alias(c) for c in columns])
        more = space.save(dealt.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInPandas(_against(least), "a bigint, b bigint"), f"more{turn}")
        found = more if found is None else found.unionByName(more)
        led = leaders.select("cluster", "doc") if led is None else led.unionByName(leaders.select("cluster", "doc"))
        roots = components(found.withColumn("part", F.lit(0)), space, f"turn{turn}_").select(F.col("node").alias("rep"), "root")
        state = large.select("cluster", "doc", each).join(led, ["cluster", "doc"], "left_anti").join(roots, F.col("doc") == F.col("rep"), "left").select("cluster", "doc", F.coalesce("root", "doc").alias("root"), "each")
        turn, wanted = turn + 1, wanted * 4


def one_of_each(docs: DataFrame, least: int = LEAST, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id. Columns unchanged.

    Rows without a doc_id or without words stay.
    """
    space, opened = Workspace(docs.sparkSession, "one-of-each"), len(Workspace.opened)
    gone = jaccard_components(docs, least, width).filter("doc_id != component_id").select("doc_id").distinct()
    gone = space.save(gone, "gone")
    Workspace.close_since(opened)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
