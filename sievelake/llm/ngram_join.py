"""Exact n-gram Jaccard join with a count-vector R-tree.

A document is the set of its distinct 5-word shingles.  Two documents link when
100 * |intersection| >= 75 * |union|.  Shingles are hashed into groups, and the
counts per group are a document's point; the overlap of two documents is at most
the sum of their coordinates' minima, and of two R-tree nodes the sum of the
minima of their upper corners.  Pairs that survive the bound are verified on the
whole sets.

Over all documents one tree would prune little (long documents have similar
counts) and could not be spread, so the points are first dealt out to the lists
of a prefix filter, which loses no link: in any order of shingles that all
documents share, linked documents have a shingle in common among the first
``n - ceil(3n/4) + 1`` of theirs.  The order is by hash, with frequent shingles
last.  A tree is built on each list.

1. Documents become (doc_id, size, fingerprint); equal sets are one class.
2. Classes post their prefix shingles to buckets as packed blocks; a bucket
   keeps the lists of two or more classes, equal lists once.
3. On each list a tree of the points gives a forest of pairs that the bound lets
   through: at most one pair a class, never all pairs of a list.  The pairs meet
   with whole sets; most near copies hang together then.
4. Lists that had such pairs and still span several components give all surviving
   pairs between these; of two components the likeliest pair is verified first.
5. Components are taken over all edges, and the smallest doc_id names each.

Nothing is capped: a list of any length is worked through, a long one in pieces
of ``most_members``: first each piece for itself, then, once most of a family
hangs together, the members of different components in chunks.  The driver collects
at most ``most_frequent`` frequent shingles, which only order the prefix, and
``filter_words`` words of a bit table that spares most texts a second reading;
neither changes results.  A class is named by a
64-bit fingerprint of its set: among 10^9 different texts two share theirs with
a probability of 3 in 100.

Defined results: a null or blank text has no shingles, n_shingles 0, and is a
component of its own; fewer than five words are one shingle; repeated rows and
equal texts are in one component; component_id is the smallest non-null doc_id;
an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components, joined_components

SHINGLE = 5
#: Linked: overlap * (100 + 75) >= 75 * (sum of sizes), or 7 * overlap >= 3 * sum.
LEAF = 16


def fingerprint(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        mixed = common.hash_mix(tokens ^ np.uint64(0x27D4EB2F165667C5)).sum(dtype=np.uint64) + np.uint64(len(tokens)) * common._ODD[2]
    return int(np.uint64(mixed).astype(np.int64))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    return 7 * common_count(a, b) >= 3 * (len(a) + len(b))


def groups_for(n: int, per: int) -> int:
    """A power of two of groups for sets of about ``n``: ``per`` to 2 * ``per`` for
    each shingle."""
    return max(64, 1 << max(0, n * per - 1).bit_length())


def point(tokens: np.ndarray) -> np.ndarray:
    """Counts of the tokens in each of 4 to 8 groups a shingle."""
    groups = groups_for(len(tokens), 4)
    return np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def fold(p: np.ndarray, groups: int) -> np.ndarray:
    """A point in fewer groups: group g takes what is g modulo ``groups``."""
    return p if len(p) == groups else p.reshape(-1, groups).sum(0, dtype=np.int32)


def packed_point(tokens: np.ndarray) -> bytes:
    """A compressed point behind two bytes: the width of a count, log2 of the groups."""
    p = point(tokens)
    width = 1 if p.max() < 256 else 4
    return bytes([width, len(p).bit_length() - 1]) + pa.compress(p.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)


def unpacked_point(blob: bytes) -> np.ndarray:
    width, groups = blob[0], 1 << blob[1]
    return np.frombuffer(pa.decompress(blob[2:], width * groups, codec="zstd", asbytes=True), f"<u{width}")


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sets given as arrays without repeats."""
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


class Forest:
    """Union-find over places 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


class Node:
    __slots__ = ("high", "least", "most", "children", "places")

    def __init__(self, high, least, most, children, places):
        self.high, self.least, self.most, self.children, self.places = high, least, most, children, places


def build_tree(points: np.ndarray, sizes: np.ndarray) -> Node:
    """A packed R-tree: points by size, then by their largest counts' groups."""
    order = np.lexsort((points.argmax(1), sizes))
    nodes = []
    for i in range(0, len(order), LEAF):
        p = order[i : i + LEAF]
        nodes.append(Node(points[p].max(0), sizes[p].min(), sizes[p].max(), None, p))
    while len(nodes) > 1:
        above = []
        for i in range(0, len(nodes), LEAF):
            c = nodes[i : i + LEAF]
            above.append(Node(np.max([x.high for x in c], 0), min(x.least for x in c), max(x.most for x in c), c, np.concatenate([x.places for x in c])))
        nodes = above
    return nodes[0]


def surviving_pairs(points: list[np.ndarray], sizes: np.ndarray, together) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) that the bound lets through.

    Points of one octave of sizes, and what sets of the octave can link with
    above it, share their groups and a tree.  ``together(places)`` says whether
    all of them hang together already; such pairs of nodes are not entered.
    """
    octave = np.frexp(sizes)[1] - 1
    for k in np.unique(octave).tolist():
        low = 1 << k
        some = np.flatnonzero((sizes >= low) & (3 * sizes < 8 * low + 3))
        if len(some) < 2:
            continue
        groups = groups_for(low, 2)
        table = np.stack([fold(points[i], groups) for i in some.tolist()])
        table = table.astype(np.int16 if table.max() < 1 << 15 else np.int32)
        for i, j in tree_pairs(table, sizes[some], lambda p, some=some: together(some[p])):
            if octave[some[i]] == k or octave[some[j]] == k:
                yield int(some[i]), int(some[j])


def tree_pairs(points: np.ndarray, sizes: np.ndarray, together) -> Iterator[tuple[int, int]]:
    """Pairs of points whose summed minima reach the overlap that a link needs."""

    def near(a: Node, b: Node) -> bool:
        if 4 * min(a.most, b.most) < 3 * max(a.least, b.least):
            return False
        return 7 * int(np.minimum(a.high, b.high).sum()) >= 3 * (a.least + b.least)

    root = build_tree(points, sizes)
    todo = [(root, root)]
    while todo:
        a, b = todo.pop()
        if together(a.places if a is b else np.concatenate([a.places, b.places])):
            continue
        if a.children is None and b.children is None:
            i, j = np.meshgrid(a.places, b.places, indexing="ij")
            i, j = i.ravel(), j.ravel()
            ok = (i < j) if a is b else np.ones(len(i), bool)
            ok &= 4 * np.minimum(sizes[i], sizes[j]) >= 3 * np.maximum(sizes[i], sizes[j])
            i, j = i[ok], j[ok]
            if len(i):
                bound = np.minimum(points[i], points[j]).sum(1)
                good = 7 * bound >= 3 * (sizes[i] + sizes[j])
                # the likeliest first: a link found early spares the others
                order = np.argsort(-(bound[good] / (sizes[i][good] + sizes[j][good])), kind="stable")
                yield from zip(i[good][order].tolist(), j[good][order].tolist())
        elif a is b:
            c = a.children
            todo += [(x, y) for n, x in enumerate(c) for y in c[n:] if x is y or near(x, y)]
        else:
            split, other = (a, b) if a.children is not None else (b, a)
            todo += [(x, other) for x in split.children if near(x, other)]


def _blob(column, kind) -> np.ndarray:
    return np.frombuffer(column, kind)


def describe(docs: DataFrame, block_bytes: int, count_tokens: int) -> DataFrame:
    """One row per document (what=0: doc_id, text hash h, size n, name fp, point)
    and one per locally frequent shingle of a block (what=1: count n, shingle fp)."""
    schema = "what int, doc_id long, h long, n long, fp long, point binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        held: dict[int, np.ndarray] = {}  # sets counted so far, equal ones once

        def shared():
            tokens, counts = np.unique(np.concatenate(list(held.values())), return_counts=True)
            often = counts >= 3
            held.clear()
            m = int(often.sum())
            none = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), none, none, pa.array(counts[often].astype(np.int64)), pa.array(tokens[often].view(np.int64)), pa.nulls(m, pa.binary())], names=names)

        for batch in batches:
            texts = common.as_one(batch.column(1))
            for a, b in common.slices_by_bytes(texts, block_bytes):
                sets = common.shingle_sets(texts.slice(a, b - a), SHINGLE)
                fps = [fingerprint(s) for s in sets]
                sizes = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int32)), batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sizes), pa.array(fps, pa.int64()), pa.array([packed_point(x) for x in sets], pa.binary())], names=names)
                held.update(zip(fps, sets))
                if sum(map(len, held.values())) > count_tokens:
                    yield shared()
        if held:
            yield shared()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, schema)


def prefix_lists(docs: DataFrame, frequent: np.ndarray, buckets: int, block_bytes: int, most_members: int) -> DataFrame:
    """(piece, key, long, fps, bundle): lists of two or more classes that share a prefix
    shingle and may have near sizes; equal lists come once.  A list of over
    ``most_members`` is ``long`` and comes in pieces of near sizes.  Lists with
    the same smallest class, as those of one family have, are a bundle.

    ``frequent`` holds frequent shingles, the most frequent last.
    """
    sorted_frequent = np.sort(frequent)
    rank_of = np.argsort(frequent)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.as_one(batch.column(0))
            for a, b in common.slices_by_bytes(texts, block_bytes):
                seen: set[int] = set()
                tokens, owners, sizes = [], [], []
                for s in common.shingle_sets(texts.slice(a, b - a), SHINGLE):
                    n = len(s)
                    if not n or (fp := fingerprint(s)) in seen:
                        continue
                    seen.add(fp)
                    p = n - -(-3 * n // 4) + 1
                    if len(sorted_frequent):
                        at = np.minimum(np.searchsorted(sorted_frequent, s), len(sorted_frequent) - 1)
                        often = sorted_frequent[at] == s
                        if often.any():
                            rest = s[often][np.argsort(rank_of[at[often]], kind="stable")]
                            s = np.concatenate([s[~often], rest])
                    s = s[:p]
                    tokens.append(s)
                    owners.append(np.full(len(s), fp, np.int64))
                    sizes.append(np.full(len(s), n, np.uint32))
                if not tokens:
                    continue
                tokens, owners, sizes = map(np.concatenate, (tokens, owners, sizes))
                mixed = common.hash_mix(tokens)
                bucket = (mixed >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                low, owners, sizes = (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], owners[order], sizes[order]
                full = np.flatnonzero(np.diff(edges))
                rows = [[x[edges[k] : edges[k + 1]].tobytes() for k in full] for x in (low, owners, sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array(r, pa.binary()) for r in rows]], names=["bucket", "tokens", "fps", "ns"])

    def lists_of(tokens, fps, ns) -> Iterator[tuple[int, np.ndarray]]:
        if len(tokens) < 2:
            return
        order = np.lexsort((fps, ns, tokens))
        tokens, fps, ns = tokens[order], fps[order], ns[order]
        # a chain breaks where the token changes or the next size is out of reach
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (4 * ns[:-1] < 3 * ns[1:])])
        same = np.concatenate([[False], (tokens[1:] == tokens[:-1]) & (fps[1:] == fps[:-1])])
        keep = ~same | new
        fps, ns, chain = fps[keep], ns[keep], (np.cumsum(new) - 1)[keep]
        start = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
        size = np.diff(np.append(start, len(chain)))
        with np.errstate(over="ignore"):
            name = np.add.reduceat(common.hash_mix(fps.view(np.uint64) ^ np.uint64(0x9FB21C651E98DF25)), start) + size.astype(np.uint64)
        big = size > 1
        _, first = np.unique(name[big], return_index=True)
        for i in np.flatnonzero(big)[first].tolist():
            yield int(name[i].astype(np.int64)), fps[start[i] : start[i] + size[i]]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["piece", "key", "long", "fps"]

        def pieces(key, fps):
            if len(fps) <= most_members:
                yield key, key, False, fps
                return
            for i, at in enumerate(range(0, len(fps), most_members)):
                name = common.hash_mix(np.array([key], np.int64).view(np.uint64) + np.uint64(i + 1)).view(np.int64)
                yield int(name[0]), key, True, fps[at : at + most_members]

        def flush(parts):
            tokens, fps, ns = (np.concatenate([_blob(p[i], k) for p in parts]) for i, k in ((0, np.uint32), (1, np.int64), (2, np.uint32)))
            rows = [r for found in lists_of(tokens, fps, ns.astype(np.int64)) for r in pieces(*found)]
            for at in range(0, len(rows), 5000):
                columns = zip(*rows[at : at + 5000])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())))], names=names)

        current, parts = None, []
        for batch in batches:
            for bucket, *blobs in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if bucket != current and parts:
                    yield from flush(parts)
                    parts = []
                current = bucket
                parts.append(blobs)
        if parts:
            yield from flush(parts)

    posted = docs.select("text").mapInArrow(post, "bucket int, tokens binary, fps binary, ns binary")
    dealt = posted.repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(gather, "piece long, key long, long boolean, fps array<long>")
    found = found.groupBy("piece").agg(F.first("key").alias("key"), F.first("long").alias("long"), F.first("fps").alias("fps"))
    return found.withColumn("bundle", F.array_min("fps"))


def id_filter(ids: DataFrame, words: int) -> np.ndarray:
    """A table of ``words`` 64-bit words with a bit set for each id: all that the
    driver gets, however many ids there are.  A full table lets every id pass."""
    h = F.xxhash64(F.col("doc_id"))
    bits = ids.select(F.pmod(h, F.lit(words)).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(doc_id), 40), 64) as int))").alias("bit"))
    table = np.zeros(words, np.int64)
    for row in bits.groupBy("w").agg(F.bit_or("bit").alias("bit")).collect():
        table[row["w"]] = row["bit"]
    return table


def whole_sets(docs: DataFrame, ends: DataFrame, words: int, block_bytes: int) -> DataFrame:
    """(fp, tokens): one set for each class of ``ends`` (fp, doc_id), read from
    the document of ``docs`` (doc_id, text) with that id.

    A bit table of the ids spares most texts; the join leaves out what passes
    it by chance, so copies of a class never travel further.
    """
    table = id_filter(ends.select("doc_id"), words)
    hashed = docs.select("text", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(words)).alias("w"), F.expr("pmod(shiftright(xxhash64(doc_id), 40), 64)").alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bit = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            passed = pa.array((table[word] >> bit) & 1 == 1)
            texts, ids = common.as_one(batch.column(0)).filter(passed), batch.column(1).filter(passed)
            for a, b in common.slices_by_bytes(texts, block_bytes):
                sets = common.shingle_sets(texts.slice(a, b - a), SHINGLE)
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.int64()), ids.slice(a, b - a), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["fp", "id", "tokens"])

    found = hashed.mapInArrow(run, "fp long, id long, tokens binary")
    ends = ends.select(F.col("fp").alias("__fp"), F.col("doc_id").alias("__id"))
    found = found.join(ends, (F.col("fp") == F.col("__fp")) & F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    return found.select("fp", "tokens").dropDuplicates(["fp"])


def grouped(rows: DataFrame, key: str, columns: list[str], work, schema: str) -> DataFrame:
    """``work(column lists)`` for the rows of each ``key``, streamed in key order;
    ``schema`` begins with the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.list_(pa.int64()) if "array" in c else pa.int64() for c in schema.split(", ")]
        current, held, made = None, [], []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kinds[i]) for i in range(len(names))], names=names)

        for batch in batches:
            for k, *values in zip(*[c.to_pylist() for c in batch.columns]):
                if k != current and held:
                    made += [(current, *m) for m in work([list(c) for c in zip(*held)])]
                    held = []
                    if len(made) > 5000:
                        yield flush()
                        made = []
                current = k
                held.append(values)
        if held:
            made += [(current, *m) for m in work([list(c) for c in zip(*held)])]
        if made:
            yield flush()

    return rows.select(key, *columns).repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


class Bundle:
    """Lists of classes whose points are at hand: rows (piece, fp, label, None) of
    members and (None, fp, None, point) of points."""

    def __init__(self, columns: list[list]):
        self.points: dict[int, bytes | np.ndarray] = {}
        self.sizes: dict[int, int] = {}
        self.lists: dict[int, list[int]] = {}
        self.label: dict[int, int] = {}
        for piece, fp, label, blob in zip(*columns):
            if blob is not None:
                self.points[fp] = blob
            else:
                self.lists.setdefault(piece, []).append(fp)
                self.label[fp] = label
        place = {x: i for i, x in enumerate(sorted(set(self.label.values())))}
        self.label = {fp: place[x] for fp, x in self.label.items()}
        self.forest = Forest(len(place))

    def point(self, fp: int) -> np.ndarray:
        if isinstance(self.points[fp], bytes):
            self.points[fp] = unpacked_point(self.points[fp])
            self.sizes[fp] = int(self.points[fp].sum())
        return self.points[fp]

    def pairs(self, fps: list[int], joined: bool, seen: list) -> Iterator[tuple[int, int, int]]:
        """(class, class, bound per mille of the sizes): pairs of one list that the
        bound lets through and that do not hang together.  If ``joined``, a pair
        counts as linked once it is given.  ``seen`` grows if there are pairs that
        hang together already."""
        fps = sorted(set(fps))
        points = [self.point(fp) for fp in fps]
        sizes = np.array([self.sizes[fp] for fp in fps], np.int64)
        label = [self.label[fp] for fp in fps]

        def together(places: np.ndarray) -> bool:
            root = self.forest.root(label[places[0]])
            found = all(self.forest.root(label[p]) == root for p in places[1:].tolist())
            if found and len(places) > 1:
                seen.append(True)
            return found

        for i, j in surviving_pairs(points, sizes, together):
            if self.forest.root(label[i]) == self.forest.root(label[j]):
                seen.append(True)
                continue
            groups = min(len(points[i]), len(points[j]))
            bound = int(np.minimum(fold(points[i], groups), fold(points[j], groups)).sum())
            if 7 * bound >= 3 * (sizes[i] + sizes[j]):
                if joined:
                    self.forest.join(label[i], label[j])
                yield fps[i], fps[j], int(2000 * bound // (sizes[i] + sizes[j]))


def bundle_forest(columns: list[list]) -> list[tuple]:
    """(piece, class, class): at most one pair less than the bundle has components,
    and (piece, null, null) for each list that has surviving pairs."""
    bundle, out = Bundle(columns), []
    for piece, fps in bundle.lists.items():
        seen: list[bool] = []
        found = [(piece, a, b) for a, b, _ in bundle.pairs(fps, True, seen)]
        out += found
        if found or seen:
            out.append((piece, None, None))
    return out


def bundle_crossings(columns: list[list]) -> list[tuple]:
    """(class, class, bound): the surviving pairs between components, each once."""
    bundle, out = Bundle(columns), {}
    for fps in bundle.lists.values():
        for a, b, bound in bundle.pairs(fps, False, []):
            out[a, b] = bound
    return [(a, b, bound) for (a, b), bound in out.items()]


def meetings(members: DataFrame, most_members: int) -> DataFrame:
    """(piece, fp, label): the members (key, fp, label) of long lists, dealt out so
    that any two of different labels meet in a piece.

    A label with many members in a list is a team of its own, the others form a
    mixed one; teams are cut into chunks, and the chunks of two teams, and those
    of the mixed one among themselves, meet.  Members that hang together already
    do not, so a large family of copies meets the rest once.
    """
    few = max(1, most_members // 4)
    counts = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("team", F.when(F.col("n") >= few, F.col("label")))
    mixed = F.col("team").isNull()
    teams = counts.groupBy("key", "team").agg(F.ceil(F.sum("n") / few).cast("int").alias("chunks"))
    # a chunk of the mixed team has whole labels
    dealt = F.when(mixed, F.xxhash64("label")).otherwise(F.xxhash64("fp"))
    placed = members.join(counts.select("key", "label", "team"), ["key", "label"]).join(teams.select(F.col("key").alias("k"), F.col("team").alias("t"), "chunks"), (F.col("key") == F.col("k")) & F.col("team").eqNullSafe(F.col("t")))
    placed = placed.select("key", "team", F.pmod(dealt, F.col("chunks")).cast("int").alias("chunk"), "fp", "label")
    one = teams.select("key", F.col("team").alias("a"), F.col("chunks").alias("na"))
    two = teams.select("key", F.col("team").alias("b"), F.col("chunks").alias("nb"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = one.join(two, "key").filter("a < b or a is null").select("key", "a", "b", "nb", every("na").alias("x")).select("key", "a", "b", "x", every("nb").alias("y"))
    met = met.filter("b is not null or a is not null or x <= y").withColumn("piece", F.xxhash64("key", F.coalesce("a", F.lit(0)), F.isnull("a"), F.coalesce("b", F.lit(0)), F.isnull("b"), "x", "y"))
    ends = met.select("piece", F.col("key").alias("k"), F.explode(F.array(F.struct(F.col("a").alias("team"), F.col("x").alias("chunk")), F.struct(F.col("b").alias("team"), F.col("y").alias("chunk")))).alias("end"))
    same = (F.col("key") == F.col("k")) & F.col("team").eqNullSafe(F.col("end.team")) & (F.col("chunk") == F.col("end.chunk"))
    return placed.join(ends.distinct(), same).select("piece", "fp", "label")


def verify_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""
    left = sets.select(F.col("fp").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col("tokens").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yes = [linked(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")) for p, q in zip(x, y)]
            mask = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` (a, b, bound) of different components, with these as la < lb."""
    one = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    found = pairs.join(one, "a", "left").join(two, "b", "left").select("a", "b", "bound", F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"))
    return found.filter("x <> y").select("a", "b", "bound", F.least("x", "y").alias("la"), F.greatest("x", "y").alias("lb"))


def jaccard_components(docs: DataFrame, most_frequent: int = 262_144, filter_words: int = 65_536, count_tokens: int = 3_000_000, block_bytes: int = 4_000_000, most_members: int = 16_384) -> DataFrame:
    """(doc_id, h, n_shingles, component_id) for each row of ``docs`` (doc_id,
    text); ``h`` is xxhash64 of the text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    described = common.checkpoint(describe(docs, block_bytes, count_tokens))
    rows = described.filter("what = 0").select("doc_id", "h", "n", "fp", "point")
    often = described.filter("what = 1").groupBy("fp").agg(F.sum("n").alias("n")).filter("n >= 8")
    often = often.orderBy(F.desc("n"), "fp").limit(most_frequent).collect()
    frequent = np.array([r["fp"] for r in reversed(often)], np.int64).view(np.uint64)
    classes = rows.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("point").alias("point"))
    buckets = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = common.checkpoint(prefix_lists(docs, frequent, buckets, block_bytes, most_members))
    listed = lists.select("bundle", "piece", "key", "long", F.explode("fps").alias("fp"))
    firsts = classes.select("fp", F.col("first").alias("doc_id"))

    points = classes.select("fp", "point")

    def pairs_of(members: DataFrame, work, schema: str) -> DataFrame:
        """What ``work`` gives for bundles of members (bundle, piece, fp, label); a
        point comes once to a bundle, however many of its lists want it."""
        null = F.lit(None)
        wanted = members.select("bundle", "fp").distinct().join(points, "fp")
        both = members.select("bundle", "piece", "fp", "label", null.cast("binary").alias("point")).unionByName(wanted.select("bundle", null.cast("long").alias("piece"), "fp", null.cast("long").alias("label"), "point"))
        return common.checkpoint(grouped(both, "bundle", ["piece", "fp", "label", "point"], work, schema))

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = common.checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(firsts, "fp"))
        return whole_sets(docs, ends, filter_words, block_bytes)

    def labelled(lists: DataFrame) -> DataFrame:
        """Members (bundle, key, fp, label) of the lists that span several components."""
        members = lists.select("bundle", "key", "fp").join(labels.withColumnRenamed("node", "fp"), "fp", "left")
        members = members.select("bundle", "key", "fp", F.coalesce("component", "fp").alias("label"))
        several = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
        return members.join(several, "key", "left_semi")

    def verified(pairs: DataFrame) -> DataFrame:
        return common.checkpoint(verify_pairs(pairs, common.checkpoint(sets_of(pairs))).distinct())

    found = pairs_of(listed.withColumn("label", F.col("fp")), bundle_forest, "bundle long, piece long, a long, b long")
    tried = common.checkpoint(found.filter("a is not null").select("a", "b").distinct())
    labels = connected_components(verified(tried))

    # a list in one piece without a surviving pair is done
    short = listed.filter("not long").join(found.filter("a is null").select("piece"), "piece", "left_semi")
    left = labelled(short).select("bundle", F.col("key").alias("piece"), "fp", "label")
    long = lists.filter("long")
    if not long.isEmpty():
        far = meetings(labelled(listed.filter("long")).select("key", "fp", "label"), most_members)
        left = left.union(far.select(F.col("piece").alias("bundle"), "piece", "fp", "label"))
    met = pairs_of(left, bundle_crossings, "bundle long, a long, b long, bound long").select("a", "b", "bound")
    pairs = common.checkpoint(between(met.distinct(), labels).join(tried, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        sets = common.checkpoint(sets_of(pairs))
        # of two components the likeliest pair first: if it links, the others need no look
        best = pairs.groupBy("la", "lb").agg(F.max_by(F.struct("a", "b"), F.struct("bound", "a", "b")).alias("p")).select("p.a", "p.b")
        best = common.checkpoint(best)
        labels = joined_components(labels, common.checkpoint(verify_pairs(best, sets).distinct()))
        rest = between(pairs.select("a", "b", "bound"), labels).select("a", "b").join(best, ["a", "b"], "left_anti")
        labels = joined_components(labels, common.checkpoint(verify_pairs(rest, sets).distinct()))

    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select(F.col("fp").alias("__fp"), "component_id")
    out = rows.drop("point").join(named, (F.col("fp") == F.col("__fp")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op6_rtree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.read(spark, sf_dir, "documents")).drop("h")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
    ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT k.y, r.c FROM r JOIN k ON k.x = r.doc_id)
SELECT r.doc_id, coalesce(min(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: its smallest doc_id.

    Documents without words are linked with nothing and all stay, as do rows
    without doc_id that stand alone; of rows that repeat one stays.
    """
    found = jaccard_components(docs)
    first = found.filter((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    marked = docs.withColumn("__text", F.xxhash64("text"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = marked.join(first, marked["doc_id"].eqNullSafe(first["__id"]) & (marked["__text"] == first["__h"]), "left_semi")
    kept = kept.filter(worded).dropDuplicates(["doc_id", "__text"])
    return kept.unionByName(marked.filter(~worded)).drop("__text")
