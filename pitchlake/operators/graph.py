"""Property graph as node and edge frames: merge and delete semantics, neighbourhoods, trails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators.dedup import with_surrogate_ids
from pitchlake.session import checkpoint


def merge_last(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Upsert: of all rows of a key the one with the highest version stays, on a tie the greatest row."""
    rows = old.unionByName(new, allowMissingColumns=True)
    others = [c for c in rows.columns if c not in key]
    last = F.max(F.struct(F.col(version).alias("_v"), *[c for c in others if c != version])).alias("_r")
    return rows.groupBy(*key).agg(last).select(*key, *[F.col("_r._v").alias(c) if c == version else F.col(f"_r.{c}").alias(c) for c in others])


def merge_matched(old: DataFrame, new: DataFrame, key: str, set_on_match: list[str]) -> DataFrame:
    """Conditional merge: rows of ``old`` with their ``set_on_match`` columns taken from ``new`` where it has the key; other keys of ``new`` are created.

    ``action`` tells ``created``, ``matched`` or ``kept``. Keys are unique on both sides.
    """
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    action = F.when(F.col("o._there").isNull(), "created").when(F.col("n._there").isNotNull(), "matched").otherwise("kept")
    columns = []
    for c in old.columns:
        if c == key:
            columns.append(F.col(key))
        elif c != "_there":
            fresh = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in set_on_match else F.col(f"o.{c}")
            columns.append(F.when(F.col("o._there").isNull(), F.col(f"n.{c}")).otherwise(fresh).alias(c))
    return joined.select(*columns, action.alias("action"))


def merge_on_match(old: DataFrame, new: DataFrame, key: str, set_on_match: list[str]) -> DataFrame:
    """``merge_matched`` over plain frames."""
    return merge_matched(old.withColumn("_there", F.lit(1)), new.withColumn("_there", F.lit(1)), key, set_on_match)


def create_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` whose key it doesn't have; equal new keys once."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def undirected(edges: DataFrame) -> DataFrame:
    """Simple undirected edges a < b of an edge frame; loops are dropped."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a < b").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions (eid, rel, src, dst)."""
    return edges.select("eid", "rel", "src", "dst").unionByName(edges.select("eid", "rel", F.col("dst").alias("src"), F.col("src").alias("dst")))


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes for which ``gone`` holds and the edges at them."""
    dead = nodes.filter(gone).select("id")
    kept = edges.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.filter(~F.coalesce(gone, F.lit(False))), kept


def neighbours(edges: DataFrame, anchors: DataFrame, direction: str = "both", rels: list[str] | None = None) -> DataFrame:
    """(anchor, eid, rel, other): edges at the anchors. ``direction`` is out, in or both."""
    e = edges if rels is None else edges.filter(F.col("rel").isin(rels))
    out = e.select(F.col("src").alias("anchor"), "eid", "rel", F.col("dst").alias("other"))
    into = e.select(F.col("dst").alias("anchor"), "eid", "rel", F.col("src").alias("other"))
    found = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    return found.join(anchors.select(F.col("id").alias("anchor")).distinct(), "anchor", "left_semi")


def distances(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, id, distance): breadth-first distances up to ``most`` hops, undirected, level by level.

    A level joins the frontier with the edges and keeps the nodes that weren't reached; each level is checkpointed.
    """
    pairs = undirected(edges)
    step = pairs.select(F.col("a").alias("id"), F.col("b").alias("next")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("next")))
    frontier = sources.select(F.col("id").alias("source"), "id").distinct()
    reached = frontier.withColumn("distance", F.lit(0))
    for d in range(1, most + 1):
        fresh = frontier.join(step, "id").select("source", F.col("next").alias("id")).distinct()
        frontier = checkpoint(fresh.join(reached.select("source", "id"), ["source", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier.withColumn("distance", F.lit(d)))
    return reached


#: Pairs of numbers in a row of the shuffle; tasks among which the sources of a search are dealt at most; words of 64 sources in a table of nodes, and in a step over it; pairs that a level may list in any case.
CHUNK, SEARCHES, TABLE, STEP, LISTED = 1 << 15, 24, 3 << 22, 1 << 16, 1 << 14


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component: labels spread over the edges and along themselves."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low, new = np.minimum(x, y), label.copy()
        for at in (x, y, a, b):
            np.minimum.at(new, at, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _batches(start: np.ndarray, kind: np.ndarray, reach: np.ndarray, width: Callable[[int], int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first node, end, sources, their words, their bits): components that stand in order, small ones together, the sources of large ones in parts.

    The sources of a word are of one kind (0: no source); words of central sources come first, as their searches end earlier.
    """
    c = 0
    while c < len(start) - 1:
        low, c = start[c], c + 1
        while c < len(start) - 1 and start[c + 1] - low <= 4096:
            c += 1
        of = low + np.flatnonzero(kind[low : start[c]])
        if not len(of):
            continue
        of = of[np.lexsort((-reach[of], kind[of]))]
        begins = np.flatnonzero(np.diff(kind[of], prepend=-1))
        counts = np.diff(begins, append=len(of))
        rank = np.arange(len(of)) - np.repeat(begins, counts)
        full = -(-counts // 64)
        word = np.repeat(np.cumsum(full) - full, counts) + rank // 64
        order = np.argsort(-reach[of[rank % 64 == 0]], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        word, most = place[word], width(start[c] - low)
        for i in range(0, len(order), most):
            here = (word >= i) & (word < i + most)
            yield low, start[c], of[here], word[here] - i, rank[here] % 64


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _search(first: np.ndarray, to: np.ndarray, component: np.ndarray, sources: np.ndarray, word: np.ndarray, bit: np.ndarray, leaves: np.ndarray, most: int | None, tables: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of each word's sources and the nodes at distance 1, 2 and so on, and with the nodes counted by their ``leaves``, until there is none. Nodes stand by falling degree.

    While the pairs of a level are few they are listed; later a row of the tables holds the sources that have reached a
    node as bits. Only rows beside those that changed are visited that some source of their component hasn't reached,
    and where few are missing only the words that miss some; the k-th neighbours of all rows are joined in one step.
    Rows beside one that all sources have reached are full without a look at the others.
    """
    n, words, degree = len(first) - 1, int(word.max()) + 1, np.diff(first)
    seen, before = (t[: n * words].reshape(n, words) for t in tables)
    seen[:] = 0
    seen[sources, word] = np.uint64(1) << bit.astype(np.uint64)
    whole = np.zeros((component.max() + 1, words), np.uint64)
    np.bitwise_or.at(whole, (component[sources], word), seen[sources, word])
    left = np.bincount(component[sources], minlength=len(whole))[component]
    left[sources] -= 1
    listed, active, d, few = sources * (64 * words) + word * 64 + bit, np.sort(sources), 0, True
    step = max(1, STEP // words)
    held, joined = np.empty((2, step, words), np.uint64)
    while len(active) and (most is None or d < most):
        d += 1
        gains = np.zeros((2, words))
        if few:
            node, source = np.divmod(listed, 64 * words)
            lengths = degree[node]
            if lengths.sum() > max(len(to) * words // 64, LISTED):
                few = False
                before[:] = seen
        if few:
            listed = np.unique(to[_ranges(first[node], lengths)].astype(np.int64) * (64 * words) + np.repeat(source, lengths))
            flat, b = seen.reshape(-1), (listed % 64).astype(np.uint64)
            fresh = (flat[listed // 64] >> b & np.uint64(1)) == 0
            listed, b = listed[fresh], b[fresh]
            cell = listed // 64
            node, at = np.divmod(cell, words)
            if len(cell):
                begins = np.flatnonzero(np.diff(cell, prepend=-1))
                flat[cell[begins]] |= np.bitwise_or.reduceat(np.uint64(1) << b, begins)
            gains = np.stack([np.bincount(at, minlength=words), np.bincount(at, leaves[node], words)])
            np.subtract.at(left, node, 1)
            active = np.unique(node)
        else:
            beside, full = np.zeros((2, n), bool)
            if len(active) < n // 2:
                beside[to[_ranges(first[active], degree[active])]] = True
            else:
                beside[:] = True
            beside &= left > 0
            shut = active[left[active] == 0]
            full[to[_ranges(first[shut], degree[shut])]] = True
            full &= beside
            stale, changed = active[~beside[active]], []
            before[stale] = seen[stale]
            flat = seen.reshape(-1)
            for is_full, rows in ((True, np.flatnonzero(full)), (False, np.flatnonzero(beside & ~full))):
                for lo in range(0, len(rows), step):
                    r = rows[lo : lo + step]
                    begins, size, missing = first[r], degree[r], left[r]
                    hubs = int(np.searchsorted(-size, -64, "left"))
                    if not is_full and int(missing.sum()) * 12 < len(r) * words:
                        i, at = np.nonzero(np.take(seen, r, axis=0) != (whole if len(whole) == 1 else whole[component[r]]))
                        cell, starts, sizes = r[i] * words + at, begins[i], size[i]
                        old = flat[cell]
                        new = old.copy()
                        for k in range(min(int(size[0]), 64)):
                            m = int(np.searchsorted(-sizes, -k, "left"))
                            new[:m] |= flat[to[starts[:m] + k] * np.int64(words) + at[:m]]
                        for j in range(hubs):
                            new[i == j] |= _joined(seen, to[begins[j] : begins[j] + size[j]])[at[i == j]]
                        before[r] = seen[r]
                        before.reshape(-1)[cell] = new
                        more = np.bitwise_count(new ^ old).astype(np.float64)
                        gains += np.stack([np.bincount(at, more, words), np.bincount(at, more * leaves[r[i]], words)])
                        more = np.bincount(i, more, len(r))
                    else:
                        together, more = r[-1] - r[0] == len(r) - 1, joined[: len(r)]
                        new, old = (before[r[0] : r[-1] + 1], seen[r[0] : r[-1] + 1]) if together else (held[: len(r)], np.take(seen, r, axis=0))
                        all_of = whole if len(whole) == 1 else whole[component[r]]
                        if is_full:
                            new[:] = all_of
                        else:
                            new[:] = old
                            _join(seen, to, begins, size, new, more, np.broadcast_to(all_of, new.shape) if int(missing.sum()) * 4 < len(r) * len(sources) else None)
                            for j in range(hubs):  # rows of more neighbours, each by itself
                                new[j] |= _joined(seen, to[begins[j] : begins[j] + size[j]])
                        if not together:
                            before[r] = new
                        np.bitwise_xor(new, old, out=more)
                        hung = leaves[r]
                        exact = np.float32 if hung.sum() + len(r) + words < 1 << 18 else np.float64  # up to 64 times these numbers
                        more = np.bitwise_count(more).astype(exact)
                        gains[0] += np.ones(len(r), exact) @ more
                        gains[1] += hung.astype(exact) @ more
                        more = more @ np.ones(words, exact)
                    left[r] = missing - more.astype(np.int64)
                    changed.append(r[more > 0])
            seen, before = before, seen
            active = np.sort(np.concatenate(changed)) if changed else active[:0]
        if len(active):
            yield gains.astype(np.int64)


def _join(seen: np.ndarray, to: np.ndarray, begins: np.ndarray, size: np.ndarray, new: np.ndarray, room: np.ndarray, whole: np.ndarray | None) -> None:
    """Joins up to 64 neighbours to each of the ``new`` rows, which stand by falling size; with ``whole``, rows that are full after four are left alone."""
    for k in range(min(int(size[0]), 64)):
        m = int(np.searchsorted(-size, -k, "left"))
        if k == 4 and whole is not None and m > 8:
            live = np.flatnonzero((new[:m] != whole[:m]).any(axis=1))
            if len(live) < 0.8 * m:
                if len(live):
                    rest = new[live]
                    _join(seen, to, begins[live] + k, size[live] - k, rest, room, None)
                    new[live] = rest
                return
        np.take(seen, to[begins[:m] + k], axis=0, out=room[:m], mode="clip")
        np.bitwise_or(new[:m], room[:m], out=new[:m])


def _joined(seen: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All sources that have reached some of the rows."""
    out = np.zeros(seen.shape[1], np.uint64)
    for k in range(0, len(rows), 1 << 12):
        out |= np.bitwise_or.reduce(seen[rows[k : k + (1 << 12)]], axis=0)
    return out


def count_paths(edges: np.ndarray, is_source: np.ndarray, part: int, parts: int, words: int, most: int | None) -> dict[int, int]:
    """Pairs by distance of a share of the sources of a graph, given as pairs of numbers of its nodes.

    Nodes with one neighbour, that has others, are left out of the search: what lies ``d`` from their neighbour lies ``d + 1`` from them.
    """
    a, b = edges[:, 0], edges[:, 1]
    n = len(is_source)
    degree, near = np.bincount(np.concatenate([a, b]), minlength=n), np.zeros(n, np.int64)
    near[a], near[b] = b, a
    leaf = (degree == 1) & (degree[near] > 1)
    leaves, told = np.bincount(near[leaf], minlength=n), np.bincount(near[leaf & is_source], minlength=n)
    inner = ~(leaf[a] | leaf[b])
    place = np.cumsum(~leaf) - 1
    a, b, leaves, told, is_source = place[a[inner]], place[b[inner]], leaves[~leaf], told[~leaf], is_source[~leaf]
    n = len(is_source)
    label = _components(n, a, b)
    degree = np.bincount(np.concatenate([a, b]), minlength=n)
    order = np.lexsort((-degree, label))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    a, b = place[a], place[b]
    to = np.concatenate([a * n + b, b * n + a])
    del a, b, inner
    to.sort()  # the same order in all tasks; neighbours of high degree first
    to = (to % n).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(degree[order])])
    degree, label, leaves, told, is_source = degree[order], label[order], leaves[order], told[order], is_source[order]
    start = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1], [True]]))
    reach = np.ones(n)
    for _ in range(3):
        reach = np.diff(np.concatenate([[0], np.cumsum(reach[to])])[first])
    width = lambda size: max(1, min(words, TABLE // size))
    tables = np.empty((2, max(4096 * words, *((end - low) * width(end - low) for low, end in zip(start[:-1], start[1:])))), np.uint64)
    found: dict[int, int] = {}
    for i, (low, end, sources, word, bit) in enumerate(_batches(start, 2 * told + is_source, reach, width)):
        if i % parts != part:
            continue
        lengths, near, component = degree[low:end], to[first[low] : first[end]] - np.int32(low), np.unique(label[low:end], return_inverse=True)[1]
        if component[-1]:  # together by degree
            by_degree = np.argsort(-lengths, kind="stable")
            here = np.empty(end - low, np.int32)
            here[by_degree] = np.arange(end - low)
            near = here[near[_ranges((first[low:end] - first[low])[by_degree], lengths[by_degree])]]
            lengths, component = lengths[by_degree], component[by_degree]
        else:
            by_degree = here = np.arange(end - low)
        own, outer = np.zeros((2, int(word.max()) + 1), np.int64)
        own[word], outer[word] = is_source[sources], told[sources]  # a word's sources are of one kind
        zero = np.stack([np.bincount(word), np.bincount(word, leaves[sources]).astype(np.int64)])
        found[2] = found.get(2, 0) - int(told[sources].sum())  # leaves to themselves
        for d, (nodes, hung) in enumerate([zero, *_search(np.concatenate([[0], np.cumsum(lengths)]), near, component, here[sources - low].astype(np.int64), word, bit, leaves[low + by_degree], most, tables)]):
            for at, pairs in ((d, nodes @ own), (d + 1, hung @ own + nodes @ outer), (d + 2, hung @ outer)):
                found[at] = found.get(at, 0) + int(pairs)
    return {d: pairs for d, pairs in found.items() if pairs and 0 < d and (most is None or d <= most)}


def path_counts(edges: DataFrame, words: int = 64, at_once: int = 1 << 11, sources: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(distance, pairs): how many ordered pairs of different nodes lie at each distance, undirected; from every node (or those of ``sources``), without a cap on hops (or up to ``most``).

    Nodes are numbered, and each of up to ``SEARCHES`` tasks gets all edges, packed 8 bytes an edge, and a share of the
    sources, one task per ``at_once`` of them at most; it goes breadth-first through memory, 64 times ``words`` sources at once, a component at a time.
    So the number of jobs doesn't grow with the distances, and the pairs are counted where they are found.
    """
    pairs = checkpoint(undirected(edges))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    nodes = with_surrogate_ids(ids, ["id"], "no").select("id", (F.col("no") - 1).cast("int").alias("no"))
    nodes = checkpoint(nodes)
    n = nodes.count()
    parts = max(1, min(SEARCHES, -(-n // at_once)))
    numbered = pairs.join(nodes.select(F.col("id").alias("a"), F.col("no").alias("x")), "a").join(nodes.select(F.col("id").alias("b"), F.col("no").alias("y")), "b").select("x", "y")
    if sources is not None:  # each is told as an edge to itself; else all nodes are sources
        told = nodes.join(sources.select("id").distinct(), "id", "left_semi").select(F.col("no").alias("x"), F.col("no").alias("y"))
        numbered = numbered.unionByName(told)
    every = sources is None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy = np.stack([c.to_numpy().astype(np.int32) for c in batch.columns], axis=1)
            xy = xy[np.argsort(xy[:, 0])]
            for i in range(0, len(xy), CHUNK):  # first bytes, second bytes and so on: so they compress
                yield pa.RecordBatch.from_pydict({"xy": [xy[i : i + CHUNK].view(np.uint8).reshape(-1, 8).T.tobytes()]}, schema=pa.schema({"xy": pa.binary()}))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, v in zip(batch.column("part").to_pylist(), batch.column("xy")):
                shares.setdefault(part, []).append(np.ascontiguousarray(np.frombuffer(v.as_py(), np.uint8).reshape(8, -1).T).view(np.int32))
        while shares:
            part, chunks = shares.popitem()
            xy, is_source = np.concatenate(chunks), np.full(n, every)
            del chunks
            if not every:
                loops = xy[:, 0] == xy[:, 1]
                is_source[xy[loops, 0]] = True
                xy = xy[~loops]
            found = count_paths(xy, is_source, part, parts, words, most)
            yield pa.RecordBatch.from_pydict({"distance": list(found), "pairs": list(found.values())}, schema=pa.schema({"distance": pa.int32(), "pairs": pa.int64()}))

    packed = numbered.mapInArrow(pack, "xy binary").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = packed.repartitionById(parts, F.col("part")).mapInArrow(search, "distance int, pairs bigint")
    return found.groupBy("distance").agg(F.sum("pairs").alias("pairs"))


def shortest_paths(edges: DataFrame, wanted: DataFrame, most: int = 3) -> DataFrame:
    """(source, target, hops, path): one shortest undirected path of node ids per wanted pair within ``most`` hops; pairs without one are left out.

    Of equal paths the smallest by ids is kept at every node, so each frontier row carries one path.
    """
    pairs = undirected(edges)
    step = pairs.select(F.col("a").alias("id"), F.col("b").alias("next")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("next")))
    frontier = wanted.select("source").distinct().select("source", F.col("source").alias("id"), F.array("source").alias("path"))
    reached = frontier
    for _ in range(most):
        fresh = frontier.join(step, "id").select("source", F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path"))
        fresh = fresh.groupBy("source", "id").agg(F.min("path").alias("path"))
        frontier = checkpoint(fresh.join(reached.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", "path"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    found = reached.withColumnRenamed("id", "target").join(wanted, ["source", "target"])
    return found.select("source", "target", (F.size("path") - 1).alias("hops"), "path")


def trails(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, target, hops, eids): all undirected trails of 1 to ``most`` edges; an edge isn't repeated, a node may be."""
    step = both_ways(edges).select("eid", "src", "dst")
    at = sources.select(F.col("id").alias("source"), F.col("id").alias("target"), F.array().cast("array<bigint>").alias("eids"))
    out = None
    for n in range(1, most + 1):
        at = at.join(step, at["target"] == step["src"]).filter(~F.array_contains("eids", F.col("eid")))
        at = at.select("source", F.col("dst").alias("target"), F.concat("eids", F.array(F.col("eid").cast("bigint"))).alias("eids"))
        part = at.select("source", "target", F.lit(n).alias("hops"), "eids")
        out = part if out is None else out.unionByName(part)
    return out


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose both ends are among the ids."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def capped_two_hops(edges: DataFrame, anchors: DataFrame, first: int, second: int) -> DataFrame:
    """(anchor, via, other): two-hop expansion that keeps the first neighbours by id at each hop: a top-k, ``first`` then ``second``."""
    one = neighbours(edges, anchors).select("anchor", F.col("other").alias("via")).filter("anchor <> via").distinct()
    one = one.withColumn("_rn", F.row_number().over(Window.partitionBy("anchor").orderBy("via"))).filter(F.col("_rn") <= first).drop("_rn")
    two = neighbours(edges, one.select(F.col("via").alias("id"))).select(F.col("anchor").alias("via"), "other").distinct()
    out = one.join(two, "via").filter("other <> anchor AND other <> via")
    return out.withColumn("_rn", F.row_number().over(Window.partitionBy("anchor", "via").orderBy("other"))).filter(F.col("_rn") <= second).select("anchor", "via", "other")
