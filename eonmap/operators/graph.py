"""Connected components, shared-boundary graphs and colouring.

Components, edges, containment and first-fit colouring are DataFrame loops. Saturation colouring and cliques
are sequential by nature and work on a graph of bounded size (states of the world), held by the
driver; ``collect_graph`` checks the size.
"""

from __future__ import annotations

import random
import time
from collections import Counter
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eonmap.operators.numbering import key_neighbours, neighbour_counts, overlapping_neighbours
from eonmap.sources.tables import materialise

Adjacency = dict[int, set[int]]
#: Edges that the driver takes at most for colouring.
MOST_EDGES = 1_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node of each connected component.

    Each round takes the least label of the neighbours and then the label of that label, so that
    the number of rounds grows with the logarithm of the longest path.
    """
    both = materialise(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).distinct())
    labels = materialise(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("component")).withColumnRenamed("x", "node"))
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["x"]).select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        new = materialise(step.join(jump, "component").select("node", F.least("component", "jump").alias("component"), "old"))
        done = new.where("component <> old").isEmpty()
        labels = new.select("node", "component")
        if done:
            return labels


def merged_chronologies(members: DataFrame, chrono: str = "chrono_id", member: str = "member_id", pos: str = "pos") -> DataFrame:
    """chrono_id (the canonical one), pos, member_id: chronologies that share members become one.

    The canonical one has most members, then the least id. Members stand in order of size of their
    chronology (large first), its id, and position; each once.
    """
    size = members.groupBy(chrono).agg(F.count("*").alias("size"), F.min(member).alias("_any"))
    hub = members.groupBy(member).agg(F.min(chrono).alias("h"))
    links = members.join(hub, member).select(F.col(chrono).alias("a"), F.col("h").alias("b")).distinct()
    comp = components(links)
    sized = size.join(comp, F.col(chrono) == F.col("node")).select(chrono, "size", "component")
    canon = sized.groupBy("component").agg(F.min_by(F.col(chrono), F.struct((-F.col("size")).alias("s"), F.col(chrono).alias("c"))).alias("canonical"))
    rows = members.join(sized, chrono).join(canon, "component")
    first = rows.groupBy("canonical", member).agg(F.min(F.struct((-F.col("size")).alias("s"), F.col(chrono).alias("c"), F.col(pos).alias("p"))).alias("o"))
    w = Window.partitionBy("canonical").orderBy("o", member)
    return first.select(F.col("canonical").alias(chrono), (F.row_number().over(w) - 1).alias(pos), member)


def node_edges(node_ways: DataFrame, node_ranges: DataFrame, of_ages: bool = False) -> DataFrame:
    """a, b (a < b): nodes that share a way and have ranges that overlap.

    node_ways: node, way_id. node_ranges: node, start, end (date keys); a node may have several. of_ages: ways have
    nodes of many ages, of which only contemporaries are paired; else ranges are compared once for each pair of nodes.
    """
    ranges = node_ranges.select("node", "start", "end").distinct()
    if of_ages:
        near = neighbour_counts(overlapping_neighbours(node_ways.select("way_id", "node").distinct().join(ranges, "node"), "way_id", "node", "start", "end"))
        return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = neighbour_counts(key_neighbours(node_ways, ["way_id"], "node")).select("a", "b")
    ra = ranges.select(F.col("node").alias("a"), F.col("start").alias("sa"), F.col("end").alias("ea"))
    rb = ranges.select(F.col("node").alias("b"), F.col("start").alias("sb"), F.col("end").alias("eb"))
    return near.join(ra, "a").join(rb, "b").where("sa < eb and sb < ea").select("a", "b").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree of an undirected edge list, each edge once."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return e.select(F.col("a").alias("node")).union(e.select("b")).groupBy("node").agg(F.count("*").alias("degree"))


def degree_stats(degree: DataFrame) -> DataFrame:
    """least, upper_median, most, isolated of a (node, degree) table."""
    # a row for each degree, not for each node, meets in one task
    sizes = degree.groupBy("degree").agg(F.count("*").alias("n"))
    upto = sizes.withColumn("_upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("_half", F.floor(F.sum("n").over(Window.partitionBy(F.lit(0))) / 2))
    return upto.agg(F.min("degree").alias("least"), F.min(F.when(F.col("_upto") > F.col("_half"), F.col("degree"))).alias("upper_median"),
                    F.max("degree").alias("most"), F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("n"))), F.lit(0)).alias("isolated"))


def collect_graph(nodes: DataFrame, edges: DataFrame, most: int = MOST_EDGES) -> Adjacency:
    """The graph as a dictionary; an error if it has more than ``most`` edges, or twice as many nodes."""
    there = nodes.select("node").limit(2 * most + 1).collect()
    if len(there) > 2 * most:
        raise ValueError(f"more than {2 * most} nodes; colour the components one by one")
    found = edges.select("a", "b").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} edges; colour the components one by one")
    adj: Adjacency = {r[0]: set() for r in there}
    for a, b in found:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    return adj


def first_fit(edges: DataFrame, order: DataFrame) -> DataFrame:
    """node, colour: the least colour that no earlier neighbour has, for each node in turn.

    order: node, and ``at``, a column that sorts and tells all nodes apart; edges (a, b) between them. A
    round colours all nodes whose earlier neighbours are coloured, which gives what one pass in order
    gives; rounds grow with the longest run of ever earlier neighbours.
    """
    nodes = materialise(order.select("node", "at"))
    place = lambda c: nodes.select(F.col("node").alias(c), F.col("at").alias(f"at_{c}"))
    both = edges.select(F.col("a"), F.col("b")).union(edges.select("b", "a")).where("a <> b").distinct()
    waits = materialise(both.join(place("a"), "a").join(place("b"), "b").where("at_b < at_a").select(F.col("a").alias("node"), F.col("b").alias("earlier")))
    done = materialise(nodes.select("node").join(waits.select("node").distinct(), "node", "left_anti").withColumn("colour", F.lit(0)))
    while True:
        seen = waits.join(done.select("node"), "node", "left_anti").join(done.select(F.col("node").alias("earlier"), "colour"), "earlier", "left")
        seen = seen.groupBy("node").agg(F.count_if(F.col("colour").isNull()).alias("open"), F.collect_set("colour").alias("used"))  # a set of colours, not of neighbours
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"))
        new = materialise(seen.where("open = 0").select("node", free.alias("colour")))
        if new.isEmpty():
            return done
        done = materialise(done.unionByName(new))


def by_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, at: nodes of high degree first, then the least id; the order of ``welsh_powell``."""
    return nodes.select("node").join(degrees(edges), "node", "left").select("node", F.struct((-F.coalesce("degree", F.lit(0))).alias("degree"), "node").alias("at"))


def _free(adj: Adjacency, colour: dict[int, int], v: int) -> int:
    used = {colour[u] for u in adj[v] if u in colour}
    return next(c for c in range(len(used) + 1) if c not in used)


def colour_in_order(adj: Adjacency, order: Iterable[int]) -> dict[int, int]:
    """The smallest free colour for each node in turn."""
    out: dict[int, int] = {}
    for v in order:
        out[v] = _free(adj, out, v)
    return out


def welsh_powell(adj: Adjacency, key: Callable[[int], object] = lambda v: v) -> dict[int, int]:
    """Nodes of high degree first; ties by ``key``."""
    return colour_in_order(adj, sorted(adj, key=lambda v: (-len(adj[v]), key(v))))


def dsatur(adj: Adjacency) -> dict[int, int]:
    """Next comes the node whose neighbours have most colours, then the highest degree, then the largest id."""
    out: dict[int, int] = {}
    seen: dict[int, set[int]] = {v: set() for v in adj}
    left = set(adj)
    while left:
        v = max(left, key=lambda v: (len(seen[v]), len(adj[v]), v))
        left.remove(v)
        out[v] = _free(adj, out, v)
        for u in adj[v]:
            seen[u].add(out[v])
    return out


def best_random(adj: Adjacency, rounds: int = 20, seed: int = 42) -> int:
    """Fewest colours of greedy colouring in random orders."""
    rng, nodes, best = random.Random(seed), list(adj), len(adj)
    for _ in range(rounds):
        rng.shuffle(nodes)
        best = min(best, len(set(colour_in_order(adj, nodes).values())))
    return best


def clashes(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """Edges whose two nodes have one colour."""
    ca = colours.select(F.col("node").alias("a"), F.col("colour").alias("_ca"))
    cb = colours.select(F.col("node").alias("b"), F.col("colour").alias("_cb"))
    return edges.join(ca, "a").join(cb, "b").where("_ca = _cb").select("a", "b")


def largest_clique(adj: Adjacency, seconds: float = 5.0) -> list[int]:
    """A largest set of nodes that are all adjacent, or the best found in the time given."""
    until, best = time.monotonic() + seconds, []
    stack: list[tuple[list[int], set[int], set[int]]] = [([], set(adj), set())]
    while stack and time.monotonic() < until:
        have, may, done = stack.pop()
        if len(have) > len(best):
            best = have
        if len(have) + len(may) <= len(best):
            continue
        pivot = max(may | done, key=lambda v: len(adj[v] & may), default=None)
        for v in sorted(may - (adj[pivot] if pivot is not None else set()), key=lambda v: len(adj[v])):
            stack.append(([*have, v], may & adj[v], done & adj[v]))
            may, done = may - {v}, done | {v}
    return sorted(best)


def induced(adj: Adjacency, nodes: Iterable[int]) -> Adjacency:
    keep = set(nodes)
    return {v: adj[v] & keep for v in keep if v in adj}


def hardest(adj: Adjacency, k: int) -> list[int]:
    """The k nodes of highest degree, ties by id as text."""
    return sorted(adj, key=lambda v: (-len(adj[v]), str(v)))[:k]


def analysis(adj: Adjacency, remove: Sequence[int] = (1, 5, 10)) -> dict[str, object]:
    """Colours by three methods, clique size, density among the hardest nodes, colours without them."""
    top = hardest(adj, 10)
    return {
        "welsh_powell": len(set(welsh_powell(adj, str).values())), "dsatur": len(set(dsatur(adj).values())), "random": best_random(adj),
        "clique": len(largest_clique(adj)), "mutual_top10": sum(b in adj[a] for i, a in enumerate(top) for b in top[i + 1:]),
        "edges_top20": sum(map(len, induced(adj, hardest(adj, 20)).values())) // 2,
        "without": {k: len(set(dsatur(induced(adj, set(adj) - set(hardest(adj, k)))).values())) for k in remove},
        "colours": dict(Counter(dsatur(adj).values())),
    }


def resolve_containment(pairs: Sequence[tuple[int, int]]) -> dict[int, int]:
    """dropped -> absorber, in the order given; pairs with a side that is already dropped are passed over."""
    out: dict[int, int] = {}
    for small, large in pairs:
        if small not in out and large not in out:
            out[small] = large
    return out


def contained_into(pairs: DataFrame) -> DataFrame:
    """(small, large, rank) -> id, into: what ``resolve_containment`` gives for the pairs by rank.

    Only as the small side can a unit be dropped. So a pair is settled as soon as it is the small
    unit's first, and the large unit can't be dropped before it; a whole takes all its parts in one
    round, and rounds grow with the length of chains, not with the number of parts. Without a column
    ``rank`` the order is that of (small, large).
    """
    rank = F.col("rank") if "rank" in pairs.columns else F.struct("small", "large")
    open_pairs = materialise(pairs.select("small", "large", rank.alias("rank")).groupBy("small", "large").agg(F.min(F.struct("rank", "small", "large")).alias("rank")))
    out = None
    while not open_pairs.isEmpty():
        first = open_pairs.groupBy("small").agg(F.min("rank").alias("least"))
        own = open_pairs.join(first, "small").where("rank = least").select("small", "large", "rank")
        settled = materialise(own.join(first.select(F.col("small").alias("large"), "least"), "large", "left").where("least is null or rank < least").select("small", "large", "rank"))
        left = open_pairs.join(settled.select("small"), "small", "left_anti")
        left = left.join(settled.select(F.col("small").alias("large"), F.col("rank").alias("gone")), "large", "left").where("gone is null or rank < gone")
        open_pairs = materialise(left.select("small", "large", "rank"))
        out = settled if out is None else out.unionByName(settled)
    if out is None:
        out = open_pairs
    return out.select(F.col("small").alias("id"), F.col("large").alias("into"))


def final_home(into: DataFrame) -> DataFrame:
    """(id, into) -> id, into: the unit at the end of each chain. The chains halve in every round."""
    now = materialise(into.select("id", "into"))
    while True:
        step = now.select(F.col("id").alias("into"), F.col("into").alias("next"))
        new = materialise(now.join(step, "into", "left").select("id", F.coalesce("next", "into").alias("into"), F.col("next").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("id", "into")
        now = new.select("id", "into")


def absorbed(into: dict[int, int]) -> dict[int, list[int]]:
    """absorber -> all it holds, also through others that it absorbed."""
    out: dict[int, list[int]] = {}
    for v in into:
        at, seen = into[v], {v}
        while at in into and at not in seen:
            seen.add(at)
            at = into[at]
        out.setdefault(at, []).append(v)
    return {k: sorted(v) for k, v in out.items()}
