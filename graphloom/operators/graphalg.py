"""Iterative graph algorithms (GR1-GR13, WN13, SR7).

Each round is a join plus a grouped aggregate over narrow tables, stored by a
reliable checkpoint; the driver only reads counts. Grouped minima, sums and
max_by combine before the shuffle, so a hub costs one row per map task.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.operators.batching import chunk_groups, even_split
from graphloom.operators.endpoints import missing_ends, with_ends
from graphloom.operators.ranking import row_numbers
from graphloom.operators.stats import with_folder_group
from graphloom.session import checkpointed


def adjacency(edges: DataFrame, directed: bool = False) -> DataFrame:
    """``(src, dst)`` rows; both directions unless ``directed``."""
    out = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return out if directed else out.union(out.select(F.col("dst"), F.col("src")))


def bfs(
    edges: DataFrame, starts: DataFrame, max_hops: int | None = None, directed: bool = False, stop_at: str | None = None
) -> DataFrame:
    """``(id, depth, parent)`` of the nodes reachable from ``starts(id)``; the
    starts have depth 0. Parents are the smallest id among equals."""
    adj = adjacency(edges, directed)
    frontier = checkpointed(starts.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    seen = frontier
    depth = 0
    while max_hops is None or depth < max_hops:
        depth += 1
        step = (
            frontier.select(F.col("id").alias("src")).join(adj, "src")
            .groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        )
        frontier = checkpointed(
            step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "parent")
        )
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if stop_at is not None and not frontier.filter(F.col("id") == stop_at).isEmpty():
            break
    return seen


def neighbours(edges: DataFrame, node_id: str, max_hops: int = 2) -> DataFrame:
    """k-hop neighbourhood without the start (GR1)."""
    start = edges.sparkSession.range(1).select(F.lit(node_id).alias("id"))
    return bfs(edges, start, max_hops).filter("depth > 0").select("id", "depth")


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``(pos, id)`` along a shortest undirected path (GR2); empty when the ends
    are equal or not connected. The walk back reads one parent per level."""
    spark = edges.sparkSession
    empty = spark.createDataFrame([], "pos int, id string")
    if source == target:
        return empty
    tree = bfs(edges, spark.range(1).select(F.lit(source).alias("id")), stop_at=target)
    hit = tree.filter(F.col("id") == target).first()
    if hit is None:
        return empty
    chain = [target]
    for level in range(hit["depth"], 0, -1):
        row = tree.filter((F.col("id") == chain[-1]) & (F.col("depth") == level)).first()
        chain.append(row["parent"])
    return spark.createDataFrame(list(enumerate(reversed(chain))), "pos int, id string")


def bfs_depths(edges: DataFrame, entry: str, types: tuple[str, ...] = ("imports", "calls")) -> DataFrame:
    """Directed depth of each node from an entry point (GR3)."""
    start = edges.sparkSession.range(1).select(F.lit(entry).alias("id"))
    return bfs(edges.filter(F.col("type").isin(list(types))), start, directed=True).select("id", "depth")


def trajectory(nodes: DataFrame, edges: DataFrame, node_id: str, max_hops: int = 3) -> DataFrame:
    """Nodes and edges within reach, with their times (WN13)."""
    near = checkpointed(neighbours(edges, node_id, max_hops).select("id"))
    every = near.union(nodes.sparkSession.range(1).select(F.lit(node_id)))
    seen_nodes = nodes.join(every, "id", "left_semi").select("created_at", F.lit("node").alias("kind"), "id")
    # an edge found by its source needs no look at its target
    src = near.select(F.col("id").alias("source"), F.lit(True).alias("_s"))
    looked = edges.select("source", "target", "seq", "created_at").join(src, "source", "left")
    found = F.coalesce("_s", F.col("source") == node_id, F.lit(False))
    by_target = looked.filter(~found).join(near.select(F.col("id").alias("target")), "target", "left_semi")
    seen_edges = looked.filter(found).select(*by_target.columns).unionByName(by_target).select(
        "created_at", F.lit("edge").alias("kind"), F.col("seq").cast("string").alias("id"))
    return seen_nodes.unionByName(seen_edges).orderBy("created_at", "kind", "id")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weakly connected components as ``(id, component)``; a component is named
    by its smallest id (GR4).

    Every component hooks onto its smallest neighbour component, pointer jumping
    leads all hooks to the root of their tree, and the links are contracted to
    links between the merged components. A tree holds two components at least, so
    links halve each round; a tree of any depth takes a logarithm of jumps, long
    chains included.
    """
    pairs = adjacency(edges, directed=True).filter("src <> dst")
    return _connected(nodes.select("id"), checkpointed(_once(pairs)))


def _once(pairs: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)``, the smaller id first."""
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _connected(ids: DataFrame, links: DataFrame) -> DataFrame:
    """:func:`components` over stored ``links(src, dst)``, one row a pair, the smaller id first."""
    labels = ids.select("id", F.col("id").alias("component"))
    while not links.isEmpty():
        hooks = _rooted(
            links.select(F.col("dst").alias("root"), F.col("src").alias("hook"))
            .union(links.select("src", "src")).groupBy("root").agg(F.min("hook").alias("hook"))
        )
        labels = checkpointed(
            labels.join(hooks.withColumnRenamed("root", "component"), "component", "left")
            .select("id", F.coalesce("hook", "component").alias("component"))
        )
        links = checkpointed(_once(
            links.join(hooks.toDF("src", "_s"), "src").join(hooks.toDF("dst", "_d"), "dst")
            .select(F.col("_s").alias("src"), F.col("_d").alias("dst")).filter("src <> dst")
        ))
    return labels


def _rooted(hooks: DataFrame) -> DataFrame:
    """``(root, hook)`` with every hook led on to the end of its tree; an end hooks
    onto itself. Three jumps a table, until the last jump moves nothing."""
    hooks = checkpointed(hooks)
    while True:
        for _ in range(3):
            onward = hooks.select(F.col("root").alias("hook"), F.col("hook").alias("_next"))
            hooks = hooks.join(onward, "hook").select(
                "root", F.col("_next").alias("hook"), (F.col("_next") != F.col("hook")).alias("moved"))
        hooks = checkpointed(hooks)
        still = hooks.filter("moved").isEmpty()
        hooks = hooks.select("root", "hook")
        if still:
            return hooks


def component_report(labels: DataFrame, min_size: int = 2, k: int = 12) -> DataFrame:
    """Largest components first (GR4)."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    return sizes.orderBy(F.col("n").desc(), "component").limit(k)


#: Longer than any path; keeps the lengths that run around a cycle from overflowing.
_FAR = 1 << 40


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, level)``; nodes in or behind cycles get a null level (GR5).

    A level is the longest way from a root. A node with a single predecessor
    hangs at a fixed distance from it, so such chains are shortened by pointer
    jumping (eightfold a round) and their edges lead on from the chain's head.
    What starts at a root is kept apart as the longest distance of each node: a
    node with nothing else is settled and its own edges lead on from the root, so
    every round also settles at least one whole level. Edges that coincide stay,
    which spares moving all edges to fold them; predecessors are told apart by
    name. ``edges`` are read several times, so they should be stored.
    """
    ids = checkpointed(nodes.select("id").distinct())
    missing = missing_ends(edges, ids)
    inner = with_ends(edges).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    if not missing.isEmpty():
        for end in ("src", "dst"):
            inner = inner.join(missing.withColumnRenamed("id", end), end, "left_anti")
        inner = checkpointed(inner.select("src", "dst").distinct())
    links = inner.withColumn("w", F.lit(1).cast("long"))
    roots = checkpointed(ids.join(inner.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
    base = roots.select(F.col("id").alias("dst"), F.lit(0).cast("long").alias("w"))
    done = None
    while True:
        rooted = base.select(F.lit(None).cast(links.schema["src"].dataType).alias("src"), "dst", "w")
        hung = checkpointed(
            links.unionByName(rooted).groupBy(F.col("dst").alias("node")).agg(
                F.count(F.when(F.col("src").isNull(), 1)).alias("n"), F.min("src").alias("up"),
                F.max("src").alias("last"), F.max("w").alias("dist"))
            .filter("up IS NULL OR (n = 0 AND up = last)").select("node", "up", "dist")
        )
        if hung.filter("up IS NULL").isEmpty():
            break
        for _ in range(3):
            hung = _led_on(hung, "up", "dist", hung)
        hung = checkpointed(hung)
        settled = hung.filter("up IS NULL").select(F.col("node").alias("id"), F.col("dist").cast("int").alias("level"))
        done = settled if done is None else done.union(settled)
        # a chain may now hang on a node that has just been settled; leading the chain on spares a join of all links
        rest = checkpointed(_led_on(links, "src", "w", _led_on(hung, "up", "dist", hung.filter("up IS NULL"))))
        links = rest.filter("src IS NOT NULL")
        # every link to a settled node now starts at the root, so only those links have to meet the settled nodes
        far = rest.filter("src IS NULL").select("dst", "w").union(base).groupBy("dst").agg(F.max("w").alias("w"))
        base = checkpointed(far.join(settled, F.col("dst").eqNullSafe(F.col("id")), "left_anti"))
    left = links.select(F.col("dst").alias("id")).union(base.select("dst")).distinct()
    left = left.withColumn("level", F.lit(None).cast("int"))
    return left if done is None else done.union(left)


def _led_on(rows: DataFrame, start: str, length: str, hung: DataFrame) -> DataFrame:
    """Rows whose ``start`` hangs on another node start there, that much longer."""
    onward = hung.select(F.col("node").alias(start), F.col("up").alias("_up"), F.col("dist").alias("_dist"),
                         F.lit(True).alias("_here"))
    joined = rows.join(onward, start, "left")
    return joined.withColumns({
        start: F.when(F.col("_here"), F.col("_up")).otherwise(F.col(start)),
        length: F.least(F.col(length) + F.coalesce("_dist", F.lit(0)), F.lit(_FAR)),
    }).select(*rows.columns)


def simple_undirected(edges: DataFrame) -> DataFrame:
    """``(src, dst, w)`` in both directions, one row per pair, no self loops."""
    lo, hi = F.least("source", "target"), F.greatest("source", "target")
    once = edges.filter("source <> target").select(lo.alias("a"), hi.alias("b")).distinct()
    return once.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w")).union(
        once.select(F.col("b"), F.col("a"), F.lit(1.0))
    )


#: Links (both directions) of a component that one task may hold; larger ones move in rounds.
_TASK_LINKS = 1 << 18
#: Links that a group of small components holds on average.
_BUNDLE_LINKS = 1 << 14


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Modularity communities ``(id, community)`` (GR6).

    A community never leaves its component, and a move needs only the weights
    around it and the weight of the whole graph. So components of a bounded size
    are dealt over the tasks, where their nodes move in turn; larger components
    move in rounds over tables. Isolated nodes keep a community of their own.
    """
    adj = checkpointed(simple_undirected(edges))
    weight = adj.agg(F.sum("w").alias("w"), F.count("*").alias("n")).first()
    if not weight["n"]:
        return nodes.select("id", F.col("id").alias("community"))
    total = weight["w"]
    homes = _connected(adj.select(F.col("src").alias("id")).distinct(), adj.filter("src < dst").select("src", "dst"))
    links = checkpointed(adj.join(homes.withColumnRenamed("id", "src"), "src").select("component", "src", "dst", "w"))
    large = checkpointed(
        links.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > _TASK_LINKS).select("component"))
    bundles = weight["n"] // _BUNDLE_LINKS + 1
    placed = (
        links.join(F.broadcast(large), "component", "left_anti")
        .select(F.pmod(F.xxhash64("component"), F.lit(bundles)).alias("bundle"), "src", "dst", "w")
    ).groupBy("bundle").applyInPandas(
        lambda rows: _moved_in_turn(rows, total), "id string, community string")
    if not large.isEmpty():
        rest = links.join(F.broadcast(large), "component", "left_semi").select("src", "dst", "w")
        placed = placed.unionByName(_moved_in_rounds(checkpointed(rest), total))
    return nodes.select("id").join(placed, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def _moved_in_turn(rows: pd.DataFrame, total: float) -> pd.DataFrame:
    """Communities of whole components in one task: each node moves to the neighbour
    community of most gain, and its neighbours look again, until none moves;
    communities then become nodes, until a level moves nothing. A community is
    named by its smallest id."""
    names, src = np.unique(rows["src"].to_numpy(), return_inverse=True)
    near: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in zip(src.tolist(), np.searchsorted(names, rows["dst"].to_numpy()).tolist(), rows["w"].tolist()):
        near[a][b] = w
    label = np.arange(len(names))
    while True:
        degree = [sum(links.values()) for links in near]
        home, tot = list(range(len(near))), list(degree)
        waiting, queued = deque(range(len(near))), [True] * len(near)
        while waiting:
            v = waiting.popleft()
            queued[v] = False
            into: dict[int, float] = {}
            for u, w in near[v].items():
                if u != v:
                    into[home[u]] = into.get(home[u], 0.0) + w
            own, k = home[v], degree[v]
            tot[own] -= k
            best, top = own, into.get(own, 0.0) - k * tot[own] / total
            for c, w in into.items():
                if w - k * tot[c] / total > top + 1e-9:
                    best, top = c, w - k * tot[c] / total
            tot[best] += k
            if best != own:
                home[v] = best
                for u in near[v]:
                    if home[u] != best and not queued[u]:
                        queued[u] = True
                        waiting.append(u)
        kept, place = np.unique(home, return_inverse=True)
        label = place[label]
        if len(kept) == len(near):
            break
        merged: list[dict[int, float]] = [{} for _ in kept]
        for v, links in enumerate(near):
            out = merged[place[v]]
            for u, w in links.items():
                out[place[u]] = out.get(place[u], 0.0) + w
        near = merged
    first = np.full(len(near), len(names))
    np.minimum.at(first, label, np.arange(len(names)))
    return pd.DataFrame({"id": names, "community": names[first[label]]})


def _moved_in_rounds(adj: DataFrame, total: float) -> DataFrame:
    """``(id, community)`` by multi-level local moving over tables: every node scores
    its neighbour communities by modularity gain in one grouped aggregate; a new half
    of the nodes, by a hash, moves at once each round, which keeps two neighbours from
    swapping forever, until nothing moves or modularity stops rising; communities are
    then contracted to nodes. Levels go on until one does not raise modularity."""
    member = checkpointed(adj.select(F.col("src").alias("id"), F.col("src").alias("community")).distinct())
    best_q = _modularity_value(adj, member, total)
    graph = adj
    while True:
        placed = _local_moves(graph, total)
        joined = member.join(placed.withColumnRenamed("id", "community"), "community", "left").select(
            "id", F.coalesce("new", "community").alias("community")
        )
        candidate = checkpointed(joined)
        q = _modularity_value(adj, candidate, total)
        if q <= best_q + 1e-9:
            break
        best_q, member = q, candidate
        c = placed.select("id", "new")
        graph = checkpointed(
            graph.join(c.toDF("src", "_cs"), "src").join(c.toDF("dst", "_cd"), "dst")
            .groupBy(F.col("_cs").alias("src"), F.col("_cd").alias("dst")).agg(F.sum("w").alias("w"))
        )
    return member


def _local_moves(graph: DataFrame, total: float) -> DataFrame:
    degree = checkpointed(graph.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    state = checkpointed(degree.select("id", "k", F.col("id").alias("new")))
    links = graph.filter("src <> dst")
    best, best_q = state, _modularity_value(graph, state.select("id", F.col("new").alias("community")), total)
    idle = stale = r = 0
    while idle < 2 and stale < 4:
        sizes = state.groupBy("new").agg(F.sum("k").alias("tot"))
        near = (
            links.join(state.select(F.col("id").alias("dst"), "new"), "dst")
            .groupBy(F.col("src").alias("id"), "new").agg(F.sum("w").alias("k_in"))
        )
        own = state.select("id", "k", F.col("new").alias("home"))
        options = (
            near.unionByName(state.select("id", "new", F.lit(0.0).alias("k_in")))
            .groupBy("id", "new").agg(F.sum("k_in").alias("k_in"))
            .join(own, "id").join(sizes, "new")
        )
        others = F.col("tot") - F.when(F.col("new") == F.col("home"), F.col("k")).otherwise(0.0)
        gain = F.col("k_in") - F.col("k") * others / total
        scored = options.withColumn("gain", F.round(gain, 9))
        chosen = scored.groupBy("id", "k", "home").agg(
            F.min_by("new", F.struct((-F.col("gain")).alias("g"), F.col("new"))).alias("best"),
            F.max("gain").alias("top"),
            F.max(F.when(F.col("new") == F.col("home"), F.col("gain"))).alias("stay"),
        )
        turn = F.pmod(F.xxhash64("id", F.lit(r // 2)), F.lit(2)) == r % 2
        moves = turn & (F.col("top") > F.col("stay") + 1e-9)
        nxt = checkpointed(
            chosen.select("id", "k", F.when(moves, F.col("best")).otherwise(F.col("home")).alias("new"), moves.alias("moved"))
        )
        idle = idle + 1 if nxt.filter("moved").isEmpty() else 0
        state, r = nxt.select("id", "k", "new"), r + 1
        q = _modularity_value(graph, state.select("id", F.col("new").alias("community")), total)
        stale = stale + 1 if q <= best_q + 1e-9 else 0
        if not stale:
            best, best_q = state, q
    return best.select("id", "new")


def _modularity_parts(adj: DataFrame, member: DataFrame, total: float) -> DataFrame:
    c = member.select(F.col("id").alias("src"), F.col("community").alias("cs"))
    d = member.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    rows = adj.join(c, "src").join(d, "dst")
    return rows.groupBy(F.col("cs").alias("community")).agg(
        F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("tot")
    )


def _modularity_value(adj: DataFrame, member: DataFrame, total: float) -> float:
    q = F.sum(F.col("inside") / total - (F.col("tot") / total) * (F.col("tot") / total))
    return _modularity_parts(adj, member, total).agg(q).first()[0] or 0.0


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Modularity of a partition ``(id, community)`` as one row (GR7)."""
    adj = simple_undirected(edges)
    m2 = adj.agg(F.sum("w").alias("m2"))
    parts = _modularity_parts(adj, member, 1.0)
    sums = parts.agg(F.sum("inside").alias("i"), F.sum(F.col("tot") * F.col("tot")).alias("t2"))
    return sums.withColumn("_k", F.lit(1)).join(m2.withColumn("_k", F.lit(1)), "_k").select(
        (F.try_divide("i", "m2") - F.try_divide("t2", F.col("m2") * F.col("m2"))).alias("modularity")
    )


def containers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, container, strategy)`` (GR8): folders, or communities when there
    are fewer than two buckets or one holds over 70 %; members of a one-node
    container are released (null) when there are three nodes or more."""
    grouped = with_folder_group(nodes.select("id", "file_path")).select("id", F.col("folder").alias("container"))
    sizes = grouped.groupBy("container").agg(F.count("*").alias("n"))
    shape = sizes.agg(F.count("*").alias("buckets"), F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    strategy = "folder"
    if shape["total"] and (shape["buckets"] < 2 or shape["largest"] / shape["total"] > 0.7):
        strategy = "community"
        inner = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(
            nodes.select(F.col("id").alias("target")), "target", "left_semi"
        )
        grouped = communities(nodes, inner).withColumnRenamed("community", "container")
        sizes = grouped.groupBy("container").agg(F.count("*").alias("n"))
    out = grouped.join(sizes, "container")
    if (shape["total"] or 0) >= 3:
        out = out.withColumn("container", F.when(F.col("n") > 1, F.col("container")))
    return out.select("id", "container", F.lit(strategy).alias("strategy"))


def non_code_groups(files: DataFrame) -> DataFrame:
    """``(path, grp, mergeable)`` of non-code files (GR9): Docker clusters per
    directory, workflows, other CI, migrations, then directories in twenties."""
    rows = files.select(
        "path", paths.dirname(F.col("path")).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("base")
    )
    docker_dirs = rows.filter("base = 'Dockerfile'").select("dir").distinct().withColumn("_docker", F.lit(True))
    rows = rows.join(docker_dirs, "dir", "left")
    in_docker = F.col("_docker") & (
        F.col("base").isin("Dockerfile", ".dockerignore") | F.col("base").startswith("docker-compose.")
    )
    yaml = F.col("path").endswith(".yml") | F.col("path").endswith(".yaml")
    grp = (
        F.when(in_docker, F.concat(F.lit("A:"), "dir"))
        .when(F.col("path").startswith(".github/workflows/") & yaml, "B:workflows")
        .when((F.col("path") == ".gitlab-ci.yml") | F.col("path").startswith(".circleci/"), "C:ci")
        .when(F.col("path").endswith(".sql") & F.col("dir").rlike(r"(^|/)migrations?$"), F.concat(F.lit("D:"), "dir"))
    )
    keyed = checkpointed(rows.select("path", "dir", grp.alias("grp")))
    fixed = keyed.filter("grp IS NOT NULL").select("path", "grp", F.lit(False).alias("mergeable"))
    rest = chunk_groups(keyed.filter("grp IS NULL").select("path", "dir"), ["dir"], ["path"], 20, "_chunk")
    return fixed.unionByName(
        rest.select(
            "path", F.concat_ws(":", F.lit("E"), "dir", F.col("_chunk").cast("string")).alias("grp"),
            F.lit(True).alias("mergeable"),
        )
    )


def semantic_batches(code: DataFrame, non_code: DataFrame, limit: int = 35, min_size: int = 3, pool: int = 25) -> DataFrame:
    """``(path, batch_index)`` (GR9): ``code(path, community)`` split above
    ``limit``, non-code groups, small mergeable groups pooled, numbered: code by
    size then first path, non-code groups by key, pools last."""
    split = even_split(code.select("path", "community"), "community", ["path"], limit, "_part")
    code_rows = split.select(
        "path", F.concat_ws(":", F.lit("code"), "community", F.col("_part").cast("string")).alias("grp"),
        F.lit(True).alias("mergeable"), F.lit(0).alias("_kind"),
    )
    rows = checkpointed(
        code_rows.unionByName(non_code_groups(non_code).withColumn("_kind", F.lit(1)))
    )
    sizes = rows.groupBy("grp", "mergeable", "_kind").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
    small = F.col("mergeable") & (F.col("n") < min_size)
    keepers = sizes.filter(~small).select(
        "grp", "_kind", F.when(F.col("_kind") == 0, -F.col("n")).otherwise(0).alias("_o1"),
        F.when(F.col("_kind") == 0, F.col("first_path")).otherwise(F.col("grp")).alias("_o2"),
    )
    pooled = chunk_groups(
        rows.join(sizes.filter(small).select("grp"), "grp", "left_semi").select("path"), [], ["path"], pool, "_chunk"
    ).select("path", F.concat(F.lit("pool:"), F.col("_chunk").cast("string")).alias("grp"), F.col("_chunk").alias("_o1"))
    pools = pooled.select("grp", F.lit(2).alias("_kind"), "_o1", F.lit("").alias("_o2")).distinct()
    numbered = row_numbers(keepers.unionByName(pools), [], ["_kind", "_o1", "_o2", "grp"], "batch_index").select("grp", "batch_index")
    placed = rows.join(sizes.filter(~small).select("grp"), "grp", "left_semi").select("path", "grp").unionByName(
        pooled.select("path", "grp")
    )
    return placed.join(numbered, "grp").select("path", "batch_index")


def heuristic_tour(nodes: DataFrame, edges: DataFrame, members: DataFrame | None) -> DataFrame:
    """``(id, step, title)`` (GR10): topological order grouped by layer (the
    last layer declared for a node), or three per step without layers;
    unlayered nodes and concepts come last."""
    code = nodes.filter("type <> 'concept'").select("id", "seq")
    levels = topological_levels(code, edges)
    ordered = code.join(levels, "id").withColumn("_level", F.coalesce("level", F.lit(2147483647)))
    if members is None:
        steps = row_numbers(ordered.select("id", "_level"), [], ["_level", "id"], "_pos").select(
            "id", (F.floor((F.col("_pos") - 1) / 3) + 1).alias("step")
        ).withColumn("title", F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit(": Code Walkthrough")))
    else:
        home = members.groupBy(F.col("node_id").alias("id")).agg(
            F.max_by(F.struct("layer_name", "layer_id"), F.struct("layer_pos", "layer_id")).alias("_h")
        ).select("id", F.col("_h.layer_name").alias("title"), F.col("_h.layer_id").alias("layer_id"))
        placed = checkpointed(ordered.join(home, "id", "left").select("id", "_level", "title", "layer_id"))
        first = placed.filter("layer_id IS NOT NULL").groupBy("layer_id").agg(F.min(F.struct("_level", "id")).alias("_f"))
        keys = first.select("layer_id", F.col("_f._level").alias("_l"), F.col("_f.id").alias("_i"))
        numbers = row_numbers(keys, [], ["_l", "_i"], "step").select("layer_id", "step")
        last = numbers.agg((F.coalesce(F.max("step"), F.lit(0)) + 1).alias("step"))
        loose = placed.filter("layer_id IS NULL").select("id", F.lit("Supporting Components").alias("title"), F.lit(1).alias("_k"))
        steps = placed.join(numbers, "layer_id").select("id", "step", "title").unionByName(
            loose.join(last.withColumn("_k", F.lit(1)), "_k").select("id", "step", "title")
        )
    ideas = nodes.filter("type = 'concept'").select("id", F.lit("Key Concepts").alias("title"), F.lit(1).alias("_k"))
    end = steps.agg((F.coalesce(F.max("step"), F.lit(0)) + 1).alias("step")).withColumn("_k", F.lit(1))
    return steps.unionByName(ideas.join(end, "_k").select("id", "step", "title"))


def mutual_pairs(edges: DataFrame, types: tuple[str, ...] = ("imports", "calls")) -> DataFrame:
    """Pairs linked in both directions (GR11 seeds), smaller id first."""
    e = edges.filter(F.col("type").isin(list(types)) & (F.col("source") != F.col("target"))).select("source", "target", "type")
    pair = e.select(
        F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "type",
        (F.col("source") < F.col("target")).alias("up"),
    )
    # both directions seen for one pair and type; no self join is needed
    both = pair.groupBy("a", "b", "type").agg(F.bool_or("up").alias("u"), F.bool_or(~F.col("up")).alias("d"))
    return both.filter("u AND d").select("a", "b").distinct()


def coupled_groups(edges: DataFrame, rounds: int = 3, max_size: int = 5, k: int = 10) -> DataFrame:
    """``(group_id, id)`` of the k most linked small groups (GR11).

    Every seed pair grows, each round by the node with most links (two at least)
    into the group. Seeds that grow into one set are one group, named by the
    smallest seed; groups rank by the links inside them.
    """
    adj = checkpointed(simple_undirected(edges.filter(F.col("type").isin("imports", "calls"))).select("src", "dst"))
    seeds = mutual_pairs(edges).select(F.concat_ws("|", "a", "b").alias("group_id"), F.array("a", "b").alias("ids"))
    groups = checkpointed(seeds.select("group_id", F.explode("ids").alias("id")))
    for _ in range(min(rounds, max_size - 2)):
        near = groups.withColumnRenamed("id", "src").join(adj, "src").groupBy("group_id", F.col("dst").alias("id")).agg(
            F.count("*").alias("links")
        )
        best = (
            near.filter("links >= 2").join(groups, ["group_id", "id"], "left_anti")
            .groupBy("group_id").agg(F.min_by("id", F.struct((-F.col("links")).alias("l"), F.col("id"))).alias("id"))
        )
        if best.isEmpty():
            break
        groups = checkpointed(groups.unionByName(best))
    inner = (
        groups.withColumnRenamed("id", "src").join(adj, "src").join(groups.withColumnRenamed("id", "dst"), ["group_id", "dst"])
        .groupBy("group_id").agg((F.count("*") / 2).cast("long").alias("links"))
    )
    sets = groups.groupBy("group_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # max_size ids at most
    ranked = sets.join(inner, "group_id").groupBy("ids", "links").agg(F.min("group_id").alias("group_id"))
    return ranked.orderBy(F.col("links").desc(), "group_id").limit(k).select("group_id", F.explode("ids").alias("id"))


def feature_clusters(nodes: DataFrame, edges: DataFrame, members: DataFrame, k: int = 12) -> DataFrame:
    """First k of layer, import and tag clusters (GR12)."""
    files = nodes.filter("type = 'file'").select("id", "tags", "seq")
    by_layer = (
        members.filter("lower(layer_name) <> 'root'").select("layer_id", "layer_pos", F.col("node_id").alias("id")).distinct()
        .join(files.select("id"), "id", "left_semi")
        .groupBy(F.col("layer_id").alias("key")).agg(F.count("*").alias("n"), F.min("layer_pos").cast("long").alias("pos"))
        .select(F.lit(0).alias("kind"), F.lit("layer-cluster").alias("strategy"), "key", "n", "pos", F.lit(0.55).alias("confidence"))
    )
    file_ids = files.select("id")
    imports = (
        edges.filter("type = 'imports'")
        .join(file_ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(file_ids.withColumnRenamed("id", "target"), "target", "left_semi")
    )
    report = component_report(components(file_ids, imports), 2, k)
    by_import = report.select(
        F.lit(1).alias("kind"), F.lit("import-cluster").alias("strategy"), F.col("component").alias("key"), "n",
        (-F.col("n")).alias("pos"), F.lit(0.44).alias("confidence"),
    )
    by_tag = (
        files.select("seq", F.explode("tags").alias("key")).filter("key <> ''")
        .groupBy("key").agg(F.count("*").alias("n"), F.min("seq").alias("pos"))
        .select(F.lit(2).alias("kind"), F.lit("tag-cluster").alias("strategy"), "key", "n", "pos", F.lit(0.495).alias("confidence"))
    )
    every = by_layer.unionByName(by_import).unionByName(by_tag).filter("n >= 2")
    return every.orderBy("kind", "pos", "key").limit(k).select("strategy", "key", "n", "confidence")


def graph_hits(edges: DataFrame, seeds: DataFrame, max_hops: int = 2) -> DataFrame:
    """Graph source for hybrid search (SR7): ``seeds(query_id, id)``; a node
    scores the summed weight of its edges from the previous hop, over the hop."""
    both = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight").union(
        edges.select(F.col("target"), F.col("source"), F.col("weight"))
    )
    frontier = checkpointed(seeds.select("query_id", "id").distinct())
    seen = frontier
    out = None
    for hop in range(1, max_hops + 1):
        step = (
            frontier.withColumnRenamed("id", "src").join(both, "src")
            .groupBy("query_id", F.col("dst").alias("id")).agg(F.sum("weight").alias("w"))
        )
        scored = checkpointed(
            step.join(seen, ["query_id", "id"], "left_anti").select("query_id", "id", (F.col("w") / hop).alias("score"))
        )
        out = scored if out is None else out.union(scored)
        frontier = scored.select("query_id", "id")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return out


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and their incident edges removed (GR13)."""
    ids = gone.select("id").distinct()
    return nodes.join(ids, "id", "left_anti").select(*nodes.columns), (
        edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
        .select(*edges.columns)
    )
