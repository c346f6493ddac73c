"""Bounded traversals: frontier joins with a visited set, a level at a time (rows G1-G14).

Each level is written to the shared folder, which cuts the lineage and
survives lost executors; no node is looked up on its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps"
    return base.rstrip("/")


def _step(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{_folder(spark)}/level-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Nodes of a frontier that are broadcast at most; a larger one is shuffled.
BROADCAST_NODES = 2_000_000


def _nodes(front: DataFrame) -> DataFrame:
    """The nodes of a written frontier, broadcast as long as they are few: Parquet's footers give the number."""
    nodes = front.select("node")
    return F.broadcast(nodes) if front.count() <= BROADCAST_NODES else nodes


def symmetric(R: DataFrame) -> DataFrame:
    """(node, other, rel_type, confidence) of each edge from both ends, without a second scan."""
    ends = F.array(F.struct(F.col("source_qualified").alias("node"), F.col("target_qualified").alias("other")), F.struct(F.col("target_qualified").alias("node"), F.col("source_qualified").alias("other")))
    return R.select(F.explode(ends).alias("x"), "rel_type", "confidence").select("x.*", "rel_type", "confidence")


def severity(depth: Column, confidence: Column) -> Column:
    return F.when((depth == 1) & (confidence >= 0.8), "WILL_BREAK").when(depth <= 2, "LIKELY_AFFECTED").otherwise("MAY_BE_AFFECTED")


def reach(moves: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node and least depth over moves (node, other, confidence), with the best confidence of a first arrival.

    As long as frontiers are few nodes, a level scans the moves and nothing of the graph is shuffled or written; the
    first larger one has the moves of later levels written once.
    """
    held = False
    seen = _step(start.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence")))
    front = seen
    for level in range(1, depth + 1):
        if not held and level < depth and front.count() > BROADCAST_NODES:
            moves, held = _step(moves), True
        step = moves.join(_nodes(front), "node", "left_semi").groupBy(F.col("other").alias("node")).agg(F.max("confidence").alias("confidence"))
        front = _step(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("depth"), "confidence"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reach_by_scans(R: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """As ``reach``, both ways along edges, for searches of a few levels from few nodes: a level scans the edges by source and by target.

    Only frontiers are written, and one of few nodes is broadcast, so that nothing of the graph is shuffled.
    """
    seen = _step(start.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence")))
    front = seen
    for level in range(1, depth + 1):
        near = _nodes(front)
        out = R.join(near.withColumnRenamed("node", "source_qualified"), "source_qualified", "left_semi").select(F.col("target_qualified").alias("node"), "confidence")
        back = R.join(near.withColumnRenamed("node", "target_qualified"), "target_qualified", "left_semi").select(F.col("source_qualified").alias("node"), "confidence")
        step = out.unionByName(back).groupBy("node").agg(F.max("confidence").alias("confidence"))
        front = _step(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("depth"), "confidence"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def impact_radius(E: DataFrame, R: DataFrame, start: str, depth: int, min_confidence: float = 0.0, cap: int | None = None) -> DataFrame:
    """G1: elements within ``depth`` steps either way, with the severity: all of them, or the first ``cap``."""
    sure = R.where(F.col("confidence") >= min_confidence).select("source_qualified", "target_qualified", "confidence")
    origin = E.sparkSession.createDataFrame([(start,)], "node string")
    known = E.select(F.col("qualified_name").alias("node")).distinct()
    found = reach_by_scans(sure, origin, depth).where("depth > 0").join(known, "node", "left_semi")
    out = found.withColumn("severity", severity(F.col("depth"), F.col("confidence"))).orderBy("depth", "node")
    return out if cap is None else out.limit(cap)


def call_graph(R: DataFrame, start: str, depth: int, limit: int = 1000) -> DataFrame:
    """Forward call edges up to ``depth``, also those back to a node seen before; unresolved ones end there."""
    calls = _step(R.where(F.col("rel_type") == "calls").select("source_qualified", "target_qualified").distinct())
    front = _step(R.sparkSession.createDataFrame([(start,)], "node string"))
    seen, out = front, None
    for level in range(1, depth + 1):
        edges = _step(calls.join(front.withColumnRenamed("node", "source_qualified"), "source_qualified").withColumn("depth", F.lit(level)))
        out = edges if out is None else out.unionByName(edges)
        new = edges.where(~F.col("target_qualified").startswith("__unresolved__")).select(F.col("target_qualified").alias("node")).distinct()
        front = _step(new.join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return out.orderBy("depth", "source_qualified", "target_qualified").limit(limit)


def shortest_path(R: DataFrame, start: str, goal: str, max_hops: int = 10) -> DataFrame:
    """One undirected shortest path as an array of nodes; ties by label rank, then by the nodes' names.

    Both ends are searched from, each time the one with the smaller frontier, so
    that the widest levels are never reached. A frontier has of each node the
    best way from its end, and the first two frontiers that share nodes meet on
    all shortest paths. Edges are scanned and only those of a frontier travel.
    """
    rank = F.when(F.col("confidence") >= 0.9, 0).when(F.col("confidence") >= 0.6, 1).otherwise(2)
    moves = symmetric(R).select("node", "other", rank.alias("rank"))
    schema = "node string, path array<string>, cost int"
    sides = [_step(R.sparkSession.createDataFrame([(end, [end], 0)], schema)) for end in (start, goal)]
    before: list[DataFrame | None] = [None, None]
    meeting = None
    for hop in range(min(max_hops, 10) + 1):
        if hop:
            k = int(sides[1].count() < sides[0].count())
            front = sides[k]
            live = moves.join(_nodes(front), "node", "left_semi").join(front, "node")
            path = F.concat(F.array("other"), "path") if k else F.concat("path", F.array("other"))
            step = live.select(F.col("other").alias("node"), path.alias("path"), (F.col("cost") + F.col("rank")).cast("int").alias("cost"))
            for old in (front, before[k]):  # a neighbour is one level up, on the same level or one below
                step = step if old is None else step.join(_nodes(old), "node", "left_anti")
            best = step.groupBy("node").agg(F.min(F.struct("cost", "path")).alias("x")).select("node", "x.path", "x.cost")
            before[k], sides[k] = front, _step(best)
            if sides[k].isEmpty():
                break
        rest = sides[1].select("node", F.col("path").alias("rest"), F.col("cost").alias("more"))
        whole = F.concat("path", F.slice("rest", F.lit(2), F.size("rest")))
        met = sides[0].join(rest, "node").agg(F.min(F.struct((F.col("cost") + F.col("more")).alias("cost"), whole.alias("path"))).alias("x"))
        meeting = _step(met.where("x IS NOT NULL").select("x.path", "x.cost"))
        if not meeting.isEmpty():
            break
    return meeting.select("path", "cost", (F.size("path") - 1).alias("hops"))


def seeded_traversal(E: DataFrame, R: DataFrame, seeds: DataFrame, rules: DataFrame, cap: int = 60, max_hops: int = 4) -> DataFrame:
    """Rules (element_type, rel_type, hops, fan_out) bound each seed's expansion; the cap cuts whole levels in order."""
    typed = E.select(F.col("qualified_name").alias("node"), "element_type")
    moves = R.select(F.col("source_qualified").alias("node"), F.col("target_qualified").alias("other"), "rel_type").join(typed, "node")
    allowed = moves.join(F.broadcast(rules), ["element_type", "rel_type"])
    order = Window.partitionBy("node", "rel_type").orderBy("other")
    allowed = _step(allowed.withColumn("r", F.row_number().over(order)).where("r <= fan_out").select("node", "other", "hops"))
    seen = _step(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for level in range(1, max_hops + 1):
        new = allowed.where(F.col("hops") >= level).join(front.select("node"), "node").select(F.col("other").alias("node")).distinct()
        front = _step(new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.orderBy("depth", "node").limit(cap)


def ontology_expansion(R: DataFrame, root: str, depth: int) -> DataFrame:
    """Outgoing expansion."""
    moves = R.select(F.col("source_qualified").alias("node"), F.col("target_qualified").alias("other"), "confidence")
    return reach(moves, R.sparkSession.createDataFrame([(root,)], "node string"), depth).select("node", "depth")


def subgraph(R: DataFrame, root: str, depth: int, types: list[str] | None = None) -> DataFrame:
    """Edges whose two ends lie within ``depth`` of the root, by least depth."""
    R = R.where(F.col("rel_type").isin(types)) if types else R
    near = reach(symmetric(R).select("node", "other", "confidence"), R.sparkSession.createDataFrame([(root,)], "node string"), min(depth, 10)).select("node")
    inside = R.join(near.withColumnRenamed("node", "source_qualified"), "source_qualified", "left_semi")
    return inside.join(near.withColumnRenamed("node", "target_qualified"), "target_qualified", "left_semi")


#: Rows that ``_moved`` takes together, about; all of one node at least.
ROWS_AT_ONCE = 1 << 17


def _moved(rows: DataFrame, twice: float) -> DataFrame:
    """node, community, k after the moves of a sweep.

    rows: sorted by node; of each link its w and its neighbour's community with
    that one's total, and of each node a row of w 0 with its own community and
    its k as total. A node without links here keeps its community.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def moved(c):
            node, community, total, w = c
            mine = w == 0
            nodes, own, k = node[mine], community[mine], total[mine]
            n = np.searchsorted(nodes, node[~mine])
            label = own.copy()
            if len(n):
                com, tot, w = community[~mine], total[~mine], w[~mine]
                by = np.lexsort((com, n))
                n, com, tot, w = n[by], com[by], tot[by], w[by]
                at = np.flatnonzero(np.append(True, (n[1:] != n[:-1]) | (com[1:] != com[:-1])))
                into, n, com, tot = np.add.reduceat(w, at), n[at], com[at], tot[at]
                same = com == own[n]
                gain = np.round(into - k[n].astype(np.float64) * (tot - np.where(same, k[n], 0)) / twice, 9)
                stay = np.zeros(len(nodes))
                stay[n[same]] = gain[same]
                by = np.lexsort((com, gain, n))
                last = by[np.append(n[by][1:] != n[by][:-1], True)]  # of the best gain the greatest community
                last = last[gain[last] > stay[n[last]] + 0.001]
                label[n[last]] = com[last]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes, label, k)], ["node", "community", "k"])

        held, size, enough = [], 0, ROWS_AT_ONCE
        for batch in batches:
            held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
            size += batch.num_rows
            if size >= enough:
                c = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = int(np.searchsorted(c[0], c[0][-1]))  # the last node's rows may go on in the next batch
                held, size = [[x[last:].copy() for x in c]], size - last
                enough = max(ROWS_AT_ONCE, 2 * size)
                if last:
                    yield moved([x[:last] for x in c])
        if size:
            yield moved([np.concatenate(x) for x in zip(*held, strict=True)])

    return rows.mapInArrow(run, "node long, community long, k long")


def communities(R: DataFrame, sweeps: int = 10) -> DataFrame:
    """Local moves by modularity gain, in turn for nodes of even and odd hash; calls weigh 2, other edges 1.

    Nodes get numbers in the order of their names, the last bit of which says
    their turn. Links lie in buckets of the neighbour, so that a sweep moves
    only labels to the links of the nodes whose turn it is, and numbers from there.
    """
    spark = R.sparkSession
    ends = R.where("source_qualified <> target_qualified").select(F.col("source_qualified").alias("s"), F.col("target_qualified").alias("t"), F.when(F.col("rel_type") == "calls", 2).otherwise(1).cast("long").alias("w"))
    names = ends.select(F.explode(F.array("s", "t")).alias("name")).distinct().repartitionByRange("name").sortWithinPartitions("name")
    names = _step(names.select("name", (2 * F.monotonically_increasing_id() + F.pmod(F.xxhash64("name"), F.lit(2))).alias("node")))
    code = lambda name, node: names.select(F.col("name").alias(name), F.col("node").alias(node)).hint("shuffle_hash")  # noqa: E731  (no edge is sorted by a name)
    coded = ends.join(code("s", "a"), "s").join(code("t", "b"), "t")
    pairs = _step(coded.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")))
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("x")
    links = pairs.select(both, "w").select("x.node", "x.other", "w")
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"links_{uuid.uuid4().hex}"
    turns = links.withColumn("turn", (F.col("node") % 2).cast("int")).repartition(buckets, "other")
    turns.write.partitionBy("turn").bucketBy(buckets, "other").option("path", f"{_folder(spark)}/{table}").format("parquet").saveAsTable(table)
    links = spark.table(table)
    label = _step(pairs.select(both, "w").groupBy("x.node").agg(F.sum("w").alias("k")).select("node", F.col("node").alias("community"), "k"))
    twice = float(label.agg(F.sum("k")).first()[0] or 1)
    for sweep in range(sweeps):
        total = F.sum("k").over(Window.partitionBy("community")).alias("total")
        known = label.select(F.col("node").alias("other"), "community", total)
        sent = links.where(F.col("turn") == sweep % 2).join(known.hint("shuffle_hash"), "other").select("node", "community", "total", "w")
        own = label.select("node", "community", F.col("k").alias("total"), F.lit(0).cast("long").alias("w"))
        label = _step(_moved(sent.unionByName(own).repartition("node").sortWithinPartitions("node"), twice))
    spark.sql(f"DROP TABLE {table}")
    named = label.join(names, "node").select(F.col("name").alias("node"), "community")
    return named.join(names.select(F.col("name").alias("of"), F.col("node").alias("community")), "community").select("node", F.col("of").alias("community"))


def entry_scores(R: DataFrame, E: DataFrame) -> DataFrame:
    """How likely a function starts a process."""
    calls = R.where(F.col("rel_type") == "calls").select("source_qualified", "target_qualified").distinct()
    out = calls.groupBy(F.col("source_qualified").alias("qualified_name")).agg(F.count("*").alias("callees"))
    back = calls.groupBy(F.col("target_qualified").alias("qualified_name")).agg(F.count("*").alias("callers"))
    f = E.where(F.col("element_type").isin("function", "method")).select("qualified_name", "name")
    f = f.join(out, "qualified_name", "left").join(back, "qualified_name", "left").fillna(0, ["callees", "callers"])
    bonus = F.when(F.lower("name").rlike("^(main|handle|run|start|process|on_)"), 1.5).otherwise(1.0)
    score = F.log1p("callees") * 10.0 / F.least(F.pow(F.lit(2.0), 2.0 * F.col("callers")), F.lit(100.0)) * bonus
    return f.withColumn("score", F.round(score, 6))


def processes(R: DataFrame, E: DataFrame, entries: int = 200, depth: int = 10, branch: int = 4, limit: int = 75) -> DataFrame:
    """Call traces from the best entries; of traces with the same ends the longest stays."""
    calls = R.where(F.col("rel_type") == "calls").select(F.col("source_qualified").alias("node"), F.col("target_qualified").alias("other")).distinct()
    calls = _step(calls.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("other"))).where(F.col("r") <= branch).drop("r"))
    top = entry_scores(R, E).where("score > 0").orderBy(F.desc("score"), "qualified_name").limit(entries)
    front = _step(top.select(F.col("qualified_name").alias("node"), F.array("qualified_name").alias("path")))
    done = None
    for _ in range(depth):
        more = front.join(calls, "node", "left").withColumn("go", F.col("other").isNotNull() & ~F.coalesce(F.array_contains("path", F.col("other")), F.lit(True)))
        more = _step(more)
        ended = more.where("not go").select("path").distinct()
        done = ended if done is None else done.unionByName(ended)
        front = _step(more.where("go").select(F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path")))
        if front.isEmpty():
            break
    done = done.unionByName(front.select("path")).where(F.size("path") >= 2).distinct()
    ends = [F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last")]
    best = done.select("path", *ends).groupBy("first", "last").agg(F.max(F.struct(F.size("path").alias("n"), "path")).alias("x"))
    return best.select("first", "last", F.col("x.n").alias("steps"), F.col("x.path").alias("path")).orderBy(F.desc("steps"), "first", "last").limit(limit)


def timeline(R: DataFrame) -> DataFrame:
    """When edges were added and invalidated, in order of time."""
    t = lambda k: F.get_json_object("metadata", f"$.{k}").cast("long")
    both = F.array(F.struct(t("valid_from").alias("at"), F.lit("added").alias("event")), F.struct(t("valid_to").alias("at"), F.lit("invalidated").alias("event")))
    out = R.select(F.explode(both).alias("x"), "source_qualified", "target_qualified", "rel_type").select("x.at", "x.event", "source_qualified", "target_qualified", "rel_type")
    return out.where("at is not null")


def budgeted(E: DataFrame, budget: int, partition: str = "file_path") -> DataFrame:
    """Of each file the greedy prefix of elements, the largest first, whose tokens stay within the budget."""
    tokens = F.ceil((F.col("line_end") - F.col("line_start") + 1) * 10 / 4).cast("long")
    w = Window.partitionBy(partition).orderBy(F.desc("tokens"), "qualified_name").rowsBetween(Window.unboundedPreceding, 0)
    return E.withColumn("tokens", tokens).withColumn("running", F.sum("tokens").over(w)).where(F.col("running") <= budget)


def incremental_dependents(R: DataFrame, files: DataFrame) -> DataFrame:
    """Sources of edges whose target is a changed file or ends with its name."""
    tail = F.element_at(F.split("target_qualified", "/"), -1)
    names = files.select(F.element_at(F.split("file_path", "/"), -1).alias("tail"), "file_path").distinct()
    hit = R.withColumn("tail", tail).join(names, "tail").where(F.col("target_qualified").endswith(F.col("file_path")))
    return hit.select("source_qualified").distinct()


def force_layout(E: DataFrame, R: DataFrame, component: DataFrame, iterations: int = 50) -> DataFrame:
    """Positions in the plane for each component (node, component) of at most a few thousand nodes."""
    import numpy as np
    import pandas as pd

    ends = R.select("source_qualified", "target_qualified").join(component.select(F.col("node").alias("source_qualified"), "component"), "source_qualified")

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(edges["source_qualified"]) | set(edges["target_qualified"]))
        at = {n: k for k, n in enumerate(names)}
        rng = np.random.default_rng(7)
        p = rng.uniform(-1, 1, (len(names), 2))
        a, b = edges["source_qualified"].map(at).to_numpy(), edges["target_qualified"].map(at).to_numpy()
        k = 1 / max(len(names), 1) ** 0.5
        for t in range(iterations):
            d = p[:, None] - p[None]
            r = np.sqrt((d**2).sum(-1)) + 1e-9
            force = (d * (k * k / r**2)[..., None]).sum(1)
            pull = p[a] - p[b]
            pull *= (np.sqrt((pull**2).sum(-1)) / k)[:, None]
            np.add.at(force, a, -pull)
            np.add.at(force, b, pull)
            size = np.sqrt((force**2).sum(-1))[:, None] + 1e-9
            p += force / size * np.minimum(size, 0.1 * (1 - t / iterations))
        return pd.DataFrame({"node": names, "x": p[:, 0], "y": p[:, 1]})

    return ends.groupBy("component").applyInPandas(run, "node string, x double, y double")
