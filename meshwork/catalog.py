"""Queries over the driver's tables, one per operator, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions import codec
from meshwork.graph import Graph, symmetrize, vertex_rows
from meshwork.operators import analytics, deltas, distribution, frontier, layout, sampling, topology, traversal
from meshwork.plans import block_index, properties
from meshwork.runtime import ship, sized
from meshwork.sources import derive, workload

_graphs: dict[tuple, Graph] = {}


def graph(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    """A derived graph, written once a session and folder: loading is not part of an algorithm."""
    ship(spark)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _graphs:
        with sized(spark, 2 * derive.read(spark, sf_dir, derive.SOURCES[name]).count()):
            _graphs[key] = getattr(derive, name)(spark, sf_dir).materialised()
    return _graphs[key]


QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _edges_sql(pairs: str) -> str:
    return f"""p AS MATERIALIZED (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM ({pairs}) WHERE a <> b),
e AS MATERIALIZED (SELECT a AS src, b AS dst FROM p UNION ALL SELECT b, a FROM p)"""


SP = _edges_sql(f"SELECT l_suppkey AS a, l_partkey + {derive.SHIFT} AS b FROM lineitem") + ", v AS MATERIALIZED (SELECT DISTINCT src AS id FROM e)"
CO = _edges_sql(f"SELECT o_custkey AS a, o_orderkey + {derive.SHIFT} AS b FROM orders") + ", v AS MATERIALIZED (SELECT DISTINCT src AS id FROM e)"
OP = (
    _edges_sql(f"SELECT l_orderkey AS a, l_partkey + {1000 * derive.SHIFT} AS b FROM lineitem")
    + f", v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT p_partkey + {1000 * derive.SHIFT} FROM part)"
)
CN = (
    _edges_sql(f"SELECT c_custkey AS a, c_nationkey::BIGINT + {derive.SHIFT} AS b FROM customer")
    + f", v AS MATERIALIZED (SELECT c_custkey AS id, c_nationkey::BIGINT AS community FROM customer UNION SELECT c_nationkey + {derive.SHIFT}, c_nationkey::BIGINT FROM customer)"
)
DELTAS = """d AS MATERIALIZED (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'INSERT' END AS op, user_id AS src, event_id % 97 + 1000 AS dst,
  event_id // 100 + 1 AS commit_ts FROM events),
b AS MATERIALIZED (SELECT DISTINCT user_id AS src, event_id % 89 + 1000 AS dst, 0::BIGINT AS commit_ts FROM events)"""


def _merged_sql(log: str = "d") -> str:
    return f"""l AS MATERIALIZED (SELECT src, dst, arg_max(op, seq) AS op, arg_max(commit_ts, seq) AS commit_ts FROM {log} GROUP BY src, dst),
m AS MATERIALIZED (SELECT src, dst, commit_ts FROM b WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.src = b.src AND l.dst = b.dst)
  UNION ALL SELECT src, dst, commit_ts FROM l WHERE op = 'INSERT')"""


#: Vertices of so many edges serve as active sets and subsets: they grow with the tables.
BUSY = 30
BUSY_SQL = f"s AS MATERIALIZED (SELECT src AS id FROM e GROUP BY src HAVING count(*) >= {BUSY})"


def busy(g: Graph) -> DataFrame:
    return topology.giant_vertices(g, BUSY).select("id")


# sources


@query(f"WITH {SP} SELECT src, dst FROM e")
def load_graph(spark, sf_dir):
    return derive.supplier_part(spark, sf_dir).edges


@query(f"WITH r AS (SELECT l_suppkey AS a, l_partkey + {derive.SHIFT} AS b FROM lineitem) SELECT a AS src, b AS dst FROM r UNION ALL SELECT b, a FROM r")
def load_graph_nodedup(spark, sf_dir):
    li = derive.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + derive.SHIFT).alias("dst"))
    return li.union(li.select("dst", "src"))


@query("SELECT event_id AS seq, user_id AS src, event_id % 97 + 1000 AS dst FROM events")
def edge_list_load(spark, sf_dir):
    return derive.event_list(spark, sf_dir)


@query("SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT user_id FROM events UNION SELECT event_id % 97 + 1000 FROM events)) AS vertices, max(greatest(user_id, event_id % 97 + 1000)) AS max_id FROM events")
def edge_list_statistics(spark, sf_dir):
    from meshwork.sources.text import EdgeList

    lst = EdgeList(spark, "events")
    lst.edges = derive.event_list(spark, sf_dir)
    return lst.statistics()


@query("WITH r AS (SELECT user_id AS a, event_id % 97 + 1000 AS b FROM events WHERE user_id <> event_id % 97 + 1000) SELECT DISTINCT a AS src, b AS dst FROM (SELECT a, b FROM r UNION ALL SELECT b, a FROM r)", name="symmetrize")
def symmetrize_query(spark, sf_dir):
    return symmetrize(derive.event_list(spark, sf_dir))


# scans


@query(f"WITH {SP} SELECT sum(src + 2 * dst)::BIGINT AS total FROM e")
def edge_scan_sum(spark, sf_dir):
    return topology.edge_scan(graph(spark, sf_dir, "supplier_part"), F.col("src") + 2 * F.col("dst"))


@query(f"WITH {SP}, {BUSY_SQL} SELECT sum(dst)::BIGINT AS total FROM e WHERE src IN (SELECT id FROM s)")
def edge_scan_active(spark, sf_dir):
    g = graph(spark, sf_dir, "supplier_part")
    return topology.edge_scan(g, F.col("dst"), busy(g))


@query(f"WITH {SP}, {BUSY_SQL} SELECT dst AS id, min(src) AS value FROM e WHERE src IN (SELECT id FROM s) AND dst NOT IN (SELECT id FROM s) GROUP BY dst")
def edge_map(spark, sf_dir):
    g = graph(spark, sf_dir, "supplier_part")
    state = topology.degree(g)
    return frontier.edge_map(g, frontier.VertexSubset(busy(g)), F.min("message"), state=state, cond=F.col("degree") < BUSY)


@query(f"WITH {SP}, {BUSY_SQL} SELECT id, id IN (SELECT id FROM s) AS active FROM v")
def frontier_to_dense(spark, sf_dir):
    g = graph(spark, sf_dir, "supplier_part")
    return frontier.VertexSubset(busy(g)).to_dense(g)


@query(f"WITH {SP}, {BUSY_SQL} SELECT id, CASE WHEN id IN (SELECT id FROM s) THEN id * 2 ELSE 0 END AS x FROM v")
def vertex_map(spark, sf_dir):
    g = graph(spark, sf_dir, "supplier_part")
    return frontier.vertex_map(frontier.VertexSubset(busy(g)), g.vertices.select("id", F.lit(0).cast("long").alias("x")), F.col("id") * 2, "x")


@query(f"WITH {SP}, {BUSY_SQL} SELECT id FROM s WHERE id > {derive.SHIFT}")
def vertex_filter(spark, sf_dir):
    g = graph(spark, sf_dir, "supplier_part")
    return frontier.vertex_filter(frontier.VertexSubset(busy(g)), g.vertices, F.col("id") > derive.SHIFT).rows


@query("SELECT event_id, user_id, (coalesce(sum(user_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS prefix, (sum(user_id) OVER ())::BIGINT AS total FROM events")
def prefix_scan(spark, sf_dir):
    return frontier.prefix_scan(derive.read(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", "user_id")


# reads


@query(f"WITH {SP} SELECT dst FROM e WHERE src = 7")
def neighbors(spark, sf_dir):
    return topology.neighbors(graph(spark, sf_dir, "supplier_part"), 7)


@query(f"WITH {OP} SELECT v.id, count(e.dst) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id")
def degree(spark, sf_dir):
    return topology.degree(graph(spark, sf_dir, "order_part"))


@query(f"WITH {OP} SELECT count(*) AS vertices FROM v")
def vertex_count(spark, sf_dir):
    return graph(spark, sf_dir, "order_part").vertices.agg(F.count(F.lit(1)).alias("vertices"))


@query(f"WITH {OP} SELECT count(*) AS edges FROM e")
def edge_count(spark, sf_dir):
    return graph(spark, sf_dir, "order_part").edges.agg(F.count(F.lit(1)).alias("edges"))


@query(f"WITH {OP} SELECT v.id, coalesce(string_agg(e.dst::VARCHAR, ',' ORDER BY e.dst), '') AS neighbors FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id")
def adjacency(spark, sf_dir):
    return topology.adjacency(graph(spark, sf_dir, "order_part")).select("id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query(f"WITH {SP} SELECT src AS id, count(*) AS degree FROM e GROUP BY src HAVING count(*) >= 128")
def giant_vertices(spark, sf_dir):
    return topology.giant_vertices(graph(spark, sf_dir, "supplier_part"))


@query(f"WITH {CN} SELECT id FROM v WHERE community = 3")
def community_members(spark, sf_dir):
    return topology.community_members(graph(spark, sf_dir, "customer_nation"), 3)


@query(f"WITH {CN} SELECT community, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM v GROUP BY community")
def communities(spark, sf_dir):
    return topology.communities(graph(spark, sf_dir, "customer_nation")).select("community", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


# subgraphs


@query(f"WITH {SP} SELECT id FROM v")
def vertex_list(spark, sf_dir):
    return graph(spark, sf_dir, "supplier_part").live()


@query(f"WITH {SP} SELECT (SELECT count(*) FROM v WHERE id = 7) > 0 AS vertex, (SELECT count(*) FROM v WHERE id = -7) > 0 AS no_vertex, (SELECT count(*) FROM e WHERE src = 0 AND dst = (SELECT min(dst) FROM e WHERE src = 0)) > 0 AS edge, (SELECT count(*) FROM e WHERE src = 0 AND dst = 7) > 0 AS no_edge")
def has_vertex_has_edge(spark, sf_dir):
    g = graph(spark, sf_dir, "supplier_part")
    first = topology.neighbors(g, 0).first()
    found = topology.has_vertex(g, 7), topology.has_vertex(g, -7), first is not None and topology.has_edge(g, 0, first[0]), topology.has_edge(g, 0, 7)
    return spark.createDataFrame([found], "vertex boolean, no_vertex boolean, edge boolean, no_edge boolean")


@query(f"WITH {SP}, {BUSY_SQL} SELECT src, dst FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)")
def induced_subgraph(spark, sf_dir):
    g = graph(spark, sf_dir, "supplier_part")
    return topology.induced_subgraph(g, busy(g)).edges


@query(f"WITH {SP}, {BUSY_SQL} SELECT s.id, coalesce(string_agg(e.dst::VARCHAR, ',' ORDER BY e.dst), '') AS neighbors FROM s LEFT JOIN e ON e.src = s.id GROUP BY s.id")
def induced_subgraph_map(spark, sf_dir):
    g = graph(spark, sf_dir, "supplier_part")
    return topology.induced_map(g, busy(g)).select("id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query(f"WITH {CN} SELECT a.community, e.src, e.dst FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst WHERE a.community = b.community")
def community_subgraph(spark, sf_dir):
    return topology.within_communities(graph(spark, sf_dir, "customer_nation"))


@query(f"WITH {SP} SELECT DISTINCT src % 16 AS src_block, dst % 16 AS dst_block FROM e WHERE src % 16 <> dst % 16")
def block_adjacency(spark, sf_dir):
    g = graph(spark, sf_dir, "supplier_part")
    return topology.block_adjacency(g.edges, g.vertices.select("id", (F.col("id") % 16).alias("block")))


@query()
def block_tree(spark, sf_dir):
    """Tests hold it against a walk of the same rule in plain Python."""
    g = graph(spark, sf_dir, "supplier_part")
    return block_index.build(g.edges, g.vertices.select("id", (F.col("id") % 64).alias("block"))).tree


@query(f"WITH {SP}, {BUSY_SQL}, q AS (SELECT DISTINCT src % 64 AS a, dst % 64 AS b FROM e WHERE src % 64 <> dst % 64) SELECT a AS block, string_agg(b::VARCHAR, ',' ORDER BY b) AS neighbors FROM q GROUP BY a")
def neighbor_blocks(spark, sf_dir):
    g = graph(spark, sf_dir, "supplier_part")
    index = block_index.build(g.edges, g.vertices.select("id", (F.col("id") % 64).alias("block")))
    return index.block_adjacency(0).select("block", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


# search


@query(f"WITH RECURSIVE {SP}, t(v, l) USING KEY (v) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT e.dst, min(t.l) + 1 FROM t JOIN e ON e.src = t.v LEFT JOIN recurring.t r ON r.v = e.dst WHERE r.v IS NULL GROUP BY e.dst) SELECT v AS id, l AS level FROM t")
def bfs_levels(spark, sf_dir):
    return traversal.bfs_levels(graph(spark, sf_dir, "supplier_part"), 0)


@query(f"WITH RECURSIVE {SP}, t(v, l) USING KEY (v) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT e.dst, min(t.l) + 1 FROM t JOIN e ON e.src = t.v LEFT JOIN recurring.t r ON r.v = e.dst WHERE r.v IS NULL GROUP BY e.dst) SELECT l AS level, count(*) AS vertices FROM t GROUP BY l")
def bfs_level_sizes(spark, sf_dir):
    return traversal.level_sizes(traversal.bfs_levels(graph(spark, sf_dir, "supplier_part"), 0))


#: The order in which a queue visits: within a level by the first-visited neighbour before, then by id.
_VISIT = """t(v, l, o) USING KEY (v) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT UNION SELECT dst, l + 1, row_number() OVER (ORDER BY p, dst) FROM
  (SELECT e.dst, min(t.l) AS l, min(t.o) AS p FROM t JOIN e ON e.src = t.v LEFT JOIN recurring.t r ON r.v = e.dst WHERE r.v IS NULL GROUP BY e.dst)),
o AS MATERIALIZED (SELECT v AS id, l AS level, row_number() OVER (ORDER BY l, o) - 1 AS pos FROM t)"""


@query(f"WITH RECURSIVE {SP}, {_VISIT} SELECT id, level, pos AS visit_order FROM o")
def bfs_sequential(spark, sf_dir):
    return traversal.bfs_visit_order(graph(spark, sf_dir, "supplier_part"), 0)


_INNER = """k AS MATERIALIZED (SELECT src, dst FROM e WHERE src % 16 = dst % 16),
t(v, l) USING KEY (v) AS (SELECT {roots} UNION SELECT k.dst, min(t.l) + 1 FROM t JOIN k ON k.src = t.v LEFT JOIN recurring.t r ON r.v = k.dst WHERE r.v IS NULL GROUP BY k.dst)"""


@query(f"WITH RECURSIVE {SP}, {_INNER.format(roots='0::BIGINT, 0::BIGINT')} SELECT v AS id, l AS level FROM t")
def bfs_block(spark, sf_dir):
    """The whole search within the block of vertex 0."""
    g = graph(spark, sf_dir, "supplier_part")
    return traversal.bfs_in_block(g, g.vertices.select("id", (F.col("id") % 16).alias("block")), 0)


@query(f"WITH RECURSIVE {SP}, {_INNER.format(roots='min(id), 0::BIGINT FROM v GROUP BY id % 16')} SELECT v AS id, v % 16 AS block, l AS level FROM t")
def bfs_blocks(spark, sf_dir):
    """A search in every block, each from its smallest vertex."""
    g = graph(spark, sf_dir, "supplier_part")
    return traversal.bfs_in_blocks(g, g.vertices.select("id", (F.col("id") % 16).alias("block")))


# components, ranks, communities

_WCC = "w(v, c) USING KEY (v) AS (SELECT id, id FROM v UNION SELECT e.dst, min(w.c) FROM w JOIN e ON e.src = w.v JOIN recurring.w r ON r.v = e.dst GROUP BY e.dst, r.c HAVING min(w.c) < r.c)"


@query(f"WITH RECURSIVE {OP}, {_WCC} SELECT v AS id, c AS label FROM w")
def wcc(spark, sf_dir):
    return analytics.wcc(graph(spark, sf_dir, "order_part"))


@query(f"WITH RECURSIVE {OP}, {_WCC} SELECT v AS id, dense_rank() OVER (ORDER BY c) - 1 AS label FROM w")
def wcc_sequential(spark, sf_dir):
    return analytics.wcc_ordinal(graph(spark, sf_dir, "order_part"))


@query(f"WITH RECURSIVE {CO}, {_WCC} SELECT v AS id, c AS label FROM w")
def wcc_many_components(spark, sf_dir):
    return analytics.wcc(graph(spark, sf_dir, "customer_order"))


@query(f"WITH RECURSIVE {CO}, {_WCC} SELECT c AS label, count(*) AS size FROM w GROUP BY c")
def component_sizes(spark, sf_dir):
    return analytics.component_sizes(analytics.wcc(graph(spark, sf_dir, "customer_order")))


_SCAN = """s(i, id, c) AS (SELECT 0, id, id FROM v UNION ALL SELECT q.i + 1, q.id, least(q.c, coalesce(t.c, q.c)) FROM s q
  LEFT JOIN (SELECT e.dst, min(x.c) AS c FROM s x JOIN e ON e.src = x.id GROUP BY e.dst) t ON t.dst = q.id WHERE q.i < 3)"""


@query(f"WITH RECURSIVE {OP}, {_SCAN} SELECT id, c AS label FROM s WHERE i = 3")
def cdlp_scan(spark, sf_dir):
    return analytics.wcc_scan(graph(spark, sf_dir, "order_part"), 3)


def _pagerank_sql(lost: str, of: str = OP) -> str:
    return f"""WITH RECURSIVE {of}, n AS (SELECT count(*)::DOUBLE AS n FROM v), dg AS (SELECT v.id, count(e.dst) AS d FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id),
r(i, id, r) AS (SELECT 0, id, 1 / (SELECT n FROM n) FROM v UNION ALL
  SELECT q.i + 1, q.id, 0.15 / (SELECT n FROM n) + 0.85 * coalesce(s.s, 0) + 0.85 * q.lost / (SELECT n FROM n)
  FROM (SELECT r.i, r.id, {lost} AS lost FROM r JOIN dg USING (id) WHERE r.i < 5) q
  LEFT JOIN (SELECT e.dst, sum(r.r / dg.d) AS s FROM r JOIN dg USING (id) JOIN e ON e.src = r.id GROUP BY e.dst) s ON s.dst = q.id)
SELECT id, round(r, 9) AS rank FROM r WHERE i = 5"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql("0.0::DOUBLE"))
def pagerank_map(spark, sf_dir):
    return _rounded(analytics.pagerank_map(graph(spark, sf_dir, "order_part"), 5, epsilon=None))


@query(_pagerank_sql("sum(CASE WHEN dg.d = 0 THEN r.r ELSE 0 END) OVER ()"))
def pagerank(spark, sf_dir):
    return _rounded(analytics.pagerank(graph(spark, sf_dir, "order_part"), 5, epsilon=None))


@query(f"""WITH RECURSIVE {OP}, dg AS (SELECT v.id, count(e.dst) AS d FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id),
r(i, id, r) AS (SELECT 0, id, CASE WHEN d > 0 THEN 1.0::DOUBLE / d ELSE 0 END FROM dg UNION ALL
  SELECT q.i + 1, q.id, CASE WHEN q.i = 4 THEN 0.15 + 0.85 * coalesce(s.s, 0) WHEN q.d > 0 THEN (0.15 + 0.85 * coalesce(s.s, 0)) / q.d ELSE q.r END
  FROM (SELECT r.i, r.id, r.r, dg.d FROM r JOIN dg USING (id) WHERE r.i < 5) q
  LEFT JOIN (SELECT e.dst, sum(r.r) AS s FROM r JOIN e ON e.src = r.id GROUP BY e.dst) s ON s.dst = q.id)
SELECT id, round(r, 7) AS rank FROM r WHERE i = 5""")
def pagerank_scan(spark, sf_dir):
    return analytics.pagerank_scan(graph(spark, sf_dir, "order_part"), 5).select("id", F.round("rank", 7).alias("rank"))


@query(_pagerank_sql("0.0::DOUBLE", SP))
def pagerank_map_supplier_part(spark, sf_dir):
    return _rounded(analytics.pagerank_map(graph(spark, sf_dir, "supplier_part"), 5, epsilon=None))


@query(_pagerank_sql("sum(CASE WHEN dg.d = 0 THEN r.r ELSE 0 END) OVER ()", SP))
def pagerank_supplier_part(spark, sf_dir):
    return _rounded(analytics.pagerank(graph(spark, sf_dir, "supplier_part"), 5, epsilon=None))


_CDLP = """lp(i, id, l) AS (SELECT 0, id, id FROM v UNION ALL SELECT lp.i + 1, lp.id, coalesce(t.l, lp.l) FROM lp
  LEFT JOIN (SELECT e.dst, q.l, row_number() OVER (PARTITION BY e.dst ORDER BY count(*) DESC, q.l) AS rn FROM lp q JOIN e ON e.src = q.id GROUP BY e.dst, q.l) t
  ON t.dst = lp.id AND t.rn = 1 WHERE lp.i < 5)"""


@query(f"WITH RECURSIVE {OP}, {_CDLP} SELECT id, l AS label FROM lp WHERE i = 5")
def cdlp(spark, sf_dir):
    return analytics.cdlp(graph(spark, sf_dir, "order_part"), 5)


@query(f"WITH RECURSIVE {SP}, {_CDLP} SELECT id, l AS label FROM lp WHERE i = 5")
def cdlp_voting(spark, sf_dir):
    return analytics.cdlp(graph(spark, sf_dir, "supplier_part"), 5)


@query("SELECT user_id, label FROM (SELECT user_id, event_id % 7 AS label, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_id % 7) AS rn FROM events GROUP BY user_id, event_id % 7) WHERE rn = 1")
def most_frequent_label(spark, sf_dir):
    votes = derive.read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 7).alias("label"))
    return analytics.most_frequent(votes, "user_id", "label")


# statistics and distributions

_DEGREES = "g AS (SELECT v.id, count(e.dst) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)"


@query(f"WITH {OP}, {_DEGREES} SELECT count(*) AS vertices, sum(degree)::BIGINT AS edges, round(avg(degree), 9) AS avg_degree, min(degree) AS min_degree, max(degree) AS max_degree FROM g")
def graph_statistics(spark, sf_dir):
    return topology.graph_statistics(graph(spark, sf_dir, "order_part")).withColumn("avg_degree", F.round("avg_degree", 9))


@query(f"WITH {CN}, c AS (SELECT community, count(*) AS size FROM v GROUP BY community) SELECT count(*) AS communities, round(avg(size), 9) AS avg_size, min(size) AS min_size, max(size) AS max_size FROM c")
def community_statistics(spark, sf_dir):
    return topology.community_statistics(graph(spark, sf_dir, "customer_nation")).withColumn("avg_size", F.round("avg_size", 9))


@query(f"WITH {CN}, c AS (SELECT community, count(*) AS size FROM v GROUP BY community) SELECT size, count(*) AS communities FROM c GROUP BY size")
def community_size_histogram(spark, sf_dir):
    return topology.community_size_histogram(graph(spark, sf_dir, "customer_nation"))


def _dist_sql(edges: str, step: int, name: str) -> str:
    return f"""{name} AS (SELECT degree // {step} * {step} AS range_start, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM {edges}) AS percentage FROM {edges} GROUP BY 1)"""


@query(f"WITH {OP}, {_DEGREES}, {_dist_sql('g', 2, 'x')} SELECT range_start, round(percentage, 9) AS percentage FROM x")
def degree_distribution(spark, sf_dir):
    return distribution.degree_distribution(graph(spark, sf_dir, "order_part"), 2).withColumn("percentage", F.round("percentage", 9))


@query(f"WITH {OP}, {_DEGREES}, {_dist_sql('g', 2, 'x')}, k AS (SELECT * FROM x WHERE range_start > 0) SELECT range_start, round(percentage / sum(percentage) OVER () * 100, 9) AS percentage FROM k")
def normalize_distribution(spark, sf_dir):
    d = distribution.degree_distribution(graph(spark, sf_dir, "order_part"), 2).where("range_start > 0")
    return distribution.normalize(d).withColumn("percentage", F.round("percentage", 9))


_RESAMPLE = """c AS (SELECT range_start AS a, range_start + 10 AS b, percentage, unnest(range(range_start // 4, (range_start + 9) // 4 + 1)) * 4 AS t FROM x),
z AS (SELECT t AS range_start, sum(percentage * (least(b, t + 4) - greatest(a, t)) / 10.0::DOUBLE) AS percentage FROM c GROUP BY t HAVING sum(percentage * (least(b, t + 4) - greatest(a, t))) > 0)"""


@query(f"WITH {SP}, {_DEGREES}, {_dist_sql('g', 10, 'x')}, {_RESAMPLE} SELECT range_start, round(percentage, 9) AS percentage FROM z")
def resample_distribution(spark, sf_dir):
    d = distribution.degree_distribution(graph(spark, sf_dir, "supplier_part"), 10)
    return distribution.resample(d, 10, 4).withColumn("percentage", F.round("percentage", 9))


def _kl_sql(direction: str) -> str:
    return f"""WITH {OP}, {_DEGREES}, {_dist_sql('g', 1, 'x')},
ep AS MATERIALIZED (SELECT DISTINCT o_custkey AS a, o_orderkey + {derive.SHIFT} AS b FROM orders), ee AS (SELECT a AS src FROM ep UNION ALL SELECT b FROM ep),
h AS (SELECT src AS id, count(*) AS degree FROM ee GROUP BY src), {_dist_sql('h', 1, 'y')},
u AS (SELECT coalesce(x.percentage / 100, 1e-10) AS p, coalesce(y.percentage / 100, 1e-10) AS q FROM x FULL JOIN y USING (range_start))
SELECT round({direction}, 9) AS kl FROM u"""


def _two(spark, sf_dir):
    return [distribution.degree_distribution(graph(spark, sf_dir, g), 1) for g in ("order_part", "customer_order")]


@query(_kl_sql("sum(p * ln(p / q))"))
def kl_divergence(spark, sf_dir):
    return distribution.kl_table(*_two(spark, sf_dir), 1, 1).select(F.round("kl", 9).alias("kl"))


@query(_kl_sql("(sum(p * ln(p / q)) + sum(q * ln(q / p))) / 2"))
def symmetric_kl_divergence(spark, sf_dir):
    p, q = _two(spark, sf_dir)
    both = distribution.kl_table(p, q, 1, 1).union(distribution.kl_table(q, p, 1, 1))
    return both.agg(F.round(F.sum("kl") / 2, 9).alias("kl"))


@query(f"WITH {SP}, g AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src), o AS (SELECT id, row_number() OVER (ORDER BY degree DESC, id) - 1 AS pos FROM g) SELECT round(avg(abs(a.pos - b.pos)), 6) AS locality FROM e JOIN o a ON a.id = e.src JOIN o b ON b.id = e.dst WHERE e.src < e.dst")
def locality_score(spark, sf_dir):
    g = graph(spark, sf_dir, "supplier_part")
    return topology.locality_score(g, layout.degree_order(g)).select(F.round("locality", 6).alias("locality"))


# orders, partitions, samples


@query(f"WITH {SP}, g AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src) SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) - 1 AS pos FROM g")
def degree_order(spark, sf_dir):
    return layout.degree_order(graph(spark, sf_dir, "supplier_part"))


@query(f"WITH {SP}, {BUSY_SQL}, g AS (SELECT s.id, count(x.dst) AS degree FROM s LEFT JOIN (SELECT e.src, e.dst FROM e JOIN s ON s.id = e.dst) x ON x.src = s.id GROUP BY s.id) SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) - 1 AS pos FROM g")
def internal_degree_order(spark, sf_dir):
    g = graph(spark, sf_dir, "supplier_part")
    return layout.internal_degree_order(g, busy(g))


@query(f"""WITH RECURSIVE {OP}, {_WCC}, first AS MATERIALIZED (SELECT v.id FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id ORDER BY count(e.dst) DESC, v.id LIMIT 1),
roots AS MATERIALIZED (SELECT CASE WHEN c = (SELECT c FROM w WHERE v = (SELECT id FROM first)) THEN (SELECT id FROM first) ELSE c END AS root, c FROM (SELECT DISTINCT c FROM w)),
t(v, l, o) USING KEY (v) AS (SELECT root, 0::BIGINT, root FROM roots UNION SELECT dst, l + 1, row_number() OVER (ORDER BY p, dst) FROM
  (SELECT e.dst, min(t.l) AS l, min(t.o) AS p FROM t JOIN e ON e.src = t.v LEFT JOIN recurring.t r ON r.v = e.dst WHERE r.v IS NULL GROUP BY e.dst))
SELECT t.v AS id, row_number() OVER (ORDER BY r.root <> (SELECT id FROM first), w.c, t.l, t.o) - 1 AS pos FROM t JOIN w ON w.v = t.v JOIN roots r ON r.c = w.c""")
def bfs_order_csr(spark, sf_dir):
    return layout.bfs_order(graph(spark, sf_dir, "order_part"))


@query(f"WITH {CN} SELECT id, community AS block FROM v")
def native_partition(spark, sf_dir):
    return layout.native_partition(graph(spark, sf_dir, "customer_nation"))


@query(f"WITH {CN}, g AS (SELECT v.id, v.community, count(e.dst) AS d FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id, v.community) SELECT community AS block, count(*) AS vertices, sum(d + 1)::BIGINT AS weight FROM g GROUP BY community")
def block_weight(spark, sf_dir):
    g = graph(spark, sf_dir, "customer_nation")
    return layout.block_weight(g, layout.native_partition(g))


@query(f"WITH {SP}, b AS (SELECT id, id % 50 * 7 AS block FROM v) SELECT id, dense_rank() OVER (ORDER BY block) - 1 AS block FROM b")
def compress_block_ids(spark, sf_dir):
    g = graph(spark, sf_dir, "supplier_part")
    return layout.compress_block_ids(g.vertices.select("id", (F.col("id") % 50 * 7).alias("block")))


#: The search order from the vertex of largest degree, which reaches all of this graph, with degrees.
_ORDERED = _VISIT.replace("SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT", "SELECT id, 0::BIGINT, 0::BIGINT FROM (SELECT src AS id FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)") + """,
g AS MATERIALIZED (SELECT o.id, o.pos, count(e.dst) AS degree FROM o JOIN e ON e.src = o.id GROUP BY o.id, o.pos)"""


@query(f"""WITH RECURSIVE {SP}, {_ORDERED}, x AS (SELECT id, pos, CASE WHEN degree >= 128 THEN 1 ELSE degree + 1 END AS w FROM g),
k AS (SELECT id, (sum(w) OVER (ORDER BY pos) - w) // 2048 AS key FROM x WHERE w <= 2048 UNION ALL SELECT id, (1::BIGINT << 40) + id FROM x WHERE w > 2048)
SELECT id, dense_rank() OVER (ORDER BY key) - 1 AS block FROM k""")
def weight_bounded_partition(spark, sf_dir):
    return layout.weight_bounded_partition(graph(spark, sf_dir, "supplier_part"), 4096)


@query(f"""WITH RECURSIVE {SP}, {_ORDERED}, k AS (SELECT id, pos, (sum(degree + 1) OVER (ORDER BY pos) - degree - 1) * 16 // sum(degree + 1) OVER () AS key FROM g),
d AS (SELECT id, pos, dense_rank() OVER (ORDER BY key) - 1 AS block, count(*) OVER () AS n FROM k)
SELECT id, CASE WHEN max(block) OVER () = 15 THEN block ELSE pos * 16 // n END::BIGINT AS block FROM d""")
def kway_partition(spark, sf_dir):
    return layout.kway_partition(graph(spark, sf_dir, "supplier_part"), 16)


@query(f"WITH {CN}, q AS (SELECT DISTINCT a.community AS a, b.community AS b FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst WHERE a.community <> b.community) SELECT DISTINCT community AS id FROM v")
def block_partition(spark, sf_dir):
    """Every block is in one parent, and no parent has more than eight; the parents themselves are tested in plain Python."""
    g = graph(spark, sf_dir, "customer_nation")
    blocks = layout.native_partition(g)
    ids = blocks.select(F.col("block").alias("id")).distinct()
    quotient = topology.block_adjacency(g.edges, blocks).select(F.col("src_block").alias("src"), F.col("dst_block").alias("dst"))
    parents = layout.block_partition(Graph(vertex_rows(ids), quotient, True), 8)
    small = parents.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n <= 8")
    return parents.join(small, "block", "left_semi").select("id")


@query()
def gorder(spark, sf_dir):
    g = graph(spark, sf_dir, "customer_nation")
    return layout.window_order(g, layout.native_partition(g))


@query()
def graph_sparsification(spark, sf_dir):
    """Tests hold it against the pass over all edges in plain Python."""
    return layout.sparsify(graph(spark, sf_dir, "order_part"), 2)


@query(f"WITH RECURSIVE {SP}, {_VISIT}, s AS MATERIALIZED (SELECT id FROM o WHERE pos < 200) SELECT src, dst FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)")
def sample_bfs(spark, sf_dir):
    return sampling.sample_bfs(graph(spark, sf_dir, "supplier_part"), 0, 200).edges


@query()
def sample_random_walk(spark, sf_dir):
    return sampling.sample_random_walk(graph(spark, sf_dir, "supplier_part"), 0, 60)


@query(f"WITH {CN}, c AS (SELECT id FROM v WHERE community = (SELECT community FROM v WHERE id = 5)) SELECT src, dst FROM e WHERE src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c)")
def sample_page(spark, sf_dir):
    g = graph(spark, sf_dir, "customer_nation")
    return sampling.sample_block(g, layout.native_partition(g), 5).edges


# updates


@query(f"WITH {DELTAS}, {_merged_sql()} SELECT src, dst FROM m")
def apply_deltas(spark, sf_dir):
    return deltas.apply_deltas(derive.event_base(spark, sf_dir), derive.event_deltas(spark, sf_dir))


@query(f"WITH {DELTAS}, {_merged_sql()} SELECT src, dst, commit_ts FROM m")
def apply_deltas_ts(spark, sf_dir):
    return deltas.apply_deltas_ts(derive.event_base(spark, sf_dir), derive.event_deltas(spark, sf_dir))


@query(f"WITH {DELTAS}, {_merged_sql('(SELECT * FROM d WHERE op = ' + chr(39) + 'INSERT' + chr(39) + ')')} SELECT src, dst FROM m")
def insert_edge(spark, sf_dir):
    return deltas.apply_deltas(derive.event_base(spark, sf_dir), derive.event_deltas(spark, sf_dir).where("op = 'INSERT'"))


@query(f"WITH {DELTAS}, {_merged_sql('(SELECT * FROM d WHERE op = ' + chr(39) + 'DELETE' + chr(39) + ')')} SELECT src, dst FROM m")
def delete_edge(spark, sf_dir):
    return deltas.apply_deltas(derive.event_base(spark, sf_dir), derive.event_deltas(spark, sf_dir).where("op = 'DELETE'"))


@query(f"WITH {DELTAS}, {_merged_sql()} SELECT dst FROM m WHERE src = 3")
def neighbors_merged(spark, sf_dir):
    return deltas.neighbors_merged(derive.event_base(spark, sf_dir), derive.event_deltas(spark, sf_dir), 3)


@query(f"WITH {DELTAS}, {_merged_sql('(SELECT * FROM d WHERE commit_ts <= 40)')} SELECT src, dst FROM m")
def snapshot_read(spark, sf_dir):
    return deltas.snapshot_edges(derive.event_base(spark, sf_dir), derive.event_deltas(spark, sf_dir), 40)


@query("SELECT user_id AS src, count(*) AS records FROM events GROUP BY user_id")
def delta_chain_length(spark, sf_dir):
    return deltas.chain_lengths(derive.event_deltas(spark, sf_dir))


@query("""WITH c AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type <> 'click') AS writes, count(*) FILTER (WHERE event_type = 'click') AS reads FROM events GROUP BY user_id),
r AS (SELECT *, writes::DOUBLE / (reads + writes) AS w FROM c)
SELECT id, reads, writes, round(w, 9) AS write_ratio, CASE WHEN reads + writes < 8 THEN 4 WHEN w < 0.1 THEN 1 WHEN w < 0.25 THEN 4 WHEN w < 0.5 THEN 6 WHEN w < 0.75 THEN 12 ELSE 20 END::BIGINT AS threshold,
  CASE WHEN reads + writes < 8 THEN 0 WHEN w < 0.1 THEN 0 WHEN w < 0.25 THEN 1 WHEN w < 0.5 THEN 2 WHEN w < 0.75 THEN 3 ELSE 4 END::BIGINT AS reservation FROM r""")
def update_sketch(spark, sf_dir):
    e = derive.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count_if(F.col("event_type") == "click").alias("reads"), F.count_if(F.col("event_type") != "click").alias("writes"))
    return deltas.update_sketch(e).withColumn("write_ratio", F.round("write_ratio", 9))


@query("""SELECT c_custkey AS id, 'segment' AS key, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS value FROM customer
UNION ALL SELECT c_custkey, 'name', c_name FROM customer WHERE c_custkey % 5 <> 0""")
def vertex_props(spark, sf_dir):
    return properties.current(derive.customer_properties(spark, sf_dir)).select("id", "key", F.col("value").cast("string").alias("value"))


@query("SELECT user_id AS id, event_id % 97 + 1000 AS dst, 'type' AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id, event_id % 97")
def edge_props(spark, sf_dir):
    e = derive.read(spark, sf_dir, "events")
    log = e.select(
        F.col("event_id").alias("seq"), F.lit("edge").alias("kind"), F.col("user_id").alias("id"), (F.col("event_id") % 97 + 1000).alias("dst"),
        F.lit("type").alias("key"), F.col("event_type").cast("binary").alias("value"), F.lit(False).alias("deleted"),
    )
    return properties.current(log).select("id", "dst", "key", F.col("value").cast("string").alias("value"))


# workloads, codec


@query()
def generate_workload(spark, sf_dir):
    return workload.random_workload(spark, 500, 4)


@query("SELECT range AS src, 4 AS edges, 4 AS targets, 0 AS loops FROM range(500)")
def generate_workload_counts(spark, sf_dir):
    """What a workload promises of each source: the number of edges, all to different targets, none to itself."""
    rows = workload.random_workload(spark, 500, 4)
    return rows.groupBy("src").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("dst").alias("targets"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))


@query()
def to_zipfian(spark, sf_dir):
    return workload.to_zipf(derive.event_list(spark, sf_dir), 1.0, 42, 400)


#: Weights 1 / rank; with a cap of 400 the first ``f`` ranks are full, the others share the rest, and the largest remainders get one more.
_ZIPF = """c AS (SELECT count(*) AS e, count(DISTINCT user_id) AS n FROM events), r AS (SELECT unnest(range((SELECT n FROM c))) AS k),
w AS (SELECT k, 1.0::DOUBLE / (k + 1) AS w, sum(1.0::DOUBLE / (k + 1)) OVER (ORDER BY k DESC) AS s FROM r),
f AS (SELECT min(k) AS f FROM w WHERE w / s * ((SELECT e FROM c) - 400 * k) <= 400),
x AS (SELECT k, CASE WHEN k < (SELECT f FROM f) THEN 400.0::DOUBLE ELSE w / (SELECT s FROM w WHERE k = (SELECT f FROM f)) * ((SELECT e FROM c) - 400 * (SELECT f FROM f)) END AS x FROM w),
y AS (SELECT k, x, least(floor(x + 1e-9), 400)::BIGINT AS n FROM x),
z AS (SELECT k, n, row_number() OVER (PARTITION BY n < 400 ORDER BY n - x, k) AS place FROM y)"""


@query(f"WITH {_ZIPF}, q AS (SELECT n + CASE WHEN n < 400 AND place <= (SELECT (SELECT e FROM c) - sum(n) FROM y) THEN 1 ELSE 0 END AS edges FROM z) SELECT edges, count(*) AS sources FROM q WHERE edges > 0 GROUP BY edges")
def to_zipfian_counts(spark, sf_dir):
    """How many sources have how many edges, which is all of a Zipf list that is not random."""
    per = workload.to_zipf(derive.event_list(spark, sf_dir), 1.0, 42, 400).groupBy("src").agg(F.count(F.lit(1)).alias("edges"))
    return per.groupBy("edges").agg(F.count(F.lit(1)).alias("sources"))


@query("SELECT row_number() OVER (ORDER BY user_id, event_id % 97, event_id) - 1 AS seq, user_id AS src, event_id % 97 + 1000 AS dst FROM events")
def apply_sequential(spark, sf_dir):
    return workload.replay_order(derive.event_list(spark, sf_dir), "SEQUENTIAL")


@query("SELECT event_id AS seq, user_id AS src, event_id % 97 + 1000 AS dst FROM events ORDER BY event_id LIMIT 100 OFFSET 50")
def apply_range(spark, sf_dir):
    return workload.replay_range(derive.event_list(spark, sf_dir), 50, 100)


@query(f"WITH {CN} SELECT v.id, coalesce(string_agg(e.dst::VARCHAR, ',' ORDER BY e.dst), '') AS ids, sum(CASE WHEN e.dst IS NULL THEN 0 WHEN e.dst < 64 THEN 1 WHEN e.dst < 16384 THEN 2 WHEN e.dst < 4194304 THEN 3 ELSE 4 END)::BIGINT AS bytes FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id")
def ptv_round_trip(spark, sf_dir):
    lists = topology.adjacency(graph(spark, sf_dir, "customer_nation"))
    coded = lists.select("id", codec.encode_ids(F.col("neighbors")).alias("data"))
    return coded.select("id", F.array_join(codec.decode_ids(F.col("data")).cast("array<string>"), ",").alias("ids"), F.length("data").cast("long").alias("bytes"))


def _round_trip(spark, sf_dir, encode, decode):
    lists = topology.adjacency(graph(spark, sf_dir, "customer_nation"))
    coded = lists.select("id", encode(F.col("neighbors")).alias("data"))
    return coded.select("id", F.array_join(decode(F.col("data")).cast("array<string>"), ",").alias("ids"))


_LISTS_SQL = f"WITH {CN} SELECT v.id, coalesce(string_agg(e.dst::VARCHAR, ',' ORDER BY e.dst), '') AS ids FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id"


@query(_LISTS_SQL)
def gap_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, codec.gap_encode, codec.gap_decode)


@query(_LISTS_SQL)
def frame_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, codec.frame_encode, codec.frame_decode)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
