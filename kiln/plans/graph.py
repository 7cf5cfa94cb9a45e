"""Queries on the graph of entities: names of one question in their order are tied to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators import graph as G
from kiln.plans.base import Tables, query

V = "(SELECT DISTINCT upper(trim(title)) AS name, lower(entity_type) AS type, lang FROM entity_titles)"
R = "(SELECT upper(trim(name)) AS source, upper(trim(lead(name) OVER (PARTITION BY question_id ORDER BY qe_id))) AS target, description FROM (SELECT qe_id, question_id, min(name) AS name, min(description) AS description FROM query_entities GROUP BY 1, 2))"
E = f"(SELECT least(source, target) AS src, greatest(source, target) AS dst, count(*) AS merged FROM {R} WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2)"
P = f"(SELECT src, dst FROM {E} WHERE src <> dst UNION SELECT dst, src FROM {E} WHERE src <> dst)"
N = f"(SELECT name FROM {V} UNION SELECT src FROM {P})"


def relations(t: Tables) -> DataFrame:
    one = t.query_entities.groupBy("qe_id", "question_id").agg(F.min("name").alias("name"), F.min("description").alias("description"))
    w = Window.partitionBy("question_id").orderBy("qe_id")
    return one.select(F.upper(F.trim("name")).alias("source"), F.upper(F.trim(F.lead("name").over(w))).alias("target"), F.lit(1.0).alias("weight"), "description")


def vertices(t: Tables) -> DataFrame:
    return t.entity_titles.select(F.upper(F.trim("title")).alias("name"), F.lower("entity_type").alias("type"), "lang").distinct()


def edges(t: Tables) -> DataFrame:
    return G.build(relations(t))


def names(t: Tables) -> DataFrame:
    return G.complete(vertices(t), edges(t)).select("name").distinct()


@query(f"SELECT src, dst, merged::DOUBLE AS weight, merged FROM {E}")
def edge_merge(t: Tables) -> DataFrame:
    return edges(t).select("src", "dst", "weight", "merged")


@query(f"SELECT name FROM (SELECT src AS name FROM {P}) WHERE name NOT IN (SELECT name FROM {V}) GROUP BY name")
def dangling_endpoints(t: Tables) -> DataFrame:
    return G.complete(vertices(t).withColumn("known", F.lit(1)), edges(t)).filter("known is null").select("name")


@query(f"""
WITH d AS (SELECT n.name, count(p.dst) AS degree FROM {N} n LEFT JOIN {P} p ON p.src = n.name GROUP BY 1)
SELECT count(*) AS n_vertices, (sum(degree) / 2)::BIGINT AS n_edges, round(avg(degree), 6) AS mean_degree, median(degree)::DOUBLE AS median_degree, max(degree) AS max_degree, count(*) FILTER (degree = 1) AS n_leaves, count(*) FILTER (degree = 0) AS n_isolated,
  round(sum(degree) / (count(*) * (count(*) - 1))::DOUBLE, 8) AS density FROM d
""")
def degree_stats(t: Tables) -> DataFrame:
    d = G.degrees(names(t), edges(t))
    n = F.count("*")
    return d.agg(n.alias("n_vertices"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.median("degree").alias("median_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 1).alias("n_leaves"), F.count_if(F.col("degree") == 0).alias("n_isolated"), F.round(F.sum("degree") / (n * (n - 1)), 8).alias("density"))


PT = f"pt AS MATERIALIZED (SELECT DISTINCT src, dst FROM {P})"
COMP = f"r(name, reach) AS (SELECT name, name FROM {N} UNION SELECT r.name, p.dst FROM r JOIN {P} p ON p.src = r.reach), c AS (SELECT name, min(reach) AS component FROM r GROUP BY name)"


@query(f"WITH RECURSIVE {COMP} SELECT name, component FROM c")
def components(t: Tables) -> DataFrame:
    return G.components(names(t), edges(t))


@query(f"""
WITH RECURSIVE {COMP}, e AS (SELECT count(*) AS m FROM {P} WHERE src < dst)
SELECT (SELECT count(*) FROM {N}) AS v, m AS e, (SELECT count(DISTINCT component) FROM c) AS c, m - (SELECT count(*) FROM {N}) + (SELECT count(DISTINCT component) FROM c) AS cyclomatic FROM e
""")
def cyclomatic(t: Tables) -> DataFrame:
    n, e = names(t), edges(t)
    c = G.components(n, e).groupBy("component").agg(F.count("*").alias("v"), F.lit(0).alias("e"), F.lit(1).alias("c"))
    m = G.both(e).filter("src < dst").select(F.lit(0).alias("v"), F.lit(1).alias("e"), F.lit(0).alias("c"))
    s = c.select("v", "e", "c").unionByName(m).agg(*[F.sum(x).alias(x) for x in ("v", "e", "c")])
    return s.select("v", "e", "c", (F.col("e") - F.col("v") + F.col("c")).alias("cyclomatic"))


@query(f"""
WITH RECURSIVE {COMP}, s AS (SELECT component, count(*) AS n FROM c GROUP BY 1)
SELECT count(*) AS n_components, max(n) AS largest, round(max(n) / sum(n)::DOUBLE, 8) AS largest_share, count(*) FILTER (n = 1) AS n_single FROM s
""")
def lcc_share(t: Tables) -> DataFrame:
    s = G.components(names(t), edges(t)).groupBy("component").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("n_components"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 8).alias("largest_share"), F.count_if(F.col("n") == 1).alias("n_single"))


@query(f"SELECT x.src AS a, x.dst AS b, y.dst AS c FROM {P} x JOIN {P} y ON y.src = x.dst JOIN {P} z ON z.src = x.src AND z.dst = y.dst WHERE x.src < x.dst AND y.src < y.dst")
def triangles(t: Tables) -> DataFrame:
    return G.triangles(edges(t))


@query(f"""
WITH tr AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM {P} x JOIN {P} y ON y.src = x.dst JOIN {P} z ON z.src = x.src AND z.dst = y.dst WHERE x.src < x.dst AND y.src < y.dst),
tv AS (SELECT unnest([a, b, c]) AS name FROM tr), tn AS (SELECT name, count(*) AS k FROM tv GROUP BY 1), d AS (SELECT n.name, count(p.dst) AS degree FROM {N} n LEFT JOIN {P} p ON p.src = n.name GROUP BY 1)
SELECT round(avg(CASE WHEN degree > 1 THEN 2.0 * coalesce(k, 0) / (degree * (degree - 1)) ELSE 0 END), 8) AS mean_clustering, count(*) FILTER (k > 0) AS n_in_triangles FROM d LEFT JOIN tn USING (name)
""")
def clustering(t: Tables) -> DataFrame:
    return G.clustering(names(t), edges(t)).agg(F.round(F.avg("clustering"), 8).alias("mean_clustering"), F.count_if(F.col("triangles") > 0).alias("n_in_triangles"))


SEEDS = "('OXIDE FILM', 'SCALE LAYER', 'PEARLITE FRACTION')"


def seeds(t: Tables) -> DataFrame:
    return names(t).filter(F.col("name").isin("OXIDE FILM", "SCALE LAYER", "PEARLITE FRACTION")).select(F.col("name").alias("seed"))


BFS = f"b(seed, name, d) AS (SELECT name, name, 0 FROM {N} WHERE name IN {SEEDS} UNION SELECT b.seed, p.dst, b.d + 1 FROM b JOIN {P} p ON p.src = b.name WHERE b.d < 3), m AS (SELECT seed, name, min(d) AS distance FROM b GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {BFS} SELECT seed, distance::INT AS distance, count(*) AS n FROM m GROUP BY 1, 2")
def bfs_depth_counts(t: Tables) -> DataFrame:
    return G.bfs(edges(t), seeds(t), 3).groupBy("seed", "distance").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {BFS} SELECT a.name AS a, b.name AS b, m.distance::INT AS distance FROM {N} a JOIN {N} b ON a.name IN {SEEDS} LEFT JOIN m ON m.seed = a.name AND m.name = b.name")
def shortest_path_len(t: Tables) -> DataFrame:
    """Three names with every name; null where they are more than 3 edges apart."""
    asked = names(t).select(F.explode(F.array(*[F.lit(x.strip(" '")) for x in SEEDS.strip("()").split(",")])).alias("a"), F.col("name").alias("b"))
    return G.shortest(edges(t), asked.join(seeds(t).select(F.col("seed").alias("a")), "a", "left_semi"), 3)


@query(f"""
WITH RECURSIVE {PT}, b(a, b, d) AS (SELECT DISTINCT upper(trim(name)), upper(trim(name)), 0 FROM query_entities WHERE name IS NOT NULL UNION SELECT b.a, pt.dst, b.d + 1 FROM b JOIN pt ON pt.src = b.b WHERE b.d < 3)
SELECT a, b, min(d)::INT AS distance FROM b GROUP BY 1, 2
""")
def shortest_paths(t: Tables) -> DataFrame:
    """Every queried name to every name at most 3 edges away; shortest_path_len has pairs of three names only."""
    asked = t.query_entities.filter("name is not null").select(F.upper(F.trim("name")).alias("seed")).distinct()
    return G.bfs_many(edges(t), asked, 3).select(F.col("seed").alias("a"), F.col("name").alias("b"), "distance")


@query(f"""
SELECT coalesce(type, 'none') AS type, count(*) AS n FROM {V} GROUP BY 1
""")
def type_hist(t: Tables) -> DataFrame:
    return vertices(t).groupBy(F.coalesce("type", F.lit("none")).alias("type")).agg(F.count("*").alias("n"))


VT = f"(SELECT name, min(type) AS type, min(lang) AS lang FROM {V} GROUP BY 1)"


@query(f"""
SELECT least(coalesce(a.type, 'none'), coalesce(b.type, 'none')) || '-' || greatest(coalesce(a.type, 'none'), coalesce(b.type, 'none')) AS pair, count(*) AS n FROM {E} e LEFT JOIN {VT} a ON a.name = e.src LEFT JOIN {VT} b ON b.name = e.dst GROUP BY 1
""")
def type_pair_hist(t: Tables) -> DataFrame:
    v = vertices(t).groupBy("name").agg(F.min("type").alias("type"))
    e = edges(t).join(v.select(F.col("name").alias("src"), F.coalesce("type", F.lit("none")).alias("x")), "src", "left").join(v.select(F.col("name").alias("dst"), F.coalesce("type", F.lit("none")).alias("y")), "dst", "left")
    x, y = F.coalesce("x", F.lit("none")), F.coalesce("y", F.lit("none"))
    return e.groupBy(F.concat_ws("-", F.least(x, y), F.greatest(x, y)).alias("pair")).agg(F.count("*").alias("n"))


@query(f"""
SELECT count(*) AS n_edges, count(*) FILTER (a.lang <> b.lang) AS n_cross, count(*) FILTER (a.lang IS NULL OR b.lang IS NULL) AS n_unknown FROM {E} e LEFT JOIN {VT} a ON a.name = e.src LEFT JOIN {VT} b ON b.name = e.dst
""")
def cross_language_edges(t: Tables) -> DataFrame:
    v = vertices(t).groupBy("name").agg(F.min("lang").alias("lang"))
    e = edges(t).join(v.select(F.col("name").alias("src"), F.col("lang").alias("x")), "src", "left").join(v.select(F.col("name").alias("dst"), F.col("lang").alias("y")), "dst", "left")
    return e.agg(F.count("*").alias("n_edges"), F.count_if(F.col("x") != F.col("y")).alias("n_cross"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("n_unknown"))


@query(f"""
WITH s AS (SELECT name FROM {VT} WHERE type = 'phase'), x AS (SELECT src IN (FROM s) AS a, dst IN (FROM s) AS b, src, dst FROM {E} WHERE src <> dst)
SELECT (SELECT count(*) FROM s) AS n_members, count(*) FILTER (a AND b) AS internal, count(*) FILTER (a <> b) AS boundary, (SELECT count(*) FROM s WHERE name NOT IN (SELECT src FROM {P})) AS isolated FROM x
""")
def subgraph_boundary(t: Tables) -> DataFrame:
    s = vertices(t).groupBy("name").agg(F.min("type").alias("type")).filter("type = 'phase'").select("name")
    x = edges(t).filter("src <> dst").join(s.select(F.col("name").alias("src"), F.lit(1).alias("a")), "src", "left").join(s.select(F.col("name").alias("dst"), F.lit(1).alias("b")), "dst", "left")
    zero, one = F.lit(0), F.lit(1)
    inner = x.select(zero.alias("n_members"), (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int").alias("internal"), (F.col("a").isNotNull() != F.col("b").isNotNull()).cast("int").alias("boundary"), zero.alias("isolated"))
    members = G.degrees(s, edges(t)).select(one.alias("n_members"), zero.alias("internal"), zero.alias("boundary"), (F.col("degree") == 0).cast("int").alias("isolated"))
    return members.unionByName(inner).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_members", "internal", "boundary", "isolated")])


@query(f"WITH d AS (SELECT src AS name, count(*) AS degree FROM {P} GROUP BY 1) SELECT name, degree FROM d ORDER BY degree DESC, name LIMIT 10")
def hub_anchors(t: Tables) -> DataFrame:
    return G.degrees(names(t), edges(t)).filter("degree > 0").orderBy(F.desc("degree"), "name").limit(10)


@query(f"""
WITH d AS (SELECT n.name, count(p.dst) AS degree FROM {N} n LEFT JOIN {P} p ON p.src = n.name GROUP BY 1),
k AS (SELECT name, degree, name AS alias FROM d UNION SELECT name, degree, regexp_replace(name, ' [A-Z]{{2}}-[0-9]+$', '') FROM d UNION SELECT name, degree, regexp_replace(name, '(S| ДВА| NEU)$', '') FROM d),
q AS (SELECT DISTINCT upper(trim(name)) AS alias FROM query_entities WHERE qe_id % 50 = 0)
SELECT q.alias, k.name, k.degree, row_number() OVER (PARTITION BY q.alias ORDER BY k.degree DESC, k.name)::INT AS rank FROM q JOIN k ON k.alias = q.alias
""")
def alias_resolve(t: Tables) -> DataFrame:
    d = G.degrees(names(t), edges(t))
    k = d.select("name", "degree", F.explode(F.array_distinct(F.array("name", F.regexp_replace("name", " [A-Z]{2}-[0-9]+$", ""), F.regexp_replace("name", "(S| ДВА| NEU)$", "")))).alias("alias"))
    q = t.query_entities.filter("qe_id % 50 = 0").select(F.upper(F.trim("name")).alias("alias")).distinct()
    return q.join(k, "alias").withColumn("rank", F.row_number().over(Window.partitionBy("alias").orderBy(F.desc("degree"), "name")))


@query(f"""
WITH RECURSIVE {PT}, r(a, b, v) AS (SELECT src, dst, src FROM pt WHERE src < dst UNION SELECT r.a, r.b, pt.dst FROM r JOIN pt ON pt.src = r.v WHERE NOT (pt.src = r.a AND pt.dst = r.b) AND NOT (pt.src = r.b AND pt.dst = r.a))
SELECT src, dst FROM pt WHERE src < dst AND NOT EXISTS (SELECT 1 FROM r WHERE r.a = src AND r.b = dst AND r.v = dst)
""")
def bridges(t: Tables) -> DataFrame:
    return G.bridges(names(t), edges(t))


@query(f"""
WITH RECURSIVE {COMP}, {PT}, f AS (SELECT src AS x, min(dst) AS first FROM pt GROUP BY 1), w(x, v) AS (SELECT x, first FROM f UNION SELECT w.x, pt.dst FROM w JOIN pt ON pt.src = w.v WHERE pt.dst <> w.x)
SELECT DISTINCT c.component, pt.src AS name FROM pt JOIN c ON c.name = pt.src WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.x = pt.src AND w.v = pt.dst)
""")
def articulation_points(t: Tables) -> DataFrame:
    return G.articulation(names(t), edges(t))


@query()
def min_cycle_basis(t: Tables) -> DataFrame:
    return G.cycle_basis(names(t), edges(t)).select("component", "length", F.array_join("members", "|").alias("members"))


@query()
def dfs_depth(t: Tables) -> DataFrame:
    return G.depth_first(names(t), edges(t))


@query(f"""
WITH RECURSIVE {COMP}, {PT}, b(s, v, d) AS (SELECT name, name, 0 FROM {N} UNION SELECT b.s, pt.dst, b.d + 1 FROM b JOIN pt ON pt.src = b.v WHERE b.d < 40), m AS (SELECT s, v, min(d) AS d FROM b GROUP BY 1, 2)
SELECT c.component, count(DISTINCT s)::INT AS size, max(d)::INT AS diameter, round(coalesce(sum(d) / nullif(count(*) FILTER (d > 0), 0), 0)::DOUBLE, 8) AS mean_path FROM m JOIN c ON c.name = m.s GROUP BY 1
""")
def path_lengths(t: Tables) -> DataFrame:
    return G.path_lengths(names(t), edges(t)).withColumn("mean_path", F.round("mean_path", 8))


@query()
def bfs_window(t: Tables) -> DataFrame:
    return G.best_window(edges(t), seeds(t))


@query()
def lifted_edges(t: Tables) -> DataFrame:
    coded = names(t).filter(F.col("name").rlike(r"^[A-Z]{2}-[0-9]+$"))
    return G.lift(edges(t), coded)


@query()
def communities(t: Tables) -> DataFrame:
    return G.communities(names(t), edges(t))
