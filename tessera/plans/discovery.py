"""Queries of the published graph: parts are nodes with facts, orders that they share relate them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import discovery as D
from tessera.sources.stages import stage

from . import graphs
from .registry import Registry
from .shared import t

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

WORLD = f"""{graphs.EDGES}, nd AS (SELECT p_partkey AS id, p_name AS name, p_brand AS kind, p_type AS description, CASE WHEN p_partkey % 10 > 0 THEN p_partkey // 10 * 10 END AS parent FROM part),
    fc AS (SELECT DISTINCT l_partkey AS node, 'flag ' || l_linestatus AS key, l_returnflag AS value FROM lineitem UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part),
    rl AS (SELECT a AS src, b AS dst, 'CO_OCCURS' AS relation, CASE WHEN pages > 1 THEN 'often' ELSE 'once' END AS label FROM e UNION ALL SELECT parent, id, 'PARENT_OF', 'within' FROM nd WHERE parent IS NOT NULL),
    dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM rl UNION ALL SELECT dst FROM rl WHERE src <> dst) GROUP BY id)"""


def world(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    nodes = p.select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.col("p_type").alias("description"), F.when(k % 10 > 0, F.floor(k / 10) * 10).alias("parent"))
    flags = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.concat(F.lit("flag "), "l_linestatus").alias("key"), F.col("l_returnflag").alias("value")).distinct()
    facts = flags.unionByName(p.select(k.alias("node"), F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")))
    # Every use of the relations reads the edges, which are counted once.
    together = stage(graphs.edges(spark, sf_dir), "edges").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("CO_OCCURS").alias("relation"), F.when(F.col("pages") > 1, "often").otherwise("once").alias("label"))
    within = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit("PARENT_OF").alias("relation"), F.lit("within").alias("label"))
    return nodes, facts, together.unionByName(within)


@register(f"""WITH {WORLD}, f AS (SELECT id, name, kind, coalesce(degree, 0) AS degree, CASE WHEN lower(name) = '49' THEN 100 WHEN starts_with(lower(name), '49') THEN 80 WHEN contains(lower(name), '49') THEN 60 ELSE 30 END AS match_score FROM nd LEFT JOIN dg USING (id)
        WHERE contains(lower(name), '49') OR contains(lower(description), '49') OR EXISTS (SELECT 1 FROM fc WHERE node = id AND (contains(lower(key), '49') OR contains(lower(value), '49'))))
    SELECT *, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 15 AS has_more FROM f ORDER BY match_score DESC, degree DESC, name, id LIMIT 10 OFFSET 5""")
def g1_fact_search(spark, sf_dir):
    return D.search(*world(spark, sf_dir), "49", offset=5, limit=10)


@register(f"""WITH {WORLD}, f AS (SELECT id, name, kind, coalesce(degree, 0) AS degree, CASE WHEN parent IS NULL THEN 20 ELSE 0 END AS match_score FROM nd LEFT JOIN dg USING (id) WHERE kind = 'Brand#11')
    SELECT *, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 20 AS has_more FROM f ORDER BY match_score DESC, degree DESC, name, id LIMIT 20""")
def t6_nodes_of_a_kind(spark, sf_dir):
    return D.search(*world(spark, sf_dir), " ", "Brand#11")


OVERVIEW = f"""{WORLD}, s AS (SELECT * FROM nd ORDER BY CASE WHEN parent IS NULL THEN 0 ELSE 1 END, name, id LIMIT 150), ins AS (SELECT rl.*, a.name AS source_name, b.name AS target_name FROM rl JOIN s a ON a.id = src JOIN s b ON b.id = dst)"""


@register(f"""WITH {OVERVIEW}, g AS (SELECT node, list_sort(list(DISTINCT key || '=' || value)) AS x FROM fc GROUP BY node)
    SELECT id, name, kind, coalesce(len(x), 0)::INT AS fact_count, coalesce(array_to_string(x, ';'), '') AS facts, (SELECT count(*) FROM nd) AS total_nodes, (SELECT count(*) FROM rl) AS total_relations, (SELECT count(*) FROM fc) AS total_facts, (SELECT count(*) FROM nd) > 150 AS node_truncated, (SELECT count(*) FROM ins) > 40 AS relation_truncated FROM s LEFT JOIN g ON node = id""")
def g2_domain_overview(spark, sf_dir):
    nodes, _, totals = D.overview(*world(spark, sf_dir), 150, 40)
    facts = F.array_join(F.array_sort(F.transform("facts", lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";")
    return nodes.select("id", "name", "kind", "fact_count", facts.alias("facts")).crossJoin(F.broadcast(totals))


@register(f"WITH {OVERVIEW} SELECT src, source_name, dst, target_name, relation, label FROM ins ORDER BY relation, label, source_name, target_name, src, dst LIMIT 40")
def g2_overview_relations(spark, sf_dir):
    return D.overview(*world(spark, sf_dir), 150, 40)[1]


@register(f"""WITH {WORLD}, i AS (SELECT *, CASE WHEN src = 30 THEN dst ELSE src END AS neighbour FROM rl WHERE src = 30 OR dst = 30), f AS (SELECT i.*, a.name AS source_name, b.name AS target_name, n.name AS neighbour_name, n.kind AS neighbour_kind FROM i JOIN nd a ON a.id = src JOIN nd b ON b.id = dst JOIN nd n ON n.id = neighbour)
    SELECT *, (SELECT count(*) FROM f) AS total_relations, (SELECT count(*) FROM f) > 60 AS truncated FROM f ORDER BY relation, label, source_name, target_name, src, dst LIMIT 60""")
def g3_node_detail(spark, sf_dir):
    nodes, _, relations = world(spark, sf_dir)
    return D.detail(nodes, relations, 30, 60)
