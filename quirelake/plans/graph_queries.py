"""Graph building and pattern queries: customers, nations, parts and suppliers as nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from .registry import Tables, query

C = F.col


def _nodes(t: Tables) -> DataFrame:
    parts = [
        graph.nodes(t.customer, "Document", C("c_custkey"), F.struct("c_name")), graph.nodes(t.nation, "Place", C("n_nationkey"), F.struct("n_name")), graph.nodes(t.region, "Region", C("r_regionkey")),
        graph.nodes(t.supplier, "Person", C("s_suppkey"), F.struct("s_name")), graph.nodes(t.part.select("p_brand").distinct(), "Tag", C("p_brand")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edges(t: Tables) -> DataFrame:
    parts = [
        graph.edges(t.customer, "MENTIONS", ("Document", C("c_custkey")), ("Place", C("c_nationkey"))), graph.edges(t.nation, "IN_REGION", ("Place", C("n_nationkey")), ("Region", C("n_regionkey"))),
        graph.edges(t.supplier, "LIVES_IN", ("Person", C("s_suppkey")), ("Place", C("s_nationkey"))), graph.edges(t.part, "HAS_TAG", ("Part", C("p_partkey")), ("Tag", C("p_brand"))),
        graph.edges(t.lineitem, "SUPPLIED_BY", ("Part", C("l_partkey")), ("Person", C("l_suppkey"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT 'Document' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Place', count(*) FROM nation UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'Person', count(*) FROM supplier UNION ALL SELECT 'Tag', count(DISTINCT p_brand) FROM part""")
def graph_node_counts(t: Tables) -> DataFrame:
    return graph.node_counts(_nodes(t))


@query("""SELECT 'MENTIONS' AS type, count(*) AS n FROM customer UNION ALL SELECT 'IN_REGION', count(*) FROM nation UNION ALL SELECT 'LIVES_IN', count(*) FROM supplier UNION ALL SELECT 'HAS_TAG', count(*) FROM part UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)""")
def graph_edge_counts(t: Tables) -> DataFrame:
    return graph.edge_counts(_edges(t))


@query("""WITH r AS (SELECT DISTINCT o_custkey AS hub, o_orderpriority AS item FROM orders) SELECT x.item AS a, y.item AS b, count(*) AS shared FROM r x JOIN r y ON x.hub = y.hub AND x.item <> y.item GROUP BY ALL""")
def graph_cooccurrence(t: Tables) -> DataFrame:
    return graph.cooccurrence(t.orders, "o_custkey", "o_orderpriority")


@query("""WITH r AS (SELECT DISTINCT s_nationkey AS item, l_partkey AS hub FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT x.item AS a, y.item AS b, count(*) AS shared FROM r x JOIN r y ON x.hub = y.hub AND x.item <> y.item GROUP BY ALL HAVING count(*) >= 2""")
def graph_shared_tags(t: Tables) -> DataFrame:
    pairs = t.lineitem.join(t.supplier, C("l_suppkey") == C("s_suppkey")).select("l_partkey", "s_nationkey")
    return graph.cooccurrence(pairs, "l_partkey", "s_nationkey", least=2)


@query("""WITH e AS (SELECT n_nationkey::VARCHAR AS id, 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation), u AS (SELECT id, a, b FROM e UNION ALL SELECT id, b, a FROM e),
    p1 AS (SELECT a AS s, b AS t, id AS i1 FROM u), p2 AS (SELECT s, b AS t, i1, id AS i2 FROM p1 JOIN u ON p1.t = u.a AND id <> i1), p3 AS (SELECT s, b AS t FROM p2 JOIN u ON p2.t = u.a AND id <> i1 AND id <> i2),
    x AS (SELECT s, t, 1 AS hops FROM p1 UNION ALL SELECT s, t, 2 FROM p2 UNION ALL SELECT s, t, 3 FROM p3) SELECT s AS start, t AS "end", hops, count(*) AS paths FROM x WHERE starts_with(s, 'n') GROUP BY ALL""")
def graph_paths_1_3(t: Tables) -> DataFrame:
    e = t.nation.select(C("n_nationkey").cast("string").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"))
    return graph.paths(e, e.select(C("a").alias("start")).distinct(), 3)


@query("""SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS items FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) >= 2""")
def graph_multi_place(t: Tables) -> DataFrame:
    return graph.having_many(t.orders, "o_custkey", "o_orderpriority")


@query("""SELECT r_name, n_name, count(*) AS documents FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def graph_geo_distribution(t: Tables) -> DataFrame:
    j = t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey")).join(t.region, C("n_regionkey") == C("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("documents"))


@query("""SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND year(o_orderdate) = 1997""")
def graph_language_period(t: Tables) -> DataFrame:
    return t.orders.where(F.year("o_orderdate") == 1997).join(t.customer.where("c_mktsegment = 'BUILDING'"), C("o_custkey") == C("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("""SELECT s_nationkey AS sender, c_nationkey AS receiver, count(*) AS letters FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def graph_correspondence(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.supplier, C("l_suppkey") == C("s_suppkey")).join(t.orders, C("l_orderkey") == C("o_orderkey")).join(t.customer, C("o_custkey") == C("c_custkey"))
    return j.groupBy(C("s_nationkey").alias("sender"), C("c_nationkey").alias("receiver")).agg(F.count("*").alias("letters"))


@query("""SELECT type, src, dst FROM (SELECT 'MENTIONS' AS type, c_custkey::VARCHAR AS src, c_nationkey::VARCHAR AS dst FROM customer WHERE c_nationkey = 3 OR c_custkey = 3 UNION ALL SELECT 'LIVES_IN', s_suppkey::VARCHAR, s_nationkey::VARCHAR FROM supplier WHERE s_nationkey = 3 OR s_suppkey = 3)""")
def graph_neighbourhood(t: Tables) -> DataFrame:
    e = graph.edges(t.customer, "MENTIONS", ("Document", C("c_custkey")), ("Place", C("c_nationkey"))).unionByName(graph.edges(t.supplier, "LIVES_IN", ("Person", C("s_suppkey")), ("Place", C("s_nationkey"))))
    return graph.neighbourhood(e, F.lit("3")).select("type", "src", "dst")


@query("""SELECT DISTINCT p_partkey, word AS item FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE trim(word) <> ''""")
def graph_tag_edges(t: Tables) -> DataFrame:
    return graph.listed(t.part, "p_partkey", "p_name", " ")


@query("""SELECT o_orderkey, s_suppkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""")
def footnotes_join(t: Tables) -> DataFrame:
    notes = t.lineitem.select(C("l_orderkey").alias("document_id"), C("l_suppkey").alias("source"))
    kept = graph.footnotes(notes, t.orders.select(C("o_orderkey").alias("document_id")), t.supplier.select(C("s_suppkey").alias("source")))
    return kept.distinct().select(C("document_id").alias("o_orderkey"), C("source").alias("s_suppkey"))


@query("""SELECT l_orderkey AS fragment, c_custkey AS document FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN customer ON c_custkey = l_partkey""")
def fragments_join(t: Tables) -> DataFrame:
    listed = t.lineitem.select("l_orderkey", F.concat(C("l_partkey"), F.lit("; ;x")).alias("ids"))
    parts = graph.listed(listed, "l_orderkey", "ids", ";").select("l_orderkey", C("item").try_cast("long").alias("id")).where("id is not null")
    return parts.join(t.customer, C("id") == C("c_custkey")).select(C("l_orderkey").alias("fragment"), C("c_custkey").alias("document"))


@query("""SELECT 'Tag' AS label, p_brand AS id, max_by(p_name, p_partkey) AS name FROM part GROUP BY p_brand""")
def graph_merge_nodes(t: Tables) -> DataFrame:
    rows = t.part.select(F.lit("Tag").alias("label"), C("p_brand").alias("id"), C("p_name").alias("name"), "p_partkey")
    return graph.merge_nodes(rows, "p_partkey")
