"""The graph operators as queries over the projected test tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graph import CodeGraph, file_of, short_name
from ..operators import changes, communities, derive, lookup, reach, resolve
from ..schema import CAPABILITIES, CAPABILITY_SCHEMA
from .projection import oracle, project

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a graph as query ``name``, with SQL over ``nodes`` and ``edges``."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(project(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return keep


CHANGED_SQL = "(file_path LIKE 'r1/%' OR file_path LIKE 'part/%/Brand1_.ts')"
SEEDS_SQL = "(SELECT qualified_name q FROM nodes WHERE kind='Class' ORDER BY ord LIMIT 5)"


def changed(g: CodeGraph) -> DataFrame:
    return g.nodes.filter(F.expr(CHANGED_SQL)).select("file_path").distinct()


def seeds(g: CodeGraph, first: int = 0) -> DataFrame:
    """Five classes in order of input, or with ``first`` those after so many."""
    rows = g.nodes.filter("kind = 'Class'").orderBy("ord").limit(5 + first)
    return rows.select("qualified_name") if not first else rows.orderBy(F.desc("ord")).limit(5).select("qualified_name")


DEGREE = "(SELECT q, sum(i) i, sum(o) o FROM (SELECT source_qualified q, 0 i, 1 o FROM edges {w} UNION ALL SELECT target_qualified, 1, 0 FROM edges {w}) x GROUP BY q)"
RANKED = DEGREE.format(w="WHERE kind IN ('CALLS','INHERITS','USES_TYPE')")


@query("rank_symbols", f"SELECT n.qualified_name, n.name, n.kind, n.file_path, CAST(d.i AS BIGINT) in_degree, CAST(d.o AS BIGINT) out_degree, CAST(d.i+d.o AS BIGINT) score FROM {RANKED} d JOIN nodes n ON n.qualified_name=d.q ORDER BY score DESC, in_degree DESC, n.qualified_name LIMIT 20")
def _(g):
    return lookup.rank(g, 20).select("qualified_name", "name", "kind", "file_path", "in_degree", "out_degree", "score")


@query("degrees", f"SELECT q qualified_name, CAST(i AS BIGINT) in_degree, CAST(o AS BIGINT) out_degree FROM {DEGREE.format(w='')} d")
def _(g):
    return lookup.degrees(g)


MOST_CALLED = "(SELECT target_qualified q FROM edges WHERE kind='CALLS' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def most_called(g: CodeGraph) -> str:
    row = g.of_kind("CALLS").groupBy("target_qualified").count().orderBy(F.desc("count"), "target_qualified").first()
    return row[0] if row else ""


for _direction, _here, _there in (("callers", "target", "source"), ("callees", "source", "target")):

    @query(f"{_direction}_of", f"SELECT n.qualified_name, e.line, e.confidence, n.name, n.kind, n.file_path FROM edges e JOIN nodes n ON n.qualified_name=e.{_there}_qualified WHERE e.kind='CALLS' AND e.{_here}_qualified=" + (MOST_CALLED if _direction == "callers" else "(SELECT min(source_qualified) FROM edges WHERE kind='CALLS')"))
    def _(g, d=_direction):
        symbol = most_called(g) if d == "callers" else g.of_kind("CALLS").agg(F.min("source_qualified")).first()[0]
        return lookup.neighbours(g, symbol, d)


@query("context_of", f"""SELECT relation, qualified_name, CAST(degree AS BIGINT) degree, place FROM (SELECT relation, qualified_name, degree, row_number() OVER (PARTITION BY relation ORDER BY degree DESC, qualified_name) place FROM (
 SELECT DISTINCT 'caller' relation, source_qualified qualified_name, i+o degree FROM edges JOIN {DEGREE.format(w='')} d ON d.q=source_qualified WHERE kind='CALLS' AND target_qualified={MOST_CALLED}
 UNION ALL SELECT DISTINCT 'callee', target_qualified, i+o FROM edges JOIN {DEGREE.format(w='')} d ON d.q=target_qualified WHERE kind='CALLS' AND source_qualified={MOST_CALLED}
 UNION ALL SELECT DISTINCT 'uses_type', target_qualified, 0 FROM edges WHERE kind='USES_TYPE' AND source_qualified={MOST_CALLED}
 UNION ALL SELECT DISTINCT 'tested_by', target_qualified, 0 FROM edges WHERE kind='TESTED_BY' AND source_qualified={MOST_CALLED}) a) b WHERE place<=10 OR relation IN ('uses_type','tested_by')""")
def _(g):
    return lookup.context_of(g, most_called(g))


_SHOWN = "SELECT qualified_name, name, kind, file_path, line_start FROM nodes WHERE "


def shown(df: DataFrame) -> DataFrame:
    return df.select("qualified_name", "name", "kind", "file_path", "line_start")


@query("search_glob", _SHOWN + "regexp_matches(lower(name), '^c1.*5$') OR regexp_matches(lower(qualified_name), '^c1.*5$')")
def _(g):
    return shown(lookup.search(g, "C1*5"))


@query("search_regex", _SHOWN + "regexp_matches(name, '^P\\d+7$') OR regexp_matches(qualified_name, '^P\\d+7$')")
def _(g):
    return shown(lookup.search(g, r"/^P\d+7$/"))


@query("search_substring", _SHOWN + "(contains(lower(name), 's1') OR contains(lower(qualified_name), 's1')) AND kind='Class'")
def _(g):
    return shown(lookup.search(g, "s1", kind="Class"))


TESTED = "(SELECT DISTINCT source_qualified q FROM edges WHERE kind='TESTED_BY')"


@query("tested_symbols", "SELECT DISTINCT source_qualified AS name, CASE WHEN contains(source_qualified,'::') THEN 'symbol' ELSE 'file' END AS level FROM edges WHERE kind='TESTED_BY'")
def _(g):
    return lookup.tested_symbols(g)


GAPS = f"SELECT qualified_name, file_path, line_start, line_end FROM nodes WHERE {CHANGED_SQL} AND kind IN ('Function','Method') AND NOT is_test AND qualified_name NOT IN {TESTED} AND file_path NOT IN {TESTED}"


@query("test_gaps", GAPS)
def _(g):
    return lookup.test_gaps(g, changed(g))


DERIVING = "(SELECT DISTINCT source_qualified FROM edges WHERE kind IN ('INHERITS','IMPLEMENTS'))"
SHARE = f"SELECT coalesce(avg(CASE WHEN qualified_name IN {DERIVING} OR regexp_extract(qualified_name, '^(.*::.*)\\.[^.]*$', 1) IN {DERIVING} THEN 1.0 ELSE 0.0 END), 0.0) s FROM nodes WHERE {CHANGED_SQL}"


@query("hierarchy_share", f"SELECT round(s, 6) AS share FROM ({SHARE}) x")
def _(g):
    return lookup.hierarchy_share(g, lookup.in_files(g, changed(g))).select(F.round("share", 6).alias("share"))


@query("inheritance", f"""SELECT n.qualified_name, n.file_path, (SELECT max(target_qualified) FROM edges e WHERE e.kind='INHERITS' AND e.source_qualified=n.qualified_name) AS extends,
 (SELECT count(DISTINCT target_qualified) FROM edges e WHERE e.kind='IMPLEMENTS' AND e.source_qualified=n.qualified_name) AS n_implements, (SELECT count(DISTINCT source_qualified) FROM edges e WHERE e.kind='INHERITS' AND e.target_qualified=n.qualified_name) AS n_children FROM nodes n WHERE kind='Class' AND {CHANGED_SQL}""")
def _(g):
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return lookup.inheritance(g, changed(g)).select("qualified_name", "file_path", "extends", F.greatest(size("implements"), F.lit(0)).alias("n_implements"), F.greatest(size("children"), F.lit(0)).alias("n_children"))


@query("symbols_in_files", _SHOWN + CHANGED_SQL)
def _(g):
    return shown(lookup.in_files(g, changed(g)))


ADJACENT = """adj AS (SELECT f, t, kind, max(conf) conf FROM (
 SELECT e.target_qualified f, e.source_qualified t, 'CALLS' kind, coalesce(e.confidence,1.0) conf FROM edges e LEFT JOIN nodes n ON n.qualified_name=e.target_qualified WHERE e.kind='CALLS' AND coalesce(e.confidence,1.0)>=0.5 AND NOT (coalesce(n.is_exported,true)=false AND split_part(e.source_qualified,'::',1)<>split_part(e.target_qualified,'::',1))
 UNION ALL SELECT target_qualified, source_qualified, 'USES_TYPE', 0.8 FROM edges WHERE kind='USES_TYPE' UNION ALL SELECT target_qualified, source_qualified, 'INHERITS', 0.9 FROM edges WHERE kind='INHERITS'
 UNION ALL SELECT target_qualified, source_qualified, 'IMPORTS', 1.0 FROM edges WHERE kind='IMPORTS') z GROUP BY f, t, kind)"""


def blast_sql(tag: str, start: str) -> str:
    """CTEs that end in ``blast{tag}``: three levels, unrolled."""
    best = "SELECT node, acc, kind, origin FROM (SELECT a.t node, {acc} acc, a.kind, {origin} origin, row_number() OVER (PARTITION BY a.t ORDER BY {acc} DESC, a.kind, {origin}) r FROM {prev} p JOIN adj a ON a.f=p.{at} WHERE a.t NOT IN (SELECT q FROM s0{tag})) x WHERE r=1"
    out = f"s0{tag} AS {start}, l1{tag} AS ({best.format(acc='CAST(a.conf AS DOUBLE)', origin='p.q', prev=f's0{tag}', at='q', tag=tag)}), b1{tag} AS (SELECT node, acc, kind, origin, 1 depth FROM l1{tag})"
    for d in (2, 3):
        prev = "l1" + tag if d == 2 else f"f2{tag}"
        out += f", c{d}{tag} AS ({best.format(acc='CAST(p.acc*a.conf AS DOUBLE)', origin='p.origin', prev=prev, at='node', tag=tag)})"
        out += f", f{d}{tag} AS (SELECT * FROM c{d}{tag} WHERE node NOT IN (SELECT node FROM b{d - 1}{tag}))"
        out += f", b{d}{tag} AS (SELECT b.node, CASE WHEN c.acc>b.acc THEN c.acc ELSE b.acc END acc, CASE WHEN c.acc>b.acc THEN c.kind ELSE b.kind END kind, CASE WHEN c.acc>b.acc THEN c.origin ELSE b.origin END origin, b.depth FROM b{d - 1}{tag} b LEFT JOIN c{d}{tag} c ON c.node=b.node UNION ALL SELECT node, acc, kind, origin, {d} FROM f{d}{tag})"
    return out + f", blast{tag} AS (SELECT node qualified_name, depth, acc confidence, kind, origin FROM b3{tag})"


def with_blast(body: str, *starts: str) -> str:
    return ", " + ADJACENT + ", " + ", ".join(blast_sql(str(k), s) for k, s in enumerate(starts or (SEEDS_SQL,))) + " " + body


@query("blast_radius", with_blast("SELECT qualified_name, depth, round(confidence, 6) AS confidence, kind, origin, CASE WHEN depth=1 AND kind='CALLS' AND origin IN (SELECT min(q) FROM s00) THEN 'contract_breaking' WHEN depth=1 THEN 'behavior_affected' ELSE 'transitive' END AS category FROM blast0"))
def _(g):
    s = seeds(g)
    return reach.blast_radius(g, s, contract_breaking=s.agg(F.min("qualified_name").alias("qualified_name"))).withColumn("confidence", F.round("confidence", 6))


ALL_HIT = "(SELECT qualified_name q FROM blast0 UNION SELECT q FROM s00)"


@query("blast_summary", with_blast(f"SELECT count(*) AS total_functions, count(DISTINCT file_path) AS total_files FROM {ALL_HIT} h LEFT JOIN nodes n ON n.qualified_name=h.q"))
def _(g):
    s = seeds(g)
    return reach.blast_summary(g, s, reach.blast_radius(g, s))


@query("risk_score", with_blast(f"""SELECT floor(br*100+0.5)/100.0 AS blast_radius, floor(tg*100+0.5)/100.0 AS test_gaps, floor(cx*100+0.5)/100.0 AS complexity, floor(ih*100+0.5)/100.0 AS inheritance, floor((0.35*br+0.3*tg+0.2*cx+0.15*ih)*100+0.5)/100.0 AS score,
 CASE WHEN 0.35*br+0.3*tg+0.2*cx+0.15*ih>=0.6 THEN 'HIGH' WHEN 0.35*br+0.3*tg+0.2*cx+0.15*ih>=0.3 THEN 'MEDIUM' ELSE 'LOW' END AS level
 FROM (SELECT least(ln(1.0+(SELECT count(*) FROM {ALL_HIT} h))/ln(21.0), 1.0) br, (SELECT count(*) FROM ({GAPS}) t)*1.0/(SELECT count(*) FROM nodes WHERE {CHANGED_SQL} AND kind IN ('Function','Method') AND NOT is_test) tg,
 least((SELECT avg(complexity) FROM nodes WHERE {CHANGED_SQL} AND kind IN ('Function','Method','Constructor'))/10, 1.0) cx, ({SHARE}) ih) f"""))
def _(g):
    s = seeds(g)
    total = reach.blast_summary(g, s, reach.blast_radius(g, s)).first()["total_functions"]
    return changes.risk_score(g, changed(g), total)


@query("file_risk", f"""SELECT c.file_path, coalesce(d.n, 0) AS dependents, CASE WHEN coalesce(d.n,0)>=10 THEN 'HIGH' WHEN coalesce(d.n,0)>=3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (SELECT DISTINCT file_path FROM nodes WHERE {CHANGED_SQL}) c
 LEFT JOIN (SELECT n.file_path, count(DISTINCT e.source_qualified) n FROM edges e JOIN nodes n ON n.qualified_name=e.target_qualified WHERE e.kind IN ('CALLS','INHERITS','IMPLEMENTS','USES_TYPE') AND (n.file_path LIKE 'r1/%' OR n.file_path LIKE 'part/%/Brand1_.ts') AND NOT (e.file_path LIKE 'r1/%' OR e.file_path LIKE 'part/%/Brand1_.ts') GROUP BY 1) d ON d.file_path=c.file_path""")
def _(g):
    return changes.file_risk(g, changed(g))


SECOND = "(SELECT qualified_name q FROM (SELECT qualified_name, ord FROM nodes WHERE kind='Class' ORDER BY ord LIMIT 8) z ORDER BY ord DESC LIMIT 5)"
OVERLAP = """(SELECT CASE WHEN ca AND cb THEN 'shared_changed' WHEN ba AND cb THEN 'a_impacts_b' WHEN bb AND ca THEN 'b_impacts_a' WHEN ba AND bb THEN 'shared_blast' END relation, q qualified_name FROM (
 SELECT q, q IN (SELECT q FROM s00) ca, q IN (SELECT q FROM s01) cb, q IN (SELECT qualified_name FROM blast0) ba, q IN (SELECT qualified_name FROM blast1) bb FROM (SELECT q FROM s00 UNION SELECT q FROM s01 UNION SELECT qualified_name FROM blast0 UNION SELECT qualified_name FROM blast1) u) v)"""


@query("pr_overlap", with_blast(f"SELECT relation, qualified_name FROM {OVERLAP} o WHERE relation IS NOT NULL", SEEDS_SQL, SECOND))
def _(g):
    return reach.overlap(g, seeds(g), seeds(g, 3))


@query("pr_overlap_level", with_blast(f"SELECT CASE WHEN a>0 THEN 'HIGH' WHEN b+c>0 THEN 'MEDIUM' ELSE 'LOW' END AS level, a AS shared_changed, b AS a_impacts_b, c AS b_impacts_a, d AS shared_blast FROM (SELECT count(*) FILTER (relation='shared_changed') a, count(*) FILTER (relation='a_impacts_b') b, count(*) FILTER (relation='b_impacts_a') c, count(*) FILTER (relation='shared_blast') d FROM {OVERLAP} o) x", SEEDS_SQL, SECOND))
def _(g):
    return reach.overlap_level(reach.overlap(g, seeds(g), seeds(g, 3)))


ENTRIES = "(SELECT qualified_name e, CASE WHEN kind='Test' THEN 'test' ELSE 'http' END ty FROM nodes WHERE kind='Test' OR (kind IN ('Function','Method') AND (lower(name) IN ('get','post','put','delete','patch','handle','handler') OR lower(parent_name) LIKE '%controller')))"
FLOWS = f""", ent AS {ENTRIES}, cl AS (SELECT DISTINCT source_qualified s, target_qualified t FROM edges WHERE kind='CALLS'),
 m1 AS (SELECT DISTINCT e, ty, t node FROM ent JOIN cl ON s=e WHERE t<>e), m2 AS (SELECT DISTINCT e, ty, t node FROM m1 JOIN cl ON s=node WHERE t<>e EXCEPT SELECT * FROM m1),
 mem AS (SELECT e, ty, e node, 0 d FROM ent UNION ALL SELECT e, ty, node, 1 FROM m1 UNION ALL SELECT e, ty, node, 2 FROM m2),
 fl AS (SELECT e entry, ty "type", max(d) AS depth, count(*) node_count, count(DISTINCT file_path) file_count, count(*)*count(DISTINCT file_path) criticality FROM mem LEFT JOIN nodes n ON n.qualified_name=node GROUP BY e, ty) """


def flow_query(name: str, sql: str):
    """Registers a function of a graph and its flow members: ``name`` to the operator's depth, ``name_depth2`` to the two levels of its SQL."""

    def keep(f):
        query(name)(lambda g: f(g, reach.flow_members(g, reach.entry_points(g))))
        query(f"{name}_depth2", sql)(lambda g: f(g, reach.flow_members(g, reach.entry_points(g), 2)))
        return f

    return keep


@flow_query("flows", FLOWS + 'SELECT entry, "type", depth, node_count, file_count, criticality FROM fl')
def _(g, m):
    return reach.flows(g, m)


@flow_query("flow_summary", FLOWS + """SELECT count(*) AS total_flows, count(*) FILTER ("type"='test') AS test_flows, count(*) FILTER ("type"='http') AS http_flows, floor(avg(depth)*10+0.5)/10.0 AS avg_depth, max(criticality) AS max_criticality FROM fl""")
def _(g, m):
    return reach.flow_summary(reach.flows(g, m))


@flow_query("affected_flows", FLOWS + f'SELECT DISTINCT e AS entry, ty AS "type" FROM mem WHERE node IN {SEEDS_SQL} AND node IN (SELECT qualified_name FROM nodes WHERE NOT is_test)')
def _(g, m):
    return reach.affected_flows(g, m, seeds(g))


@flow_query("blast_flow_scores", FLOWS + with_blast("""SELECT b.qualified_name, b.depth, floor(b.confidence*w*100+0.5)/100.0 AS impact_score FROM (SELECT b.qualified_name, b.depth, b.confidence, CASE WHEN h IS NOT NULL THEN least(h*1.0/mx,1.0) WHEN t IS NOT NULL THEN 0.3*least(t*1.0/mx,1.0) ELSE 0.1 END w FROM blast0 b
 LEFT JOIN (SELECT node, max(criticality) FILTER (fl."type"='http') h, max(criticality) FILTER (fl."type"='test') t FROM mem JOIN fl ON fl.entry=mem.e AND fl."type"=mem.ty GROUP BY node) x ON x.node=b.qualified_name CROSS JOIN (SELECT greatest(max(criticality),1) mx FROM fl) y) b"""))
def _(g, m):
    return reach.score_blast(reach.blast_radius(g, seeds(g)), m, reach.flows(g, m)).select("qualified_name", "depth", "impact_score")


PATH_ENDS = "(SELECT min(qualified_name) a FROM nodes WHERE kind='Function'), (SELECT max(qualified_name) z FROM nodes WHERE kind='Class')"


def path_length(g: CodeGraph, **more) -> DataFrame:
    ends = g.nodes.agg(F.min(F.when(F.col("kind") == "Function", F.col("qualified_name"))), F.max(F.when(F.col("kind") == "Class", F.col("qualified_name")))).first()
    return reach.shortest_path(g, ends[0], ends[1], **more).agg((F.count(F.lit(1)) - 1).alias("length"))


@query("shortest_path_length")
def _(g):
    return path_length(g)


@query("shortest_path_length_depth4", f""", ends AS (SELECT a, z FROM {PATH_ENDS.replace('), (', ') p0, (')} p1), cl AS (SELECT DISTINCT source_qualified s, target_qualified t FROM edges WHERE kind='CALLS'),
 walk(node, d) AS (SELECT a, 0 FROM ends UNION SELECT t, d+1 FROM walk JOIN cl ON s=node WHERE d<4) SELECT CAST(coalesce(min(d), -1) AS BIGINT) AS length FROM walk, ends WHERE node=z""")
def _(g):
    return path_length(g, max_depth=4)


DIRS = "(SELECT qualified_name q, language, array_to_string(string_split(file_path,'/')[1:2],'/') c FROM nodes)"


@query("dir_communities", f"""SELECT s.c AS community, s.n AS node_count, CASE WHEN s.n>1 THEN floor(coalesce(i.n,0)*100.0/(s.n*(s.n-1))+0.5)/100.0 ELSE 0.0 END AS cohesion, l.language FROM (SELECT c, count(*) n FROM {DIRS} d GROUP BY c HAVING count(*)>=3) s
 JOIN (SELECT c, language FROM (SELECT c, language, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, language) r FROM {DIRS} d GROUP BY c, language) x WHERE r=1) l ON l.c=s.c
 LEFT JOIN (SELECT a.c, count(*) n FROM edges e JOIN {DIRS} a ON a.q=e.source_qualified JOIN {DIRS} b ON b.q=e.target_qualified WHERE a.c=b.c GROUP BY 1) i ON i.c=s.c""")
def _(g):
    return communities.directory_communities(g)


@query("dir_coupling", f""", dd AS (SELECT * FROM {DIRS} d WHERE c IN (SELECT c FROM {DIRS} d2 GROUP BY c HAVING count(*)>=3)), st AS (SELECT c, count(*) n FROM edges JOIN dd ON q=source_qualified GROUP BY c)
 SELECT p.a, p.b, p.calls, floor(p.calls*100.0/(x.n+y.n)+0.5)/100.0 AS ratio, CASE WHEN p.calls*1.0/(x.n+y.n)>0.3 THEN 'HIGH' WHEN p.calls*1.0/(x.n+y.n)>0.1 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT least(s.c,t.c) a, greatest(s.c,t.c) b, count(*) calls FROM edges e JOIN dd s ON s.q=source_qualified JOIN dd t ON t.q=target_qualified WHERE e.kind='CALLS' AND s.c<>t.c GROUP BY 1,2) p JOIN st x ON x.c=p.a JOIN st y ON y.c=p.b""")
def _(g):
    return communities.directory_coupling(g)


WG = """, e0 AS (SELECT source_qualified a, target_qualified b FROM edges WHERE kind IN ('CALLS','INHERITS','USES_TYPE') AND source_qualified<>target_qualified AND source_qualified IN (SELECT qualified_name FROM nodes) AND target_qualified IN (SELECT qualified_name FROM nodes)),
 wg AS (SELECT a, b, CAST(count(*) AS BIGINT) w FROM (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0) u GROUP BY a, b), ks AS (SELECT a q, CAST(sum(w) AS BIGINT) k, count(*) degree FROM wg GROUP BY a) """


@query("weighted_graph", WG + "SELECT a, b, w FROM wg")
def _(g):
    return communities.weighted_graph(g)


@query("hubs", WG + "SELECT q AS qualified_name, k, degree FROM ks ORDER BY degree DESC, q LIMIT 10")
def _(g):
    return communities.hubs(communities.weighted_graph(g))


def by_directory(g: CodeGraph) -> DataFrame:
    return g.known().select("qualified_name", communities.directory_of("file_path", 2).alias("community"))


@query("bridges", WG + f"SELECT w.a AS qualified_name, count(DISTINCT y.c) AS communities FROM wg w JOIN {DIRS} x ON x.q=w.a JOIN {DIRS} y ON y.q=w.b WHERE x.c<>y.c GROUP BY w.a ORDER BY communities DESC, w.a LIMIT 10")
def _(g):
    return communities.bridges(communities.weighted_graph(g), by_directory(g))


@query("modularity_adjacent", WG + f"SELECT round(sum(w.w - x.k*y.k*1.0/m)/max(m), 6) AS q FROM wg w JOIN ks x ON x.q=w.a JOIN ks y ON y.q=w.b JOIN {DIRS} p ON p.q=w.a JOIN {DIRS} r ON r.q=w.b CROSS JOIN (SELECT sum(k) m FROM ks) t WHERE p.c=r.c")
def _(g):
    return communities.adjacent_modularity(g, by_directory(g)).select(F.round("q", 6).alias("q"))


@query("connected_parts", WG + f""", il AS (SELECT w.a, w.b FROM wg w JOIN {DIRS} p ON p.q=w.a JOIN {DIRS} r ON r.q=w.b WHERE p.c=r.c), reach(n, m) AS (SELECT qualified_name, qualified_name FROM nodes UNION SELECT il.b, r.m FROM reach r JOIN il ON il.a=r.n)
 SELECT n AS qualified_name, min(m) AS part FROM reach GROUP BY n""")
def _(g):
    return communities.connected_parts(communities.weighted_graph(g), by_directory(g))


@query("louvain_communities")
def _(g):
    return communities.topological_communities(g)


@query("subsystem_context", f""", ins AS (SELECT q FROM {DIRS} d WHERE c IN (SELECT c FROM {DIRS} d2 WHERE q IN {SEEDS_SQL})) SELECT DISTINCT 'caller' AS relation, source_qualified AS qualified_name FROM edges WHERE kind='CALLS' AND target_qualified IN (SELECT q FROM ins) AND source_qualified NOT IN (SELECT q FROM ins)
 UNION ALL SELECT DISTINCT 'callee', target_qualified FROM edges WHERE kind='CALLS' AND source_qualified IN (SELECT q FROM ins) AND target_qualified NOT IN (SELECT q FROM ins)""")
def _(g):
    return reach.subsystem_context(g, by_directory(g), seeds(g))


def before(g: CodeGraph) -> CodeGraph:
    """An older state: some symbols not there yet, some with other signatures or bodies, some edges missing."""
    params = F.when(F.col("ord") % 13 == 0, F.concat("params", F.lit(" "))).when(F.col("ord") % 6 == 0, F.lit("(x)")).otherwise(F.col("params"))
    nodes = g.nodes.filter("ord % 11 <> 0").withColumns({"params": params, "content_hash": F.when(F.col("ord") % 5 == 0, F.lit("old")).otherwise(F.col("content_hash"))})
    return CodeGraph(nodes, g.edges.filter("line % 9 <> 0"))


def after(g: CodeGraph) -> CodeGraph:
    return CodeGraph(g.nodes.filter("ord % 17 <> 0"), g.edges.filter("line % 10 <> 0"))


PARAMS_DIFFER = "(ord % 6 = 0 AND ord % 13 <> 0 AND params IS NOT NULL)"


@query("diff_nodes", f"""SELECT qualified_name, CASE WHEN ord%11=0 THEN 'added' WHEN ord%17=0 THEN 'removed' ELSE 'modified' END AS status, CASE WHEN ord%11=0 OR ord%17=0 THEN '' ELSE concat_ws(',', CASE WHEN ord%5=0 THEN 'body' END, CASE WHEN {PARAMS_DIFFER} OR (ord%6=0 AND ord%13<>0 AND params IS NULL) THEN 'params' END) END AS changes
 FROM nodes WHERE {CHANGED_SQL} AND NOT (ord%11=0 AND ord%17=0) AND (ord%11=0 OR ord%17=0 OR ord%5=0 OR (ord%6=0 AND ord%13<>0))""")
def _(g):
    return changes.diff_nodes(before(g), after(g), changed(g)).withColumn("changes", F.array_join("changes", ","))


@query("diff_contracts", f"SELECT qualified_name, 'params' AS field, '(x)' AS old_value, coalesce(params, '()') AS new_value FROM nodes WHERE {CHANGED_SQL} AND ord%11<>0 AND ord%17<>0 AND ord%6=0 AND ord%13<>0")
def _(g):
    return changes.diff_contracts(before(g), after(g), changed(g))


_NEW, _OLD = (f"SELECT DISTINCT kind, source_qualified, target_qualified FROM edges WHERE {CHANGED_SQL} AND line%{k}<>0" for k in (10, 9))


@query("diff_edges", f"SELECT 'added' AS status, * FROM ({_NEW} EXCEPT {_OLD}) x UNION ALL SELECT 'removed', * FROM ({_OLD} EXCEPT {_NEW}) y")
def _(g):
    return changes.diff_edges(before(g), after(g), changed(g))


@query("merge_graph", f"SELECT kind, count(*) AS n FROM (SELECT kind FROM nodes WHERE ord%11<>0 AND NOT {CHANGED_SQL} UNION ALL SELECT kind FROM nodes WHERE ord%17<>0 AND {CHANGED_SQL}) x GROUP BY kind")
def _(g):
    new = CodeGraph(lookup.in_files(after(g), changed(g)), after(g).edges)
    return changes.merge(before(g), new, changed(g)).nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_STORED = "(SELECT file_path, max(file_hash) h FROM nodes WHERE ord%3<>0 GROUP BY 1)"
_CURRENT = "(SELECT file_path, min(file_hash) h FROM nodes WHERE ord%5<>0 AND file_path NOT LIKE 'r2/%' GROUP BY 1)"


def file_tables(g: CodeGraph) -> tuple[DataFrame, DataFrame]:
    stored = g.nodes.filter("ord % 3 <> 0").groupBy("file_path").agg(F.max("file_hash").alias("file_hash"))
    return stored, g.nodes.filter("ord % 5 <> 0 AND NOT file_path LIKE 'r2/%'").groupBy("file_path").agg(F.min("file_hash").alias("file_hash"))


@query("update_classify", f"SELECT coalesce(s.file_path, c.file_path) AS file_path, CASE WHEN s.h IS NULL THEN 'added' WHEN c.h IS NULL THEN 'deleted' WHEN s.h<>c.h THEN 'modified' ELSE 'unchanged' END AS status FROM {_STORED} s FULL OUTER JOIN {_CURRENT} c ON s.file_path=c.file_path")
def _(g):
    return changes.classify_files(*file_tables(g))


@query("status_files", f"SELECT s.file_path, CASE WHEN c.h IS NULL THEN 'deleted' WHEN s.h=c.h THEN 'fresh' ELSE 'stale' END AS status FROM (SELECT file_path, max(file_hash) h FROM nodes GROUP BY 1) s LEFT JOIN {_CURRENT} c ON s.file_path=c.file_path")
def _(g):
    return changes.file_status(g, file_tables(g)[1])


_HUNKS = "(SELECT DISTINCT file_path f, line_start+3 a, line_start%7 n FROM nodes WHERE ord%50=1)"


@query("hunk_overlap", f"SELECT DISTINCT n.qualified_name, n.kind, n.file_path, n.line_start, n.line_end FROM nodes n JOIN {_HUNKS} h ON n.file_path=h.f AND h.n>0 AND n.line_start<=h.a+h.n-1 AND n.line_end>=h.a")
def _(g):
    hunks = g.nodes.filter("ord % 50 = 1").select(F.col("file_path").alias("file"), (F.col("line_start") + 3).alias("new_start"), (F.col("line_start") % 7).alias("new_count")).distinct()
    return changes.hunk_symbols(g, hunks)


def call_sites(g: CodeGraph) -> DataFrame:
    """CALLS edges as call sites: where they stand and the name they call."""
    edges = g.of_kind("CALLS").select(F.xxhash64("source_qualified", "target_qualified", "line").alias("site_id"), "file_path", "line", "target_qualified")
    return edges.join(g.nodes.select(F.col("qualified_name").alias("target_qualified"), F.col("name").alias("call_name"), F.col("parent_name")), "target_qualified")


@query("enclosing_function", """SELECT e.target_qualified, e.file_path, e.line, max_by(n.qualified_name, n.line_start*100000000000 + n.ord) AS source FROM (SELECT * FROM edges WHERE kind='CALLS') e JOIN nodes n ON n.file_path=e.file_path AND n.kind IN ('Function','Method','Test') AND n.line_start<=e.line AND e.line<=n.line_end GROUP BY e.source_qualified, e.target_qualified, e.file_path, e.line
""".replace("max_by(n.qualified_name, n.line_start*100000000000 + n.ord)", "split_part(max(lpad(CAST(n.line_start AS STRING), 6, '0')||'|'||n.qualified_name), '|', 2)"))
def _(g):
    sites = call_sites(g).select("site_id", "target_qualified", "file_path", "line")
    return changes.enclosing_function(g.nodes, sites).select("target_qualified", "file_path", "line", "source")


def resolution_inputs(g: CodeGraph):
    symbols = resolve.symbol_table(g.nodes)
    sites = call_sites(g).select("site_id", F.col("file_path").alias("file"), F.lit("typescript").alias("language"), "call_name", F.when(F.col("line") % 3 == 0, F.col("parent_name")).alias("receiver_type"), F.lit(None).cast("string").alias("di_type"), F.lit(None).cast("string").alias("resolve_in_class"), "line", "target_qualified")
    imported = sites.filter("line % 5 = 0").groupBy("file", F.col("call_name").alias("name")).agg(F.min(file_of("target_qualified")).alias("target_file"))
    noise = g.nodes.sparkSession.createDataFrame([("typescript", "P7"), ("typescript", "S3")], "language string, name string")
    return sites, symbols, imported, noise


_SITES = """, sites AS (SELECT e.source_qualified sq, e.file_path file, e.line, e.target_qualified tq, n.name cn, CASE WHEN e.line%3=0 THEN n.parent_name END rt FROM edges e JOIN nodes n ON n.qualified_name=e.target_qualified WHERE e.kind='CALLS'),
 sym AS (SELECT file_path file, name, qualified_name q, ord FROM nodes WHERE kind IN ('Function','Method','Class','Interface')), ex AS (SELECT file, name, min(q) q FROM sym GROUP BY 1,2 HAVING count(*)=1), st AS (SELECT name, count(*) n, count(DISTINCT file) f FROM sym GROUP BY 1),
 mem AS (SELECT regexp_extract(q, '::([^.:]+)\\.[^.:]+$', 1) ty, name, count(*) n FROM sym WHERE contains(split_part(q,'::',2),'.') GROUP BY 1,2),
 im AS (SELECT file, cn name, min(split_part(tq,'::',1)) tf FROM sites WHERE line%5=0 GROUP BY 1,2),
 res AS (SELECT s.*, CASE WHEN m.n IS NOT NULL THEN 'receiver' WHEN cn IN ('P7','S3') THEN 'noise' WHEN im.tf IS NOT NULL THEN 'import' WHEN x.q IS NOT NULL THEN 'same' WHEN st.n=1 THEN 'unique' WHEN st.n>1 AND st.f < greatest(15, ceil((SELECT count(DISTINCT file) FROM sym)/50.0)) THEN 'ambiguous' WHEN st.n>1 THEN 'too_common' ELSE 'external' END outcome
  FROM sites s LEFT JOIN mem m ON m.ty=s.rt AND m.name=s.cn LEFT JOIN im ON im.file=s.file AND im.name=s.cn LEFT JOIN ex x ON x.file=s.file AND x.name=s.cn LEFT JOIN st ON st.name=s.cn) """


@query("resolve_calls_tiers", _SITES + "SELECT outcome, cn AS call_name, count(*) AS n FROM res GROUP BY 1,2")
def _(g):
    sites, symbols, imported, noise = resolution_inputs(g)
    return resolve.resolve_calls(sites, symbols, imported, noise=noise).groupBy("outcome", "call_name").agg(F.count(F.lit(1)).alias("n"))


@query("tier_distribution", _SITES + "SELECT outcome, count(*) AS n FROM res GROUP BY 1")
def _(g):
    sites, symbols, imported, noise = resolution_inputs(g)
    return resolve.tier_distribution(resolve.resolve_calls(sites, symbols, imported, noise=noise))


_CALLEES = """, w AS (SELECT DISTINCT split_part(e.target_qualified,'::',1) file, n.name callee, n.file_path src FROM edges e JOIN nodes n ON n.qualified_name=e.source_qualified WHERE e.kind='CALLS' AND n.kind='Function'),
 im AS (SELECT file, callee, CASE WHEN length(callee)%2=0 THEN src ELSE 'nowhere.ts' END tf FROM w WHERE length(callee)%2=0 OR callee LIKE '%7'), sym AS (SELECT file_path file, name, qualified_name q FROM nodes WHERE kind IN ('Function','Method','Class','Interface')),
 ex AS (SELECT file, name, min(q) q FROM sym GROUP BY 1,2 HAVING count(*)=1), only1 AS (SELECT name, min(q) q FROM sym GROUP BY 1 HAVING count(*)=1)
 SELECT w.file, w.callee, r.return_type AS type FROM w LEFT JOIN im ON im.file=w.file AND im.callee=w.callee LEFT JOIN ex h ON h.file=w.file AND h.name=w.callee LEFT JOIN ex t ON t.file=im.tf AND t.name=w.callee LEFT JOIN only1 o ON o.name=w.callee
 LEFT JOIN nodes r ON r.qualified_name=coalesce(h.q, t.q, im.tf||'::'||w.callee, o.q)"""


@query("callee_types", _CALLEES)
def _(g):
    calls = g.of_kind("CALLS").select(F.col("source_qualified").alias("qualified_name"), file_of("target_qualified").alias("file"))
    wanted = calls.join(g.nodes.filter("kind = 'Function'").select("qualified_name", F.col("name").alias("callee"), "file_path"), "qualified_name").select("file", "callee", "file_path").distinct()
    known = F.length("callee") % 2 == 0
    imported = wanted.filter(known | F.col("callee").endswith("7")).select("file", F.col("callee").alias("name"), F.when(known, F.col("file_path")).otherwise("nowhere.ts").alias("target_file"))
    return resolve.callee_types(wanted, resolve.symbol_table(g.nodes), imported, resolve.returned_types(g.nodes))


@query("name_stats", ", sym AS (SELECT file_path file, name FROM nodes WHERE kind IN ('Function','Method','Class','Interface')) SELECT name, count(*) AS definitions, count(DISTINCT file) AS files FROM sym GROUP BY name")
def _(g):
    return resolve.name_stats(resolve.symbol_table(g.nodes))


@query("exact_symbols", "SELECT file_path AS file, name, min(qualified_name) AS qualified FROM nodes WHERE kind IN ('Function','Method','Class','Interface') GROUP BY 1,2 HAVING count(*)=1")
def _(g):
    return resolve.exact(resolve.symbol_table(g.nodes))


@query("ambiguous_names", "SELECT name, count(*) AS n, count(DISTINCT file_path) AS files FROM nodes WHERE kind IN ('Function','Method','Class','Interface') GROUP BY 1 HAVING count(*)>1")
def _(g):
    return resolve.name_stats(resolve.symbol_table(g.nodes)).filter("definitions > 1").select("name", F.col("definitions").alias("n"), "files")


@query("derive_contains", "SELECT 'CONTAINS' AS kind, file_path AS source_qualified, qualified_name AS target_qualified, file_path, line_start AS line FROM nodes WHERE kind IN ('Function','Method','Constructor','Class')")
def _(g):
    return derive.contains(g.nodes)


@query("derive_tested_by", "SELECT DISTINCT 'TESTED_BY' AS kind, target_qualified AS source_qualified, file_path AS target_qualified, file_path, 0 AS line FROM edges WHERE kind='CALLS' AND file_path IN (SELECT file_path FROM nodes WHERE kind='Test') AND split_part(target_qualified,'::',1)<>file_path")
def _(g):
    return derive.tested_by_calls(g.of_kind("CALLS").drop("kind"), g.nodes)


@query("derive_imports", "SELECT 'IMPORTS' AS kind, s AS source_qualified, t AS target_qualified, s AS file_path, min(line) AS line FROM (SELECT file_path s, split_part(target_qualified,'::',1) t, line FROM edges WHERE kind='CALLS') x WHERE s<>t GROUP BY s, t")
def _(g):
    calls = g.of_kind("CALLS").select(F.col("file_path").alias("file"), file_of("target_qualified").alias("target"), "line").filter("file <> target")
    return derive.imports(calls)


@query("derive_uses_type", """, ty AS (SELECT file_path f, name, qualified_name q FROM nodes WHERE kind IN ('Class','Interface')), only1 AS (SELECT name, min(q) q FROM ty GROUP BY 1 HAVING count(*)=1),
 nm AS (SELECT DISTINCT qualified_name, file_path, line_start, unnest(regexp_extract_all(concat_ws(' ', params, return_type), '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM nodes WHERE kind IN ('Function','Method'))
 SELECT 'USES_TYPE' AS kind, nm.qualified_name AS source_qualified, coalesce(o.q, u.q) AS target_qualified, nm.file_path, min(nm.line_start) AS line FROM nm LEFT JOIN (SELECT f, name, min(q) q FROM ty GROUP BY 1,2) o ON o.f=nm.file_path AND o.name=nm.name LEFT JOIN only1 u ON u.name=nm.name WHERE coalesce(o.q,u.q) IS NOT NULL GROUP BY 1,2,3,4""")
def _(g):
    none = g.nodes.sparkSession.createDataFrame([], "file string, name string, target_file string")
    return derive.uses_type(g.nodes, none)


_MESSY = "replace(replace(replace(params, '(', '( _'), ', ', ' ,\n  __b: X,_1z: [ _k ], '), ')', ' , )')"


@query("normalize_params", f"""SELECT qualified_name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MESSY}, '\\s+', ' ', 'g'), '([({{\\[,])\\s*_([a-zA-Z])', '\\1\\2', 'g'), ',\\s*([)}}\\]])', '\\1', 'g'), '([({{\\[])\\s+', '\\1', 'g'), '\\s+([)}}\\]])', '\\1', 'g')) AS params FROM nodes WHERE params IS NOT NULL""")
def _(g):
    return g.nodes.filter("params IS NOT NULL").select("qualified_name", S.normalize_params(F.expr(_MESSY)).alias("params"))


@query("qualified_parts", "SELECT qualified_name, split_part(qualified_name,'::',1) AS file, split_part(qualified_name,'::',2) AS short, regexp_extract(qualified_name, '^(.*::.*)\\.[^.]*$', 1) AS owner, sha256(qualified_name) AS hash FROM nodes")
def _(g):
    return g.nodes.select("qualified_name", file_of("qualified_name").alias("file"), short_name("qualified_name").alias("short"), lookup.owner_of("qualified_name").alias("owner"), S.content_hash("qualified_name").alias("hash"))


@query("signatures", "SELECT qualified_name, name || coalesce(params, '()') || CASE WHEN return_type IS NOT NULL THEN ': ' || return_type ELSE '' END AS signature FROM nodes")
def _(g):
    return g.nodes.select("qualified_name", S.signature().alias("signature"))


@query("enriched_functions", f"""SELECT n.qualified_name, (SELECT count(DISTINCT source_qualified) FROM edges e WHERE e.kind='CALLS' AND e.target_qualified=n.qualified_name AND coalesce(confidence,1.0)>=0.5) AS callers, (SELECT count(DISTINCT target_qualified) FROM edges e WHERE e.kind='CALLS' AND e.source_qualified=n.qualified_name) AS callees,
 (n.qualified_name IN {TESTED} OR n.file_path IN {TESTED}) AS tested FROM nodes n WHERE {CHANGED_SQL} AND kind IN ('Function','Method')""")
def _(g):
    return changes.enriched_functions(g, changed(g)).select("qualified_name", "callers", "callees", "tested")


@query("function_risk", f"""SELECT qualified_name, round(0.3*CAST(ord%6=0 AS INT) + 0.25*least(c/10.0, 1.0) + 0.2*CAST(NOT t AS INT) + 0.15*CAST(ord%5=0 AS INT) + 0.1*least((line_end-line_start)/100.0, 1.0), 6) AS risk FROM (SELECT n.qualified_name, n.ord, n.line_start, n.line_end, (SELECT count(DISTINCT source_qualified) FROM edges e WHERE e.kind='CALLS' AND e.target_qualified=n.qualified_name AND coalesce(confidence,1.0)>=0.5) c,
 (n.qualified_name IN {TESTED} OR n.file_path IN {TESTED}) t FROM nodes n WHERE {CHANGED_SQL} AND kind IN ('Function','Method')) x""")
def _(g):
    rows = changes.enriched_functions(g, changed(g)).join(g.nodes.select("qualified_name", "ord"), "qualified_name")
    return rows.select("qualified_name", F.round(changes.function_risk(rows, F.col("ord") % 6 == 0, F.col("ord") % 5 == 0), 6).alias("risk"))


@query("applicable_contracts", f"SELECT qualified_name, 'params' AS field FROM nodes WHERE {CHANGED_SQL} AND ord%11<>0 AND ord%17<>0 AND ord%6=0 AND ord%13<>0")
def _(g):
    capabilities = g.nodes.sparkSession.createDataFrame(CAPABILITIES, CAPABILITY_SCHEMA)
    return changes.applicable_contracts(changes.diff_contracts(before(g), after(g), changed(g)), g.nodes, capabilities).select("qualified_name", "field")


@query("outline", """SELECT n.qualified_name, n.kind, n.file_path, k.owner,
 (SELECT count(*) FROM edges e WHERE e.kind='CALLS' AND e.target_qualified=n.qualified_name) AS fan_in, (SELECT count(*) FROM edges e WHERE e.kind='CALLS' AND e.source_qualified=n.qualified_name) AS fan_out
 FROM nodes n LEFT JOIN (SELECT m.qualified_name q, min_by(c.qualified_name, c.line_start*100000+c.line_end) AS owner, min_by(coalesce(c.is_exported,false), c.line_start*100000+c.line_end) AS shown FROM nodes m JOIN nodes c
  ON c.kind IN ('Class','Interface','Enum') AND m.kind IN ('Method','Constructor') AND c.file_path=m.file_path AND c.name=m.parent_name AND c.line_start<=m.line_start AND m.line_end<=c.line_end GROUP BY 1) k ON k.q=n.qualified_name
 WHERE coalesce(n.is_exported, false) AND coalesce(k.shown, true)""")
def _(g):
    return changes.outline(g, exported_only=True).select("qualified_name", "kind", "file_path", "owner", "fan_in", "fan_out")


@query("changed_imports", f"""SELECT DISTINCT e.file_path, e.target_qualified, e.target_qualified NOT IN (SELECT target_qualified FROM edges o WHERE o.kind='IMPORTS' AND o.line%9<>0 AND o.file_path=e.file_path) AS is_new, e.target_qualified NOT IN (SELECT split_part(qualified_name,'::',1) FROM nodes) AS unresolved FROM edges e WHERE kind='IMPORTS' AND {CHANGED_SQL}""")
def _(g):
    return lookup.changed_imports(g, changed(g), before(g))


def _over(table: str):
    def keep(name: str, sql: str):
        def inner(f):
            QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
            ORACLES[name] = sql
            return f

        return inner

    return keep


@_over("documents")("content_hashes", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(d):
    return d.select("doc_id", S.content_hash("text").alias("hash"))


@_over("pages")("url_identifiers", "SELECT page_id, list_aggregate(list_sort(list_distinct(regexp_extract_all(url, '[A-Za-z_$][A-Za-z0-9_$]*'))), 'string_agg', ',') AS ids FROM pages")
def _(d):
    return d.select("page_id", F.array_join(F.array_sort(S.identifiers("url")), ",").alias("ids"))


@_over("events")("event_transitions", "SELECT a, b, count(*) AS w FROM (SELECT event_type a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events) x WHERE b IS NOT NULL GROUP BY a, b")
def _(d):
    from pyspark.sql.window import Window

    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return d.select(F.col("event_type").alias("a"), nxt.alias("b")).filter("b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rank_symbols"](spark, sf_dir)
