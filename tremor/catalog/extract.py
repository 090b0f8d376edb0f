"""Registered queries of extraction (C) and streaming feeds (S)."""
import uuid

from pyspark.sql import functions as F

from tremor.catalog.core import define, query, using
from tremor.catalog.corpus import _files
from tremor.catalog.evidence import RUN_CALLS, RUN_EDGES
from tremor.operators import extract as E
from tremor.session import shared_folder
from tremor.sources import projection as P
from tremor.streaming import feeds as S

# Every part's file, those in node_modules too: extraction takes the files it is given.
define("srcs", "SELECT concat('repo_', CAST(floor(p_partkey / 20) AS BIGINT)) AS repo, CAST(floor(p_partkey / 20) AS BIGINT) AS no, p_partkey AS k, p_size % 5 AS lang, lower(p_type) AS t, CASE WHEN p_partkey % 20 = 19 THEN 'node_modules/' ELSE '' END AS pre FROM @part")
define("py", "SELECT repo, k, t, concat(pre, 'src/', t, '/mod_', k, '.py') AS path, concat(replace(pre, '/', '.'), 'src.', t, '.mod_', k) AS m FROM srcs WHERE lang = 0", ["srcs"])


@query("C01_python_nodes", using("py") + """SELECT repo, 'file:' || path AS id, 'FILE' AS kind, 1 AS line FROM py UNION ALL SELECT repo, 'module:' || m, 'MODULE', 1 FROM py UNION ALL SELECT repo, concat('class:', m, '.Part', k), 'CLASS', 8 FROM py
  UNION ALL SELECT repo, concat('method:', m, '.Part', k, '.run'), 'METHOD', 9 FROM py UNION ALL SELECT repo, concat('method:', m, '.helper'), 'METHOD', 12 FROM py UNION ALL SELECT repo, concat('call:', m, '.Part', k, '.run:10:helper'), 'CALL_EXPR', 10 FROM py
  UNION ALL SELECT concat('repo_', s_suppkey), unnest(['file:src/tools/__init__.py', 'module:src.tools', 'assignment:src.tools:1:x']), unnest(['FILE', 'MODULE', 'ASSIGNMENT']), 1 FROM @supplier WHERE s_suppkey % 2 = 0""")
def c01(spark, sf):
    return E.fact_nodes(E.extract_python(_files(spark, sf))).select("repo", "id", "kind", "line")


@query("C01_python_edges", using("py") + """SELECT repo, 'file:' || path AS from_id, 'module:' || m AS to_id, 'CONTAINS' AS kind, 1 AS line FROM py UNION ALL SELECT repo, 'module:' || m, concat('class:', m, '.Part', k), 'DECLARES', 8 FROM py
  UNION ALL SELECT repo, concat('class:', m, '.Part', k), concat('method:', m, '.Part', k, '.run'), 'DECLARES', 9 FROM py UNION ALL SELECT repo, 'module:' || m, concat('method:', m, '.helper'), 'DECLARES', 12 FROM py
  UNION ALL SELECT repo, concat('method:', m, '.Part', k, '.run'), concat('call:', m, '.Part', k, '.run:10:helper'), 'CONTAINS', 10 FROM py
  UNION ALL SELECT repo, 'module:' || m, 'module:' || unnest(['os', 'requests', 'numpy.linalg', 'flask.views', 'lib_' || t, 'web']), 'IMPORTS', unnest([1, 2, 2, 3, 5, 6]) FROM py
  UNION ALL SELECT concat('repo_', s_suppkey), unnest(['file:src/tools/__init__.py', 'module:src.tools']), unnest(['module:src.tools', 'assignment:src.tools:1:x']), 'CONTAINS', 1 FROM @supplier WHERE s_suppkey % 2 = 0""")
def c01b(spark, sf):
    return E.fact_edges(E.extract_python(_files(spark, sf))).select("repo", "from_id", "to_id", "kind", "line")


_CTOR = "SELECT concat('r', CAST(floor(p_partkey / 20) AS BIGINT)) AS repo, concat('m', p_partkey, '.py') AS path, concat('from lib import Db', chr(10), 'class A', p_partkey, ':', chr(10), '    def __init__(self, db: Db, n: int, x=1):', chr(10), CASE WHEN p_size = 9 THEN '  bad' ELSE '        self.db = db' END) AS content FROM @part"


@query("C02_propagate_ctor_types", "SELECT concat('r', CAST(floor(p_partkey / 20) AS BIGINT)) AS repo, concat('class:m', p_partkey, '.A', p_partkey) AS class_id, unnest(['db', 'n']) AS param, unnest(['lib.Db', concat('m', p_partkey, '.int')]) AS type FROM @part WHERE p_size <> 9")
def c02(spark, sf):
    return E.propagate_ctor_types(E.extract_python(P.run(spark, sf, _CTOR)))


def _pattern_nodes(spark, sf, *suffixes):
    files = _files(spark, sf).where(F.regexp_extract("path", r"(\.[a-z]+)$", 1).isin(*suffixes))
    return E.fact_nodes(E.extract_patterns(files)).select("repo", "id", "kind", "line")


@query("C03_extract_js", using("srcs") + """, f AS (SELECT repo, k, lang, concat(pre, CASE lang WHEN 1 THEN 'web/part_' ELSE 'app/part_' END, k) AS m, CASE lang WHEN 1 THEN '.ts' ELSE '.js' END AS x FROM srcs WHERE lang IN (1, 2))
  SELECT repo, concat('file:', m, x) AS id, 'FILE' AS kind, 1 AS line FROM f UNION ALL SELECT repo, 'module:' || m, 'MODULE', 1 FROM f UNION ALL SELECT repo, concat('Part', k), 'CLASS', 6 FROM f WHERE lang = 1 UNION ALL SELECT DISTINCT ON (repo) repo, 'helper', 'METHOD', 7 FROM f WHERE lang = 1
  UNION ALL SELECT repo, concat('f', k), 'METHOD', 4 FROM f WHERE lang = 2 UNION ALL SELECT DISTINCT ON (repo) repo, 'g', 'METHOD', 5 FROM f WHERE lang = 2""")
def c03(spark, sf):
    return _pattern_nodes(spark, sf, ".js", ".ts")


@query("C04_extract_go", using("srcs") + """SELECT repo, concat('file:', pre, 'svc/part_', k, '.go') AS id, 'FILE' AS kind, 1 AS line FROM srcs WHERE lang = 3 UNION ALL SELECT DISTINCT repo, 'module:svc', 'MODULE', 1 FROM srcs WHERE lang = 3
  UNION ALL SELECT repo, concat('svc.Svc.Run', k), 'METHOD', 10 FROM srcs WHERE lang = 3""")
def c04(spark, sf):
    return _pattern_nodes(spark, sf, ".go")


@query("C05_extract_java", using("srcs") + """, f AS (SELECT *, concat(pre, 'java/Part', k) AS m FROM srcs WHERE lang = 4) SELECT repo, concat('file:', m, '.java') AS id, 'FILE' AS kind, 1 AS line FROM f UNION ALL SELECT repo, 'module:' || m, 'MODULE', 1 FROM f
  UNION ALL SELECT repo, concat('com.acme.r', no, '.Part', k), 'CLASS', 8 FROM f UNION ALL SELECT repo, concat('com.acme.r', no, '.Part', k, '.run'), 'METHOD', 8 FROM f""")
def c05(spark, sf):
    return _pattern_nodes(spark, sf, ".java")


@query("C08_extraction_status", """SELECT repo, count(*) AS files, bool_or(ok) AS native, bool_or(NOT ok) AS fallback, CASE WHEN bool_or(ok) AND bool_or(NOT ok) THEN 'partial_native' WHEN bool_or(ok) THEN 'native' ELSE 'partial_local_fallback' END AS status
   FROM (SELECT concat('r', CAST(floor(p_partkey / 20) AS BIGINT)) AS repo, p_size <> 9 AS ok FROM @part) GROUP BY repo""")
def c08(spark, sf):
    facts = E.extract_python(P.run(spark, sf, _CTOR)).groupBy("repo", "path").agg(F.max(F.when(F.col("kind") == "ERROR", "fallback").otherwise("native")).alias("s"),
                                                                                  F.bool_or(F.col("kind") == "ERROR").alias("bad"))
    return E.extraction_status(facts.select("repo", F.when(F.col("bad"), "fallback").otherwise("native").alias("status")))


_FIELDS = """SELECT 'r' AS repo, concat('p', p_partkey, CASE WHEN p_size % 2 = 0 THEN '.go' ELSE '.java' END) AS path, CASE WHEN p_size % 2 = 0 THEN concat('package x', chr(10), 'type S', p_partkey, ' struct {', chr(10), '  repo *Repo', p_size, chr(10), '  name string', chr(10), '}', chr(10), 'func F() {}')
   ELSE concat('class J', p_partkey, ' {', chr(10), '  private final Repo', p_size, ' repo;', chr(10), '  protected List<String> names = null;', chr(10), '}') END AS content FROM @part"""


@query("C15_extract_typed_fields", """SELECT concat('p', p_partkey, '.go') AS path, concat('S', p_partkey) AS owner, unnest(['repo', 'name']) AS field, unnest([concat('Repo', p_size), 'string']) AS type FROM @part WHERE p_size % 2 = 0
  UNION ALL SELECT concat('p', p_partkey, '.java'), concat('J', p_partkey), unnest(['repo', 'names']), unnest([concat('Repo', p_size), 'List']) FROM @part WHERE p_size % 2 = 1""")
def c15(spark, sf):
    return E.extract_typed_fields(P.run(spark, sf, _FIELDS)).drop("repo")


# --- streams -----------------------------------------------------------------------------------

def _place(spark):
    return f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    """A table as a stream: one file beside the other tables, or a folder of files."""
    table = P.table(spark, sf, name)
    reader, own = spark.readStream.schema(table.schema), f"{name}.parquet"
    if all(f.rsplit("/", 1)[-1] == own for f in table.inputFiles()):
        return reader.option("pathGlobFilter", own).parquet(sf)
    return reader.parquet(f"{sf}/{own}")


@query("S01_stream_file_changes", """SELECT path, sha256, seq, CASE WHEN prev IS NULL THEN 'added' ELSE 'modified' END AS change FROM (SELECT *, lag(sha256) OVER (PARTITION BY path ORDER BY seq) AS prev FROM (
   SELECT concat(source, '/', lang) AS path, sha256(text) AS sha256, doc_id AS seq FROM @documents)) WHERE prev IS NULL OR prev <> sha256""")
def s01(spark, sf):
    files = _stream(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("path"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("seq"))
    place = _place(spark)
    S.stream_file_changes(files, place)
    return S.read_file_changes(spark, place)


@query("S02_stream_distinct_calls", """SELECT DISTINCT event_type AS caller, concat('u', user_id) AS callee, concat('t', user_id % 7) AS test_id FROM @events""")
def s02(spark, sf):
    calls = _stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("caller"), F.concat(F.lit("u"), "user_id").alias("callee"), F.lit("a.py").alias("caller_file"), F.lit(1).alias("caller_line"),
        F.lit("b.py").alias("callee_file"), F.lit(2).alias("callee_line"), F.concat(F.lit("t"), F.col("user_id") % 7).alias("test_id"))
    place = _place(spark)
    S.stream_distinct_calls(calls, "3650 days").writeStream.format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/out").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("caller", "callee", "test_id")


@query("S03_stream_confirm", """SELECT concat('e', o_orderkey) AS edge_id, concat('t', o_custkey % 50) AS test_id, 0.98::DOUBLE AS runtime_confidence FROM @orders""")
def s03(spark, sf):
    orders = _stream(spark, sf, "orders")
    calls = orders.select(F.concat(F.lit("app.orders.o"), "o_orderkey", F.lit(".place")).alias("caller"), F.concat(F.lit("app.customers.c"), "o_custkey", F.lit(".bill")).alias("callee"),
                          F.lit("a.py").alias("caller_file"), F.lit(1).alias("caller_line"), F.lit("b.py").alias("callee_file"), F.lit(2).alias("callee_line"),
                          F.concat(F.lit("t"), F.col("o_custkey") % 50).alias("test_id"), F.lit(0.98).alias("confidence"))
    edges = P.run(spark, sf, RUN_EDGES).where("id LIKE 'e%'")
    place = _place(spark)
    S.stream_confirm(calls, edges, place)
    return S.read_confirmations(spark, place)


@query("S04_stream_refresh", using("py") + "SELECT concat('r', k % 3) AS repo, concat('method:m', k, '.f') AS id, 'METHOD' AS kind FROM (SELECT p_partkey AS k FROM @part)")
def s04(spark, sf):
    part = _stream(spark, sf, "part")
    files = part.select(F.concat(F.lit("r"), F.col("p_partkey") % 3).alias("repo"), F.concat(F.lit("m"), "p_partkey", F.lit(".py")).alias("path"),
                        F.lit("def f(x):\n    return x\n").alias("content"))
    place = _place(spark)
    S.stream_refresh(files, E.extract_python, place)
    return S.read_refreshed(spark, place).select("repo", "id", "kind")
