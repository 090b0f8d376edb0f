"""Graph documents in and out, foreign dialects, and the run log."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor import constants as C
from tremor.functions import columns as X

_EVIDENCE = "array<struct<description:string,file:string,line:int,source:string>>"
GRAPH_SCHEMA = f"""repo string,
  nodes array<struct<id:string,kind:string,name:string,properties:map<string,string>>>,
  edges array<struct<id:string,kind:string,`from`:string,from_node:string,`to`:string,to_node:string,source:string,confidence:double,
    evidence:{_EVIDENCE},properties:map<string,string>>>,
  links array<struct<id:string,kind:string,type:string,label:string,`from`:string,`to`:string,source:string,target:string,confidence:string,relation:string>>"""


def read_graph_json(spark: SparkSession, path: str) -> DataFrame:
    """Graph documents, one JSON object per file."""
    return spark.read.schema(GRAPH_SCHEMA).option("multiLine", "true").json(path)


def parse_graph_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """Graph documents held as text in a column."""
    rest = [c for c in texts.columns if c != column]
    return texts.select(*rest, F.from_json(column, GRAPH_SCHEMA).alias("g")).select(*rest, "g.nodes", "g.edges", "g.links")


def graph_nodes(docs: DataFrame) -> DataFrame:
    """Node rows in document order; a missing name falls back to the id."""
    return docs.select("repo", F.posexplode("nodes").alias("pos", "n")).select(
        "repo", "n.id", "n.kind", F.coalesce(F.nullif("n.name", F.lit("")), "n.id").alias("name"), "n.properties", "pos")


def graph_edge_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejects): both endpoint spellings, default ids; edges without an endpoint are rejected."""
    rows = docs.select("repo", F.posexplode("edges").alias("pos", "e"))
    pick = lambda a, b: F.coalesce(F.nullif(f"e.{a}", F.lit("")), F.nullif(f"e.{b}", F.lit("")))
    rows = rows.select("repo", "pos", F.col("e.id").alias("_id"), "e.kind", pick("from", "from_node").alias("from_id"), pick("to", "to_node").alias("to_id"),
                       F.coalesce("e.source", F.lit("EXTRACTED")).alias("source"), F.coalesce("e.confidence", F.lit(1.0)).alias("confidence"), "e.evidence", "e.properties")
    bad = F.col("from_id").isNull() | F.col("to_id").isNull()
    default = F.concat("from_id", F.lit("__"), "kind", F.lit("__"), "to_id")
    good = rows.where(~bad).withColumn("id", F.coalesce(F.nullif("_id", F.lit("")), default)).drop("_id")
    rejects = rows.where(bad).select("repo", F.col("_id").alias("edge_id"), F.lit("missing_endpoint").alias("reason"),
                                     F.coalesce("from_id", F.lit("")).alias("from_id"), F.coalesce("to_id", F.lit("")).alias("to_id"))
    return good, rejects


def normalize_external_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, skipped counts) of graphs from other tools: incomplete rows are skipped, and a
    claim of INFERRED becomes EXTERNAL_TOOL."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    nodes = docs.select("repo", F.explode("nodes").alias("n")).select("repo", "n.id", "n.kind", "n.name")
    node_bad = blank("id") | blank("kind") | blank("name") | ~F.coalesce(F.col("kind").isin(*C.NODE_KINDS), F.lit(False))
    edges = docs.select("repo", F.explode("edges").alias("e")).select(
        "repo", "e.id", "e.kind", F.col("e.from").alias("from_id"), F.col("e.to").alias("to_id"),
        F.when(blank("e.source") | (F.col("e.source") == "INFERRED"), "EXTERNAL_TOOL").otherwise(F.col("e.source")).alias("source"),
        F.coalesce("e.confidence", F.lit(1.0)).alias("confidence"))
    ok = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    edge_bad = (blank("id") | blank("kind") | blank("from_id") | blank("to_id") | ~ok("kind", C.EDGE_KINDS) | ~ok("source", C.EDGE_SOURCES)
                | (F.col("confidence") < 0) | (F.col("confidence") > 1))
    skipped = nodes.select("repo", node_bad.cast("int").alias("n"), F.lit(0).alias("e")).unionByName(
        edges.select("repo", F.lit(0).alias("n"), edge_bad.cast("int").alias("e"))).groupBy("repo").agg(
        F.sum("n").alias("skipped_nodes"), F.sum("e").alias("skipped_edges"))
    return nodes.where(~node_bad), edges.where(~edge_bad), skipped


# Confidence words of the link dialect and its ceiling.
LINK_CONFIDENCE = {"EXTRACTED": 0.60, "INFERRED": 0.55, "AMBIGUOUS": 0.35}
LINK_CAP = 0.70


def adapt_links_graph(docs: DataFrame) -> DataFrame:
    """Edges of the links dialect (source/target names, confidence words), capped and marked when dangling."""
    rows = docs.select("repo", F.explode("links").alias("k"))
    first = lambda *cs: F.coalesce(*[F.nullif(f"k.{c}", F.lit("")) for c in cs])
    kind = F.upper(F.coalesce(first("kind", "type", "label"), F.lit("CALLS")))
    word = F.upper(F.col("k.confidence"))
    number = F.when(F.col("k.confidence").isNull(), F.lit(0.5)).otherwise(F.coalesce(X.lookup(word, LINK_CONFIDENCE), F.col("k.confidence").try_cast("double")))
    conf = F.when(number.isNull(), F.lit(0.5)).otherwise(F.least(F.lit(LINK_CAP), F.greatest(F.lit(0.0), number)))
    out = rows.select("repo", first("id").alias("_id"), F.when(kind.isin(*C.EDGE_KINDS), kind).otherwise("CALLS").alias("kind"),
                      first("from", "source").alias("from_id"), first("to", "target").alias("to_id"), F.lit("EXTERNAL_TOOL").alias("source"),
                      conf.alias("confidence"), first("relation", "kind", "type").alias("external_relation")).where("from_id IS NOT NULL AND to_id IS NOT NULL")
    out = out.withColumn("id", F.coalesce("_id", F.concat_ws("_", F.lit("edge"), "from_id", "to_id", "kind"))).drop("_id")
    ids = docs.select("repo", F.explode("nodes").alias("n")).select("repo", F.col("n.id").alias("_n")).distinct()
    for end in ("from_id", "to_id"):
        out = out.join(ids.select("repo", F.col("_n").alias(end), F.lit(True).alias(f"_{end}")), ["repo", end], "left")
    dangling = F.col("_from_id").isNull() | F.col("_to_id").isNull()
    return out.withColumn("quality_warning", F.when(dangling, "dangling_external_reference")).drop("_from_id", "_to_id")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a graph in its canonical order: nodes by id, edges by (from, to, kind, source, rule, id).

    The range partitioning makes the files themselves globally ordered without a single-task sort.
    """
    nodes.orderBy("id").write.mode("overwrite").format(fmt).save(f"{path}/nodes")
    edges.orderBy("ord").write.mode("overwrite").format(fmt).save(f"{path}/edges")


def write_facts(facts: DataFrame, path: str, by: str = "language") -> None:
    facts.repartition(by).sortWithinPartitions("fact_id").write.mode("overwrite").partitionBy(by).parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


RUN_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("run_id", T.StringType()), ("ts", T.TimestampType()), ("project_path", T.StringType()), ("status", T.StringType()),
    ("nodes", T.LongType()), ("edges", T.LongType()), ("metadata", T.StringType()))])


def append_run(runs: DataFrame, path: str) -> None:
    """Append run rows to the log; a repeated run id replaces the older row when listed."""
    runs.select(*RUN_SCHEMA.fieldNames()).write.mode("append").parquet(path)


def latest_runs(log: DataFrame) -> DataFrame:
    """One row per run id, its newest."""
    rest = [c for c in log.columns if c != "run_id"]
    newest = log.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "status")).alias("r"))
    return newest.select("run_id", "r.*")


def list_runs(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest runs first."""
    out = latest_runs(log).orderBy(F.desc("ts"), "run_id")
    return out if limit is None else out.limit(limit)


def read_packs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(packs, exploded edge rules) from rule pack JSON files."""
    schema = """schema_version string, library string, ecosystem string, version string, trust_level string, status string, scope string,
      edge_rules array<struct<id:string,type:string,match:map<string,string>,emit:struct<`from`:string,`to`:string,kind:string,confidence:double,description:string>>>"""
    packs = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    packs = packs.withColumn("pack", F.col("_metadata.file_path"))
    return packs.drop("edge_rules"), pack_rules(packs)


def pack_rules(packs: DataFrame) -> DataFrame:
    return packs.select("pack", "library", "ecosystem", "trust_level", "status", "scope", F.posexplode("edge_rules").alias("pos", "r")).select(
        "pack", "library", "ecosystem", "trust_level", "status", "scope", "pos", F.col("r.id").alias("rule_id"), F.col("r.type").alias("rule_type"), "r.match",
        F.col("r.emit.from").alias("emit_from"), F.col("r.emit.to").alias("emit_to"), F.col("r.emit.kind").alias("emit_kind"),
        F.col("r.emit.confidence").alias("emit_confidence"), F.col("r.emit.description").alias("description"))
