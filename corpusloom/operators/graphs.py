"""Typed graphs over chunks: semantic, sequence and unified, as node and edge tables.

Merges are grouped aggregates with partial combination, never collected maps; order-dependent choices
(first name, first type among equals) are ``min_by`` over an explicit position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Fixed value: what counts as a name.
ENTITY = r"(?U)\b[A-Z][A-Za-z0-9&.\-]*(?:\s+[A-Z][A-Za-z0-9&.\-]*){0,4}\b|[一-鿿]{2,12}"


def extract(chunks: DataFrame, *, pattern: str = ENTITY, most: int = 8) -> DataFrame:
    """Adds names: the first distinct capitalised phrases or Chinese runs of a chunk."""
    found = F.regexp_extract_all(F.replace("content", F.lit("[CONTENT]"), F.lit(" ")), F.lit(pattern), F.lit(0))
    found = F.transform(found, lambda n: F.regexp_replace(n, r"^[ .,:;!?()\[\]{}]+|[ .,:;!?()\[\]{}]+$", ""))
    names = F.slice(F.array_distinct(F.filter(found, lambda n: (F.length(n) >= 2) & (n != "CONTENT"))), 1, most)
    return chunks.withColumn("names", names)


def mentions(extracted: DataFrame) -> DataFrame:
    """One row per entity named in a chunk: chunk_id, doc_id, locate, pos, name, entity_id, entity_type."""
    out = extracted.select("chunk_id", "doc_id", "file_name", "start_line", "end_line", F.posexplode("names").alias("pos", "name"))
    return out.select(
        "chunk_id", "doc_id", T.locate(F.col("file_name"), F.col("start_line"), F.col("end_line")).alias("locate"), "pos", "name",
        T.entity_id(F.col("name")).alias("entity_id"), T.guess_type(F.col("name")).alias("entity_type"),
    )


def co_occurrences(extracted: DataFrame, keyword: str = "co_occurs") -> DataFrame:
    """Relations between names that follow one another in a chunk."""
    pairs = F.transform(
        F.slice("names", F.lit(1), F.greatest(F.size("names") - 1, F.lit(0))),
        lambda n, i: F.struct(n.alias("source"), F.element_at("names", i + 2).alias("target")),
    )
    out = extracted.select("chunk_id", "doc_id", "file_name", "start_line", "end_line", F.posexplode(pairs).alias("pos", "p"))
    return out.select(
        "chunk_id", "doc_id", T.locate(F.col("file_name"), F.col("start_line"), F.col("end_line")).alias("locate"), "pos", "p.source", "p.target",
        F.array(F.lit(keyword)).alias("keywords"), F.lit(1.0).alias("weight"),
    )


def merge_entities(mention_rows: DataFrame, *, most_described: int = 5) -> DataFrame:
    """One row per entity: first name, majority type (first seen among equals), chunks and locates."""
    at = F.struct("chunk_id", "pos")
    types = mention_rows.groupBy("entity_id", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
    best = types.groupBy("entity_id").agg(
        F.min_by("entity_type", F.struct(-F.col("n"), "first")).alias("entity_type"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "n")))).alias("type_counts"),
    )
    merged = mention_rows.groupBy("entity_id").agg(
        F.min_by("name", at).alias("name"),
        F.sort_array(F.collect_set("chunk_id")).alias("source_chunk_ids"),
        F.sort_array(F.collect_set("locate")).alias("source_locates"),
    )
    return merged.join(best, "entity_id")


def placeholder_entities(relations: DataFrame, mention_rows: DataFrame) -> DataFrame:
    """Endpoints of relations that no chunk lists as entity, with the first chunk's provenance."""
    ends = relations.select("chunk_id", "locate", "pos", F.explode(F.array("source", "target")).alias("name"))
    ends = ends.withColumn("entity_id", T.entity_id(F.col("name"))).join(mention_rows.select("entity_id").distinct(), "entity_id", "left_anti")
    at = F.struct("chunk_id", "pos", "name")
    return ends.groupBy("entity_id").agg(
        F.min_by("name", at).alias("name"), F.lit("UNKNOWN").alias("entity_type"), F.lit(True).alias("auto_created"),
        F.array(F.min_by("chunk_id", at)).alias("source_chunk_ids"), F.array(F.min_by("locate", at)).alias("source_locates"),
    )


def merge_relations(relations: DataFrame) -> DataFrame:
    """One row per unordered pair of entities: summed weight, distinct keywords, provenance."""
    a, b = T.entity_id(F.col("source")), T.entity_id(F.col("target"))
    keyed = relations.select(F.least(a, b).alias("source"), F.greatest(a, b).alias("target"), "chunk_id", "locate", "keywords", "weight")
    out = keyed.groupBy("source", "target").agg(
        F.sum("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords")))).alias("relation_types"),
        F.sort_array(F.collect_set("chunk_id")).alias("source_chunk_ids"), F.sort_array(F.collect_set("locate")).alias("source_locates"),
    )
    return out.withColumn("relation_types", F.when(F.size("relation_types") == 0, F.array(F.lit("related_to"))).otherwise(F.col("relation_types")))


def source_edges(mention_rows: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct (entity, chunk) from mentions and from relation endpoints."""
    ends = relations.select(F.explode(F.array("source", "target")).alias("n"), "chunk_id").select(T.entity_id(F.col("n")).alias("source"), "chunk_id")
    both = mention_rows.select(F.col("entity_id").alias("source"), "chunk_id").unionByName(ends).distinct()
    return both.select("source", F.concat(F.lit("chunk:"), "chunk_id").alias("target"), F.lit("source").alias("edge_type"))


def chunk_source_edges(extracted: DataFrame) -> DataFrame:
    """``source_edges`` of chunks whose relations join their own names, as ``co_occurrences`` has them: distinct in a chunk, so no row is shuffled."""
    ids = F.array_distinct(F.transform("names", T.entity_id))
    return extracted.select(F.explode(ids).alias("source"), F.concat(F.lit("chunk:"), "chunk_id").alias("target"), F.lit("source").alias("edge_type"))


def entity_names(mention_rows: DataFrame) -> DataFrame:
    """entity_id, name: the first name of each entity, as ``merge_entities`` picks it, without lists of its chunks."""
    return mention_rows.groupBy("entity_id").agg(F.min_by("name", F.struct("chunk_id", "pos")).alias("name"))


def chunk_places(extracted: DataFrame) -> DataFrame:
    """entity_id, locate: where each entity is named, once; what ``merge_entities`` holds in source_locates, a row each."""
    at = T.locate(F.col("file_name"), F.col("start_line"), F.col("end_line"))
    return extracted.select(F.explode(F.array_distinct(F.transform("names", T.entity_id))).alias("entity_id"), at.alias("locate")).where("locate is not null")


def sequence_nodes(chunks: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("start_line", "end_line", "chunk_id")
    return chunks.select(
        F.concat(F.lit("chunk:"), "chunk_id").alias("node_id"), "chunk_id", "doc_id", "start_line", "end_line",
        (F.row_number().over(order) - 1).alias("doc_position"), F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("doc_chunk_count"),
        F.lag("chunk_id").over(order).alias("prev_chunk_id"), F.lead("chunk_id").over(order).alias("next_chunk_id"),
    )


def sequence_edges(nodes: DataFrame) -> DataFrame:
    """next and prev edges of neighbours in a document, from one window."""
    pair = nodes.where("next_chunk_id is not null").select(F.col("node_id").alias("a"), F.concat(F.lit("chunk:"), "next_chunk_id").alias("b"))
    both = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("next").alias("direction")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("target"), F.lit("prev").alias("direction")),
    )
    return pair.select(F.inline(both)).withColumns({"edge_type": F.lit("sequence"), "distance": F.lit(1)})


def expand_context(nodes: DataFrame, seeds: DataFrame, *, before: int = 1, after: int = 1) -> DataFrame:
    """Chunks within reach of seeds along a document, each with its smallest hop (seed: 0).

    Neighbours in a sequence are positions, so reach is arithmetic: seeds are spread over the few
    positions they reach and joined by equality.
    """
    at = seeds.join(nodes.select("chunk_id", "doc_id", "doc_position"), "chunk_id")
    reach = at.select("doc_id", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("hop"), "doc_position")
    reach = reach.select("doc_id", "hop", (F.col("doc_position") + F.col("hop")).alias("doc_position"))
    best = reach.groupBy("doc_id", "doc_position").agg(F.min_by("hop", F.struct(F.abs("hop"), "hop")).alias("hop"))
    return nodes.join(best, ["doc_id", "doc_position"]).select("chunk_id", "doc_id", "doc_position", "hop")


def reach_ahead(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """node_id, depth: chunks from a seed on along next edges, in documents of several chunks; the nearest seed before counts.

    nodes: of ``sequence_nodes``; seeds: node_id.  The same as ``paths.reach`` over next edges, but positions replace rounds.
    """
    marked = nodes.where("doc_chunk_count > 1").join(seeds.select("node_id", F.lit(True).alias("_seed")).distinct(), "node_id", "left")
    order = Window.partitionBy("doc_id").orderBy("doc_position").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("_seed"), F.col("doc_position"))).over(order)
    return marked.select("node_id", (F.col("doc_position") - last).cast("int").alias("depth")).where("depth is not null")


#: Order in which views win when several describe one node or edge.
VIEWS = ("semantic", "structure", "sequence")


def merge_views(tables: dict[str, DataFrame], key: list[str], scalars: list[str], lists: list[str]) -> DataFrame:
    """Union of views of the same nodes or edges: the first non-empty scalar by view order, united lists."""
    parts = []
    for rank, view in enumerate(VIEWS):
        if view in tables:
            t = tables[view]
            have = set(t.columns)
            cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in scalars]
            cols += [F.col(c) if c in have else F.array().cast("array<string>").alias(c) for c in lists]
            parts.append(t.select(*key, *cols, F.lit(rank).alias("_rank"), F.lit(view).alias("_view")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    filled = lambda c: F.when(F.col(c).cast("string") != "", F.struct("_rank", F.col(c).alias("v")))
    return rows.groupBy(*key).agg(
        *[F.min(filled(c))["v"].alias(c) for c in scalars],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists],
        F.transform(F.array_sort(F.collect_set(F.struct("_rank", "_view"))), lambda x: x["_view"]).alias("views"),
    )


def edge_key(edge_type: Column, source: Column, target: Column, direction: Column) -> Column:
    """Semantic edges have no direction, sequence edges one of two, others run from source to target."""
    return (
        F.when(edge_type == "semantic", F.concat_ws("|", edge_type, F.least(source, target), F.greatest(source, target)))
        .when(edge_type == "sequence", F.concat_ws("|", edge_type, source, target, direction))
        .otherwise(F.concat_ws("|", edge_type, source, target))
    )


def normalize_types(nodes: DataFrame, type_col: str = "node_type") -> DataFrame:
    """raptor is summary, semantic_relation is semantic; what it was is kept."""
    named = F.when(F.col(type_col) == "raptor", "summary").when(F.col(type_col) == "semantic_relation", "semantic").otherwise(F.col(type_col))
    return nodes.withColumn(f"original_{type_col}", F.col(type_col)).withColumn(type_col, named)


def degree_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, degree; a loop counts once, a node without edges 0."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node_id"))
    return nodes.select("node_id").join(ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree")), "node_id", "left").fillna(0, ["degree"])


def components(edges: DataFrame, checkpoint) -> DataFrame:
    """node_id, component (smallest node id): nodes move to their smallest neighbour until no edge is left."""
    ends = checkpoint(edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct())
    moves = []
    while not ends.isEmpty():
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = checkpoint(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node_id"), F.least("a", "low").alias("to")))
        onward = move.select(F.col("node_id").alias("to"), F.col("to").alias("next"))
        move = checkpoint(move.join(onward, "to", "left").select("node_id", F.coalesce("next", "to").alias("to")))
        moves.append(move)
        left, right = move.toDF("a", "x"), move.toDF("b", "y")
        ends = ends.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        ends = checkpoint(ends)
    if not moves:
        return ends.toDF("node_id", "component")
    out = moves[0].withColumnRenamed("to", "component")
    for move in moves[1:]:
        out = checkpoint(out.join(move.toDF("component", "to"), "component", "left").select("node_id", F.coalesce("to", "component").alias("component")))
    return out


def all_components(nodes: DataFrame, edges: DataFrame, checkpoint) -> DataFrame:
    """components over all nodes: a node without edges is one by itself, edges that leave the nodes do not count."""
    ids = nodes.select("node_id").distinct()
    inside = edges.select("source", "target").join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi")
    inside = inside.join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
    linked = components(inside, checkpoint)
    return ids.join(linked, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def subset(nodes: DataFrame, edges: DataFrame, chunk_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with provenance in the chunks, nodes they need or that are supported, and edges whose ends remain."""
    picked = chunk_ids.select("chunk_id").distinct()
    touched = edges.select("source", "target", F.explode("source_chunk_ids").alias("chunk_id")).join(picked, "chunk_id", "left_semi").select("source", "target").distinct()
    supported = nodes.select("node_id", F.explode("source_chunk_ids").alias("chunk_id")).join(picked, "chunk_id", "left_semi").select("node_id")
    needed = touched.select(F.explode(F.array("source", "target")).alias("node_id")).unionByName(supported).distinct()
    kept = nodes.join(needed, "node_id", "left_semi")
    ids = kept.select("node_id")
    some = edges.join(touched, ["source", "target"], "left_semi")
    some = some.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return kept, some
