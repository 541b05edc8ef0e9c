"""Entity-passage graphs: mentions, bridges, triples, layers, and rankings over them.

named: chunk_id, doc_id, content, names (in order of appearance).  Triples are rows (chunk_id, pos, source,
target, label).  Rankings take scores as tables, so any PageRank or vector search can feed them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.retrieval import top_k

# --- building -----------------------------------------------------------------------------------


def entity_mentions(named: DataFrame, triples: DataFrame | None = None) -> DataFrame:
    """chunk_id, key, name: each chunk's entities and endpoints once, in the first spelling of the chunk."""
    rows = named.select("chunk_id", F.posexplode("names").alias("at", "name")).withColumn("kind", F.lit(0))
    if triples is not None:
        ends = triples.select("chunk_id", F.col("pos").alias("at"), F.explode(F.array("source", "target")).alias("name"), F.lit(1).alias("kind"))
        rows = rows.unionByName(ends)
    rows = rows.withColumn("key", F.lower(F.trim("name"))).where("key <> ''")
    return rows.groupBy("chunk_id", "key").agg(F.min_by("name", F.struct("kind", "at", "name")).alias("name"))


def chunk_keys(named: DataFrame) -> DataFrame:
    """chunk_id, doc_id, key: what ``entity_mentions`` finds when relations join names of their own chunk; nothing is shuffled."""
    keys = F.array_distinct(F.transform("names", lambda n: F.lower(F.trim(n))))
    return named.select("chunk_id", "doc_id", F.explode(keys).alias("key")).where("key <> ''")


def without_types(rows: DataFrame, *types: str) -> DataFrame:
    """Entities of other types (dates, as a rule); no type is none of them."""
    return rows.where(~F.upper(F.coalesce("entity_type", F.lit(""))).isin(*[t.upper() for t in types]))


def passage_weights(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """key, chunk_id, weight: share of a chunk's mentions, counted as substrings, each at least one; 0.01 at least."""
    body = chunks.select("chunk_id", F.lower("content").alias("body"))
    rows = mentions.join(body, "chunk_id").withColumn("n", F.greatest(T.occurrences(F.col("body"), F.lower("name")), F.lit(1)))
    return rows.select("key", "chunk_id", F.greatest(F.col("n") / F.sum("n").over(Window.partitionBy("chunk_id")), F.lit(0.01)).alias("weight"))


def sentence_bridges(mentions: DataFrame, chunks: DataFrame, *, least: int = 1) -> DataFrame:
    """key, chunk_id, sentence_no, sentence: the sentences of a chunk that hold an entity of it, without case."""
    own = mentions.groupBy("chunk_id").agg(F.collect_list(F.struct("key", F.lower("name").alias("name"))).alias("names"))
    rows = chunks.select("chunk_id", "content").join(own, "chunk_id")
    rows = rows.select("chunk_id", "names", F.posexplode(T.split_sentences(F.col("content"), least)).alias("sentence_no", "sentence"))
    inside = rows.withColumn("body", F.lower("sentence")).withColumn("names", F.filter("names", lambda n: F.contains("body", n["name"])))
    return inside.select(F.explode("names.key").alias("key"), "chunk_id", "sentence_no", "sentence")


def chunk_bridges(named: DataFrame, *, least: int = 1) -> DataFrame:
    """``sentence_bridges`` of chunks by their own names, with doc_id: a chunk's names are in its row, so nothing is shuffled."""
    own = F.array_distinct(F.transform("names", lambda n: F.struct(F.lower(F.trim(n)).alias("key"), F.lower(n).alias("name"))))
    rows = named.select("chunk_id", "doc_id", own.alias("names"), F.posexplode(T.split_sentences(F.col("content"), least)).alias("sentence_no", "sentence"))
    inside = rows.withColumn("body", F.lower("sentence")).withColumn("names", F.filter("names", lambda n: (n["key"] != "") & F.contains("body", n["name"])))
    return inside.select(F.explode("names.key").alias("key"), "chunk_id", "doc_id", "sentence_no", "sentence")


def adjacent_passages(chunks: DataFrame) -> DataFrame:
    """source, target, weight: each chunk to the one before it in its document, in file order."""
    order = Window.partitionBy("doc_id").orderBy("start_line", "end_line", "chunk_id")
    rows = chunks.withColumn("before", F.lag("chunk_id").over(order)).where("before is not null")
    return rows.select(F.concat(F.lit("chunk:"), "before").alias("source"), F.concat(F.lit("chunk:"), "chunk_id").alias("target"), F.lit(1.0).alias("weight"))


def triple_index(triples: DataFrame) -> DataFrame:
    """Distinct (source, target, label, chunk_id) by keys without case; the first spelling stays."""
    rows = triples.withColumns({"s": F.lower("source"), "t": F.lower("target")})
    at = F.struct("pos", "source", "target")
    return rows.groupBy("s", "t", "label", "chunk_id").agg(F.min_by("source", at).alias("source"), F.min_by("target", at).alias("target"))


def pair_weights(triples: DataFrame, weight: Column, *, combine: str = "max") -> DataFrame:
    """a, b, weight per unordered pair of keys, loops left out: the largest weight, or the sum."""
    s, t = F.lower("source"), F.lower("target")
    rows = triples.select(F.least(s, t).alias("a"), F.greatest(s, t).alias("b"), weight.alias("w")).where("a <> b")
    return rows.groupBy("a", "b").agg((F.max("w") if combine == "max" else F.sum("w")).alias("weight"))


def memory_graph(triples: DataFrame, mentions: DataFrame) -> DataFrame:
    """a, b, weight: one for each triple of two entities and for each chunk and entity of it, added up."""
    facts = pair_weights(triples, F.lit(1.0), combine="sum")
    passages = mentions.select(F.concat(F.lit("chunk:"), "chunk_id").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("weight"))
    return facts.unionByName(passages.groupBy("a", "b").agg(F.sum("weight").alias("weight")))


def chunks_per_entity(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("key").agg(F.countDistinct("chunk_id").alias("chunks"))


def knowledge_units(triples: DataFrame) -> DataFrame:
    """unit_id, text, chunk_ids, entity_keys: sentences of triples by md5, with all their chunks and entities."""
    text = F.concat_ws(" ", "source", "label", "target")
    rows = triples.select(T.md5_id(text, "ku:").alias("unit_id"), text.alias("text"), "chunk_id", F.explode(F.array(F.lower("source"), F.lower("target"))).alias("key"))
    return rows.groupBy("unit_id").agg(F.min("text").alias("text"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.array_sort(F.collect_set("key")).alias("entity_keys"))


def memory_layers(typed: DataFrame, *, samples: int = 5) -> DataFrame:
    """source, label, target, schema, passages, examples: facts under their first schema.

    typed: chunk_id, pos, source, label, target, source_type, target_type.  Examples are the first
    ``samples`` chunks; the number of passages counts all.
    """
    schema = F.concat_ws("|", "source_type", "label", "target_type")
    rows = typed.select("source", "label", "target", "chunk_id", F.struct("chunk_id", "pos").alias("at"), schema.alias("schema"))
    facts = rows.groupBy("source", "label", "target").agg(F.min_by("schema", "at").alias("schema"), F.countDistinct("chunk_id").alias("passages"))
    w = Window.partitionBy("source", "label", "target").orderBy("chunk_id")
    some = rows.select("source", "label", "target", "chunk_id").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples)
    some = some.groupBy("source", "label", "target").agg(F.array_sort(F.collect_list("chunk_id")).alias("examples"))
    return facts.join(some, ["source", "label", "target"])


def frequent_ontologies(rows: DataFrame, *, least: int = 2) -> DataFrame:
    """Triples under the ontology seen last for them, without those of rare ontologies.

    rows: doc_no, triple, ontology.  An ontology counts the rows of all triples it is the last one of.
    """
    last = rows.groupBy("triple").agg(F.max_by("ontology", "doc_no").alias("latest"), F.count(F.lit(1)).alias("n"))
    often = last.groupBy("latest").agg(F.sum("n").alias("seen")).where(F.col("seen") >= least)
    kept = last.join(often, "latest").select("triple", "latest")
    return rows.select("doc_no", "triple").join(kept, "triple").select("doc_no", "triple", F.col("latest").alias("ontology"))


def chunk_ontologies(rows: DataFrame) -> DataFrame:
    """chunk_id, ontologies, typed_entities: what a chunk's typed facts say, sorted and distinct.

    rows: chunk_id, ontology, entity, entity_type.
    """
    pair = F.concat_ws(":", "entity_type", "entity")
    return rows.groupBy("chunk_id").agg(F.array_sort(F.collect_set("ontology")).alias("ontologies"), F.array_sort(F.collect_set(pair)).alias("typed_entities"))


def open_triples(rows: DataFrame) -> DataFrame:
    """chunk_id, pos, source, label, target: first of each triple without case; white space is one blank.

    rows: chunk_id, pos, source, target, keywords, relation, predicate, description.
    """
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    out = rows.select("chunk_id", "pos", tidy("source").alias("source"), relation_label().alias("label"), tidy("target").alias("target")).where("source <> '' and target <> ''")
    first = out.groupBy("chunk_id", F.lower("source").alias("s"), F.lower("label").alias("l"), F.lower("target").alias("t")).agg(F.min_by(F.struct("pos", "source", "label", "target"), "pos").alias("x"))
    return first.select("chunk_id", "x.*")


def relation_label(*, first_keyword: bool = False) -> Column:
    """The first three keywords; else the relation, predicate or description.  Or the fields first, then
    the first keyword."""
    words = F.filter(F.transform("keywords", lambda k: F.trim(k)), lambda k: k != "")
    named = [F.when(F.trim(c) != "", F.trim(c)) for c in ("relation", "predicate")]
    if first_keyword:
        return F.coalesce(*named, F.get(words, F.lit(0)), F.lit("related_to"))
    joined = F.array_join(F.filter(F.slice(F.transform("keywords", lambda k: F.trim(k)), 1, 3), lambda k: k != ""), ", ")
    return F.coalesce(F.when(joined != "", joined), *named, F.when(F.trim("description") != "", F.trim("description")), F.lit("related_to"))


# --- ranking ------------------------------------------------------------------------------------


def min_max(scores: DataFrame, by: str = "query_id") -> DataFrame:
    """Scores from 0 to 1 per query; equal scores are all 1."""
    ends = scores.groupBy(by).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    wide = F.col("_hi") - F.col("_lo")
    return scores.join(ends, by).withColumn("score", F.when(wide == 0, 1.0).otherwise((F.col("score") - F.col("_lo")) / wide)).drop("_lo", "_hi")


def name_overlap(entities: DataFrame, queries: DataFrame, terms=T.ascii_terms) -> DataFrame:
    """query_id, key, name, share: of a name's terms, those the question has.  Only pairs that share one."""
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("t"))
    known = entities.select("key", "name", F.array_distinct(terms(F.col("name"))).alias("ts"))
    known = known.select("key", "name", F.size("ts").alias("n"), F.explode("ts").alias("t"))
    return asked.join(known, "t").groupBy("query_id", "key", "name", "n").agg((F.count(F.lit(1)) / F.col("n")).alias("share")).drop("n")


def seed_entities(entities: DataFrame, queries: DataFrame, dots: DataFrame, k: int) -> DataFrame:
    """The k entities of largest positive inner product plus shared terms, ties by name.  dots: query_id, key, score."""
    words = name_overlap(entities, queries).select("query_id", "key", F.col("share").alias("score"))
    both = words.unionByName(dots.select("query_id", "key", "score")).groupBy("query_id", "key").agg(F.sum("score").alias("score"))
    both = both.where("score > 0").join(entities.select("key", "name"), "key")
    return top_k(both, k, order=[F.desc(F.round("score", 9)), "name"])


def lexical_seeds(entities: DataFrame, queries: DataFrame, direct: DataFrame, mentions: DataFrame, k: int) -> DataFrame:
    """Seeds by words and by direct hits: 5 for a name that stands in the question, 2 times the share of its
    terms, 1 / rank for each hit's entities; a question without any score gives the entities of its first
    three hits 0.1.  direct: query_id, chunk_id, rank."""
    shared = name_overlap(entities, queries).join(queries.select("query_id", F.lower("text").alias("q")), "query_id")
    words = shared.select("query_id", "key", (2 * F.col("share") + F.when(F.contains("q", F.lower("name")), 5.0).otherwise(0.0)).alias("score"))
    hits = direct.join(mentions.select("chunk_id", "key"), "chunk_id").select("query_id", "key", (1.0 / F.col("rank")).alias("score"))
    scored = words.unionByName(hits).groupBy("query_id", "key").agg(F.sum("score").alias("score"))
    empty = direct.where("rank <= 3").join(scored.select("query_id").distinct(), "query_id", "left_anti").join(mentions.select("chunk_id", "key"), "chunk_id")
    scored = scored.unionByName(empty.groupBy("query_id", "key").agg((0.1 * F.count(F.lit(1))).alias("score")))
    return top_k(scored.where("score > 0"), k, order=[F.desc(F.round("score", 9)), "key"])


def reset_vector(facts: DataFrame, dense: DataFrame, mentions: DataFrame, *, k: int = 5, passage_weight: float = 0.05) -> DataFrame:
    """query_id, node, r summing to 1: facts give their entities score / chunks of the entity, passages their
    scaled score times the weight; a query without positive mass has no rows, and its dense order stands.

    facts: query_id, source, target, score, rank; dense: query_id, chunk_id, score.
    """
    spread = chunks_per_entity(mentions)
    ends = facts.where(F.col("rank") <= k).select("query_id", F.explode(F.array(F.lower("source"), F.lower("target"))).alias("key"), F.greatest("score", F.lit(0.0)).alias("s"))
    phrases = ends.join(spread, "key").select("query_id", F.col("key").alias("node"), (F.col("s") / F.greatest("chunks", F.lit(1))).alias("x"))
    passages = min_max(dense).select("query_id", F.concat(F.lit("chunk:"), "chunk_id").alias("node"), (F.col("score") * passage_weight).alias("x"))
    mass = phrases.unionByName(passages).groupBy("query_id", "node").agg(F.sum("x").alias("x"))
    total = mass.groupBy("query_id").agg(F.sum("x").alias("all")).where("all > 0")
    return mass.join(total, "query_id").select("query_id", "node", (F.col("x") / F.col("all")).alias("r")).where("r > 0")


def passages_by_rank(ranks: DataFrame, k: int) -> DataFrame:
    """The k chunk nodes of largest rank, ties by id.  ranks: query_id, node_id, x."""
    rows = ranks.where(F.col("node_id").startswith("chunk:")).select("query_id", F.substring("node_id", 7, 2**31 - 1).alias("id"), F.col("x").alias("score"))
    return top_k(rows, k, order=[F.desc(F.round("score", 12)), "id"])


def recommend(ranks: DataFrame, nodes: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The k entities of largest rank that are no seeds, ties by id."""
    rows = ranks.join(nodes.where("node_type = 'entity'").select("node_id"), "node_id").join(seeds.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    return top_k(rows.select("query_id", F.col("node_id").alias("id"), F.col("x").alias("score")), k, order=[F.desc(F.round("score", 12)), "id"])


def expand_by_rank(anchors: DataFrame, ranks: DataFrame, most: int) -> DataFrame:
    """query_id, node_id: anchors and then entities of largest rank until there are ``most``."""
    anchors = anchors.select("query_id", "node_id").distinct()
    n = anchors.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    more = ranks.where(~F.col("node_id").startswith("chunk:")).join(anchors, ["query_id", "node_id"], "left_anti")
    more = top_k(more.withColumn("id", F.col("node_id")), most, order=[F.desc(F.round("x", 12)), "id"]).join(n, "query_id")
    return anchors.unionByName(more.where(F.col("rank") <= most - F.col("n")).select("query_id", "node_id"))


def neighbour_ranking(edges: DataFrame, ranks: DataFrame, *, k: int = 10) -> DataFrame:
    """node_id, id, score, rank: neighbours by 0.4 degree (as a share of the largest) + 0.6 rank (likewise).

    edges: a, b (both directions); ranks: node_id, x.
    """
    degree = edges.groupBy("a").agg(F.countDistinct("b").alias("n")).withColumnRenamed("a", "b")
    tops = degree.agg(F.max("n").alias("most")).crossJoin(ranks.agg(F.max("x").alias("best")))  # one row
    rows = edges.select("a", "b").distinct().join(degree, "b").join(ranks.withColumnRenamed("node_id", "b"), "b").crossJoin(F.broadcast(tops))
    scored = rows.select(F.col("a").alias("node_id"), F.col("b").alias("id"), (0.4 * F.col("n") / F.col("most") + 0.6 * F.try_divide("x", "best")).alias("score"))
    return top_k(scored, k, by="node_id", order=[F.desc(F.round("score", 12)), "id"])


def chunks_of_nodes(nodes: DataFrame, mentions: DataFrame, k: int, *, checkpoint: Callable[[DataFrame], DataFrame], most: int = 8) -> DataFrame:
    """The k chunks that most of a query's nodes are linked with, ties by id.  A chunk node counts for itself.

    A node may be linked with any share of the chunks, so queries and chunks are not joined by node.  Of every set of nodes inside a query's
    the k first chunks that have all of it are found once; a query's best are among those of its sets, since a chunk that is left out
    has k before it with the same nodes.  Queries of more than ``most`` nodes, whose sets would be too many, are joined.
    """
    itself = F.when(F.col("node_id").startswith("chunk:"), F.array(F.col("node_id"), F.concat(F.lit("\0"), "node_id"))).otherwise(F.array("node_id"))
    asked = checkpoint(nodes.select("query_id", F.explode(itself).alias("key")).distinct())
    links = mentions.select("key", F.col("chunk_id").alias("id"))
    links = links.unionByName(asked.where(F.col("key").startswith("\0")).select("key", F.substring("key", 8, 2**31 - 1).alias("id"))).distinct()
    links = checkpoint(links.join(asked.select("key").distinct(), "key", "left_semi"))
    known = checkpoint(links.select("key").distinct().withColumn("no", F.monotonically_increasing_id()))
    sets = checkpoint(asked.join(known, "key").groupBy("query_id").agg(F.array_sort(F.collect_list("no")).alias("s")))
    wide = sets.where(F.size("s") > most).select("query_id", F.explode("s").alias("no"))
    held = checkpoint(links.join(known, "key").select("id", "no"))
    joined = wide.join(held, "no").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("score"))
    every = F.expr("transform(sequence(1, shiftleft(1, size(s)) - 1), m -> filter(s, (x, i) -> getbit(m, i) = 1))")
    parts = sets.where(F.size("s") <= most).select("query_id", F.explode(every).alias("p"))
    parts = checkpoint(parts.select("query_id", F.array_join(F.col("p").cast("array<string>"), ",").alias("set"), F.size("p").alias("n")))
    wanted = checkpoint(parts.select("set", "n").distinct())
    # sets grow by one node a round, in the order of numbers; rest: the chunk's nodes after the last one
    rows = held.groupBy("id").agg(F.array_sort(F.collect_list("no")).alias("rest")).withColumn("set", F.lit(None).cast("string"))
    found = None
    for n in range(1, (parts.agg(F.max("n")).first()[0] or 0) + 1):
        grown = rows.select("id", F.col("set").alias("_s"), "rest", F.posexplode("rest").alias("_at", "_no"))
        grown = grown.select("id", F.concat_ws(",", "_s", F.col("_no").cast("string")).alias("set"), F.slice("rest", F.col("_at") + 2, F.size("rest")).alias("rest"))
        rows = checkpoint(grown.join(wanted.where(F.col("n") == n).select("set"), "set", "left_semi"))
        first = top_k(rows.select("set", "id"), k, by="set", order=["id"]).select("set", "id")
        found = first if found is None else found.unionByName(first)
    if found is None:
        return top_k(joined, k)
    scored = parts.join(checkpoint(found), "set").groupBy("query_id", "id").agg(F.max("n").cast("long").alias("score"))
    return top_k(scored.unionByName(joined), k)


def reasoning_paths(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """query_id, facts: the first k edges inside a query's nodes as text, by the rank of both ends.

    edges: a, b (a < b), label.  Lines are ordered by the left end's rank, then the right end's, then names.
    """
    own = nodes.select("query_id", "node_id").where(~F.col("node_id").startswith("chunk:"))
    own = own.join(ranks.select("query_id", "node_id", "x"), ["query_id", "node_id"], "left")
    # a query's own pairs look for edges: edges at one node are never formed for each query that has it
    pairs = own.toDF("query_id", "a", "xa").join(own.toDF("query_id", "b", "xb"), "query_id").where("a < b")
    inside = pairs.join(edges, ["a", "b"])
    zero = lambda c: F.desc(F.round(F.coalesce(c, F.lit(0.0)), 12))
    lines = top_k(inside.withColumn("id", F.concat_ws("|", "a", "b")), k, order=[zero("xa"), "a", zero("xb"), "b"])
    text = F.concat(F.lit("("), "a", F.lit(" [SEP] "), "label", F.lit(" [SEP] "), "b", F.lit(")"))
    facts = F.array_sort(F.collect_list(F.struct("rank", text.alias("line"))))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(facts, lambda f: f["line"]), "\n").alias("facts"))


def rerank_merge(candidates: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The k best by a model's score, then the unscored in their own order.  candidates: query_id, id, pos."""
    rows = candidates.join(scores.select("query_id", "id", "score"), ["query_id", "id"], "left")
    return top_k(rows, k, order=[F.col("score").isNull(), F.desc("score"), "pos"])


def claims(wanted: DataFrame, each: int, *, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Who gets which sentence, if the strongest choose first and take their ``each`` best that are left.

    wanted: query_id, key, strength, sentence_id, score.  All sentences rank entities alike, so the outcome is the one stable
    assignment, found by deferred acceptance: every entity asks for its ``each`` best sentences that have not refused it, every
    sentence keeps its strongest asker and refuses all weaker ones at once, until no entity was refused.  Order: strength and score
    falling, then key and sentence_id.
    """
    weak = F.struct((-F.col("strength")).alias("s"), F.col("key").alias("k"))
    left = checkpoint(wanted.select("query_id", "key", "strength", "sentence_id", "score"))
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "sentence_id")
    while True:
        asked = left.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= each).drop("_r")
        held = checkpoint(asked.groupBy("query_id", "sentence_id").agg(F.min(weak).alias("_held")))
        kept = left.join(held, ["query_id", "sentence_id"], "left").where(F.col("_held").isNull() | (weak <= F.col("_held")))
        kept = checkpoint(kept.withColumn("_mine", F.coalesce(weak == F.col("_held"), F.lit(False))))
        # an entity that was refused asks again; with all refusals gone, what is asked for is what is held
        again = kept.withColumn("_r", F.row_number().over(best)).where((F.col("_r") <= each) & ~F.col("_mine"))
        if again.isEmpty():
            return kept.where("_mine").drop("_held", "_mine")
        left = kept.drop("_held", "_mine")


def activate(
    seeds: DataFrame, sentences: DataFrame, *, checkpoint: Callable[[DataFrame], DataFrame], rounds: int = 3, threshold: float = 0.5, per_entity: int = 3
) -> DataFrame:
    """query_id, key, score: entities reached from the seeds over sentences, each with its largest score.

    In each of ``rounds`` - 1 rounds the entities that the round before reached with the threshold or more claim sentences
    (``claims``), and a claimed sentence gives all its entities the claimant's score times its own similarity, if that meets the
    threshold.  seeds: query_id, key, score; sentences: query_id, key, sentence_id, score (similarity to the query).
    """
    pairs = checkpoint(sentences.groupBy("query_id", "key", "sentence_id").agg(F.max("score").alias("score")))
    current = checkpoint(seeds.groupBy("query_id", "key").agg(F.max("score").cast("double").alias("strength")))
    reached = current
    for _ in range(1, rounds):
        firing = current.where(F.col("strength") >= threshold)
        held = claims(pairs.join(firing, ["query_id", "key"]), per_entity, checkpoint=checkpoint)
        value = F.col("strength") * F.greatest(F.col("score"), F.lit(0.0))
        fired = held.select("query_id", "sentence_id", value.alias("strength")).where(F.col("strength") >= threshold)
        hit = pairs.select("query_id", "sentence_id", "key").join(fired, ["query_id", "sentence_id"])
        current = checkpoint(hit.groupBy("query_id", "key").agg(F.max("strength").alias("strength")))
        reached = reached.unionByName(current)
    return reached.groupBy("query_id", "key").agg(F.max("strength").alias("score"))


def edge_costs(edges: DataFrame, similarity: DataFrame) -> DataFrame:
    """Adds cost: (1 - similarity to the query, from 0 to 1) / 2; without one, what the weight leaves of 1.

    edges: query_id, a, b, weight; similarity: query_id, a, b, score.
    """
    rows = edges.join(similarity, ["query_id", "a", "b"], "left")
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return rows.withColumn("cost", F.coalesce((1 - near) / 2, F.greatest(F.lit(1e-6), 1 - F.least("weight", F.lit(0.99))))).drop("score")
