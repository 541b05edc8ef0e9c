"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets.  Sources in code point order, null last, weigh ``WEIGHTS`` in turn and share all tokens;
   a target stops at ``CAP`` times its source's size and the excess is shared by weight again.  With
   sources sorted by cap over weight, the common level is the largest of (T - caps before) over
   (weights from here on), so the whole water-filling is one pass over one row per source.
2. Quotas.  The total, in equal blocks of one token, is allotted to sources by highest quotients
   target / (2k - 1), then within each source to its shards by the same rule, so that the smallest source
   meets its target too.  A shard is a hashed share of a source of about ``shard_docs`` documents, so that
   a hot source spreads over many tasks; one task ranks the shards of a source, a row per 2048 documents.
3. Selection.  A shard's documents stand in seeded order and form one token stream of S tokens, cut in nb
   blocks of ``block``.  A quota of Q tokens takes the whole stream Q div S times and, of one more pass,
   the blocks that a seeded affine permutation of the block numbers puts first, until Q mod S are taken;
   of the last one only the first tokens.

Only rows per source, per shard and per document exist; blocks are numbers inside a document's row.

Texts and other kept columns stay out of all this and rejoin their rows by a row number at the end.

Defined results: null text has size 0 and takes 0; null source is a source of its own, last; rows with null doc_id
are dealt to shards by their text; equal doc_ids are ordered by size too, so reruns agree; no rows give no rows; extra columns are ignored
unless named in ``keep``, which come back as kept_*.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import n_words, stored, table

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 32
SHARD_DOCS = 2048
SEED = 17
#: A prime above any shard's number of blocks, so that multiplying by it permutes them.
PRIME = 2147483647


def hashed(*parts: Column) -> Column:
    """48 bits of md5 over the parts; the same number in any engine with md5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def sainte_lague(df: DataFrame, groups: Sequence[str], order: Sequence[str], weight: str, seats: str, out: str) -> DataFrame:
    """Allot ``seats`` (constant in a group) over the group's rows by highest quotients.

    Every row first gets its rounded-down share less a margin that the true quota never undercuts;
    the seats left go to the highest of the next few quotients.  The number of quotients written out
    is a small multiple of the number of rows.
    """
    all_rows = Window.partitionBy(*groups) if groups else Window.partitionBy()
    n, s = F.col("_n"), F.col(seats)
    share = F.when(F.col("_w") > 0, F.col(weight) * s / F.col("_w")).otherwise(0.0)
    sized = df.withColumns({"_n": F.count(F.lit(1)).over(all_rows), "_w": F.sum(weight).over(all_rows).cast("double")})
    margin = F.when(s > 0, F.lit(1) + F.ceil(n * (share + 1) / s)).otherwise(0).cast("long")
    sized = sized.withColumns({"_m": margin, "_share": share})
    sized = sized.withColumn("_base", F.greatest(F.floor("_share").cast("long") - F.col("_m"), F.lit(0).cast("long")))
    sized = sized.withColumn("_left", s - F.sum("_base").over(all_rows))
    keys = [*groups, *order]
    tries = sized.where(F.col(weight) > 0).select(
        *keys, "_left", F.col(weight).alias("_t"), F.explode(F.expr("sequence(_base + 1, _base + 2 * _m + 2)")).alias("_k")
    )
    ranked = Window.partitionBy(*groups).orderBy(F.desc(F.col("_t") / (2 * F.col("_k") - 1)), *order, "_k")
    won = tries.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= F.col("_left"))
    won = won.groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    joined = sized.join(won, keys, "left")
    return joined.withColumn(out, F.col("_base") + F.coalesce("_won", F.lit(0).cast("long"))).drop(
        "_n", "_w", "_m", "_share", "_base", "_left", "_won"
    )


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources: _null, _src, source_size, _docs (one row each); adds target."""
    order = Window.partitionBy().orderBy("_null", "_src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = sources.withColumn("_weight", w).withColumn("_cap", (F.col("source_size") * cap).cast("double"))
    by_ratio = Window.partitionBy().orderBy(F.col("_cap") / F.col("_weight"), "_null", "_src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    df = df.withColumn("_total", F.sum("source_size").over(whole)).withColumn("_level", level)
    df = df.withColumn("target", F.least("_cap", F.col("_weight") * F.max("_level").over(whole)))
    return df.drop("_weight", "_cap", "_level")


def mix(
    docs: DataFrame,
    *,
    keep: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    block: int = BLOCK,
    shard_docs: int = SHARD_DOCS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, spans and the columns in ``keep``.

    A document is taken ``copies`` times whole and then in ``spans``, (start, end) word numbers.
    """
    kept = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    rows = stored(
        docs.withColumn("_row", F.monotonically_increasing_id()).select(
            "doc_id",
            F.col("source").isNull().alias("_null"),
            F.coalesce("source", F.lit("")).alias("_src"),
            n_words(F.col("text")).alias("size"),
            hashed(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))).alias("_hash"),
            "_row",
            *kept,
        )
    )
    whole, rows = rows, rows.drop(*[f"_keep_{i}" for i in range(len(keep))])  # what is kept rejoins its row at the end
    key = ["_null", "_src"]
    sources = rows.groupBy(*key).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    sources = targets(sources, weights, cap)
    sources = sainte_lague(sources, [], key, "target", "_total", "_quota")
    sources = stored(
        sources.select(*key, "source_size", "target", "_quota", F.ceil(F.col("_docs") / shard_docs).cast("long").alias("_shards"))
    )
    placed = rows.join(sources, key).withColumn("_shard", F.col("_hash") % F.col("_shards"))
    shard_key = [*key, "_shard"]
    shards = placed.groupBy(*shard_key).agg(F.sum("size").alias("_s"), F.first("_quota").alias("_quota"))
    shards = sainte_lague(shards, key, ["_shard"], "_s", "_quota", "_q")
    nb = F.ceil(F.col("_s") / block).cast("long")
    shards = shards.select(*shard_key, nb.alias("_nb"), "_s", "_q")
    shards = shards.withColumn("_full", F.when(F.col("_s") > 0, F.least(F.expr("_q div _s"), F.lit(cap))).otherwise(0).cast("long"))
    shards = shards.withColumn("_rest", F.when(F.col("_full") < cap, F.col("_q") - F.col("_full") * F.col("_s")).otherwise(0))
    shards = shards.withColumn("_shift", F.when(F.col("_nb") > 0, hashed(F.lit(seed), *[F.col(c) for c in shard_key]) % F.col("_nb")))
    # place of the last block in the permutation, and the tokens it lacks
    shards = shards.withColumn("_last", F.when(F.col("_nb") > 0, F.expr(f"((_nb - 1) * ({PRIME}L % _nb) + _shift) % _nb")))
    shards = shards.withColumn("_short", F.col("_nb") * block - F.col("_s")).drop("_s")
    stream = Window.partitionBy(*shard_key).orderBy("_hash", "doc_id", "size")
    stream = stream.rowsBetween(Window.unboundedPreceding, 0)
    out = placed.drop("_quota").withColumn("_hi", F.sum("size").over(stream)).join(shards, shard_key)
    out = out.withColumn("_lo", F.col("_hi") - F.col("size"))
    place = f"((j * ({PRIME}L % _nb) + _shift) % _nb)"
    before = f"({place} * {block} - if({place} > _last, _short, 0L))"  # tokens of the blocks placed earlier
    some = F.expr(f"filter(sequence(_lo div {block}, (_hi - 1) div {block}), j -> {before} < _rest)")
    numbers = F.when((F.col("size") > 0) & (F.col("_rest") > 0), some).otherwise(F.expr("array()").cast("array<bigint>"))
    taken = f"least({block} - if(j = _nb - 1, _short, 0L), _rest - {before})"
    span = F.expr(
        f"filter(transform(_chosen, j -> struct(greatest(j * {block} - _lo, 0L) AS start,"
        f" least(j * {block} + {taken} - _lo, size) AS end)), s -> s.end > s.start)"
    )
    out = out.withColumn("_chosen", numbers).withColumn("spans", span)
    partial = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    out = out.withColumn("taken", F.col("_full") * F.col("size") + partial).withColumn("copies", F.col("_full"))
    plain = ["doc_id", "size", "source_size", "target", "taken", "copies", "spans"]
    if not keep:
        return out.select(*plain)
    texts = whole.select("_row", *[F.col(f"_keep_{i}").alias(f"kept_{c}") for i, c in enumerate(keep)])
    return stored(out.select("_row", *plain)).join(texts, "_row").drop("_row")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _lague_sql(name: str, rows: str, groups: str, order: str, weight: str, seats: str, out: str) -> str:
    part = f"partition by {groups}" if groups else ""
    keys = f"{groups}, {order}" if groups else order
    return f"""
{name}_a as (select *, count(*) over ({part}) n_, cast(sum({weight}) over ({part}) as double) w_ from {rows}),
{name}_b as (select *, case when w_ > 0 then {weight} * {seats} / w_ else 0.0 end share_ from {name}_a),
{name}_c as (select *, cast(case when {seats} > 0 then 1 + ceil(n_ * (share_ + 1) / {seats}) else 0 end as bigint) m_ from {name}_b),
{name}_d as (select *, greatest(cast(floor(share_) as bigint) - m_, 0) base_ from {name}_c),
{name}_e as (select *, {seats} - sum(base_) over ({part}) left_ from {name}_d),
{name}_f as (select {keys}, left_, {weight} t_, unnest(range(base_ + 1, base_ + 2 * m_ + 3)) k_ from {name}_e where {weight} > 0),
{name}_g as (select *, row_number() over ({part} order by t_ / (2 * k_ - 1) desc, {order}, k_) r_ from {name}_f),
{name}_h as (select {keys}, count(*) won_ from {name}_g where r_ <= left_ group by {keys}),
{name} as (select e.*, base_ + coalesce(won_, 0) {out} from {name}_e e left join {name}_h h using ({keys}))"""


def _hash_sql(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"cast('0x' || substr(md5({text}), 1, 12) as bigint)"


OP7_SQL = f"""
with rows_ as (
  select doc_id, source is null null_, coalesce(source, '') src_, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) size,
    {_hash_sql(f"'{SEED}'", "coalesce(cast(doc_id as varchar), md5(coalesce(text, '')))")} hash_ from documents),
s0 as (select null_, src_, cast(sum(size) as bigint) source_size, count(*) docs_ from rows_ group by all),
s1 as (select *, [{", ".join(f"{w}.0::double" for w in WEIGHTS)}][(row_number() over (order by null_, src_) - 1) % {len(WEIGHTS)} + 1] weight_,
  cast(source_size * {CAP} as double) cap_, cast(sum(source_size) over () as bigint) total_ from s0),
s2 as (select *, (total_ - coalesce(sum(cap_) over (order by cap_ / weight_, null_, src_ rows between unbounded preceding and 1 preceding), 0.0))
  / sum(weight_) over (order by cap_ / weight_, null_, src_ rows between current row and unbounded following) level_ from s1),
s3 as (select null_, src_, source_size, docs_, least(cap_, weight_ * max(level_) over ()) target, total_ from s2),
{_lague_sql("s4", "s3", "", "null_, src_", "target", "total_", "quota_")},
placed as (select r.*, s.source_size, s.target, s.quota_, hash_ % cast(ceil(docs_ / {SHARD_DOCS}) as bigint) shard_
  from rows_ r join s4 s using (null_, src_)),
h0 as (select null_, src_, shard_, cast(sum(size) as bigint) s_, first(quota_) quota_ from placed group by all),
{_lague_sql("h1", "h0", "null_, src_", "shard_", "s_", "quota_", "q_")},
h2 as (select null_, src_, shard_, s_, q_, cast(ceil(s_ / {BLOCK}) as bigint) nb_ from h1),
h3 as (select *, case when s_ > 0 then least(q_ // s_, {CAP}) else 0 end full_ from h2),
h4 as (select *, case when full_ < {CAP} then q_ - full_ * s_ else 0 end rest_,
  case when nb_ > 0 then {_hash_sql(f"'{SEED}'", "cast(null_ as varchar)", "src_", "cast(shard_ as varchar)")} % nb_ end shift_ from h3),
h5 as (select *, case when nb_ > 0 then ((nb_ - 1) * ({PRIME} % nb_) + shift_) % nb_ end last_, nb_ * {BLOCK} - s_ short_ from h4),
d0 as (select *, cast(sum(size) over (partition by null_, src_, shard_ order by hash_, doc_id, size rows unbounded preceding) as bigint) hi_ from placed),
d1 as (select d.*, hi_ - size lo_, nb_, full_, rest_, shift_, last_, short_ from d0 d join h5 using (null_, src_, shard_))
select doc_id, cast(size as bigint) size, source_size, target,
  cast(full_ * size + case when size > 0 and rest_ > 0 then coalesce(list_sum(list_transform(
    range(lo_ // {BLOCK}, (hi_ - 1) // {BLOCK} + 1),
    lambda j: greatest(0, least(hi_, j * {BLOCK} + least({BLOCK} - case when j = nb_ - 1 then short_ else 0 end,
      rest_ - (j * ({PRIME} % nb_) + shift_) % nb_ * {BLOCK} + case when (j * ({PRIME} % nb_) + shift_) % nb_ > last_ then short_ else 0 end))
      - greatest(j * {BLOCK}, lo_)))), 0) else 0 end as bigint) taken
from d1
"""
