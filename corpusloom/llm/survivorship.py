"""Golden record survivorship by lexicographic elimination.

A field of a golden record has candidates (rows of the cluster with a value to give) and criteria in falling order of
importance.  A round takes the best value of the next criterion per cluster and field, an aggregate that combines before
the shuffle, and semi-joins the candidates that have it; a cluster's field leaves the rounds once one candidate is
left.  Fields go through their rounds side by side.  A field may depend on the survivor of another: balance
candidates take the chosen segment as their first criterion, so they start when the segments have survived.

Both sides of each join are stored tables with nothing above the join that needs a cluster's rows together, so
adaptive execution splits a cluster that holds a third of all rows, and no join is broadcast.  A task sees sums and
maxima of a hot cluster, never its rows; nothing but the number of rounds (the criteria of the longest field)
depends on the driver.

Defined results: null or blank texts (ASCII white space only) and numbers that are not finite are no values; a field without
candidates is null, and so is its *_from.  Unknown and null sources trust least.  A null client_id is the largest, a null
updated_at the oldest and stale; a cluster without any date is all stale.  Rows whose master_id and client_id are both
null form one cluster, with a null cluster_id.  Rows that tie on all criteria (repeated client_ids) give the smallest of
their values, nulls first.  No rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import stored, table

TRUST = ("crm", "web", "store", "partner")
STALE_HOURS = 60 * 24
#: A criterion that is null loses to all others.
LEAST = -(1 << 63)


@dataclass(frozen=True)
class Field:
    """``values``: columns the survivor gives; ``criteria``: long columns, the larger wins; ``where``: who is a candidate."""

    name: str
    values: tuple[str, ...]
    criteria: tuple[Column, ...]
    where: Column = field(default_factory=lambda: F.lit(True))


def falling(c: Column) -> Column:
    """A long whose order is the reverse of c's; nulls stay the least."""
    return F.bitwise_not(c.cast("long"))


def present(name: str) -> Column:
    """The text as it is, null if it is empty or ASCII white space only."""
    return F.when(F.col(name).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.col(name).cast("string"))


def micros(name: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(`{name}` as timestamp_ntz))")


def trust(name: str, order: Sequence[str] = TRUST) -> Column:
    out = F.lit(0)
    for i, s in enumerate(reversed(order), 1):
        out = F.when(F.col(name) == s, i).otherwise(out)
    return out.cast("long")


def keyed(df: DataFrame, key: Column) -> DataFrame:
    """Adds _none and _key, which are never null, for joins on a key that may be."""
    return df.withColumn("_none", key.isNull()).withColumn("_key", F.coalesce(key, F.lit("0").cast(df.select(key).schema[0].dataType)))


def candidates(rows: DataFrame, fields: Sequence[Field], values: Sequence[str]) -> DataFrame:
    """_none, _key, _field, _criteria, _value: a row for each field that the row is a candidate of."""
    types = {c: rows.schema[c].dataType for c in values}
    one = []
    for f in fields:
        given = F.struct(*[(F.col(c) if c in f.values else F.lit(None).cast(types[c])).alias(c) for c in values])
        ranks = F.array(*[F.coalesce(c.cast("long"), F.lit(LEAST)) for c in f.criteria])
        one.append(F.when(f.where, F.struct(F.lit(f.name).alias("_field"), ranks.alias("_criteria"), given.alias("_value"))))
    return rows.select("_none", "_key", F.inline(F.array_compact(F.array(*one))))


def eliminate(cands: DataFrame, rounds: int) -> DataFrame:
    """The survivors of ``candidates``: one row per cluster and field, several only if all their criteria are equal.

    A round stores the survivors with the number that their group had before it; groups of one are done.
    """
    group = ["_none", "_key", "_field"]
    alive = stored(cands)
    done = []
    for k in range(rounds):
        here = F.coalesce(F.get("_criteria", F.lit(k)), F.lit(LEAST))
        alive = alive.withColumn("_now", here)
        best = stored(alive.groupBy(*group).agg(F.max("_now").alias("_now"), F.count(F.lit(1)).alias("_n")))
        if best.where("_n > 1").isEmpty():
            break
        left = stored(alive.hint("merge").join(best, [*group, "_now"]).drop("_now"))
        done.append(left.where("_n = 1").drop("_n"))
        alive = left.where("_n > 1").drop("_n")
    out = alive.drop("_now")
    for d in done:
        out = out.unionByName(d)
    return out


def survivors(cands: DataFrame, rounds: int) -> DataFrame:
    """_none, _key, _field, _value after elimination; ties of all criteria give the smallest value."""
    return eliminate(cands, rounds).groupBy("_none", "_key", "_field").agg(F.min("_value").alias("_value"))


def client_fields() -> tuple[list[Field], Field]:
    """The rules of a client's golden record: those of the first rounds, and balance, which follows the segment."""
    recent = (F.col("updated"), F.col("trust"), falling(F.col("client_id")))
    trusted = (F.col("fresh"), F.col("trust"), F.col("updated"), falling(F.col("client_id")))
    known = F.col("city").isNotNull().cast("long") + F.col("nation_id").isNotNull().cast("long")
    own = ("client_id",)
    first = [
        Field("segment", ("segment", *own), recent, F.col("segment").isNotNull()),
        Field("email", ("email", *own), trusted, F.col("email").isNotNull()),
        Field("name", ("name", *own), (F.char_length("name"), *trusted), F.col("name").isNotNull()),
        Field("address", ("city", "nation_id", *own), (known, *trusted)),
    ]
    same = F.col("segment").eqNullSafe(F.col("chosen")).cast("long")
    return first, Field("balance", ("balance", *own), (same, *recent), F.col("balance").isNotNull())


def golden_clients(clients: DataFrame, *, stale_hours: int = STALE_HOURS, order: Sequence[str] = TRUST) -> DataFrame:
    """One record per coalesce(master_id, client_id), with the client_id that gave each field."""
    finite = F.col("balance").isNotNull() & ~F.isnan(F.col("balance").cast("double")) & (F.abs(F.col("balance").cast("double")) < float("inf"))
    rows = keyed(clients, F.coalesce("master_id", "client_id")).select(
        "_none",
        "_key",
        "client_id",
        trust("source", order).alias("trust"),
        micros("updated_at").alias("updated"),
        *[present(c).alias(c) for c in ("name", "email", "segment", "city")],
        "nation_id",
        F.when(finite, F.col("balance").cast("double")).alias("balance"),
    )
    group = ["_none", "_key"]
    latest = stored(rows.groupBy(*group).agg(F.max("updated").alias("latest")))
    age = F.col("latest") - F.col("updated")
    dated = rows.hint("merge").join(latest, group).withColumn("fresh", F.coalesce(age <= stale_hours * 3_600_000_000, F.lit(False)).cast("long"))
    first, balance = client_fields()
    values = ["name", "email", "segment", "city", "nation_id", "balance", "client_id"]
    cands = stored(candidates(dated, first, values))
    won = stored(survivors(cands, max(len(f.criteria) for f in first)))
    chosen = stored(won.where("_field = 'segment'").select(*group, F.col("_value.segment").alias("chosen")))
    given = rows.where("balance is not null").hint("merge").join(chosen, group, "left")
    balances = survivors(candidates(given, [balance], values), len(balance.criteria))
    # every row is a candidate of the address, whose second criterion says whether it is fresh
    counted = cands.where("_field = 'address'").select(*group, F.lit(1).alias("_one"), (1 - F.element_at("_criteria", 2)).alias("_stale"))
    out = won.unionByName(balances).select(*group, "_field", "_value").unionByName(counted, allowMissingColumns=True)

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("_field") == name, F.col(f"_value.{column}")))

    empty = of("address", "city").isNull() & of("address", "nation_id").isNull()
    return out.groupBy(*group).agg(
        F.sum("_one").alias("n_records"),
        F.sum("_stale").alias("n_stale"),
        *[of(c, c).alias(c) for c in ("name", "email", "segment")],
        of("address", "city").alias("city"),
        of("address", "nation_id").alias("nation_id"),
        of("balance", "balance").alias("balance"),
        *[of(c, "client_id").alias(f"{c}_from") for c in ("name", "email", "segment", "balance")],
        F.when(~empty, of("address", "client_id")).alias("address_from"),
    ).select(F.when(~F.col("_none"), F.col("_key")).alias("cluster_id"), "*").drop("_none", "_key")


def op11_survivorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = golden_clients(table(spark, sf_dir, "clients"))
    cents = F.floor(100 * F.col("balance") + 0.5).alias("balance_cents")
    froms = [f"{c}_from" for c in ("name", "email", "segment", "balance", "address")]
    return out.select("cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", cents, *froms)


_BLANK = "[^\\x20\\x09-\\x0D]"
_RECENT = "updated_at desc nulls last, trust desc, client_id nulls last"
_TRUSTED = f"fresh desc, trust desc, {_RECENT}"


def _first(name: str, columns: str, order: str, where: str = "true", rows: str = "dated") -> str:
    return f"{name}_s as (select cluster_id, client_id, {columns}, row_number() over (partition by cluster_id order by {order}) r_ from {rows} where {where})"


OP11_SQL = f"""
with cleaned as (
  select coalesce(master_id, client_id) cluster_id, client_id, cast(updated_at as timestamp) updated_at, nation_id, balance,
    case source {" ".join(f"when '{s}' then {len(TRUST) - i}" for i, s in enumerate(TRUST))} else 0 end trust,
    {", ".join(f"case when regexp_matches({c}, '{_BLANK}') then {c} end {c}" for c in ("name", "email", "segment", "city"))}
  from clients),
dated as (select *, case when updated_at >= max(updated_at) over (partition by cluster_id) - interval {STALE_HOURS} hour then 1 else 0 end fresh from cleaned),
{_first("segment", "segment", f"{_RECENT}, segment", "segment is not null")},
{_first("email", "email", f"{_TRUSTED}, email", "email is not null")},
{_first("name", "name", f"length(name) desc, {_TRUSTED}, name", "name is not null")},
{_first("address", "city, nation_id", f"(city is not null)::int + (nation_id is not null)::int desc, {_TRUSTED}, city nulls first, nation_id nulls first")},
priced as (select d.*, s.segment chosen from dated d left join segment_s s on s.cluster_id is not distinct from d.cluster_id and s.r_ = 1
  where d.balance is not null and isfinite(d.balance)),
{_first("balance", "balance", f"(segment is not distinct from chosen)::int desc, {_RECENT}, balance", rows="priced")},
g as (select cluster_id, count(*) n_records, cast(sum(1 - fresh) as bigint) n_stale from dated group by all)
select g.cluster_id, n_records, n_stale, name, email, segment, city, nation_id, cast(floor(100 * balance + 0.5) as bigint) balance_cents,
  n.client_id name_from, e.client_id email_from, s.client_id segment_from, b.client_id balance_from,
  case when city is not null or nation_id is not null then a.client_id end address_from
from g
left join name_s n on n.cluster_id is not distinct from g.cluster_id and n.r_ = 1
left join email_s e on e.cluster_id is not distinct from g.cluster_id and e.r_ = 1
left join segment_s s on s.cluster_id is not distinct from g.cluster_id and s.r_ = 1
left join balance_s b on b.cluster_id is not distinct from g.cluster_id and b.r_ = 1
left join address_s a on a.cluster_id is not distinct from g.cluster_id and a.r_ = 1
"""
