"""Query of the shards of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainstate.llm.common import table
from brainstate.llm.ring import BITS, SHARDS, VIRTUAL, on_ring

NAME = "op12_ring_shards"
LAW = "rows"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return on_ring(docs).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


_NUMBER = "('0x' || substr(md5({}), 1, 15))::bigint"
#: crc32 of a text's bytes through a table of 256 entries that a rule makes.
_BITS = "list_reduce([x] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"


def _phase(k: int) -> str:
    """The shards of all keys with what is lasts by now, and the turn at which one more shard fills."""
    return f"""
a{k} as materialized (select turn, list_filter(clockwise, lambda s: lasts[s + 1] >= turn)[1] as shard from keyed, f{k}),
h{k} as (select shard, turn from (select *, row_number() over (partition by shard order by turn) as held from a{k}) join cap using (shard), f{k}
         where held = capacity and lasts[shard + 1] = 4611686018427387904 order by turn limit 1),
f{k + 1} as materialized (select case when shard is null then lasts
         else list_transform(lasts, lambda x, i: case when i = shard + 1 then turn else x end) end as lasts from f{k} left join h{k} on true)"""


SQL = f"""
with crc_table as (select list({_BITS} order by x) as v from (select unnest(range(256)) as x)),
docs as (select doc_id, coalesce(text, '') as t from documents),
sized as (select doc_id, strlen(t) + 1 as size,
                 xor(list_reduce([4294967295] || list_transform(range(1, strlen(t) + 1), lambda i: ('0x' || substr(hx, 2 * i - 1, 2))::bigint),
                     lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32
          from (select *, hex(encode(t)) as hx from docs), crc_table),
turns as (select *, row_number() over (order by {_NUMBER.format("'turn/' || coalesce(doc_id::varchar, '')")}, doc_id nulls first, size, text_crc32) - 1 as turn,
                 {_NUMBER.format("'ring/' || coalesce(doc_id::varchar, '')")} as spot from sized),
points as (select s as shard, {_NUMBER.format("s || '/' || v")} as p from (select unnest(range({SHARDS})) as s), (select unnest(range({VIRTUAL})) as v)),
far as (select q.p, x.shard, min(case when x.p >= q.p then x.p - q.p else x.p - q.p + {1 << BITS} end) as d from points q, points x group by all),
ends as (select p, list(shard order by d) as clockwise from far group by p),
keyed as materialized (select turns.*, clockwise from turns join ends
  on p = coalesce((select min(p) from points where p >= spot), (select min(p) from points))),
cap as (select s as shard, n // {SHARDS} + (s < n % {SHARDS})::int as capacity from (select unnest(range({SHARDS})) as s), (select count(*) as n from documents)),
f0 as (select list(case when capacity = 0 then -1 else 4611686018427387904 end order by shard) as lasts from cap),{",".join(map(_phase, range(SHARDS)))}
select doc_id, size, text_crc32, '{LAW}' as law, shard::int as shard, row_number() over (partition by shard order by turn) - 1 as slot, null::int as grown_shard
from (select keyed.*, list_filter(clockwise, lambda s: lasts[s + 1] >= turn)[1] as shard from keyed, f{SHARDS})
"""
