"""Query of the Merkle manifest of all documents, with some of their copies tampered with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainstate.llm.common import table
from brainstate.llm.merkle import FIELDS, manifest, proof_digest

NAME = "op11_merkle_manifest"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    count = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return manifest(docs, tampered={"n_chars": count}).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified"
    )


def _leaf(count: str) -> str:
    values = [f"{c}::varchar" for c in ("doc_id", "source", "lang", count, "text")]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


#: crc32 of a decimal number, byte by byte, bit by bit.
_BITS = "list_reduce([x] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
_CRC = f"""bytes as (select x as b, {_BITS} as v from (select unnest(range(256)) as x)),
crc as (
  select id, i, 4294967295::bigint as c from (select distinct doc_id as id, 0 as i from documents where doc_id is not null)
  union all
  select id, i + 1, xor(c >> 8, v) from crc join bytes on bytes.b = xor(c & 255, ascii(substr(id::varchar, i + 1, 1))) where i < length(id::varchar)),
hit as (select id from crc where i = length(id::varchar) and xor(c, 4294967295) % 7 = 0)"""

SQL = f"""
with recursive {_CRC},
leaves as (
  select doc_id, coalesce('=' || lang, '') as g, {_leaf("n_chars")} as leaf,
         case when doc_id in (select id from hit) then {_leaf("(n_chars + 1)")} else {_leaf("n_chars")} end as copy
  from documents),
placed as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n from leaves),
tree as (
  select g, 0 as lvl, pos, n, leaf as node from placed
  union all
  select g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' order by pos)) from tree where n > 1 group by g, lvl, pos // 2, n),
subs as (select g, node as subroot, row_number() over (order by g) - 1 as pos, count(*) over () as n from tree where n = 1),
top as (
  select 0 as lvl, pos, n, subroot as node from subs
  union all
  select lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' order by pos)) from top where n > 1 group by lvl, pos // 2, n),
nodes as (select * from tree union all select '*', * from top),
walk as (
  select doc_id, g as home, g, 0 as lvl, pos, n, leaf, pos as start, copy as now, '' as proof from placed
  union all
  select doc_id, home, case when n > 1 then w.g else '*' end, case when n > 1 then lvl + 1 else 0 end,
         case when n > 1 then pos // 2 else (select s.pos from subs s where s.g = w.g) end,
         case when n > 1 then (n + 1) // 2 else (select count(*) from subs) end, leaf, start,
         case when n = 1 then now when pos % 2 = 0 then sha256(now || coalesce(sib, '')) else sha256(coalesce(sib, '') || now) end,
         proof || coalesce(sib, '')
  from (select w.*, s.node as sib from walk w left join nodes s
        on s.g = w.g and s.lvl = w.lvl and w.n > 1 and s.pos = case when w.pos % 2 = 0 then w.pos + 1 else w.pos - 1 end) w
  where n > 1 or w.g <> '*')
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, now as folded_root, now = root as verified
from walk join subs on subs.g = home, (select node as root from top where n = 1)
where walk.g = '*' and walk.n = 1
"""
