"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact_dedup import exact_dedup

    out = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


OP6_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents),
g as (select body, min(doc_id) as keep_id, count(*) as group_size from t group by body)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.body) as text_sha256
from t join g on t.body = g.body
"""

QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {"op6_exact_dedup": OP6_SQL}


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import Workspace
    from tidemark.llm.warc import archive_pages, read_archives

    ws = Workspace(spark, "op4")
    archive_pages(table(spark, sf_dir, "pages"), ws.path("archives"), min_bytes=0, ws=ws)
    records = read_archives(spark, ws.path("archives"))
    return records.select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
h as (select page_id, strlen(body) as payload_bytes, sha1(body) as hex, cast(cast(unhex(sha1(body)) as bit) as varchar) as bits from p),
f as (select hex, min(page_id) as first_id from h group by hex)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * cast(substr(bits, 5 * i + 1, 1) as bigint) + 8 * cast(substr(bits, 5 * i + 2, 1) as bigint) + 4 * cast(substr(bits, 5 * i + 3, 1) as bigint)
    + 2 * cast(substr(bits, 5 * i + 4, 1) as bigint) + cast(substr(bits, 5 * i + 5, 1) as bigint), 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from h join f using (hex)
"""


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.maxscore import topk_inner_product

    return topk_inner_product(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


OP5_SQL = """
with v as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.row, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.row <> c.row where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by row order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""

QUERIES |= {"op4_warc": op4_warc, "op5_topk": op5_topk}
ORACLES |= {"op4_warc": OP4_SQL, "op5_topk": OP5_SQL}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack, token_pieces

    return pack(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048), 2048)


QUERIES |= {"op1_packing": op1_packing}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix, source_rates

    docs = table(spark, sf_dir, "documents")
    return mix(docs, source_rates(docs, alpha=0.7), seed=17).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.round("mix_rate", 9).alias("rate"), F.col("mix_copy").alias("copy"), F.col("mix_key").alias("shuffle_key"))


OP8_SQL = """
with d as (select doc_id, coalesce(source, '') as source, strlen(coalesce(text, '')) + 1 as n from documents),
b as (select source, cast(sum(n) as double) as bytes from d group by source),
r as (select source, pow(bytes, 0.7) / (select sum(pow(bytes, 0.7)) from b) * (select sum(bytes) from b) / bytes as rate from b),
u as (select doc_id, source, rate, cast(('0x' || substr(md5('17|' || doc_id || '|1'), 1, 13)) as bigint) / 4503599627370496.0 as u from d join r using (source)),
c as (select *, (select count(*) from range(0, 80) k(i) where u > (select sum(exp(-rate) * pow(rate, j) / gamma(j + 1.0)) from range(0, 80) t(j) where j <= i)) as n from u)
select doc_id, source, round(rate, 9) as rate, cast(copy as integer) as copy,
  cast(('0x' || substr(md5('17|' || doc_id || '|' || copy || '|order'), 1, 15)) as bigint) as shuffle_key
from c, lateral (select unnest(range(1, n + 1)) as copy)
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), key="0123-fixture-key").withColumnRenamed("id", "doc_id")


QUERIES |= {"op8_mixing": op8_mixing, "op9_pii": op9_pii}
ORACLES |= {"op8_mixing": OP8_SQL}


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), percent=75).withColumnRenamed("id", "doc_id")


QUERIES |= {"op7_near_dedup": op7_near_dedup}


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import quality_selection

    return quality_selection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


QUERIES |= {"op3_quality": op3_quality}


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), width=100)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES |= {"op2_suffix_dedup": op2_suffix_dedup}


def op10_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.hpylm import score_texts

    return score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES |= {"op10_hpylm": op10_hpylm}


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_dedup import dedup_lines

    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
with d as (select row_number() over () as row, doc_id, coalesce(doc_id, -9223372036854775808) as id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select row, id, pos, lines[pos] as line,
  translate(trim(lines[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select *, unnest(range(1, len(lines) + 1)) as pos from d)),
k as (select key, max(id) as last from l where length(key) >= 20 group by key having count(distinct id) >= 3),
s as (select row, pos, line, coalesce(l.id < k.last, false) as gone from l left join k using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, cast(count_if(gone) as bigint) as n_dropped,
  sha256(coalesce(array_to_string(list(line order by pos) filter (where not gone), chr(10)), '')) as kept_sha256
from s join d using (row) group by row
"""

QUERIES |= {"op11_line_dedup": op11_line_dedup}
ORACLES |= {"op11_line_dedup": OP11_SQL}


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.merkle import leaf_digest, manifest

    doc_id = F.col("doc_id").cast("string")
    found = F.when(F.crc32(doc_id.cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = lambda text: leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    out = manifest(table(spark, sf_dir, "documents"), "source", "doc_id", fields(F.col("text")), fields(found))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")


def _merkle_sql() -> str:
    enc = lambda c: f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end"
    leaf = lambda text: f"sha256({' || '.join(enc(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    bit = "list_reduce(list_prepend(xor(c, b), [0::bigint,0,0,0,0,0,0,0]), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))"
    crc = f"list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda s: ascii(s)::bigint)), lambda c, b: {bit})"
    up = "select t, lvl + 1, i // 3, sha256(string_agg(h, '' order by i)), (any_value(n) + 2) // 3 from {0} where n > 1 group by t, lvl, i // 3"
    return f"""
with recursive d as (select *, case when xor({crc}, 4294967295) % 2 = 0 then replace(text, chr(10), '') else text end as found from documents),
l as (select doc_id, {leaf('text')} as leaf, {leaf('found')} as changed, dense_rank() over (order by source nulls first) - 1 as t,
  row_number() over (partition by source order by doc_id nulls first) - 1 as i, count(*) over (partition by source) as n from d),
a as (select t, 0::bigint as lvl, i, leaf as h, n from l union all {up.format('a')}),
s as (select h, t as i, count(*) over () as n from a where n = 1),
b as (select 0::bigint as t, 0::bigint as lvl, i, h, n from s union all {up.format('b')}),
w as (select t, lvl, i, h, n from a where n > 1 union all select x.t, b.lvl + 1000, b.i, b.h, b.n from b, (select distinct t from l) x where b.n > 1),
p as (select doc_id, l.t, l.changed, l.i as leaf_i, w.lvl, w.i, w.h, case when w.lvl < 1000 then (l.i // cast(pow(3, w.lvl) as bigint)) else l.t // cast(pow(3, w.lvl - 1000) as bigint) end as own from l join w on l.t = w.t
  and w.i // 3 = (case when w.lvl < 1000 then (l.i // cast(pow(3, w.lvl) as bigint)) else l.t // cast(pow(3, w.lvl - 1000) as bigint) end) // 3),
g as (select doc_id, lvl, coalesce(string_agg(h, '' order by i) filter (where i < own), '') as pre, coalesce(string_agg(h, '' order by i) filter (where i > own), '') as post from p group by doc_id, lvl),
f as (select doc_id, list({{'h': '', 'pre': pre, 'post': post}} order by lvl) as steps from g group by doc_id)
select l.doc_id, leaf, s.h as subroot, (select h from b where n = 1) as root,
  sha256(coalesce(array_to_string(list_transform(steps, lambda x: x.pre || x.post), ''), '')) as proof_sha256,
  list_reduce(list_prepend({{'h': changed, 'pre': '', 'post': ''}}, coalesce(steps, [])), lambda q, x: {{'h': sha256(x.pre || q.h || x.post), 'pre': '', 'post': ''}}).h as folded_root, folded_root = (select h from b where n = 1) as verified
from l join s on l.t = s.i left join f using (doc_id)
"""


QUERIES |= {"op12_manifest": op12_manifest}
ORACLES |= {"op12_manifest": _merkle_sql()}


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.treap import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


OP13_SQL = r"""
with t as (select 'd' as kind, row_number() over (order by doc_id) as row, doc_id as id, text from documents
  union all select 'i', row_number() over (order by item_id), item_id, text from benchmark),
x as materialized (select kind, row, any_value(id) as id, term, count(*) as tf from (select kind, row, id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from t) group by kind, row, term),
n as (select row, cast(sum(tf) as bigint) as n from x where kind = 'd' group by row),
g as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from n),
f as (select term, count(*) as df from x where kind = 'd' group by term),
w as (select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double)) as bigint) as w from f, g),
m as (select row, 100 - 25 + ((25 * n * docs) // terms) as m from n, g),
s as (select i.row as item, any_value(i.id) as item_id, d.row as doc, any_value(d.id) as doc_id,
  cast(sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * m))) as bigint) as score
  from x i join x d on i.term = d.term join w on w.term = d.term join m on m.row = d.row where i.kind = 'i' and d.kind = 'd' group by i.row, d.row),
r as (select *, row_number() over (partition by item order by score desc, doc_id nulls last, doc) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 20
"""

QUERIES |= {"op13_treap_search": op13_treap_search}
ORACLES |= {"op13_treap_search": OP13_SQL}
