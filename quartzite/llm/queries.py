"""The queries of this subpackage, one per operator, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_join, exact_dedup, filter_audit, line_dedup, mixing, ngram_join, packing, quality, secrets, sentencepiece_sampling, sharding, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    back = warc.responses(spark, path)
    revisit = F.col("record_type") == "revisit"
    return back.select(
        "page_id",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
    )


OP1_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
k as (select page_id, octet_length(body) as payload_bytes, sha1(body) as payload_digest from p),
w as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as winner from k)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> winner then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> winner then winner end as refers_to
from w
"""


def piece_model(spark: SparkSession, name: str = "piece_bpe_32k.model") -> str:
    """Sends a model of the folder in spark.quartzite.tokenizers to all executors; the name by which they find it."""
    spark.sparkContext.addFile(f"{spark.conf.get('spark.quartzite.tokenizers', '/opt/tokenizers')}/{name}")
    return name


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.segmentations(table(spark, sf_dir, "documents"), piece_model(spark), with_ids="packed")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from d join g using (t)
"""


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, case when len(words) = 0 then []::varchar[] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as grams from w),
g as (select doc_id, unnest(grams) as gram from s),
c as (select a.doc_id as x, b.doc_id as y, count(*) as n from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
l as (select x, y from c join s p on p.doc_id = x join s q on q.doc_id = y where 100 * n >= 80 * (len(p.grams) + len(q.grams) - n)),
r(x, y) as (select doc_id, doc_id from s union select r.x, l.y from r join l on r.y = l.x)
select doc_id, cast(len(grams) as bigint) as n_shingles, component_id from s join (select x, min(y) as component_id from r group by x) on x = doc_id
"""


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found_secrets(table(spark, sf_dir, "documents")).drop("found")


def op6_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
r(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.y from r join l on r.y = l.x),
c as (select x, min(y) as component_id from r group by x),
n as (select x, count(*) as n_links from l group by x)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from embeddings left join n on n.x = vec_id join c on c.x = vec_id
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    done = quality.scored(docs, model)
    return done.select("doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("starts")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = line_dedup.without_boilerplate(pages, line_dedup.html_lines(F.col("html")), line_dedup.host_of(F.col("url")))
    return done.select(F.col("row.page_id").alias("page_id"), "host", "host_pages", "n_lines", "n_dropped", F.coalesce("clean", F.lit("")).alias("clean"))


OP9_SQL = r"""
with p as (select page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) as host,
    list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines
  from pages),
h as (select host, count(*) as host_pages from p group by host),
l as (select host, line, count(*) as n from (select host, unnest(list_distinct(lines)) as line from p) group by host, line),
b as (select host, list(line) as dropped from l join h using (host) where n >= 2 and n > host_pages * cast(0.5 as double) group by host),
k as (select page_id, host, host_pages, lines, case when dropped is null then lines else list_filter(lines, lambda x: not list_contains(dropped, x)) end as kept
  from p join h using (host) left join b using (host))
select page_id, host, host_pages, cast(len(lines) as int) as n_lines, cast(len(lines) - len(kept) as int) as n_dropped, coalesce(array_to_string(kept, chr(10)), '') as clean from k
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = sharding.slots(sharding.write_shards(docs))
    return done.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_grown").alias("grown_shard"))


OP8_SQL = """
with recursive d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    md5('mix:' || coalesce(cast(doc_id as varchar), '')) as turn from documents),
s as (select source, sum(size)::bigint as source_size, count(*) as docs, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from d group by source),
c as (select *, source_size * 3 as cap from s),
r as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over (order by cap::double / weight, source nulls last rows between current row and unbounded following) as weights_left,
    row_number() over (order by cap::double / weight, source nulls last) as rank from c),
f as (select *, min(case when rest * weight <= cap * weights_left then rank end) over () as first from r),
t as (select source, source_size, docs, case when source_size = 0 then 0.0::double when rank < coalesce(first, 2147483647) then cap::double
    else (weight * max(case when rank = first then rest end) over ())::double / (max(case when rank = first then weights_left end) over ())::double end as target from f),
e as (select *, sum(target) over (order by source nulls last rows between unbounded preceding and current row) as upper from t),
n as (select sum(target) as whole, ceil(sum(target) / 256)::bigint as slots from t),
p as (select ((id + 1) * 0.6180339887498949::double - floor((id + 1) * 0.6180339887498949::double)) * whole as point from n, range(0, slots) as g(id)),
b as (select source, count(*) as blocks from p join e on point >= upper - target and point < upper group by source),
k as (select t.*, least(coalesce(blocks, 0) * 256, source_size * 3) as take from t left join b on t.source is not distinct from b.source),
o as (select d.*, source_size, target, take, coalesce(sum(size) over (partition by d.source order by turn, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start
  from d join k on d.source is not distinct from k.source)
select doc_id, size, source_size, target, cast(take // greatest(source_size, 1) * size + greatest(0, least(size, take % greatest(source_size, 1) - start)) as bigint) as taken from o
"""

def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by t) as first from d),
k as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (select part, case when len(words) < 200 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
    + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when w.doc_id > first then 16 else 0 end as mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from w left join k on k.doc_id = w.doc_id),
c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, mask),
x as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as v(letter, bit)),
o as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from x a join x b on b.bit <> a.bit
    join x c on c.bit not in (a.bit, b.bit) join x d on d.bit not in (a.bit, b.bit, c.bit) join x e on e.bit not in (a.bit, b.bit, c.bit, d.bit)),
s as (select filter_order, step, bits[step] as bit, list_sum(bits[1:step]) - bits[step] as before from o, (values (1), (2), (3), (4), (5)) as v(step)),
r as (select part, filter_order, step, bit, sum(case when (mask & (before + bit)) = 0 then n else 0 end) as kept,
    sum(case when (mask & before) = 0 and (mask & bit) > 0 then n else 0 end) as removed, sum(case when (mask & before) > 0 and (mask & bit) > 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails, sum(case when (mask & before) = 0 and (mask & bit) > 0 then good else 0 end) as good_lost,
    sum(case when (mask & before) = 0 and (mask & bit) > 0 then toxic else 0 end) as toxic_lost from c, s group by part, filter_order, step, bit)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) as shapley from r
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = packing.packed(table(spark, sf_dir, "documents"), piece_model(spark, "byte_bpe_50k.json"))
    return done.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {"op1_warc": op1_warc, "op2_sentencepiece": op2_sentencepiece, "op3_exact_dedup": op3_exact_dedup, "op4_ngram_join": op4_ngram_join, "op5_secrets": op5_secrets, "op6_embedding_join": op6_embedding_join, "op7_quality": op7_quality, "op8_mixing": op8_mixing, "op9_line_dedup": op9_line_dedup, "op10_sharding": op10_sharding, "op11_filter_audit": op11_filter_audit, "op12_whitening": op12_whitening, "op13_packing": op13_packing}
ORACLE = {"op1_warc": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op4_ngram_join": OP4_SQL, "op6_embedding_join": OP6_SQL, "op8_mixing": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_filter_audit": OP11_SQL}
