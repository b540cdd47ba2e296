"""The queries of the training-data operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import archive, backoff, decontaminate, imatch, lexical_search, minhash, packing, sharding, spelling, stream_dedup, suffix_dedup, token_rollup, toxicity
from .common import perhaps, stage, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = archive.write_archives(spark, pages, scratch_path(spark, "warc"))
    records = archive.read_archives(spark, manifest, payload=False)
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast("long").alias("refers_to"))


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: all are inserted; copies of a text with a smaller id are deleted (sent
    twice); the rest of low labelled quality is counted anew with another tokenizer. The result is the totals."""
    first, second = "word_bpe_49k", "byte_bpe_50k"
    body = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").withColumn("d1", F.xxhash64(body)).withColumn("d2", F.xxhash64(F.lit(17), body))
    low = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    text, keep = ["d1", "d2"], ["doc_id", "source", "lang", "d1", "d2"]
    counted = stage(spark, token_rollup.with_tokens(docs, token_rollup.word_counter(tokenizer_file(f"{first}.json")), keep), "token-counts")
    copies = counted.groupBy(*text).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    gone = counted.join(copies, text).filter("doc_id > least")
    left = counted.join(low, "doc_id").join(copies, text, "left").filter("least is null or doc_id <= least")
    again = perhaps(docs.select("doc_id", *text, "text"), low, "doc_id").join(low, "doc_id").distinct()
    again = token_rollup.with_tokens(again, token_rollup.library_counter(tokenizer_file(f"{second}.json")), ["doc_id", *text])
    changed = stage(spark, left.join(again.withColumnRenamed("tokens", "new_tokens"), ["doc_id", *text]), "token-recounts")

    rollup = token_rollup.Rollup(spark, scratch_path(spark, f"token-rollup-{uuid.uuid4().hex}"))
    rollup.commit(1, token_rollup.signed(counted, 1, first))
    rollup.commit(2, token_rollup.signed(gone, -1, first))
    rollup.commit(2, token_rollup.signed(gone, -1, first))
    rollup.commit(3, token_rollup.revised(changed, first, "tokens", second, "new_tokens"))
    return rollup.totals()


def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.histogram_sort(spark, table(spark, sf_dir, "documents"), shards=16)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))


def op6_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classifier = toxicity.train(docs, table(spark, sf_dir, "labels"), may_learn=toxicity.fold() != 1)
    return (toxicity.score(spark, docs, classifier, threshold=0.7)
            .select("doc_id", (toxicity.fold() == 1).alias("held_out"), "score", "predicted"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"),
                          capacity=4096, end_id=1, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(spark, table(spark, sf_dir, "documents"), with_text=False)


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.score(spark, table(spark, sf_dir, "documents"), order=3)
    return scored.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op10_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), similarity=0.8)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spark, table(spark, sf_dir, "documents"), least_length=5, least_count=3, ratio=2)


def op13_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = scratch_path(spark, f"stream-dedup-{uuid.uuid4().hex}")
    found = stream_dedup.Deduplicator(spark, f"{sf_dir.rstrip('/')}/documents.parquet", home)
    found.ingest()
    return found.decisions().select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_warc": op2_warc,
    "op3_token_rollup": op3_token_rollup,
    "op4_circulant_minhash": op4_circulant_minhash,
    "op5_histogram_sort": op5_histogram_sort,
    "op6_nnpu_toxicity": op6_nnpu_toxicity,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_imatch": op8_imatch,
    "op9_stupid_backoff": op9_stupid_backoff,
    "op10_cgk_decontamination": op10_cgk_decontamination,
    "op11_lexical_search": op11_lexical_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_stream_dedup": op13_stream_dedup,
}

# DuckDB SQL for the queries that need no tokenizer, trained weights or hash of Spark's own.
_OP1_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, i, md5(substr(h, cast(2 * i + 1 as integer), 400)) as k
      from (select doc_id, h, unnest(range(0, n - 199)) as i from d where n >= 200)),
r as (select k from w group by k having count(*) > 1),
s as (select w.doc_id, w.i from w join r on w.k = r.k),
g as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end as new from s),
b as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from g),
spans as (select doc_id, min(i) as a, max(i) + 200 as z from b group by doc_id, run),
gaps as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) as a, a as z from spans
         union all select d.doc_id, coalesce(max(s.z), 0), max(d.n) from d left join spans s on s.doc_id = d.doc_id group by d.doc_id),
kept as (select g.doc_id, string_agg(substr(d.h, cast(2 * g.a + 1 as integer), cast(2 * (g.z - g.a) as integer)), '' order by g.a) as h
         from gaps g join d on d.doc_id = g.doc_id group by g.doc_id)
select d.doc_id, d.n as n_bytes, cast(coalesce((select sum(z - a) from spans s where s.doc_id = d.doc_id), 0) as bigint) as n_removed,
(select count(*) from spans s where s.doc_id = d.doc_id) as n_spans, sha256(unhex(kept.h)) as kept_sha256
from d join kept on kept.doc_id = d.doc_id
"""

_OP2_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
f as (select page_id, h, sha1(h) as s, min(page_id) over (partition by h) as first from p)
select page_id, strlen(h) as payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  cast(((cast('0x' || substr(s, cast((i // 4) * 5 + 1 as integer), 5) as integer) >> cast(15 - 5 * (i % 4) as integer)) & 31) + 1 as integer), 1)), '')
  as payload_digest,
case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id = first then null else first end as refers_to
from f
"""

_OP4_SQL = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as i from t where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
link as (select a.doc_id as x, b.doc_id as y from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id
         join n nb on nb.doc_id = b.doc_id group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach as (select doc_id as x, doc_id as y from t union select r.x, l.y from reach r join link l on l.x = r.y),
c as (select x as doc_id, min(y) as component_id from reach group by x)
select t.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, t.doc_id = c.component_id as kept
from t join c on c.doc_id = t.doc_id left join n on n.doc_id = t.doc_id
"""

# white space as the operator splits it; sums are rounded on both sides
_OP9_SQL = r"""
with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')
  as w from documents),
tok as (select doc_id, w[i] as w3, case when i > 1 then w[i - 1] end as w2, case when i > 2 then w[i - 2] end as w1
        from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from t)),
total as (select count(*) as total from tok),
c1 as (select w3 as w, count(*) as c from tok group by w3),
c2 as (select w2 as a, w3 as b, count(*) as c from tok where w2 is not null group by w2, w3),
c3 as (select w1, w2, w3, count(*) as c from tok where w1 is not null group by w1, w2, w3),
s as (select tok.doc_id, tok.w1, tok.w2, ln(u.c) - ln(total) as uni,
      case when b.c >= 2 then ln(b.c) - ln(ub.c) else ln(0.4) + ln(u.c) - ln(total) end as bi,
      case when t3.c >= 2 then ln(t3.c) - ln(bc.c) end as tri
      from tok cross join total join c1 u on u.w = tok.w3 left join c1 ub on ub.w = tok.w2 left join c2 b on b.a = tok.w2 and b.b = tok.w3
      left join c2 bc on bc.a = tok.w1 and bc.b = tok.w2 left join c3 t3 on t3.w1 = tok.w1 and t3.w2 = tok.w2 and t3.w3 = tok.w3),
p as (select doc_id, case when w2 is null then uni when w1 is null then bi else coalesce(tri, ln(0.4) + bi) end as v from s),
g as (select doc_id, count(*) as n, sum(v) as v from p group by doc_id)
select d.doc_id, cast(coalesce(g.n, 0) as bigint) as n_tokens, round(coalesce(g.v, 0), 4) + 0.0 as log_score, round(g.v / g.n, 6) as mean_log_score
from (select distinct doc_id from documents) d left join g on g.doc_id is not distinct from d.doc_id
"""

_OP11_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents where text is not null),
s as (select count(*) as docs, sum(len(t)) as terms from d where len(t) > 0),
tf as (select r, doc_id, len(t) as n, w, count(*) as tf from (select r, doc_id, t, unnest(t) as w from d) group by r, doc_id, len(t), w),
df as (select w, count(*) as df from tf group by w),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from benchmark),
p as (select r, doc_id, tf.w, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * df + 1))) as bigint)
        * ((1000000000 * tf) // (1000 * tf + 8 * cast(10 + (90 * n * docs) // terms as bigint))) as part from tf join df on df.w = tf.w cross join s),
sc as (select item_id, r, doc_id, cast(sum(part) as bigint) as score from i join p on p.w = i.w group by item_id, r, doc_id having sum(part) > 0)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from sc) where rank <= 10
"""

_OP13_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from t
"""

ORACLE: dict[str, str] = {
    "op1_suffix_dedup": _OP1_SQL,
    "op2_warc": _OP2_SQL,
    "op4_circulant_minhash": _OP4_SQL,
    "op9_stupid_backoff": _OP9_SQL,
    "op11_lexical_search": _OP11_SQL,
    "op13_stream_dedup": _OP13_SQL,
}
