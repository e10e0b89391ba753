"""Queries over the driver's tables, one for each operator.

The first ten have no SQL oracle: their results (BPE counts, XXH64 fingerprints, trained
scores, permutations, byte runs) have no SQL counterpart. tests/llm holds them
against brute force, the libraries themselves, or held-out labels. The others are
held against SQL as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import token_counts

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hexed, near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import taken

    return taken(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import formatted

    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import edited_fingerprints

    return edited_fingerprints(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_scores

    return lm_scores(documents(spark, sf_dir))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bwt_dedup import digests

    return digests(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The rules (host, path, verdict) that the query judges by, and labels of hosts whose pages it lists.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LISTED_LABELS = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged, parts

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.sql(f"select * from values {', '.join(map(str, URL_RULES))} as r(host, path, verdict)")
    listed = pages.filter(F.arrays_overlap(F.split(parts(F.col("url"))[0], r"\."), F.array(*map(F.lit, LISTED_LABELS)))).select("url")
    return judged(pages, rules, listed)


def op12_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .product_codes import encoded, with_label_errors

    return with_label_errors(encoded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import top_documents

    return top_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


_URLS = r"""
with p as (select page_id, url, case when strpos(url, '://') > 0 then substring(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
k as (select *, regexp_replace(host, '^www\.', '') || ' ' || rtrim(path, '/') as canon from h),
listed as (select distinct canon from k where host != '' and len(list_intersect(string_split(host, '.'), [LABELS])) > 0),
rules(rh, rp, v) as (values RULES),
best as (select page_id, host, path, canon, max({l: length(rh || rp), v: v, r: rh || rp}) as b from k left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by all)
select k.page_id, k.host, k.path, (b).r as rule, coalesce((b).v, case when listed.canon is not null then 'block' else 'allow' end) as verdict, listed.canon is not null as is_listed
from k join best using (page_id, host, path) left join listed on k.canon = listed.canon
"""


_ROUND = """
a{0} as materialized (select vec_id, part, min({{d: d, e: entry}}) as best from (select vec_id, part, entry, sum((x - c) * (x - c))::bigint as d from comp join c{0} using (part, place) group by all) group by all),
c{1} as materialized (select part, place, entry, coalesce(n.c, o.c) as c from c{0} o left join
  (select part, best.e as entry, place, floor(sum(x)::double / count(*))::bigint as c from a{0} join comp using (vec_id, part) group by all) n using (part, entry, place)),"""
_CODES = f"""
with kept as (select * from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
comp as materialized (select vec_id, i // (n // 8) as part, i % (n // 8) as place, floor(4096 * x::double)::bigint as x from (select vec_id, len(embedding) as n, unnest(embedding) as x, unnest(range(len(embedding))) as i from kept)),
c0 as (select part, place, entry, x as c from (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit 16) join comp using (vec_id)),
{"".join(_ROUND.format(k, k + 1) for k in range(7))}
coded as (select vec_id, string_agg(printf('%02x', best.e), '' order by part) as code, sum(best.d)::bigint as error from a6 group by all)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, (select sha256(string_agg(c::varchar, ',' order by part, entry, place)) from c6) as codebooks_sha256
from coded join kept using (vec_id)
"""

_SEARCH = r"""
with d as materialized (select *, sum(tf) over (partition by doc_id) as n from (select doc_id, term, count(*) as tf from
  (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents) group by doc_id, term)),
q as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
t as (select count(distinct doc_id) as docs, sum(tf)::bigint as terms from d),
w as (select term, floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * count(*) + 1)))::bigint as w from d, t group by term, docs),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n::bigint * docs) // terms))))::bigint as score from q join d using (term) join w using (term), t group by all)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(str(r) for r in URL_RULES)
    labels = ", ".join(f"'{x}'" for x in LISTED_LABELS)
    return {"op11_url_filter": _URLS.replace("RULES", rules).replace("LABELS", labels), "op12_product_codes": _CODES, "op13_lexical_search": _SEARCH}
