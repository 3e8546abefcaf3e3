"""The queries of the corpus operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, importance, langid, lm, media, mixture, near, negatives, packing, pii, quality, repeats, shards
from .common import delete, materialize, shared_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row as it is read back after twelve arrivals, eight of a tenth of the documents each and four of a twentieth, and their compaction."""
    part = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % 20
    arrival = F.when(part < 16, F.floor(part / 2)).otherwise(part - 8)
    folder = shared_folder(spark)
    out = materialize(shards.sharded(documents(spark, sf_dir), folder, arrival, target_bytes=32 << 20).select("doc_id", "n_bytes", "text_sha256", "arrival_rows", "table_rows"))
    delete(spark, [folder])
    return out


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.importance(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10, least_words=20, seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(documents(spark, sf_dir), weights=(1, 2, 3), most=3).select("doc_id", "size", "source_size", "target", "taken")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), every=50, positives=5, negatives=3, low=50, high=95)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_array_dedup, op2_sharding, op3_language_id, op4_benchmark_decontamination, op5_best_fit_packing, op6_lm_scoring, op7_quality_classifier, op8_minhash_near_dedup, op9_media_columns, op10_pii, op11_importance_resampling, op12_source_mixing, op13_hard_negatives, pipeline)}
SQL: dict[str, str] = {
    "op2_sharding": """
        with parts as (select *, cast('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8) as bigint) % 20 as part from documents),
        arrivals as (select *, case when part < 16 then part // 2 else part - 8 end as arrival from parts)
        select doc_id, cast(strlen(coalesce(text, '')) as bigint) as n_bytes, sha256(coalesce(text, '')) as text_sha256, count(*) over (partition by arrival) as arrival_rows, count(*) over () as table_rows from arrivals
    """,
    "op1_suffix_array_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
        bytes as (select doc_id, i, substr(h, 2 * i + 1, 2) as x, case when i + 100 <= n then md5(substr(h, 2 * i + 1, 200)) end as w from d, unnest(range(n)) as u(i)),
        starts as (select *, w is not null and row_number() over (partition by w order by doc_id, i) > 1 as again from bytes),
        covered as (select *, max(case when again then i end) over (partition by doc_id order by i rows between 99 preceding and current row) is not null as gone from starts),
        edges as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from covered),
        sums as (select doc_id, count_if(gone) as n_removed, count_if(opens) as n_spans, coalesce(string_agg(x, '' order by i) filter (not gone), '') as kept from edges group by doc_id)
        select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join sums using (doc_id)
    """,
    "op8_minhash_near_dedup": """
        with recursive words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
        sets as (
            select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) end as s from words),
        shingles as (select doc_id, len(s) as n, unnest(s) as x from sets),
        links as (
            select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.x = b.x and a.doc_id <> b.doc_id
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach as (select doc_id, doc_id as other from documents union select r.doc_id, l.b from reach r join links l on r.other = l.a),
        least as (select doc_id, min(other) as component_id from reach group by doc_id)
        select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from sets join least using (doc_id)
    """,
    "op11_importance_resampling": """
        with recursive step as (select i as b, cast(i as ubigint) as c, 0 as k from range(256) t(i)
            union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from step where k < 8),
        tab as (select list(c order by b) as t from step where k = 8),
        texts as (select 'd' as side, doc_id, coalesce(text, '') as text from documents union all select 'b', null, coalesce(text, '') from benchmark),
        runs as (select side, doc_id, row_number() over () as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
        words as (select side, r, unnest(w) as w from runs),
        bytes as (select w, i, cast('0x' || substr(hex(encode(w)), 2 * i + 1, 2) as ubigint) as x from (select distinct w from words), unnest(range(strlen(w))) u(i)),
        walk as (select w, list(x order by i) as l from bytes group by w),
        crc as (select w, 1 as i, 4294967295::ubigint as c, l from walk
            union all select w, i + 1, xor(c >> 8, t[cast(xor(c, l[i]) & 255 as bigint) + 1]), l from crc, tab where i <= len(l)),
        buckets as (select w, xor(c, 4294967295::ubigint) % 10000 as b from crc where i = len(l) + 1),
        held as (select side, r, b from words join buckets using (w)),
        counts as (select b, count_if(side = 'd') as s, count_if(side = 'b') as t from held group by b),
        sums as (select count_if(side = 'd') as big_s, count_if(side = 'b') as big_t from held),
        gains as (select b, cast(floor(1000 * ln(((t + 1) * (big_s + 10000))::double / ((s + 1) * (big_t + 10000))::double)) as bigint) as g from counts, sums),
        weights as (select r, cast(floor(sum(g)::double / count(*)) as bigint) as weight from held join gains using (b) where side = 'd' group by r),
        scored as (select doc_id, cast(len(w) as bigint) as n_features, coalesce(weight, 0) as weight,
            coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8) as ubigint) + 0.5::double) / 4294967296::double))) as bigint) as score
            from runs left join weights using (r) where side = 'd'),
        ranked as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as k, count_if(n_features >= 20) over () as n from scored)
        select doc_id, n_features, weight, score, case when n_features >= 20 and k <= 10 * n // 100 then k end as rank from ranked
    """,
    "op12_source_mixing": """
        with docs as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
            md5('2024:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key from documents),
        per as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as number from docs group by source),
        weighed as (select *, 1 + number % 3 as weight from per),
        levels as (select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over closed, 0))::double / (sum(weight) over () - coalesce(sum(weight) over closed, 0))::double as level from weighed
            window closed as (order by source_size / weight, number rows between unbounded preceding and 1 preceding)),
        aims as (select *, least(max(level) over () * weight, (3 * source_size)::double) as target, sum(source_size) over () as total from levels),
        ends as (select *, case when total > 0 then cast(round(sum(target) over (order by number) / total::double * 4294967296) as bigint) else 0 end as high, greatest(1, cast(ceil(total::double / 262144) as bigint)) as block from aims),
        stretches as (select *, lag(high, 1, 0) over (order by number) as low from ends),
        slots as (select i as slot, i * 2654435769 % 4294967296 as point from range((select cast(ceil(max(total)::double / max(block)) as bigint) from ends)) t(i)),
        held as (select number, count(*) as n from slots join stretches on point >= low and point < high group by number),
        plan as (select s.*, cast(ceil(source_size::double / block) as bigint) as blocks, coalesce(n, 0) as n from stretches s left join held using (number)),
        full_plan as (select *, least(n // greatest(blocks, 1), 3) as passes, case when n // greatest(blocks, 1) < 3 then n % greatest(blocks, 1) * block else 0 end as rest from plan),
        placed as (select d.*, p.source_size, p.target, p.passes, p.rest, sum(size) over (partition by p.number order by key, d.doc_id rows unbounded preceding) - size as start from docs d join full_plan p on d.source is not distinct from p.source)
        select doc_id, size, source_size, target, cast(size * passes + greatest(0, least(start + size, rest) - start) as bigint) as taken from placed
    """,
    "op13_hard_negatives": """
        with raw as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
            where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        pairs as (select a.r as ar, a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score from raw a join raw b on a.vec_id % 50 = 0 and a.r <> b.r),
        positives as (select ar, anchor_id, id as positive_id, score as positive_score from pairs where same qualify row_number() over (partition by ar order by score desc, id) <= 5),
        found as (select p.anchor_id, positive_id, positive_score, n.id as negative_id, n.score as negative_score, row_number() over (partition by p.ar, positive_id order by n.score desc, n.id) as rank
            from positives p join pairs n on p.ar = n.ar and not n.same and 50 * positive_score <= 100 * n.score and 100 * n.score <= 95 * positive_score)
        select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from found where rank <= 3
    """,
}
