"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfields.llm import lexical
from binfields.llm.clustering import cluster_vectors
from binfields.llm.common import checkpoint, table
from binfields.llm.decontamination import find_contamination, is_contaminated
from binfields.llm.license_scan import licenses, scan_licenses
from binfields.llm.line_dedup import dedup_lines
from binfields.llm.neighbours import nearest_neighbours
from binfields.llm.packing import pack_documents
from binfields.llm.quality import score_quality
from binfields.llm.simhash import near_duplicates
from binfields.llm.suffix_dedup import repeated_spans
from binfields.llm.topk import top_k
from binfields.llm.toxicity import score_toxicity
from binfields.llm.url_filter import judge_urls, rules_frame

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("finds").cast("long").alias("n_finds"),
        F.concat_ws(",", licenses(F.col("finds"))).alias("licenses"),
        F.array_max(F.transform("finds", lambda x: x["coverage"])).alias("coverage"),
        F.concat_ws(";", F.transform("finds", lambda x: F.concat_ws(":", x["license"], x["begin"].cast("string"), x["end"].cast("string")))).alias("spans"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("features")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark, URL_RULES))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_lines",
        F.aggregate("removed_runs", F.lit(0).cast("long"), lambda n, run: n + run["end"] - run["begin"] + 1).alias("n_removed"),
        F.size("removed_runs").cast("long").alias("n_runs"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.concat_ws(",", F.col("evidence.id"), F.col("similar.id")).alias("nearest"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = checkpoint(lexical.build_index(table(spark, sf_dir, "documents")))
    return lexical.search(index, table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(table(spark, sf_dir, "embeddings"))
    told = F.sha2(F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string"))), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", told.alias("centroid_sha256"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_url_filter": op3_url_filter,
    "op4_decontamination": op4_decontamination,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}


def _lloyd_sql(rounds: int = 5) -> str:
    """Rounds of assignment and update, one pair of common tables for each."""
    gap = "cast(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (
    select n, v, vec_id, cluster, distance from (select p.n, p.v, p.vec_id, c.cluster, {gap} as distance from kept p, c{r} c)
    qualify row_number() over (partition by n order by distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} as materialized (
    select cluster, list((s - ((s % m) + m) % m) // m order by place) as v
    from (select cluster, place, cast(sum(x) as bigint) as s, count(*) as m from (select cluster, unnest(range(64)) as place, unnest(v) as x from a{r}) group by cluster, place)
    group by cluster union all select cluster, v from c{r} where cluster not in (select cluster from a{r}))""")
    return ",\n".join(steps)


ORACLE_SQL = {
    "op11_lexical_search": r"""
with doc_terms as (
    select row_number() over () as k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10ffff}]+') as w
    from documents),
sizes as (select k, doc_id, len(w) as n from doc_terms where len(w) > 0),
totals as (select count(*) as docs, cast(sum(n) as bigint) as terms from sizes),
item_terms as (
    select distinct q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10ffff}]+')) as term
    from (select row_number() over () as q, * from benchmark)),
postings as (
    select k, term, count(*) as tf from (select k, unnest(w) as term from doc_terms) where term in (select term from item_terms) group by k, term),
weights as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as weight from postings, totals group by term, docs),
scored as (
    select q, item_id, doc_id, k, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) as bigint) as score
    from item_terms join weights using (term) join postings using (term) join sizes using (k), totals group by q, item_id, doc_id, k)
select item_id, cast(row_number() over w as integer) as rank, doc_id, score from scored where score > 0
window w as (partition by q order by score desc, doc_id) qualify row_number() over w <= 10
""",
    "op12_centroid_clustering": f"""
with kept as materialized (
    select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
    select cast(row_number() over (order by sha256('2:' || cast(vec_id as varchar)), v) - 1 as integer) as cluster, v from kept
    qualify row_number() over (order by sha256('2:' || cast(vec_id as varchar)), v) <= 40),
{_lloyd_sql()}
select vec_id, a5.cluster, distance, cast(sum(distance) over (partition by a5.cluster) as bigint) as cluster_inertia,
       cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c5.v, ',')) as centroid_sha256
from a5 join c5 on a5.cluster = c5.cluster
""",
    "op8_exact_top_k": """
with fine as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
    from fine q join fine c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over w as integer) as rank, vec_id, score
from scored window w as (partition by query_id order by score desc, vec_id)
qualify row_number() over w <= 5
""",
    "op6_line_dedup": r"""
with docs as (select row_number() over () as k, doc_id, text, string_split(text, chr(10)) as lines from documents),
raw as (select k, doc_id, unnest(range(len(lines))) as line, unnest(lines) as own from docs),
lines as (
    select k, doc_id, line, trim(own, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as own,
           len(list_filter(regexp_split_to_array(own, '[ \t\r\x0b\x0c]+'), lambda w: w <> '')) as words
    from raw where trim(own, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
sums as (select *, sum(words) over (partition by k order by line) as after_words from lines),
placed as (select *, after_words - words as before_words from sums),
windows as (
    select k, doc_id, line as first, max(line) over f as last, string_agg(own, chr(10)) over f as content, sum(words) over f as n
    from placed window f as (partition by k order by before_words range between current row and 49 following)
    union
    select k, doc_id, min(line) over b as first, line as last, string_agg(own, chr(10)) over b as content, sum(words) over b as n
    from placed window b as (partition by k order by after_words range between 49 preceding and current row)),
ranked as (select *, rank() over (partition by content order by doc_id, first) as place from windows where n >= 50),
gone as (select distinct k, unnest(range(first, last + 1)) as line from ranked where place > 1),
real_gone as (select gone.k, gone.line from gone join lines using (k, line)),
islands as (select k, line, line - row_number() over (partition by k order by line) as island from gone),
summary as (select k, count(*) as n_removed, count(distinct island) as n_runs, list(line) as removed from islands group by k)
select doc_id, coalesce(len(lines), 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(n_runs, 0) as n_runs,
       sha256(coalesce(case when n_removed > 0 then array_to_string(list_filter(lines, lambda x, i: not list_contains(removed, i - 1)), chr(10)) else text end, '')) as kept_sha256
from docs left join summary using (k)
""",
    "op3_url_filter": r"""
with cut as (
    select page_id, case when instr(url, '://') > 0 then regexp_replace(substr(url, instr(url, '://') + 3), '[?#].*$', '', 's') else '' end as rest
    from pages),
parts as (
    select page_id,
           coalesce(translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
           coalesce(case when instr(rest, '/') > 0 then substr(rest, instr(rest, '/')) else '' end, '') as path
    from cut),
rules(rule_host, rule_path, rule_verdict) as (
    values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best as (
    select page_id, host, path,
           (select max_by(rule_host || rule_path, length(rule_host || rule_path)) from rules
            where (host = rule_host or suffix(host, '.' || rule_host)) and starts_with(path, rule_path)) as rule
    from parts)
select page_id, host, path, rule, coalesce((select rule_verdict from rules where rule_host || rule_path = rule), 'allow') as verdict
from best
""",
    "op4_decontamination": r"""
with item_words as (
    select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10ffff}]+') as w
    from benchmark where item_id is not null and text is not null),
sized as (select item_id, w, least(13, len(w)) as n from item_words where len(w) > 0),
windows as (
    select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as gram
    from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from sized)),
doc_words as (
    select row_number() over () as k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10ffff}]+'), []) as w
    from documents),
lengths as (select distinct n from windows),
doc_grams as (
    select k, i, n, array_to_string(w[i : i + n - 1], ' ') as gram
    from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from doc_words, lengths)),
hits as (select k, i, n, item_id from doc_grams join windows using (n, gram)),
covered as (select k, count(distinct place) as n_hit from (select k, unnest(range(i, i + n)) as place from hits) group by k),
found as (select k, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct k, cast(item_id as varchar) as item from hits) group by k)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc_words left join covered using (k) left join found using (k)
""",
}
