"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, bpe, exact_dedup, filter_audit, jaccard_join, line_dedup, minhash, mixing, secrets, sharding, spotsigs, token_count, toxicity
from .common import materialize, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard among 128, by its id."""
    shards = [f"shard-{k:03d}" for k in range(sharding.SHARDS)]
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), shards)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page without the lines that over a tenth of its host's pages carry."""
    pages = table(spark, sf_dir, "pages").select("page_id", line_dedup.host_of(F.col("url")).alias("host"), line_dedup.page_lines(F.col("html")).alias("text"))
    pages = materialize(pages, "page-lines")  # extracted once, read several times
    out = line_dedup.drop_boilerplate(pages, F.col("host"))
    return out.select("page_id", "host", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), "n_dropped_lines", "text")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of near-duplicates by its smallest id. Texts that are null or empty are groups of their
    own; repeated rows and equal texts are in one."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def _digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join("ids", ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's token ids as a digest, and that of the bytes they decode to; null and empty texts have none."""
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    return _digests(bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's secrets: counts by base kind, a digest of the base spans, and all spans. Null and empty texts have
    none."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), of("random").alias("n_random"), F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of equal texts, and whether it is the one that stays. Null and empty texts are one group."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity by a model that is learned from the labelled rows which are not held out. Null and empty
    texts score the model's bias."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document. Words are counted once: what is written has no text."""
    rows = mixing.measured(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
    out = mixing.copies_of(materialize(rows, "sizes"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes and tokens, and whether there are over 512 tokens; null and empty texts have none."""
    out = token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > token_count.LIMIT)


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, that of its edited text, their likeness and that to the next document's. Whether they
    are near-duplicates (alike_*) is asked by length classes, which prune most pairs before their Jaccard is taken."""
    sets = spotsigs.compare_neighbours(table(spark, sf_dir, "documents"))
    return sets.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint_text(F.col("own")).alias("fingerprint"),
        spotsigs.fingerprint_text(F.col("other")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("own"), F.col("other")).alias("near_edited"),
        spotsigs.likeness(F.col("own"), F.col("follower")).alias("near_next"),
        spotsigs.alike(F.col("own"), F.col("other")).alias("alike_edited"),
        spotsigs.alike(F.col("own"), F.col("follower")).alias("alike_next"),
    )


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's component of the join by 3-word shingles at 90 percent, and the number of its links. Texts that
    are null or empty link with nothing; repeated rows and equal texts link with each other."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op12_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster among 16, its squared distance, and the inertias. Vectors that have not 64 finite components
    are left out; rows that are equal are vectors of their own."""
    return bitplanes.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each source at each step of each order. Null texts count as empty, null
    sources as the empty string; rows that are equal count as often as they occur."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_sharding, op2_line_dedup, op3_minhash, op4_bpe, op5_secrets, op6_exact_dedup, op7_toxicity, op8_mixing, op9_token_counts, op10_spotsigs, op11_jaccard_join, op12_bit_planes, op13_filter_audit, pipeline]
    return {f.__name__: f for f in own}


_BLOCK_TAGS = "p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|table|nav|article|footer|header|section|title|head|body|html"


def _op2_sql() -> str:
    text = "regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g')"
    text = rf"regexp_replace({text}, '(?i)</?({_BLOCK_TAGS})( [^>]*)?>', chr(10), 'g')"
    text = rf"trim(regexp_replace(regexp_replace({text}, '<[^>]*>', '', 'g'), '\n[ \t\n]*', chr(10), 'g'), chr(10))"
    return rf"""
with p as (select page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host, {text} as text from pages),
l as (select distinct host, text, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x))) as line from p),
t as (select host, count(distinct text) as pages from p group by host),
b as (select l.host, line from l join t using (host) where line <> '' group by l.host, line, pages
      having count(*) >= {line_dedup.LEAST} and count(*) > {line_dedup.RATIO} * pages),
s as (select host, list(line) as boiler from b group by host),
k as (select page_id, p.host, text, string_split(text, chr(10)) as lines,
      list_filter(string_split(text, chr(10)), lambda x: not list_contains(coalesce(boiler, []), trim(x))) as kept from p left join s on p.host = s.host),
f as (select *, len(list_filter(kept, lambda x: trim(x) <> '')) > 0 as acts from k)
select page_id, host, case when acts then len(kept) else len(lines) end as n_lines, case when acts then len(lines) - len(kept) else 0 end as n_dropped_lines,
       case when acts then array_to_string(kept, chr(10)) else text end as text from f"""


OP6_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256 from n"""

OP8_SQL = rf"""
with d as (select doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size)::bigint as source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight from d group by source),
o as (select *, row_number() over (order by {mixing.MOST} * source_size::double / weight, source) as k from s),
c as (select *, sum(source_size) over () - coalesce(sum({mixing.MOST} * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as left_,
             sum(weight) over (order by k rows between current row and unbounded following) as shared from o),
m as (select left_::bigint as left_, shared::bigint as shared, k from c where weight * left_ <= {mixing.MOST} * source_size * shared order by k limit 1),
t as (select source, source_size, case when o.k < m.k then ({mixing.MOST} * source_size)::double else (weight * left_)::double / shared::double end as target from o, m),
r as (select d.*, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
      ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))), 1, 12))::bigint::double / {float(1 << 48)!r} as draw
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end))::bigint as taken from r"""


OP13_SQL = r"""
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') as ws from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad from labels where doc_id is not null group by doc_id),
f as (select part, coalesce(good, 0) as good, coalesce(bad, 0) as bad, {
        'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws), 'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
        'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) over (partition by t), false)} as x from w left join l using (doc_id)),
g as (select part, good, bad, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: case k when 'A' then x.A when 'B' then x.B when 'C' then x.C when 'D' then x.D else x.E end) as fails, count(*) as n
      from f group by all),
c as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
p as (select a.c || b.c || d.c || e.c || k.c as filter_order from c a, c b, c d, c e, c k where len(list_distinct([a.c, b.c, d.c, e.c, k.c])) = 5),
o as (select filter_order, step, substr(filter_order, step, 1) as here, string_split(substr(filter_order, 1, step - 1), '') as before from p, (select unnest([1, 2, 3, 4, 5]) as step)),
r as (select part, filter_order, step, n, good, bad, list_contains(fails, here) as fail, list_has_any(fails, before) as gone, fails = [here] as only_ from g, o),
q as (select part, filter_order, step, substr(filter_order, step, 1) as here,
        sum(case when not fail and not gone then n else 0 end)::bigint as kept, sum(case when fail and not gone then n else 0 end)::bigint as removed,
        sum(case when fail and gone then n else 0 end)::bigint as redundant, sum(case when only_ then n else 0 end)::bigint as unique_fails,
        sum(case when fail and not gone then n * good else 0 end)::bigint as good_lost, sum(case when fail and not gone then n * bad else 0 end)::bigint as toxic_lost
      from r group by part, filter_order, step)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, here)::bigint as shapley from q"""


def _op12_sql() -> str:
    text = """
with f as (select vec_id, list_transform(embedding, lambda x: x::double) as e, row_number() over () as r from embeddings),
k as (select r, vec_id, list_transform(e, lambda x: floor(64 * x)::bigint) as v from f
      where len(e) = 64 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0),
x as (select r, unnest(v) as a, unnest(range(64)) as p from k),
c0 as (select row_number() over (order by sha256('1:' || vec_id::varchar) nulls last, v) - 1 as c, v from k order by c limit 16),
m0 as (select c, unnest(v) as b, unnest(range(64)) as p from c0)"""
    for i in range(bitplanes.ROUNDS + 1):
        text += f""",
d{i} as (select r, c, sum((a - b) * (a - b))::bigint as d from x join m{i} using (p) group by r, c),
n{i} as (select r, arg_min(c, d * 64 + c) as c, min(d) as d from d{i} group by r)"""
        if i < bitplanes.ROUNDS:
            text += f""",
s{i} as (select c, p, sum(a)::bigint as s, count(*) as n from x join n{i} using (r) group by c, p),
m{i + 1} as (select c, p, case when s is null then b else (s - ((s % n) + n) % n) // n end as b from m{i} left join s{i} using (c, p))"""
    i = bitplanes.ROUNDS
    return text + f""",
h as (select c, sha256(string_agg(b::bigint::varchar, ',' order by p)) as centroid_sha256 from m{i} group by c)
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256
from n{i} join k using (r) join h using (c)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _op2_sql(), "op6_exact_dedup": OP6_SQL, "op8_mixing": OP8_SQL, "op12_bit_planes": _op12_sql(), "op13_filter_audit": OP13_SQL}
