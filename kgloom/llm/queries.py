"""The registered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, dedup, divergence, jaccard, katz, langid, matroska, packing, resampling, secrets, sharding, urls, warc
from .common import read

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), 1024, 2)


def op2_url_filter(spark, sf_dir):
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op3_secret_scan(spark, sf_dir):
    return secrets.report(read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op5_warc_archive(spark, sf_dir):
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op6_bpe(spark, sf_dir):
    return bpe.encode_digests(read(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)))
    model = langid.train(docs.filter("not held_out"))
    return langid.predict(docs, model, keep=["held_out"])


def op8_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op8_jaccard_links(spark, sf_dir):
    """The pairs of the join: a row for each link between two different sets."""
    return jaccard.similar_pairs(read(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return sharding.shard_documents(read(spark, sf_dir, "documents"), 8, "bytes")


def op10_matroska(spark, sf_dir):
    return matroska.store_texts(read(spark, sf_dir, "documents"))


def op11_katz_backoff(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    model = katz.train(docs.filter(~held_out))
    return katz.score(docs, model).withColumn("held_out", held_out)


def op12_source_divergence(spark, sf_dir):
    return divergence.audit(read(spark, sf_dir, "documents"), least_docs=10, top=10)


def op13_importance_resampling(spark, sf_dir):
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), share=25, seed=7, least_words=20)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_url_filter, op3_secret_scan, op4_exact_dedup, op5_warc_archive, op6_bpe, op7_language_id, op8_jaccard_join, op8_jaccard_links, op9_sharding, op10_matroska, op11_katz_backoff, op12_source_divergence, op13_importance_resampling, pipeline)}

#: DuckDB SQL of the queries that SQL can express.
ORACLES = {
    "op4_exact_dedup": """
        with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents),
        g as (select text_sha256, max(doc_id) as keep_id, count(*)::bigint as group_size from t group by 1)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)""",
    "op12_source_divergence": r"""
        with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
        t as (select i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
        k as (select lang, term, count(*) as n from t group by lang, term having count(distinct i) >= 10),
        g as (select distinct lang, source from d),
        l as (select lang, count(*) as v, sum(n) as n from k group by lang),
        o as (select lang, source, term, count(*) as n from t group by all),
        c as (select g.lang, g.source, k.term, coalesce(o.n, 0) as n, k.n as n_lang from g join k using (lang) left join o on o.lang = g.lang and o.source = g.source and o.term = k.term),
        w as (select lang, source, sum(n) as n from c group by all),
        p as (select c.*, 1 + (1000000000::hugeint * (c.n + 2)) // (w.n + 2 * l.v) as p, 1 + (1000000000::hugeint * (c.n_lang + 2)) // (l.n + 2 * l.v) as q from c join w on w.lang = c.lang and w.source = c.source join l on l.lang = c.lang),
        f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
        r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
          union all select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from p where n > 0 and p > q),
        s as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r)
        select * from s where part = 'pair' or rank <= 10""",
}
