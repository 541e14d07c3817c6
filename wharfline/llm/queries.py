"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lmscore, mtree, packing, phrases, pii, quality, runs, simhash, suffix, urls, warc
from .shared import crc_bucket


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"))
    model = langid.train(docs.filter("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out)
    model = quality.train(docs, labels)
    scored = quality.score(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


# The contract's rules, fixed values.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "rule string, decision string")
    return urls.judge(pages.select("page_id", "url"), rules, urls.link_edges(pages)).select("page_id", "host", "path", "rule", "verdict")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) <> double('infinity'))"
    vectors = _table(spark, sf_dir, "embeddings").filter(finite).select("vec_id", F.expr("transform(embedding, x -> floor(256 * double(x)))").alias("vector"))
    return mtree.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(_table(spark, sf_dir, "pages")))
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", F.octet_length("block").cast("long").alias("content_length"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.find_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the turns of conversations; background and scored texts: all documents."""
    return lmscore.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "conversations"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", pii.spans("text").alias("spans"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = found.select("doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))
    n = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as long) as n_{kind}") for kind in pii.KINDS[:4]]
    joined = [F.array_join(F.transform(c, name), ",") for c in ("base", "spans")]
    return base.select("doc_id", *n, F.sha2(joined[0].cast("binary"), 256).alias("base_sha256"), joined[1].alias("spans"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = "filter(split(text, '[ \\t-\\r]+'), w -> w <> '')"
    planted = "array_join(transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)])), ' ')"
    docs = docs.withColumn("words", F.expr(f"case when h % 10 = 0 then {words} end")).withColumns({"n": F.size("words").cast("long"), "g": F.expr("h div 10")})
    docs = docs.withColumn("a", F.expr("case when n > 0 then g % n end")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    docs = docs.select("doc_id", F.expr(f"case when n > 0 then {planted} else text end").alias("text"))
    found = docs.select("doc_id", runs.analyse("text").alias("found")).select("doc_id", "found.runs", "found.collapsed")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), runs.longest(F.col("runs")).alias("top"), lines.alias("lines"), "collapsed")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{'runs' if c == 'lines' else c}_sha256")
    return found.select("doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"), sha("lines"), sha("collapsed"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": op2_url_filter,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_packing": op6_packing,
    "op7_top_k": op7_top_k,
    "op8_warc": op8_warc,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_pii": op11_pii,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrases": op13_phrases,
}


# The character references that the given pages hold; the operator decodes all there are.
_REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _plain_text_sql(html: str) -> str:
    """warc.plain_text in DuckDB's SQL."""
    t = rf"regexp_replace({html}, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)</?(?:{warc.BREAKS})\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[a-zA-Z/!?][^>]*>', '', 'g')"
    for name, char in _REFERENCES.items():
        t = f"replace({t}, '{name}', '{char}')"
    t = rf"regexp_replace({t}, '[ \t\r\f]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({t}, ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


def _uuid_sql(text: str) -> str:
    h = f"md5({text})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_LF, _CRLF = "chr(10)", "chr(13) || chr(10)"
_RULES = ", ".join(f"('{r}', '{d}')" for r, d in URL_RULES)
_URL = "lower(regexp_extract({0}, '://([^/?#]*)', 1))"

ORACLE: dict[str, str] = {
    "op2_url_filter": f"""
        with recursive rules as (select *, regexp_extract(rule, '^([^/]*)', 1) as h, regexp_extract(rule, '^[^/]*(.*)$', 1) as p from (values {_RULES}) as t(rule, decision)),
        places as (select page_id, url, html, coalesce({_URL.format('url')}, '') as host, case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path from pages),
        links as (select {_URL.format('url')} || regexp_extract(url, '://[^/?#]*([^#]*)', 1) as a, unnest(regexp_extract_all(html, '(?is)<link[^>]*rel="?canonical"?[^>]*href="([^"]*)"', 1)) as u from pages), edges as (select a, {_URL.format('u')} || regexp_extract(u, '://[^/?#]*([^#]*)', 1) as b from links),
        sides as (select a, b from edges union select b, a from edges), reach(n, m) as (select a, a from sides union select r.n, b.b from reach r join sides b on b.a = r.m), comps as (select n as node, min(m) as component from reach group by n),
        fits as (select page_id, max_by(rule, length(rule)) as rule, max_by(decision, length(rule)) as decision from places join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id),
        nodes as (select p.page_id, c.component, f.decision from places p join comps c on c.node = p.host || regexp_extract(p.url, '://[^/?#]*([^#]*)', 1) left join fits f using (page_id)),
        spread as (select component, case when bool_or(decision = 'allow') then 'allow' when bool_or(decision = 'block') then 'block' end as decision from nodes group by component)
        select p.page_id, host, path, rule, coalesce(f.decision, s.decision, 'allow') as verdict from places p left join fits f using (page_id) left join nodes n using (page_id) left join spread s using (component)""",
    "op7_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as vector from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
        p as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.vector, c.vector) as bigint) as score from v q join v c on q.vec_id <> c.vec_id and len(q.vector) = len(c.vector) where q.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5""",
    "op8_warc": f"""
        with b as (select page_id, coalesce(url, '') as uri, coalesce(html, '') as body from pages), h as (select *, 'sha256:' || sha256(body) as pd, 'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(body) || {_CRLF} || {_CRLF} || body as block from b),
        r as (select *, {_uuid_sql(f"'response' || {_LF} || uri || {_LF} || pd")} as rid, {_plain_text_sql('body')} as txt, regexp_replace({_plain_text_sql("regexp_extract(body, '(?is)<title[^>]*>(.*?)</title', 1)")}, '\\s+', ' ', 'g') as title from h),
        m as (select *, 'http-status: 200' || {_CRLF} || 'http-content-type: text/html; charset=utf-8' || {_CRLF} || 'http-content-length: ' || strlen(body) || {_CRLF} || 'source-payload-digest: ' || pd || {_CRLF} || 'source-block-digest: sha256:' || sha256(block) || {_CRLF} || 'title: ' || title || {_CRLF} || 'payload-length: ' || strlen(body) || {_CRLF} || 'text-length: ' || strlen(txt) || {_CRLF} as meta from r),
        d as (select page_id, 'metadata' as record_type, rid, uri, 'application/warc-fields' as content_type, meta as block from m union all select page_id, 'conversion', rid, uri, 'text/plain', txt from m)
        select page_id, record_type, {_uuid_sql(f"record_type || {_LF} || rid")} as record_id, rid as refers_to, uri as target_uri, '1970-01-01T00:00:00Z' as date, content_type, 'sha256:' || sha256(block) as block_digest, cast(strlen(block) as bigint) as content_length from d""",
    "op13_phrases": r"""
        with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        p as (select lang, unnest(string_split_regex(t, '[.,;:!?\n\x0b\x0c\r]')) as piece from t), w as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from p),
        words as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang), g as (select lang, size, w, unnest(range(1, len(w) - size + 2)) as i from w, (values (1), (2), (3)) as sizes(size) where len(w) >= size),
        f as (select lang, size, array_to_string(w[i : i + size - 1], ' ') as phrase, count(*) as f from g group by all having count(*) >= 10),
        c as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from f where size > 1), cuts as (select *, array_to_string(w[1 : k], ' ') as lp, array_to_string(w[k + 1 :], ' ') as rp from c, (values (1), (2)) as ks(k) where k < size),
        s as (select x.lang, x.phrase, x.a, k, l.f as l, r.f as r, cast(1000000 as hugeint) * x.a * x.a // (cast(l.f as hugeint) * r.f) as score from cuts x join f l on l.lang = x.lang and l.phrase = x.lp join f r on r.lang = x.lang and r.phrase = x.rp),
        least as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        longer as (select lang, phrase, max(a) as a from (select lang, array_to_string(w[1 : 2], ' ') as phrase, a from c where size = 3 union all select lang, array_to_string(w[2 : 3], ' '), a from c where size = 3) group by lang, phrase),
        kept as (select x.* from least x left join longer y using (lang, phrase) where y.a is null or 100 * y.a < 50 * x.a),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
        select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked join words using (lang) where rank <= 2000""",
}
