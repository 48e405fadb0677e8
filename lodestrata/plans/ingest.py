"""Queries: ingest, parsing, noise, quality, chunking, hashing, text functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import chunking, ingest, wiki
from lodestrata.plans.registry import load, query
from lodestrata.sources import files

#: The lines of documents, numbered, in DuckDB.
_LINES = "lines as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ordinal from documents)"


def lines(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))


@query("""
with u as (select page_id, url || case page_id % 5 when 0 then '.pdf' when 1 then '.md' when 2 then '.txt' when 3 then '.docx' else '.html' end as name, case when page_id % 7 = 0 then 'best' else 'auto' end as mode, page_id * 10000 as size from pages)
select page_id, cast(case when lower(regexp_extract(name, '\\.([^./]+)$', 1)) not in ('md', 'markdown', 'txt', 'docx', 'pdf') then 415 when mode = 'best' then 422 when size > 104857600 then 413 else 202 end as integer) as status from u""")
def upload_validation(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, (".pdf", ".md", ".txt", ".docx", ".html"))), (F.col("page_id") % 5 + 1).cast("int"))
    mode = F.when(F.col("page_id") % 7 == 0, "best").otherwise("auto")
    return load(spark, sf_dir, "pages").select("page_id", ingest.upload_status(F.concat("url", suffix), mode, F.col("page_id") * 10000).alias("status"))


@query("select doc_id, sha256(text) as sha256, min(doc_id) over (partition by sha256(text)) as kept_id, doc_id <> min(doc_id) over (partition by sha256(text)) as duplicate from documents")
def doc_exact_dedup(spark, sf_dir):
    return ingest.exact_duplicates(load(spark, sf_dir, "documents"))


@query("with h as (select doc_id, source, sha256(text) as sha256 from documents), old as (select sha256 from h where source = 'src0') select min(doc_id) as doc_id, sha256 from h where sha256 not in (select sha256 from old) group by sha256")
def incremental_dedup(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    return ingest.new_documents(rows, rows.where("source = 'src0'").select("sha256").distinct()).select("doc_id", "sha256")


@query("select doc_id, 'raw/' || sha256(text) || '/' || source || '.txt' as path from documents")
def raw_paths(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", ingest.raw_path(F.col("text"), F.concat("source", F.lit(".txt"))).alias("path"))


@query("select doc_id, 0 as block, case when contains(text, '|') and contains(text, '---') then 'table' else 'text' end as block_type, len(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as n_chars from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def markdown_blocks(spark, sf_dir):
    return ingest.markdown_blocks(load(spark, sf_dir, "documents")).select("doc_id", "block", "block_type", F.length("content").cast("long").alias("n_chars"))


@query(f"""with {_LINES}, n as (select source, doc_id, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) as line from lines), p as (select source, count(distinct doc_id) as total from lines group by all),
c as (select source, line, count(distinct doc_id) as pages from n where line <> '' and len(line) <= 120 group by all)
select source, line, pages from c join p using (source) where pages >= greatest(3, floor(total * 0.35))""")
def repeated_line_noise(spark, sf_dir):
    return ingest.repeated_edges(lines(spark, sf_dir).withColumnRenamed("doc_id", "page"), ["source"])


@query(f"""with {_LINES}, n as (select source, doc_id, ordinal, line, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) as low from lines), p as (select source, count(distinct doc_id) as total from lines group by all),
c as (select source, low, count(distinct doc_id) as pages from n where low <> '' and len(low) <= 120 group by all), bad as (select source, low from c join p using (source) where pages >= greatest(3, floor(total * 0.35)))
select doc_id, count(*) as kept, sum(len(line))::bigint as chars from n where not regexp_full_match(trim(line), '(?i)[-–—]?\\s*(?:page\\s*)?\\d{{1,4}}\\s*[-–—]?') and not (len(regexp_replace(line, '\\s+', '', 'g')) <= 2 and not regexp_matches(line, '[\\x{{3400}}-\\x{{9fff}}A-Za-z0-9]'))
  and not exists (select 1 from bad where bad.source = n.source and bad.low = n.low) group by all""")
def noise_removal(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("page", F.col("doc_id")).withColumn("edge", F.lit(True))
    return ingest.without_noise(rows, ["source"]).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("line")).alias("chars"))


@query(f"""with {_LINES}, p as (select source, doc_id, count(*) filter (trim(line) <> '') as blocks, count(*) filter (trim(line) <> '' and len(trim(line)) < 24) as short from lines group by all),
a as (select source, count(*) as total_pages, count(*) filter (blocks > 0) as text_pages, sum(blocks)::bigint as total_blocks, sum(short)::bigint as s from p group by all),
r as (select *, total_pages - text_pages as empty_pages, round_even(total_blocks / total_pages::double, 2) as avg_blocks_per_page, case when total_blocks > 0 then round_even(s / total_blocks::double, 4) else 0 end as short_block_ratio from a)
select source, total_pages, text_pages, total_blocks, empty_pages, avg_blocks_per_page, short_block_ratio, case when total_blocks = 0 or text_pages / total_pages::double < 0.4 then 'POOR' when text_pages / total_pages::double < 0.85 or avg_blocks_per_page < 1.5 or short_block_ratio > 0.35 then 'WARNING' else 'GOOD' end as status from r""")
def parse_quality(spark, sf_dir):
    full = F.trim("line") != ""
    pages = lines(spark, sf_dir).groupBy("source", "doc_id").agg(F.count_if(full).alias("blocks"), F.count_if(full & (F.length(F.trim("line")) < 24)).alias("short_blocks"))
    return ingest.parse_quality(pages, ["source"])


@query("select doc_id, cast(len(regexp_extract_all(text, '[\\x{3400}-\\x{9fff}]')) + ceil(len(regexp_replace(text, '[\\s\\x{3400}-\\x{9fff}]', '', 'g')) / 4.0) as integer) as tokens from documents")
def token_estimate(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("""with s as (select doc_id, regexp_replace(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '([。！？!?；;])\\s*', '\\1' || chr(1), 'g'), '\\n{2,}', chr(1), 'g') as t from documents),
p as (select doc_id, regexp_replace(t, '([.])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g') as t from s), u as (select doc_id, unnest(string_split(t, chr(1))) as u from p)
select doc_id, count(*) as n_sentences, sum(len(trim(u, ' ' || chr(9) || chr(10) || chr(13))))::bigint as n_chars from u where trim(u, ' ' || chr(9) || chr(10) || chr(13)) <> '' group by all""")
def sentence_units(spark, sf_dir):
    units = load(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("u"))
    return units.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("u")).alias("n_chars"))


def chunks(spark, sf_dir):
    return chunking.chunk(ingest.markdown_blocks(load(spark, sf_dir, "documents")))


@query()
def chunk_stats(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("estimated_tokens").alias("tokens"), F.max("estimated_tokens").alias("largest"))


@query()
def chunk_manifest(spark, sf_dir):
    return chunking.manifest(chunks(spark, sf_dir))


@query(f"with {_LINES}, c as (select doc_id, cast(ordinal as integer) as ordinal, doc_id || ':' || ordinal as chunk_id from lines) select doc_id, ordinal, chunk_id, lag(chunk_id) over w as previous_id, lead(chunk_id) over w as next_id from c window w as (partition by doc_id order by ordinal)")
def chunk_links(spark, sf_dir):
    return chunking.linked(lines(spark, sf_dir).select("doc_id", "ordinal"))


@query("""with h as (select doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(sha256(text) || ':0')) as h from documents)
select doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', cast(('0x' || h[17:17])::integer % 4 + 1 as bigint), 1) || h[18:20] || '-' || h[21:32] as point_id from h""")
def point_ids(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", chunking.point_id(F.sha2("text", 256), F.lit(0)).alias("point_id"))


@query("select doc_id, sha256('bge-m3' || chr(10) || text) as hash, '标题路径：' || source || ' / ' || lang || chr(10) || '正文：' || text as embed_text from documents")
def embedding_inputs(spark, sf_dir):
    path = F.array("source", "lang")
    return load(spark, sf_dir, "documents").select("doc_id", ingest.embedding_hash(F.lit("bge-m3"), F.col("text")).alias("hash"), chunking.embed_text(path, F.col("text")).alias("embed_text"))


@query("with t as (select doc_id, source, sha256('bge-m3' || chr(10) || text) as hash from documents) select doc_id, hash from t where hash not in (select hash from t where source in ('src0', 'src1'))")
def embedding_cache_misses(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "source", ingest.embedding_hash(F.lit("bge-m3"), F.col("text")).alias("hash"))
    cache = rows.where(F.col("source").isin("src0", "src1")).select("hash", F.array(F.lit(1.0)).alias("embedding")).distinct()
    return ingest.uncached(rows, cache).select("doc_id", "hash")


@query("select doc_id, round(case when a + b = 0 then 0 else a / (a + b)::double end, 3) as chinese_ratio, b as latin from (select doc_id, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) as a, len(regexp_replace(text, '[^A-Za-z]', '', 'g')) as b from documents)")
def lang_mix(spark, sf_dir):
    text = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.round(T.chinese_ratio(text), 3).alias("chinese_ratio"), (F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]", ""))).cast("long").alias("latin"))


@query("select doc_id, (" + " + ".join(f"(len(text) - len(replace(text, {m}, ''))) // {n}" for m, n in (*((f"'{c}'", 1) for c in "æçèäå"), ("'ï¼'", 2), ("'ã'", 1), *((f"chr({c})", 1) for c in (0x80, 0x98, 0x9D, 0x81)))) + ") >= 2 as mojibake from documents")
def mojibake_flags(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.mojibake(F.col("text")).alias("mojibake"))


@query("""with t as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t, source from documents)
select doc_id, rtrim(substr(t, 1, 360)) || case when len(t) > 360 then '...' else '' end as short, trim(regexp_replace(lower(source || ' / ' || doc_id), '[^a-z0-9]+', '-', 'g'), '-') as slug from t""")
def short_texts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.short_text(F.col("text")).alias("short"), T.slug(F.concat_ws(" / ", "source", F.col("doc_id").cast("string"))).alias("slug"))


@query("""with t as (select doc_id, cast(row_number() over (partition by source order by doc_id) as integer) - 1 as seq, source, cast((doc_id * 7) % 40 as integer) as start_page from documents),
m as (select *, max(start_page) over (partition by source order by seq) as reach from t), p as (select distinct source, cast((doc_id * 3) % 40 as integer) as page from documents)
select source, page, coalesce((select max_by(doc_id, seq) from m where m.source = p.source and m.reach <= p.page), -1) as heading_doc from p""")
def heading_asof(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("source", "doc_id")
    key = F.col("source").alias("doc_id")
    seq = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    toc = docs.select(key, seq.alias("seq"), ((F.col("doc_id") * 7) % 40).cast("int").alias("start_page"), F.array(F.col("doc_id").cast("string")).alias("path"))
    pages = docs.select(key, ((F.col("doc_id") * 3) % 40).cast("int").alias("page")).distinct()
    out = ingest.heading_for_pages(pages, toc)
    return out.select(F.col("doc_id").alias("source"), "page", F.coalesce(F.get("heading_path", F.lit(0)).cast("long"), F.lit(-1).cast("long")).alias("heading_doc"))


@query(f"""with {_LINES}, r as (select doc_id, ordinal, count(*) over (partition by doc_id) as n from lines), b as (select *, round_even(ordinal * 11.0 / greatest(n - 1, 1), 0) as i from r)
select doc_id, cast(ordinal as integer) as ordinal from b where n <= 12 or round_even(i * ((n - 1) / 11.0::double), 0) = ordinal or round_even((i - 1) * ((n - 1) / 11.0::double), 0) = ordinal and i >= 1 or round_even((i + 1) * ((n - 1) / 11.0::double), 0) = ordinal and i < 11""")
def even_sample(spark, sf_dir):
    return wiki.even_sample(lines(spark, sf_dir).select("doc_id", "ordinal"), ["doc_id"], "ordinal").select("doc_id", "ordinal")


@query("""with c as (select source, cast(row_number() over (partition by source order by doc_id) as integer) - 1 as ordinal, case when doc_id % 3 = 0 then lang || ' / part' else lang end as path, cast(doc_id % 50 as integer) as page from documents),
k as (select *, array_to_string(list_slice(list_transform(string_split(path, '/'), lambda x: trim(x)), 1, 2), ' / ') as key from c),
i as (select *, sum(case when lag is null or lag <> key then 1 else 0 end) over (partition by source order by ordinal) as section from (select *, lag(key) over (partition by source order by ordinal) as lag from k)),
k1 as (select *, string_split(key, ' / ')[1] as key1, max(section) over (partition by source) as runs from i),
i1 as (select *, sum(case when lag1 is null or lag1 <> key1 then 1 else 0 end) over (partition by source order by ordinal) as section1 from (select *, lag(key1) over (partition by source order by ordinal) as lag1 from k1)),
s as (select source, ordinal, case when runs > 30 then section1 else section end as section, case when runs > 30 then key1 else key end as key from i1),
g as (select source, section, any_value(key) as title, count(*) as n_chunks, min(ordinal) as a, max(ordinal) as b from s group by all),
x as (select *, ceil(max(section) over (partition by source) / 30.0) as ratio from g)
select source, cast(floor((section - 1) / ratio) + 1 as integer) as section, case when count(*) > 1 then min_by(title, section) || ' ~ ' || max_by(title, section) else min(title) end as title, sum(n_chunks)::bigint as n_chunks, min(a) as first_ordinal, max(b) as last_ordinal from x group by source, floor((section - 1) / ratio) + 1""")
def wiki_sections(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    path = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit(" / part"))).otherwise(F.col("lang"))
    rows = load(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), at.alias("ordinal"), path.alias("heading_path"), (F.col("doc_id") % 50).cast("int").alias("page"))
    return wiki.sections(rows).select(F.col("doc_id").alias("source"), "section", "title", "n_chunks", "first_ordinal", "last_ordinal")


@query("""with c as (select source, doc_id as chunk_id, lang, text, row_number() over (partition by source order by doc_id) - 1 as ordinal from documents),
l as (select *, lag(lang) over (partition by source order by ordinal) as before from c),
i as (select *, sum(case when before is null or before <> lang then 1 else 0 end) over (partition by source order by ordinal) as section from l),
n as (select *, count(*) over (partition by source, section) as n, row_number() over (partition by source, section order by ordinal) - 1 as place from i),
e as (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as v from n where n <= 12 or list_contains(list_transform(range(0, 12), lambda k: round_even(k * ((n - 1) / 11.0::double), 0)), place::double)),
p as (select source, section, any_value(lang) as lang, string_agg('- page unknown: ' || rtrim(substr(v, 1, 360)) || case when len(v) > 360 then '...' else '' end || ' [E:' || chunk_id || ']', chr(10) order by ordinal) as lines from e group by source, section)
select source as doc_id, cast(section as bigint) as section, sha256('# ' || source || ' / ' || lang || replace('~~> 该页由确定性编译器生成，因为本地模型输出未通过引用校验。~> 原因：deterministic~~## 证据摘要~~', '~', chr(10)) || lines || replace('~~## 编译说明~~- 本页只使用列出的原始证据块。~- 如需更精细的概念页，可在审核后从本章节继续生成 claim 与关系。', '~', chr(10))) as content_hash from p""")
def wiki_pages(spark, sf_dir):
    out = wiki.section_pages(_section_evidence(spark, sf_dir), "deterministic")
    return out.select("doc_id", F.col("section").cast("long").alias("section"), F.sha2(F.encode("content", "UTF-8"), 256).alias("content_hash"))


def _section_evidence(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    at = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    rows = docs.select(F.col("source").alias("doc_id"), at.alias("ordinal"), F.col("doc_id").alias("chunk_id"), "lang", F.col("text").alias("content"), F.lit(None).cast("int").alias("page"))
    sectioned = wiki.islands(rows, F.col("lang")).withColumn("title", F.col("key")).withColumn("doc_title", F.col("doc_id"))
    return wiki.even_sample(sectioned, ["doc_id", "section"], "ordinal")


@query("select '# Documents by language' || chr(10) || chr(10) || string_agg('- ' || lang || ': ' || n, chr(10) order by lang) as value from (select lang, count(*) as n from documents group by all)")
def status_report(spark, sf_dir):
    return files.status_report(load(spark, sf_dir, "documents").withColumnRenamed("lang", "status"), "Documents by language")
