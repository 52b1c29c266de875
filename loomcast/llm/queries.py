"""Registered queries of the corpus operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.llm import bitplanes, hard_negatives, hidden_markov, language_crf, latent_search, packing, quality, recompression, secret_scan, spelling_variants, t_occurrence, url_filter, wordpieces
from loomcast.sources.lineage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return wrap


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PHRASES = " or ".join(f"contains(lower(line), '{p}')" for p in quality.BOILERPLATE)


@query(rf"""
with base as (
  select row_number() over () as rid, doc_id, text, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
tri as (select rid, unnest(range(1, len(ws) - 1)) as i, ws from base where len(ws) >= 3),
keyed as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k from tri),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as n from keyed) where n > 1),
covered as (select rid, count(distinct i + d) as n from twice, (select unnest([0, 1, 2]) as d) group by rid),
counts as (
  select b.rid, doc_id, t, len(ws) as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
         coalesce(c.n, 0) as n_repeat_words
  from base b left join covered c on c.rid = b.rid),
lines as (
  select rid, i, list[i] as line
  from (select rid, string_split(t, chr(10)) as list, unnest(range(1, len(string_split(t, chr(10))) + 1)) as i from counts)),
full_lines as (select * from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
dups as (select rid, count(*) - count(distinct line) as n from full_lines group by rid),
sized as (
  select rid, i, line, length(regexp_replace(line, '[^ ]+', '', 'g')) + 1 as n_gaps,
         list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from full_lines),
failed as (
  select rid, i from sized left join (select rid, true as again from twice group by rid) using (rid)
  where not regexp_matches(line, '[.!?…。！？]["''”’»)\]]*([\x20\x09-\x0D]|$)')
     or length(regexp_replace(line, '[^\p{{Lu}}]+', '', 'g')) > greatest(0.4 * (length(line) - n_gaps), 5)
     or length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) > 0.25 * n_gaps
     or length(regexp_replace(line, '[^|]+', '', 'g')) >= 3
     or (again and len(ws) >= 10 and len(list_distinct(ws)) < 0.2 * len(ws))
     or (length(line) <= 200 and ({_PHRASES}))),
left_over as (
  select l.rid, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) as chars
  from lines l anti join failed f on f.rid = l.rid and f.i = l.i group by l.rid)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       coalesce(d.n, 0)::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and coalesce(l.chars, 0) >= 0.7 * word_chars as kept,
       coalesce(l.chars, 0)::bigint as kept_chars
from counts left join dups d using (rid) left join left_over l using (rid)
""")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality rules over every document."""
    out = quality.clean_lines(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars"
    )


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held = language_crf.fold(F.col("doc_id"), 4) == 2
    model = language_crf.train(docs.where(~held).select("text", "lang"))
    found = language_crf.predict(docs, model)
    return found.select("doc_id", (language_crf.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@query(r"""
with base as (
  select row_number() over () as rid, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
win as (
  select rid, doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) as w
  from (select rid, doc_id, ws, unnest(range(1, len(ws) - 18)) as i from base where len(ws) >= 20)),
late as (
  select rid, i from (select rid, doc_id, i, min((doc_id, i)) over (partition by w) as f from win)
  where (doc_id, i) > f),
gone as (select distinct rid, unnest(range(i, i + 20)) as p from late),
removed as (select rid, list(p) as ps, count(*) as n from gone group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
       sha256(array_to_string(
         case when n is null then ws
              else list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: not list_contains(ps, z[2])), lambda z: z[1]) end,
         ' ')) as kept_sha256
from base left join removed using (rid)
""")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in 20-word windows that start earlier elsewhere, over every document."""
    out = recompression.repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden Markov log-probability of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return hidden_markov.language_model_scores(docs, language_crf.fold(F.col("doc_id"), 5) == 1)


@query()
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in any passage of any document."""
    return latent_search.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as compressed byte planes and read back."""
    out = scratch_path(spark, "token-ids")
    bitplanes.write_ids(table(spark, sf_dir, "documents"), out, vocabulary("word_bpe_49k.json"))
    rows = bitplanes.read_ids(spark, out)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query(r"""
with recursive base as (
  select doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
sets as (
  select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as i from base where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as n
  from sets a join sets b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (
  select x, y from common c join sizes a on a.doc_id = x join sizes b on b.doc_id = y
  where 100 * c.n >= 90 * (a.n + b.n - c.n)),
reach as (
  select doc_id as node, doc_id as root from base
  union
  select l.y, r.root from reach r join links l on l.x = r.node)
select b.doc_id, coalesce(s.n, 0)::bigint as n_shingles, r.component_id
from (select distinct doc_id from base) b left join sizes s using (doc_id)
join (select node, min(root) as component_id from reach group by node) r on r.node = b.doc_id
""")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose word 3-shingles overlap to nine tenths."""
    return t_occurrence.jaccard_components(table(spark, sf_dir, "documents"))


# fixed values: rules of the query (host and path prefix, verdict)
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


@query()
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by a regression that has learnt from URLs the rules decide."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.labelled_by_rules(pages.select("url"), URL_RULES), URL_RULES)


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match token counts of every document."""
    return wordpieces.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query()
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query(r"""
with recursive step0 as (select unnest(range(0, 256))::bigint as i, unnest(range(0, 256))::bigint as c, 0 as k),
steps as (
  select * from step0
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
lookup as (select list(c order by i) as t from steps where k = 8),
runs as (
  select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) as r from documents)),
hexed as (
  select doc_id, r, n, hex(encode(concat(doc_id, ':', r))) as x
  from (select doc_id, r, count(*) as n from runs group by doc_id, r)),
hashed as (
  select r, n, xor(list_reduce(
           list_prepend(4294967295::bigint, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i::int + 1, 2))::bigint)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h
  from hexed, lookup),
words as (
  select case when h % 31 = 0 then concat(substr(r, 1, (h % length(r))::int), substr(r, (h % length(r))::int + 2)) else r end as word, n
  from hashed),
vocabulary as (select word, sum(n)::bigint as n from words where length(word) >= 7 group by word having sum(n) >= 2),
holes as (
  select word, n, length(word) as size, i, concat(substr(word, 1, i::int - 1), substr(word, i::int + 1)) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as i from vocabulary)),
near as (
  select distinct a.word, b.word as other, b.n as m from holes a join holes b on a.rest = b.rest and a.i = b.i and a.size = b.size and a.word <> b.word
  union
  select a.word, b.word, b.n from holes a join vocabulary b on b.word = a.rest
  union
  select b.word, a.word, a.n from holes a join vocabulary b on b.word = a.rest),
best as (
  select word, count(*) over (partition by word) as n_near, other, m,
         row_number() over (partition by word order by m desc, encode(other)) as k from near),
formed as (
  select v.word, v.n, case when m >= 10 * v.n then other end as form, coalesce(n_near, 0) as n_near, case when m >= 10 * v.n then m end as form_n
  from vocabulary v left join best b on b.word = v.word and b.k = 1),
chain as (
  select word, word as at, 0 as k from formed
  union all
  select c.word, f.form, k + 1 from chain c join formed f on f.word = c.at where f.form is not null)
select f.word, n, form, arg_max(c.at, c.k) as root, n_near, form_n
from formed f join chain c on c.word = f.word group by f.word, n, form, n_near, form_n
""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents; one run in 31, by a hash, loses a letter first."""
    found = spelling_variants.runs(table(spark, sf_dir, "documents"), 7)
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run").cast("binary"))
    found = found.withColumn("h", h)
    word = F.when(F.col("h") % 31 == 0, spelling_variants.without_letter(F.col("run"), F.col("h") % F.length("run"))).otherwise(F.col("run"))
    return spelling_variants.group_variants(spelling_variants.counted(found.select(word.alias("word")), 7, 2))


@query("""
with base as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
rows as (select *, row_number() over () as r from (select distinct id, label, v from base)),
scored as (
  select a.r as a, a.id as anchor_id, b.id, b.r, a.label = b.label as same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score
  from rows a join rows b on a.r <> b.r and len(a.v) = len(b.v) where a.id % 100 = 0),
positive as (
  select * from (select *, row_number() over (partition by a order by score desc, id, r) as k from scored where same) where k <= 5),
ranked as (
  select p.anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score, p.k,
         row_number() over (partition by p.a, p.k order by n.score desc, n.id, n.r) as rank
  from positive p join scored n on n.a = p.a and not n.same
  where 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score, k::int as positive_rank
from ranked where rank <= 10
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query()
def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: the patterns' hits, and runs that the Markov models call random."""
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind, of="base": secret_scan.counted(F.col(of), kind).alias(f"n_{kind}")
    return out.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secret_scan.shown(F.col("base")), 256).alias("base_sha256"),
        secret_scan.shown(F.col("spans")).alias("spans"),
        count("markov", "spans"),
    )
