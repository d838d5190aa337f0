"""The queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, line_dedup, pieces, pii, quality, substring_dedup, toxicity, url_filter
from ._common import table

#: Where the vocabulary files are; see the README.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_pii_surrogates(spark: SparkSession, sf_dir: str, key: str = "a key for the query only") -> DataFrame:
    out = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    counts = [(F.size("entities") - F.size(F.array_remove("entities", t))).cast("long").alias(f"n_{t}") for t in pii.TYPES]
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"), *counts, "text")


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_report(docs, model_path)


def piece_report(docs: DataFrame, model_path: str = PIECE_MODEL) -> DataFrame:
    """One row per document: the N best segmentations as digests, their scores, and whether decoding gives the text back."""
    out = pieces.encode(docs.select("doc_id", "text"), model_path, round_trip=True, digest=True, keep_text=False)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "score",
        F.col("others.score").alias("other_scores"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        "others_sha256",
        "round_trip",
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.format_conversations(rows)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    turns = F.array_join(F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("segments"))
    return out.select(
        "conv_id",
        F.size(chat.read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        digest(turns).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        digest(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: The rules that the query applies.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in RULES))))
    return url_filter.judge(pages, outcomes, rules).select("page_id", "host", "path", "rule", "verdict")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.dedup_substrings(docs, min_chars=None)  # the units that the SQL has: lines and sentences of 8 words
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"], s["first_doc"])), ",")
    return out.select("doc_id", "n_units", "n_removed", cut.alias("removed_chars"), spans.alias("removed_spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def held_out(doc_id: Column) -> Column:
    """The rows that no model here learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0)) == 2


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=lambda c: ~held_out(c))
    return toxicity.score(docs, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "kept")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_pii_surrogates, op3_sentencepiece, op4_chat_formatting, op5_substring_dedup, op6_line_dedup, op7_toxicity, op8_ngram_jaccard, op9_url_filter, op10_quality_rules)}

_OP1 = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
iw as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null and text is not null),
ip as (select item, w, least(10, len(w)) as size, unnest(range(1, greatest(2, len(w) - 8))) as pos from iw where len(w) > 0),
win as (select distinct item, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') as g from ip),
sizes as (select distinct size from win),
dp as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as pos from dw, sizes where len(w) >= size),
grams as (select doc_id, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') as g from dp),
hit as (select doc_id, item, pos, grams.size as size from grams join win on grams.size = win.size and grams.g = win.g),
spans as (select distinct doc_id, pos, size from hit),
spots as (select doc_id, unnest(range(pos, pos + size)) as p from spans),
words as (select doc_id, count(distinct p) as n_hit from spots group by doc_id),
found as (select distinct doc_id, item from hit),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from found group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw d left join words using (doc_id) left join items using (doc_id)
"""

_OP6 = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (
  select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
common as (select k, max(doc_id) as last from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
marked as (select keyed.*, common.k is not null and doc_id <> last as gone from keyed left join common on keyed.k = common.k)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

_OP10 = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
grams as (select doc_id, pos, array_to_string(list_slice(w, pos, pos + 7), chr(1)) as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as pos from d where len(w) >= 8)),
often as (select doc_id, g from grams group by doc_id, g having count(*) >= 2),
spots as (select doc_id, unnest(range(pos, pos + 8)) as p from grams join often using (doc_id, g)),
repeats as (select doc_id, count(distinct p) as n from spots group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
worded as (select * from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
counted as (select doc_id, line, count(*) as n from worded group by doc_id, line),
dups as (select doc_id, cast(sum(n - 1) as bigint) as n from counted group by doc_id),
judged as (
  select doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as w,
         regexp_replace(line, '[^\p{L}]', '', 'g') as letters, regexp_replace(line, '[^\p{Lu}]', '', 'g') as uppers
  from worded),
faults as (
  select doc_id, len(w) as n,
         regexp_matches(line, '(?i)^\s*(licensed under|all rights reserved|copyright|\(c\) \d{4}|terms of (use|service)|privacy policy|cookie|sign in|log in|subscribe|share (this|on)|follow us|read more|click here)\b')
      or len(w) >= 3 and (
           3 * ((length(line) - length(replace(line, '|', ''))) + (length(line) - length(replace(line, ' > ', ''))) // 3 + (length(line) - length(replace(line, '»', ''))) + (length(line) - length(replace(line, '·', '')))) >= len(w)
        or 2 * len(list_filter(w, lambda x : regexp_matches(x, '[#*$%&!]{2,}$'))) >= len(w))
      or len(w) >= 8 and (
           5 * len(list_distinct(w)) <= 2 * len(w)
        or 2 * len(list_filter(range(1, len(w)), lambda i : w[i] = w[i + 1])) >= len(w)
        or length(letters) > 0 and 10 * length(uppers) >= 9 * length(letters)) as bad
  from judged),
lost as (select doc_id, cast(sum(n) as bigint) as n from faults where bad group by doc_id),
base as (
  select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
         coalesce(dups.n, 0) as n_dup_lines, coalesce(repeats.n, 0) as n_repeat_words, coalesce(lost.n, 0) as n_lost_words
  from d left join dups using (doc_id) left join repeats using (doc_id) left join lost using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 10 * n_lost_words <= 3 * n_words as kept
from base
"""

_CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>")


def _escapes(c: str) -> str:
    """How many characters escaping adds, in SQL."""
    return " + ".join(f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in ("\\", *_CONTROLS))


_OP4 = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (
  select *, {len("<|im_start|><|im_sep|><|im_end|>") + 1} + length(role) + length(text) + {_escapes("role")} + {_escapes("text")} as size,
         lag(role) over (partition by conv_id order by turn, role, text) as before
  from rows),
judged as (
  select *, case when before is null then role in ('system', 'user') when before = 'system' then role = 'user' when before = 'user' then role = 'assistant' when before = 'assistant' then role = 'user' else false end as fits,
         before is not null as later, role = 'system' as told
  from sized),
summed as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
         coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
         cast(sum(size) as bigint) as formatted_chars, bool_and(fits) and max_by(role, turn) <> 'system' as valid
  from judged group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars, valid from summed
"""

_OP9 = r"""
with rules(rule, rule_host, rule_path, v) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
p as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
fits as (select page_id, host, path, arg_min(rule, (-length(rule), rule)) as rule, arg_min(v, (-length(rule), rule)) as v
  from p join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id, host, path),
good as (select doc_id, max(quality) as good from labels where quality is not null group by doc_id),
h as (
  select host, string_split(regexp_replace(host, ':\d*$', ''), '.') as l, count(good) as n, coalesce(sum(good), 0) as k
  from p left join good on page_id = doc_id group by host),
hosts as (select host, n, k, l[-1] as suffix, case when len(l) > 1 then l[-2] || '.' || l[-1] else l[-1] end as domain from h),
top as (select case when sum(n) > 0 then (sum(k) + 0.5) / (sum(n) + 1) else 0.5 end as m from hosts),
s0 as (select suffix, sum(n) as n, sum(k) as k from hosts group by suffix),
t0 as (select case when count(*) = 0 or sum(n - 1) = 0 then 1.0 else 1 / least(0.9, greatest(1e-3, (sum(n * pow(k / n - m, 2) / (m * (1 - m))) - count(*)) / sum(n - 1))) - 1 end as s from s0, top where n > 0),
s1 as (select suffix, (k + s * m) / (n + s) as suffix_mean from s0, t0, top),
d0 as (select domain, suffix, suffix_mean, sum(n) as n, sum(k) as k from hosts join s1 using (suffix) group by domain, suffix, suffix_mean),
t1 as (select case when count(*) = 0 or sum(n - 1) = 0 then 1.0 else 1 / least(0.9, greatest(1e-3, (sum(n * pow(k / n - suffix_mean, 2) / (suffix_mean * (1 - suffix_mean))) - count(*)) / sum(n - 1))) - 1 end as s from d0 where n > 0),
d1 as (select domain, (k + s * suffix_mean) / (n + s) as domain_mean from d0, t1),
h0 as (select host, n, k, domain_mean as m from hosts join d1 using (domain)),
t2 as (select case when count(*) = 0 or sum(n - 1) = 0 then 1.0 else 1 / least(0.9, greatest(1e-3, (sum(n * pow(k / n - m, 2) / (m * (1 - m))) - count(*)) / sum(n - 1))) - 1 end as s from h0 where n > 0),
h1 as (select host, k + s * m as a, n - k + s * (1 - m) as b from h0, t2),
h2 as (select host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) as bound from h1)
select p.page_id, p.host, p.path, rule, coalesce(v, case when bound >= 0.5 then 'allow' else 'block' end) as verdict
from p join h2 using (host) left join (select distinct page_id, host, path, rule, v from fits) as f on p.page_id is not distinct from f.page_id and p.host = f.host and p.path = f.path
"""

_OP5 = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ln
  from documents where text is not null and text <> ''),
lines as (
  select *, sum(length(line) + 1) over (partition by doc_id order by ln) - length(line) - 1 as a,
         array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') as k,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 8 as unit
  from l),
s as (
  select doc_id, ln, a as line_a, k as line_k, unnest(regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+')) as piece, generate_subscripts(regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+'), 1) as pn
  from lines where unit),
sent as (
  select *, line_a + sum(length(piece)) over (partition by doc_id, ln order by pn) - length(piece) as a,
         array_to_string(regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') as k,
         len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+')) >= 8 as long
  from s),
occ as (
  select doc_id, ln, 0 as pn, a, a + length(line) as b, k from lines where unit
  union all select doc_id, ln, pn, a, a + length(piece), k from sent where long and k <> line_k),
firsts as (select k, min((doc_id, a, b)) as f from occ group by k having count(*) > 1),
gone as (select occ.*, f[1] as first_doc from occ join firsts on occ.k = firsts.k where (doc_id, a, b) <> f),
gone_lines as (select * from gone where pn = 0),
gone_sent as (select gone.* from gone left join gone_lines g on gone.doc_id = g.doc_id and gone.ln = g.ln where gone.pn > 0 and g.doc_id is null),
removed as (select * from gone_lines union all select * from gone_sent),
kept_sent as (
  select sent.doc_id, sent.ln, coalesce(string_agg(piece, '' order by sent.pn) filter (where g.doc_id is null), '') as line
  from sent left join gone_sent g on sent.doc_id = g.doc_id and sent.ln = g.ln and sent.pn = g.pn group by sent.doc_id, sent.ln),
kept as (
  select lines.doc_id, string_agg(coalesce(ks.line, lines.line), chr(10) order by lines.ln) as t
  from lines left join kept_sent ks on lines.doc_id = ks.doc_id and lines.ln = ks.ln
  left join gone_lines g on lines.doc_id = g.doc_id and lines.ln = g.ln where g.doc_id is null group by lines.doc_id),
n as (select doc_id, count(*) as n from occ group by doc_id),
r as (
  select doc_id, count(*) as n, cast(sum(b - a) as bigint) as chars, string_agg(a || '-' || b || '-' || first_doc, ',' order by a) as spans
  from removed group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_units, coalesce(r.n, 0) as n_removed, coalesce(r.chars, 0) as removed_chars, coalesce(r.spans, '') as removed_spans, sha256(coalesce(kept.t, '')) as kept_sha256
from documents d left join n using (doc_id) left join r using (doc_id) left join kept using (doc_id)
"""

_OP8 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (
  select distinct doc_id, array_to_string(list_slice(w, pos, pos + 4), ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as pos from w where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
often as (select g from g group by g having count(*) > 1),
shared as (select g.* from g join often using (g)),
overlap as (select a.doc_id as a, b.doc_id as b, count(*) as c from shared a join shared b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from overlap join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * c >= 75 * (na.n + nb.n - c)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select a, b from edges union select reach.doc_id, edges.b from reach join edges on reach.other = edges.a),
low as (select doc_id, min(other) as other from reach group by doc_id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(low.other, w.doc_id)) as component_id
from w left join n using (doc_id) left join low using (doc_id)
"""

ORACLES = {"op8_ngram_jaccard": _OP8, "op5_substring_dedup": _OP5, "op4_chat_formatting": _OP4, "op9_url_filter": _OP9, "op10_quality_rules": _OP10, "op1_decontamination": _OP1, "op6_line_dedup": _OP6}
