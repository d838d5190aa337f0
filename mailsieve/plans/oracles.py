"""The queries of this package in SQL, over the same tables."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.normalize import DELIMITERS, LONG_MARKS
from ..functions.text import HIRAGANA, KANJI, KATAKANA, OTHER_DIGITS, WS, ZERO_WIDTH
from .queries import _JUDGED, MAILS, RAW_LINE, RAW_MAIL, SEPARATED


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {_q(pattern)})"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, {_q(f'^[{WS}]+')}, ''), {_q(f'[{WS}]+$')}, '')"


def _zero(c: str) -> str:
    return f"regexp_replace({c}, {_q(f'[{ZERO_WIDTH}]')}, '', 'g')"


_HIDDEN = rf"{WS}\p{{Cc}}\p{{Cf}}\p{{Zl}}\p{{Zp}}"
_SPOKEN = r"\p{Lo}\p{Ll}\p{Lu}\p{Lt}\p{N}"
_N = P.names()
_DEPTH = f"length(regexp_replace(regexp_extract(text, {_q(f'^([>|][{WS}>|]*)')}, 1), '[^>|]', '', 'g'))"
_NAME = f"({_has('text', P.whole(P.NAME_SHAPES))} or length(text) <= 15 and not {_has('text', P._NOT_IN_NAMES)} and {_has('text', P.name_pattern())})"
_VISIBLE = f"regexp_replace(text, {_q(f'[{_HIDDEN}]')}, '', 'g')"
_SIGNS = f"regexp_replace({_VISIBLE}, {_q(f'[{_SPOKEN}]')}, '', 'g')"
_SEPARATOR = f"""(length({_VISIBLE}) >= 2 and {_SIGNS} = {_VISIBLE}
  or len(list_filter(list_distinct(string_split({_SIGNS}, '')), lambda c : c <> '' and length({_SIGNS}) - length(replace({_SIGNS}, c, '')) >= 3
         and 2 * (length({_SIGNS}) - length(replace({_SIGNS}, c, ''))) >= length({_VISIBLE}))) > 0)"""
_FLAGS = {
    "quote_depth": f"cast({_DEPTH} as int)",
    "is_forward_reply_header": _has("text", P.whole(P.HEADERS)),
    "is_delimiter": _SEPARATOR,
    "is_greeting": _has("text", P.whole(P.GREETINGS)),
    "is_closing": _has("text", P.whole(P.CLOSINGS)),
    "has_contact_info": f"(text <> '' and {_has('text', P.anywhere(P.CONTACTS))})",
    "has_company_pattern": f"(text <> '' and {_has('text', P.anywhere(P.COMPANIES))})",
    "has_position_pattern": f"(text <> '' and {_has('text', P.anywhere(P.POSITIONS))})",
    "has_name_pattern": _NAME,
    "has_meta_discussion": _has("text", P.anywhere(P.META)),
    "is_inside_quotation_marks": f"""({_has(_strip('text'), P.anywhere(P.QUOTED))} or {_strip('text')} = '"')""",
}


def _flags(*names: str) -> str:
    return ", ".join(f"{_FLAGS[n]} as {n}" for n in (names or _FLAGS))


_MAILS = f"mails as ({MAILS})"
_LINES = _MAILS + """,
lines as (
  select mail_id, cast(unnest(range(len(l))) as int) as pos, unnest(l) as text
  from (select mail_id, string_split(email_text, chr(10)) as l from mails))"""
_MARKED = f"{_LINES}, marked as (select *, {_flags()} from lines)"
_CONTENT = f"""{_MARKED},
content as (
  select *, cast(row_number() over w - 1 as int) as idx, cast(count(*) over (partition by mail_id) as int) as n,
         cast(pos - coalesce(lag(pos) over w, -1) - 1 as int) as blank_lines_before,
         cast(coalesce(lead(pos) over w, n_lines) - pos - 1 as int) as blank_lines_after
  from marked join (select mail_id, count(*) as n_lines from lines group by mail_id) using (mail_id) where text <> ''
  window w as (partition by mail_id order by pos))"""
_RULE = """case when quote_depth > 0 or is_forward_reply_header then 'QUOTE' when has_contact_info or has_position_pattern or has_name_pattern then 'SIGNATURE'
  when is_closing or is_delimiter then 'CLOSING' when is_greeting then 'GREETING' else 'BODY' end"""
_RULED = f"{_CONTENT}, ruled as (select *, {_RULE} as label from content)"
_FIXED = f"""{_RULED},
once as (
  select *, case when n < 2 then label when label = 'CLOSING' and is_delimiter then case when lead(label) over w = 'SIGNATURE' then 'SIGNATURE' else 'BODY' end else label end as l1
  from ruled window w as (partition by mail_id order by idx)),
fixed as (
  select *, case when l1 = 'CLOSING' and n >= 2 and coalesce(max(l1 = 'SIGNATURE') over (partition by mail_id order by idx rows between unbounded preceding and 1 preceding), false) then 'SIGNATURE' else l1 end as l2
  from once)"""

_LABEL = """case when text = '' then null when quote_depth > 0 or is_forward_reply_header then 'QUOTE' when has_contact_info or has_position_pattern or has_name_pattern then 'SIGNATURE'
       when is_closing then 'CLOSING' when is_greeting then 'GREETING' when is_delimiter then 'OTHER' else 'BODY' end"""


def _assembled(labeled: str, out: str) -> str:
    """The closed form of the body, over ``labeled`` with mail_id, pos, text, label and blank."""
    return f"""
b as (select *, min(case when label = 'SIGNATURE' and not blank then pos end) over (partition by mail_id) as signature_index from {labeled}),
c as (select *, label in ('GREETING', 'BODY', 'CLOSING') and not blank and pos < coalesce(signature_index, 2147483647) as inside from b),
d as (select *, min(case when inside then pos end) over (partition by mail_id) as a, max(case when inside then pos end) over (partition by mail_id) as z from c),
e as (select *, coalesce(max(case when label = 'QUOTE' and not blank and pos < a then pos end) over (partition by mail_id) + 1, 0) as s from d),
{out} as (
  select mail_id, coalesce(string_agg(text, chr(10) order by pos) filter (where pos between s and z), '') as body_text, any_value(signature_index) as signature_index,
         count(*) filter (where label = 'QUOTE' and not blank and pos between s and z) as inline_quote_count
  from e group by mail_id)"""


def _carried(source: str, label: str = "label") -> str:
    return f"""carried as (
  select mail_id, pos, text, text = '' as blank, last_value(case when text <> '' then {label} end ignore nulls) over (partition by mail_id order by pos rows between unbounded preceding and current row) as label
  from {source})"""


def _ratio(inside: str) -> str:
    return f"(length(text) - length(regexp_replace(text, {_q(f'[{inside}]')}, '', 'g'))) / length(text)"


_CLASSES = {"kanji_ratio": KANJI, "hiragana_ratio": HIRAGANA, "katakana_ratio": KATAKANA, "ascii_ratio": "A-Za-z", "digit_ratio": "0-9" + OTHER_DIGITS}
_ANY_NAME = f"({_has('text', P._any_of((*_N['last'], *_N['katakana'])))} or {_has('lower(text)', P._any_of(tuple(x.lower() for x in _N['romaji'])))})"
_DASHES = f"""select mail_id, pos, case when regexp_matches({_zero('raw')}, '^[{WS}]*[{DELIMITERS}]+[{WS}]*$') then {_strip(f"regexp_replace({_zero('raw')}, '[{LONG_MARKS}]', '-', 'g')")} else {_zero('raw')} end as line"""

_EVAL = f"""judged as ({_JUDGED}),
squeezed as (
  select *, list_reduce(list_prepend('', list_filter(list_transform(string_split(coalesce(body, ''), chr(10)), lambda x : {_strip('x')}), lambda x : x <> '')), lambda a, b : a || chr(10) || b) as sb,
         list_reduce(list_prepend('', list_filter(list_transform(string_split(expected_body, chr(10)), lambda x : {_strip('x')}), lambda x : x <> '')), lambda a, b : a || chr(10) || b) as se,
         {_strip("coalesce(body, '')")} as tb, {_strip('expected_body')} as te
  from judged),
flagged as (
  select *, success and tb <> '' as answered, success and tb <> '' and tb = te as exact_match, success and tb <> '' and sb = se as content_match,
         success and tb <> '' and te <> '' and (tb = te or (contains(te, tb) or contains(tb, te)) and 10 * abs(length(te) - length(tb)) <= length(te)) as acceptable
  from squeezed),
outcome as (select *, answered and not content_match as confident_wrong, not answered as failed_static, case when not answered then error_type end as error_kind from flagged)"""

#: The lines of mails with more separators; the rest of ``_CONTENT`` as it is.
_SEPARATED_CONTENT = _CONTENT.replace(_MAILS, f"plain as ({MAILS}), mails as (select mail_id, {SEPARATED} as email_text from plain)")
#: Whether separator y closes what x opens, after what ``acc`` has used.
_ALIKE = """y.i > x.i + 1 and not list_contains(acc.used, y.i) and abs(length(y.t) - length(x.t)) <= 1
    and list_sort(list_distinct(string_split(y.t, ''))) = list_sort(list_distinct(string_split(x.t, '')))
    and len(list_filter(list_distinct(string_split(x.t, '')), lambda c : abs((length(x.t) - length(replace(x.t, c, ''))) - (length(y.t) - length(replace(y.t, c, '')))) > 1)) = 0"""
#: Whether the block from separator x to separator e is body or signature by more than half.
_TAKEN = """e > x.i + 1 and not list_contains(acc.used, e) and (2 * len(list_filter(list_slice(acc.labels, x.i + 1, e + 1), lambda v : v = 'BODY')) > e + 1 - x.i
    or 2 * len(list_filter(list_slice(acc.labels, x.i + 1, e + 1), lambda v : v = 'SIGNATURE')) > e + 1 - x.i)"""

_OUT = ("exact_match", "content_match", "acceptable", "confident_wrong", "failed_static")

ORACLES = {
    "line_split": f"""
with l as (select doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) as l from documents),
x as (select doc_id, cast(unnest(range(len(l))) as int) as pos, unnest(l) as text from l)
select doc_id, pos, cast(length(text) as int) as n_chars, {_strip('text')} = '' as is_blank from x""",
    "blank_map": f"""with {_CONTENT}, b as (select mail_id, cast(count(*) filter (where text = '') as int) as n_blank, cast(count(*) as int) as n_all from lines group by mail_id)
select mail_id, idx, pos as original_index, blank_lines_before, blank_lines_after, n_blank, n_all as n_lines from content join b using (mail_id)""",
    "newline_norm": f"""with {_MAILS}, r as (select *, case when mail_id % 2 = 0 then replace(email_text, chr(10), chr(13) || chr(10)) else replace(email_text, chr(10), chr(13)) end as raw from mails),
x as (select mail_id, email_text, replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as t from r)
select mail_id, cast(len(string_split(t, chr(10))) as int) as n_lines, t = email_text as same from x""",
    "delimiter_unify": f"""with {_LINES}, r as (select mail_id, pos, {RAW_LINE} as raw from lines),
d as ({_DASHES} from r),
s as (select mail_id, pos, line, {_strip('line')} as t from d)
select mail_id, pos, case when regexp_matches(t, '^[-ー]+$') then repeat(case when length(replace(t, 'ー', '')) >= length(replace(t, '-', '')) then '-' else 'ー' end, length(t)) else t end as line from s""",
    "quote_depth": f"with {_LINES} select mail_id, pos, cast({_DEPTH} as int) as depth, {_FLAGS['is_forward_reply_header']} as header from lines",
    "quote_span": f"""with {_CONTENT} select mail_id, max(quote_depth) > 0 as has_quotes, bool_or(is_forward_reply_header) as has_forward_reply,
  coalesce(min(case when quote_depth > 0 then idx end), -1) as first_quote_index, coalesce(max(case when quote_depth > 0 then idx end), -1) as last_quote_index from content group by mail_id""",
    "pattern_flags": f"with {_LINES} select mail_id, pos, {_flags('is_greeting', 'is_closing', 'has_contact_info', 'has_company_pattern', 'has_position_pattern', 'has_meta_discussion', 'is_inside_quotation_marks')} from lines",
    "document_flags": f"""with x as (select doc_id, unnest(string_split(text, chr(10))) as text from documents),
f as (select doc_id, {_flags('has_contact_info', 'has_company_pattern', 'has_position_pattern', 'is_inside_quotation_marks', 'is_forward_reply_header')} from x)
select doc_id, {', '.join(f'count(*) filter (where {n}) as {n}' for n in ('has_contact_info', 'has_company_pattern', 'has_position_pattern', 'is_inside_quotation_marks', 'is_forward_reply_header'))} from f group by doc_id""",
    "name_lines": f"with {_LINES} select mail_id, pos, {_NAME} as is_name, {_ANY_NAME} as has_name from lines",
    "separator_lines": f"with {_LINES} select mail_id, pos, {_SEPARATOR} as is_separator from lines",
    "char_ratios": f"""with {_LINES} select mail_id, pos, {', '.join(f'{_ratio(c)} as {n}' for n, c in _CLASSES.items())}, length(regexp_replace(text, {_q('[' + ''.join(_CLASSES.values()) + ']')}, '', 'g')) / length(text) as symbol_ratio
from lines where text <> ''""",
    "positions": f"""with {_CONTENT}, q as (select *, min(case when quote_depth > 0 then idx end) over (partition by mail_id) as q1, max(case when quote_depth > 0 then idx end) over (partition by mail_id) as q2 from content)
select mail_id, idx, case when n > 1 then idx / (n - 1) else 0.0 end as position_normalized, 1.0 - case when n > 1 then idx / (n - 1) else 0.0 end as position_reverse, idx as lines_from_start, n - 1 - idx as lines_from_end,
  coalesce((idx - q1) / n, 0.0) as position_rel_first_quote, coalesce((idx - q2) / n, 0.0) as position_rel_last_quote, cast(length(text) as int) as line_length, blank_lines_before, blank_lines_after,
  coalesce(lag(is_delimiter) over (partition by mail_id order by idx), false) as preceded_by_delimiter from q""",
    "context_counts": f"""with {_CONTENT} select mail_id, idx, {', '.join(f"cast(count(*) filter (where {t}) over w - case when {t} then 1 else 0 end as int) as context_{n}_count" for n, t in (("greeting", "is_greeting"), ("closing", "is_closing"), ("contact", "has_contact_info"), ("quote", "quote_depth > 0"), ("separator", "is_delimiter")))}
from content window w as (partition by mail_id order by idx rows between 2 preceding and 2 following)""",
    "bracket_sections": f"""with {_SEPARATED_CONTENT},
seps as (
  select mail_id, list({{'i': idx, 't': text, 'used': cast([] as int[]), 'pairs': cast([] as struct(a int, z int)[])}} order by idx) as l from content where is_delimiter group by mail_id having count(*) > 1),
paired as (
  select mail_id, list_reduce(l, lambda acc, x : case when list_contains(acc.used, x.i) or len(list_filter(l, lambda y : {_ALIKE})) = 0 then acc else
    {{'i': x.i, 't': x.t, 'used': list_append(acc.used, list_filter(l, lambda y : {_ALIKE})[1].i), 'pairs': list_append(acc.pairs, {{'a': x.i, 'z': list_filter(l, lambda y : {_ALIKE})[1].i}})}} end,
    {{'i': -1, 't': '', 'used': cast([] as int[]), 'pairs': cast([] as struct(a int, z int)[])}}) as r from seps),
pairs as (select mail_id, p.a as a, p.z as z from (select mail_id, unnest(r.pairs) as p from paired)),
inside as (select c.mail_id, c.idx, max(p.a) as a from content c join pairs p on c.mail_id = p.mail_id and c.idx > p.a and c.idx < p.z group by c.mail_id, c.idx),
holds as (
  select p.mail_id, p.a, bool_or(has_contact_info or has_company_pattern or has_name_pattern) as h
  from pairs p join content c on c.mail_id = p.mail_id and c.idx > p.a and c.idx < p.z group by p.mail_id, p.a)
select c.mail_id, c.idx, i.a is not null as in_bracketed_section, coalesce(h, false) as bracket_has_signature_patterns
from content c left join inside i on c.mail_id = i.mail_id and c.idx = i.idx left join holds on holds.mail_id = i.mail_id and holds.a = i.a""",
    "unify_blocks": f"""with {_SEPARATED_CONTENT}, ruled as (select *, {_RULE} as label from content),
seps as (
  select mail_id, list(label order by idx) as labels, list(idx order by idx) filter (where is_delimiter) as places,
         list({{'i': idx, 'used': cast([] as int[]), 'labels': cast([] as varchar[])}} order by idx) filter (where is_delimiter) as l from ruled group by mail_id),
done as (
  select mail_id, case when len(labels) < 3 or coalesce(len(places), 0) < 2 then labels else list_reduce(l, lambda acc, x :
    case when list_contains(acc.used, x.i) or len(list_filter(places, lambda e : {_TAKEN})) = 0 then acc else
    {{'i': x.i, 'used': list_append(acc.used, list_filter(places, lambda e : {_TAKEN})[1]),
      'labels': list_transform(acc.labels, lambda y, k : case when k - 1 between x.i and list_filter(places, lambda e : {_TAKEN})[1]
        then case when 2 * len(list_filter(list_slice(acc.labels, x.i + 1, list_filter(places, lambda e : {_TAKEN})[1] + 1), lambda v : v = 'BODY')) > list_filter(places, lambda e : {_TAKEN})[1] + 1 - x.i then 'BODY' else 'SIGNATURE' end else y end)}} end,
    {{'i': cast(-1 as int), 'used': cast([] as int[]), 'labels': labels}}).labels end as labels from seps)
select mail_id, array_to_string(labels, ',') as labels from done""",
    "fix_transitions": f"with {_FIXED} select mail_id, idx, l2 as label from fixed",
    "reconstruct": f"""with {_RULED}, j as (select lines.mail_id, lines.pos, lines.text, label from lines left join ruled on lines.mail_id = ruled.mail_id and lines.pos = ruled.pos),
{_carried('j')} select mail_id, pos, blank as is_blank, label, case when not blank then 0.5 end as confidence from carried""",
    "assemble_body": f"with {_MARKED}, j as (select mail_id, pos, text, {_LABEL} as label from marked), {_carried('j')}, {_assembled('carried', 'out')} select * replace (coalesce(signature_index, -1) as signature_index), body_text <> '' as success from out",
    "gold_bodies": f"""with {_RULED}, j as (select lines.mail_id, lines.pos, lines.text, label from lines left join ruled on lines.mail_id = ruled.mail_id and lines.pos = ruled.pos),
{_carried('j')}, {_assembled('carried', 'out')} select mail_id, cast(length(replace(body_text, ' ', '')) as int) as n_chars, cast(len(string_split(body_text, chr(10))) as int) as n_lines from out""",
    "extract_gate": f"""with {_MAILS}, x as (select mail_id, {RAW_MAIL} as t, cast((mail_id % 10) / 10.0 as double) as confidence from mails),
y as (select *, case when t is null or {_strip('t')} = '' or {_zero('t')} = '' then 'InvalidInputError' when mail_id % 7 = 0 then 'NoBodyDetectedError' when confidence < 0.5 then 'LowConfidenceError' end as error_type from x)
select mail_id, error_type, case error_type when 'InvalidInputError' then case when t is null or {_strip('t')} = '' then 'Empty input' else 'Empty input after normalization' end when 'NoBodyDetectedError' then 'No body content detected'
  when 'LowConfidenceError' then printf('Confidence below threshold (confidence: %.2f, threshold: 0.50)', confidence) end as error_text, error_type is null as success from y""",
    "eval_outcomes": f"with {_EVAL} select doc_id, {', '.join(_OUT)}, error_kind as error_type from outcome",
    "eval_rates": f"with {_EVAL} select lang, count(*) as n_total, {', '.join(f'count(*) filter (where {n}) as n_{n}, count(*) filter (where {n}) / count(*) as {n}_rate' for n in _OUT)} from outcome group by lang",
    "eval_errors": f"with {_EVAL} select error_kind as error_type, count(*) as n from outcome where failed_static group by error_kind",
    "eval_by_group": f"""with {_EVAL}, g as (select coalesce(lang, 'unknown') as "group", count(*) filter (where failed_static) as n_failed_static, count(*) filter (where confident_wrong) as n_confident_wrong from outcome group by 1)
select *, n_failed_static + n_confident_wrong as n_failures from g where n_failed_static + n_confident_wrong > 0""",
    "eval_confidence_stats": f"""with judged as ({_JUDGED}), o as (select round(confidence, 6) as v, row_number() over (order by confidence) - 1 as k, count(*) over () as n from judged where success)
select any_value(n) as n, round(avg(v), 6) as mean, min(v) as min, max(v) as max, max(v) filter (where k = n // 2) as median, max(v) filter (where k = n // 10) as p10, max(v) filter (where k = cast(floor(n * 0.9) as bigint)) as p90 from o""",
    "eval_label_metrics": f"""with {_FIXED},
c as (select y as label, sum((l2 = y and label = y)::int)::bigint as tp, sum((l2 = y and label <> y)::int)::bigint as fp, sum((l2 <> y and label = y)::int)::bigint as fn
  from fixed, (select unnest(['GREETING', 'BODY', 'CLOSING', 'SIGNATURE', 'QUOTE', 'OTHER']) as y) group by y having sum((l2 = y or label = y)::int) > 0),
r as (select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as recall from c)
select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from r""",
    "confident_wrong": f"with {_EVAL} select doc_id, confidence from outcome where body is not null and confidence >= 0.5 and sb <> se",
    "label_distribution": f"with {_RULED} select label, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as percent from ruled group by label",
    "label_alignment": f"""with {_RULED}, a as (select label as truth, case when idx < 4 then label else '?' end as predicted from ruled)
select predicted, truth, predicted <> truth as differs, count(*) as n from a group by all""",
    "find_line": f"with {_CONTENT} select mail_id, min(case when contains(text, 'です') then idx end) as idx from content group by mail_id",
}
