"""The registered queries ``opN_<name>``: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigauge.llm.common import read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by positive-unlabelled learning."""
    from lexigauge.llm.pu_classifier import quality_scores

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and divergence verdict of every document."""
    from lexigauge.llm.quality_rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations rebuilt from their event logs, rendered, and read back."""
    from lexigauge.llm.chat import digests, event_log, fold, render

    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digests(render(fold(event_log(table.unionByName(more)))))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page: five rules, else the n-gram model trained on the small labelled table."""
    from lexigauge.llm.url_filter import Rule, labelled_urls, url_verdicts

    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
    return url_verdicts(read(spark, sf_dir, "pages"), rules, labelled_urls(spark))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the two-tier lookup."""
    import public_tokenizers

    from lexigauge.llm.token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte-level BPE, decoded again; digests of both."""
    import public_tokenizers

    from lexigauge.llm.bpe import bpe_digests

    return bpe_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back, with digests verified."""
    from lexigauge.llm.common import scratch
    from lexigauge.llm.warc import read_warc, write_warc

    folder = scratch(spark, "warc")
    manifest = write_warc(read(spark, sf_dir, "pages"), folder, minimum=0)
    back = read_warc(manifest, folder, max(1, manifest.count()))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of every document by 3-word SimHash within 2 bits."""
    from lexigauge.llm.simhash import simhash_components

    return simhash_components(read(spark, sf_dir, "documents"), words=3, radius=2)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in which a benchmark item occurs, substitutions tolerated."""
    from lexigauge.llm.decontamination import benchmark_hits

    return benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards whose byte sizes are as near equal as whole groups allow."""
    from lexigauge.llm.sharding import assign_shards

    return assign_shards(read(spark, sf_dir, "documents"), shards=40, overhead=16)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its neighbours one edit apart, its form and its root."""
    from lexigauge.llm.spelling import spelling_variants

    return spelling_variants(read(spark, sf_dir, "documents"), letters=7, least=2, one_in=31, times=10)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that other documents share with it, by keep bitmaps."""
    from lexigauge.llm.line_dedup import Shared, line_digests

    return line_digests(read(spark, sf_dir, "documents"), Shared(chars=20, docs=3))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and turned for filling in the middle, and turned back."""
    from lexigauge.llm.fim import Plan, fim_digests

    return fim_digests(read(spark, sf_dir, "documents"), Plan(seed=7, rate=100, spm=50))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


_CHAT = r"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped as (select *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) as n,
  length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) as m from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn), '')) as loss_sha256,
  cast(sum(n + m + 15) as bigint) as formatted_chars
from escaped group by conv_id"""

_WARC = """
with pages_ as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
first as (select html, max(page_id) as first from pages_ group by html),
bits as (select page_id, html, list_reduce(list_transform(range(1, 41), lambda i: case substr(h, i, 1)
  when '0' then '0000' when '1' then '0001' when '2' then '0010' when '3' then '0011' when '4' then '0100' when '5' then '0101' when '6' then '0110' when '7' then '0111'
  when '8' then '1000' when '9' then '1001' when 'a' then '1010' when 'b' then '1011' when 'c' then '1100' when 'd' then '1101' when 'e' then '1110' else '1111' end), lambda x, y: x || y) as b from pages_)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * cast(substr(b, 5 * i + 1, 1) as integer) + 8 * cast(substr(b, 5 * i + 2, 1) as integer)
    + 4 * cast(substr(b, 5 * i + 3, 1) as integer) + 2 * cast(substr(b, 5 * i + 4, 1) as integer) + cast(substr(b, 5 * i + 5, 1) as integer), 1)), lambda x, y: x || y) as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, true as verified
from bits join first using (html)"""

_OVERLAP = r"""
with d as (select doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') as w from documents),
b as (select item_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') as w from benchmark),
dt as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as i from d),
bt as (select item_id, len(w) as n, unnest(w) as t, generate_subscripts(w, 1) as k from b),
hits as (select doc_id, item_id, i - k as shift from dt join bt using (t) group by 1, 2, 3 having count(*) >= least(12, ceil(any_value(n) * 0.7))),
laid as (select doc_id, item_id, shift, len(b.w) as n, k, case when k + shift >= 1 and d.w[k + shift] = b.w[k] then 1 else 0 end as same from hits join d using (doc_id) join b using (item_id), unnest(range(1, len(b.w) + 1)) u(k)),
runs as (select *, sum(case when same = 1 then 1 else -2 end) over (partition by doc_id, item_id, shift order by k) as s from laid),
low as (select *, least(0, coalesce(min(s) over (partition by doc_id, item_id, shift order by k rows between unbounded preceding and 1 preceding), 0)) as least_ from runs),
best as (select doc_id, item_id, shift, any_value(n) as n, sum(same) as matched, greatest(0, max(s - least_)) as stretch from low group by 1, 2, 3)
select doc_id, item_id, cast(max(matched) as integer) as matched, cast(max(n) as integer) as item_tokens, cast(max(stretch) as integer) as stretch
from best where matched >= ceil(n * 0.7) or stretch >= 12 group by 1, 2"""


_RULES = r"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang from documents),
w as (select doc_id, lang, unnest(words) as word, generate_subscripts(words, 1) as i from (select doc_id, lang, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as words from d)),
lines as (select doc_id, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^ \t\n\x0B\f\r]') group by 1),
three as (select doc_id, i, count(*) over (partition by doc_id, word, b, c) as n from (select doc_id, i, word, lead(word) over o as b, lead(word, 2) over o as c from w window o as (partition by doc_id order by i)) where c is not null),
cover as (select doc_id, count(distinct i + k) as n_repeat_words from three cross join (select range as k from range(3)) where n > 1 group by 1),
sizes as (select doc_id, count(*) as n_words, sum(length(word)) as word_chars from w group by 1),
cls as (select doc_id, lang, length(text) as n, [length(regexp_replace(text, '[^\p{Ll}\p{Lt}\p{Lm}\p{Lo}]', '', 'g')), length(regexp_replace(text, '[^\p{Lu}]', '', 'g')), length(regexp_replace(text, '[^\p{N}]', '', 'g')), length(text) - length(replace(text, ' ', '')),
  length(text) - length(replace(text, chr(10), '')), length(regexp_replace(text, '[^.,;:!?''"()\-]', '', 'g'))] as six from d),
c7 as (select doc_id, lang, n, list_append(six, n - list_sum(six)) as c from cls),
cn as (select lang, lower(word) as word, count(*) as n from w group by 1, 2),
tot as (select lang, sum(n) as total from cn group by 1),
own as (select lang, word, n / cast(total as double) as q from (select *, row_number() over (partition by lang order by n desc, word) as rn from cn) join tot using (lang) where rn <= 40 and total >= 5000),
refsum as (select lang, sum(q) as q from own group by 1),
chars as (select lang, k, sum(c[k]) as n from c7 cross join (select range as k from range(1, 8)) group by 1, 2),
charref as (select t.lang, k, sum(x.n) / cast(sum(sum(x.n)) over (partition by t.lang) as double) as q from tot t join chars x on t.total >= 5000 and x.lang = t.lang group by 1, 2),
cd as (select doc_id, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) as s from (select doc_id, c[k] / cast(n as double) as p, q from c7 join charref using (lang) where n >= 200) group by 1),
wp as (select doc_id, lang, lower(word) as word, count(*) / cast(any_value(n_words) as double) as p from w join sizes using (doc_id) where n_words >= 50 group by 1, 2, 3),
seen as (select doc_id, sum(p) as p, sum(q) as q, sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) as s from wp join own using (lang, word) group by 1),
wd as (select doc_id, s + (rq - q) + case when pr > 1e-12 then pr * log2(pr / ((pr + qr) / 2)) else 0 end + case when qr > 0 then qr * log2(qr / ((pr + qr) / 2)) else 0 end as s
  from (select d.doc_id, coalesce(s.s, 0) as s, coalesce(s.q, 0) as q, r.q as rq, 1 - coalesce(s.p, 0) as pr, 1 - r.q as qr from d join sizes z on d.doc_id = z.doc_id and z.n_words >= 50 join refsum r using (lang) left join seen s on s.doc_id = d.doc_id)),
f as (select d.doc_id, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  case when cd.s is not null then round(sqrt(greatest(0, cd.s / 2)), 6) end as char_distance, case when wd.s is not null then round(sqrt(greatest(0, wd.s / 2)), 6) end as word_distance
  from d left join sizes using (doc_id) left join lines using (doc_id) left join cover using (doc_id) left join cd on cd.doc_id = d.doc_id left join wd on wd.doc_id = d.doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not coalesce(char_distance > 0.30, false) and not coalesce(word_distance > 0.22 + 1.5 / sqrt(n_words), false) as kept from f"""


_SPELLING = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (
  select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{7,}')) as run from documents),
low as (
  select coalesce(cast(doc_id as varchar), '') || ':' as head, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from runs),
bytes as (
  select w, flatten(list_transform(string_split(head || w, ''), lambda c: case when ord(c) < 128 then [cast(ord(c) as bigint)] else [192 | (ord(c) >> 6), 128 | (ord(c) & 63)] end)) as b from low),
hashed as (
  select w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) as h from bytes, crc),
words as (
  select case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word from hashed),
counts as (select word, count(*) as n from words where length(word) >= 7 group by 1 having count(*) >= 2),
shorter as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from counts)),
pairs as (
  select a.word, b.word as near, b.n as near_n from shorter a join shorter b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select s.word, c.word, c.n from shorter s join counts c on s.rest = c.word
  union select c.word, s.word, s.n from shorter s join counts c on s.rest = c.word),
ranked as (
  select *, count(*) over (partition by word) as n_near, row_number() over (partition by word order by near_n desc, near) as rn from pairs),
forms as (
  select c.word, c.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * c.n then near end as form, case when near_n >= 10 * c.n then near_n end as form_n
  from counts c left join ranked r on r.word = c.word and rn = 1),
paths as (
  select word, word as root, 0 as step from forms
  union all select p.word, f.form, step + 1 from paths p join forms f on f.word = p.root and f.form is not null),
roots as (select word, arg_max(root, step) as root from paths group by 1)
select word, n, n_near, form, cast(form_n as bigint) as form_n, root from forms join roots using (word)"""

_LINES = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
shared as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by 1 having count(distinct doc_id) >= 3),
marked as (select k.doc_id, pos, line, keeper is null or keeper = k.doc_id as kept from k left join shared using (key))
select doc_id, count(*) as n_lines, count(*) filter (not kept) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (kept), '')) as kept_sha256
from marked group by 1"""

_FIM = r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (
  select *, len(units) as n, cast('0x' || h[1:8] as bigint) % (len(units) + 1) as one, cast('0x' || h[9:16] as bigint) % (len(units) + 1) as two, cast('0x' || h[25:32] as bigint) % 100 as four from d),
cut as (
  select *, array_to_string(units[1:least(one, two)], '') as p, array_to_string(units[least(one, two) + 1:greatest(one, two)], '') as m, array_to_string(units[greatest(one, two) + 1:], '') as s,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain' when four < 50 then 'spm' else 'psm' end as form from drawn)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
from cut"""


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL, for the queries that SQL can express."""
    return {"op2_quality_rules": _RULES, "op3_chat_format": _CHAT, "op7_warc": _WARC, "op9_decontamination": _OVERLAP, "op11_spelling": _SPELLING, "op12_line_dedup": _LINES, "op13_fim": _FIM}
