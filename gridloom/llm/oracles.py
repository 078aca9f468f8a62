"""DuckDB SQL for the queries that SQL can express."""

from .license_scan import BASE, NEIGHBOURS, SHARE, TEMPLATES
from .quality_rules import BUCKET_BITS, MIN_WORDS, MOST_REPEATED, SHRINK, THRESHOLD
from .url_filter import BLOCKLIST, RULES
from .words import _BASE, _STEP

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
with w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') ws from documents),
b as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') ws from benchmark),
win as (
  select distinct item_id, least(len(ws), 10) n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') s
  from b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) t(i) where len(ws) > 0),
grams as (
  select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') s
  from w, (select distinct n from win), unnest(range(1, len(ws) - n + 2)) t(i)),
occ as (select doc_id, i, n, item_id from grams join win using (n, s)),
hit as (select doc_id, count(distinct j) n_hit from occ, unnest(range(i, i + n)) t(j) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item_id::varchar item from occ) group by doc_id)
select w.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join hit using (doc_id) left join its using (doc_id)
"""

OP4 = """
with l as (select doc_id, i - 1 pos, string_split(text, chr(10))[i] line from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)),
s as (select doc_id, pos, line, row_number() over (partition by doc_id order by pos) - 1 k from l where trim(line) <> ''),
w as (
  select doc_id, k, line || chr(10) || lead(line, 1) over d || chr(10) || lead(line, 2) over d win from s window d as (partition by doc_id order by k)),
later as (select doc_id, k from (select doc_id, k, row_number() over (partition by win order by doc_id, k) r from w where win is not null) where r > 1),
gone as (select distinct s.doc_id, s.pos from later, unnest([0, 1, 2]) t(o), s where s.doc_id = later.doc_id and s.k = later.k + o),
kept as (
  select l.doc_id, count(*) n_lines, count(g.pos) n_removed, string_agg(case when g.pos is null then line end, chr(10) order by l.pos) body
  from l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed,
  case when d.text is not null then sha256(coalesce(body, '')) end kept_sha256
from documents d left join kept using (doc_id)
"""

OP6 = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i : i + 3], ' ') g from w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) t(i) where len(ws) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
shared as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (select x, y from shared join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
reach(x, y) as (select x, y from link union select reach.x, link.y from reach join link on reach.y = link.x)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(w.doc_id, coalesce((select min(y) from reach where x = w.doc_id), w.doc_id))::bigint component_id
from w left join n using (doc_id)
"""

OP8 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) s from d, unnest(range(0, n - 49)) t(i)),
m as (select s, min(doc_id) least_id from w group by s),
hit as (select doc_id, i from w join m using (s) where least_id < doc_id),
f as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end fresh from hit),
k as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) run from f),
r as (select doc_id, run, min(i) a, max(i) + 50 b from k group by doc_id, run),
g as (select r.doc_id, run, coalesce(lag(b) over (partition by r.doc_id order by run), 0) a, r.a b from r),
e as (select doc_id, max(run) + 1 run, max(b) a from r group by doc_id),
p as (select doc_id, run, a, b from g union all select e.doc_id, run, a, n from e join d using (doc_id)),
kept as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by run) h from p join d using (doc_id) group by doc_id),
gone as (select doc_id, sum(b - a) n_removed, count(*) n_spans from r group by doc_id)
select d.doc_id, n::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(kept.h, d.h))) kept_sha256
from d left join kept using (doc_id) left join gone using (doc_id)
"""

def _positions() -> str:
    rows = []
    for exact, phrases in ((True, BASE), (False, TEMPLATES)):
        for k, (label, phrase) in enumerate(phrases):
            ws = phrase.split(" ")
            rows += [f"('{label}', {exact}, {k + 100 * (not exact)}, {len(ws) - 1}, {i}, '{a}', '{b}')" for i, (a, b) in enumerate(zip(ws, ws[1:], strict=False))]
    return ", ".join(rows)


_SHARED = "coalesce(array_to_string(list_sort(list_distinct(list({0}) filter ({1}))), ','), '')"
OP9 = f"""
with w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') ws from documents),
g as (select doc_id, i - 1 spot, ws[i] a, ws[i + 1] b from w, unnest(range(1, len(ws))) t(i)),
t as (select * from (values {_positions()}) v(label, exact, template, pairs, place, a, b)),
v as (select distinct doc_id, label, exact, template, pairs, place, spot - place diagonal from g join t using (a, b)),
d as (select distinct doc_id, exact, template, diagonal from v),
f as (select *, case when exact or diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) > {NEIGHBOURS} then 1 else 0 end apart from d),
k as (select doc_id, template, diagonal, sum(apart) over (partition by doc_id, template order by diagonal) span from f),
s as (
  select doc_id, label, exact, span, template, min(diagonal) first, count(distinct place) / pairs held
  from v join k using (doc_id, template, diagonal) group by doc_id, label, exact, template, pairs, span),
found as (
  select doc_id, count(*) filter (exact and held = 1) n_base, min(first) filter (exact and held = 1) first_word, max(first) filter (exact and held = 1) last_word,
    {_SHARED.format("label", "exact and held = 1")} base_labels, {_SHARED.format("label", f"(exact and held = 1) or (not exact and held >= {SHARE})")} labels, max(held) score
  from s group by doc_id)
select w.doc_id, len(ws)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0)::double score
from w left join found using (doc_id)
"""

_RULE_ROWS = ", ".join(f"('{v}', '{r}')" for v, r in RULES)
_LIST_ROWS = ", ".join(f"('{r}')" for r in BLOCKLIST)
_FITS = "({h} = split_part({r}, '/', 1) or ends_with({h}, '.' || split_part({r}, '/', 1))) and starts_with({p}, substr({r}, strpos({r}, '/')))"

OP10 = f"""
with p as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
u as (select page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")} host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from p),
r as (select * from (values {_RULE_ROWS}) t(verdict, rule)),
b as (select * from (values {_LIST_ROWS}) t(entry)),
best as (
  select page_id, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) verdict
  from u join r on {_FITS.format(h="host", p="path", r="rule")} group by page_id),
bad as (select distinct page_id from u join b on {_FITS.format(h="host", p="path", r="entry")})
select u.page_id, host, path, rule, coalesce(verdict, case when bad.page_id is not null then 'block' else 'allow' end) verdict
from u left join best using (page_id) left join bad using (page_id)
"""


_TO_BYTES = "list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::int)"
_64 = "18446744073709551616::hugeint"
_SOLID = r"[^\x20\x09-\x0D]"
_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F]+"


def _times(x: str, factor: int) -> str:
    """A product modulo 2**64, in halves that 128 signed bits can hold."""
    return f"((({x})::hugeint * {factor & 0xFFFFFFFF} + ({x})::hugeint * {factor >> 32} % 4294967296 * 4294967296) % {_64})"


def _mix(name: str, source: str, key: str, x: str, given: str) -> str:
    """CTEs that finish hashes as ``words.mix`` does."""
    return f"""
{name}1 as (select {key}, xor(h, h >> 30) h from (select {key}, ({x})::ubigint h from {source})),
{name}2 as (select {key}, {_times("h", 0xBF58476D1CE4E5B9)}::ubigint h from {name}1),
{name}3 as (select {key}, {_times("xor(h, h >> 27)", 0x94D049BB133111EB)}::ubigint h from {name}2),
{given} as (select {key}, xor(h, h >> 31) h from {name}3)"""


_HORNER = f"({_times('s', _BASE)} + b + 1) % {_64}"
OP11 = f"""
with d as (select doc_id, coalesce(text, '') x from documents),
w as (select doc_id, x, regexp_extract_all(x, '{_SOLID}+') ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{_SOLID}')) ls from d),
win as (select doc_id, i, array_to_string(ws[i : i + 2], ' ') g from w, unnest(range(1, len(ws) - 1)) t(i)),
rep as (select doc_id, i from win join (select doc_id, g from win group by all having count(*) > 1) using (doc_id, g)),
cov as (select doc_id, count(distinct i + o) n from rep, unnest([0, 1, 2]) t(o) group by doc_id),
form as (
  select doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) n_symbols,
    len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(n, 0) n_repeat_words from w left join cov using (doc_id)),
k as (select doc_id, regexp_extract_all({_LOWER.format("x")}, '{_TOKEN}') ts from d),
token as (select distinct unnest(ts) a from k),
sums as (select a, list_reduce(list_reverse({_TO_BYTES.format("a")}), lambda s, b: {_HORNER}, 0::hugeint) s from token),{_mix("h", "sums", "a", f"(s + octet_length(encode(a))) % {_64}", "hash")},
pair as (
  select p.a, p.b, x.h h, y.h g from (select distinct ts[i] a, ts[i + 1] b from k, unnest(range(1, len(ts))) t(i)) p join hash x on x.a = p.a join hash y on y.a = p.b),{_mix("p", "pair", "a, b", f"({_times(f'({2 * int(_STEP)} + h) % {_64}', int(_STEP))} + g) % {_64}", "joint")},
f as (
  select doc_id, h >> {64 - BUCKET_BITS} bucket from k, unnest(ts) t(a) join hash using (a)
  union all
  select doc_id, h >> {64 - BUCKET_BITS} from (select doc_id, ts[i] a, ts[i + 1] b from k, unnest(range(1, len(ts))) t(i)) join joint using (a, b)),
good as (select distinct doc_id from labels where quality = 1),
c as (select bucket, count(*) s, count(good.doc_id) t from f left join good using (doc_id) group by bucket),
gain as (
  select bucket, floor(1000000 * ln((t + {SHRINK})::double / ((sum(t) over ())::double / (sum(s) over ())::double * s::double + {SHRINK})))::bigint gain from c),
worth as (select doc_id, count(*) n_features, sum(gain) gain from f join gain using (bucket) group by doc_id),
j as (
  select form.*, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words base_failed, coalesce(n_features, 0) n_features, coalesce(gain, 0) gain
  from form left join worth using (doc_id))
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words,
  base_failed, not base_failed and gain >= {THRESHOLD} * n_features kept, n_features::bigint n_features, gain::bigint gain
from j
"""


OP12 = f"""
with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) piece from documents),
w as (select lang, row_number() over () id, regexp_extract_all(piece, '[^\\x20\\x09]+') ws from p),
t as (select lang, id, unnest(ws) a, unnest(range(len(ws))) i from w),
g as (select lang, a, lead(a) over d b, lead(a, 2) over d c from t window d as (partition by id order by i)),
f as materialized (
  select lang, 1 k, a phrase, count(*) f from g group by all
  union all select lang, 2, a || ' ' || b, count(*) from g where b is not null group by all
  union all select lang, 3, a || ' ' || b || ' ' || c, count(*) from g where c is not null group by all),
key as (select (lang, phrase) id, f from f),
total as (select lang, sum(f) n from f where k = 1 group by lang),
c as (select * from f where k > 1 and f >= 10),
cut as (
  select lang, phrase, k, f, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') one, array_to_string(string_split(phrase, ' ')[j + 1 :], ' ') two
  from c, unnest(range(1, k)) t(j)),
v as (
  select cut.*, x.f l, y.f r, (1000000::hugeint * cut.f * cut.f) // (x.f::hugeint * y.f) score
  from cut join key x on x.id = (cut.lang, one) join key y on y.id = (cut.lang, two)),
b as (select * from v qualify row_number() over (partition by lang, phrase order by score, j) = 1),
around as (
  select lang, sub, max(f) f
  from (
    select lang, f, array_to_string(string_split(phrase, ' ')[1 : 2], ' ') sub from c where k = 3
    union all
    select lang, f, array_to_string(string_split(phrase, ' ')[2 : 3], ' ') from c where k = 3) group by all),
kept as (select b.* from b left join around a on a.lang = b.lang and a.sub = b.phrase where a.f is null or 100 * a.f < 50 * b.f),
placed as (select *, row_number() over (partition by lang order by score desc, f desc, phrase) rank from kept)
select lang, rank::bigint rank, phrase, f::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score
from placed join total using (lang) where rank <= 2000
"""


def _crc_table() -> list[int]:
    """The 256 remainders of the reflected polynomial EDB88320."""
    rows = list(range(256))
    for _ in range(8):
        rows = [(r >> 1) ^ 0xEDB88320 if r & 1 else r >> 1 for r in rows]
    return rows


OP13 = f"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') ws from documents),
b as (select row_number() over () item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') ws from benchmark),
f as (
  select 0 kind, doc_id id, array_to_string(ws[i : i + k - 1], ' ') f from d, unnest([1, 2, 3]) n(k), unnest(range(1, len(ws) - k + 2)) t(i)
  union all
  select 1, item, array_to_string(ws[i : i + k - 1], ' ') f from b, unnest([1, 2, 3]) n(k), unnest(range(1, len(ws) - k + 2)) t(i)),
c as (select kind, id, f, count(*) n from f group by all),
h as (
  select f, xor(list_reduce({_TO_BYTES.format("f")}, lambda a, x: xor(a >> 8, {_crc_table()}[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 10000 bucket
  from (select distinct f from c)),
w as (select kind, id, bucket, sum(n) n from c join h using (f) group by all),
s as (
  select bucket, sum(n) filter (kind = 0) s, coalesce(sum(n) filter (kind = 1), 0) t from w group by bucket),
total as (select sum(n) filter (kind = 0) s, coalesce(sum(n) filter (kind = 1), 0) t from w),
g as (
  select bucket, floor(1000 * ln((s.t::double + 1) * (total.s::double + 10000) / ((s.s::double + 1) * (total.t::double + 10000))))::bigint gain from s, total),
weight as (select id, sum(n)::bigint n_features, sum(n * gain)::bigint weight from w join g using (bucket) where kind = 0 group by id),
scored as (
  select doc_id, len(ws) n_words, coalesce(n_features, 0)::bigint n_features, coalesce(weight, 0)::bigint weight, ('0x' || substr(sha256('42:' || doc_id::varchar), 1, 8))::bigint h
  from d left join weight on d.doc_id = weight.id),
final as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint score from scored),
placed as (select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id) end place from final)
select doc_id, n_features, weight, score, case when place <= 5 * (select count(*) from final where n_words >= 20) // 100 then place end::bigint rank from placed
"""

ORACLES: dict[str, str] = {
    "op3_decontaminate": OP3,
    "op4_line_dedup": OP4,
    "op6_jaccard_join": OP6,
    "op8_substring_dedup": OP8,
    "op9_license_scan": OP9,
    "op10_url_filter": OP10,
    "op11_quality_rules": OP11,
    "op12_phrases": OP12,
    "op13_importance": OP13,
}
