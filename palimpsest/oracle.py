"""DuckDB equivalents of the library's operators, built from expression templates over the driver's tables."""

from __future__ import annotations

W = r"[\p{L}\p{N}_]+"
BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
NUM = r"^((\p{Nd}+)(?:\.(\p{Nd}+))*[.)]?)\s+([^\n]+)$"
BULLET = r"^([•\-*]|\p{Nd}+[.)])\s+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def norm(x: str) -> str:
    flat = f"replace(replace({x}, chr(173), ''), chr(160), ' ')"
    lines = f"regexp_replace({flat}, '[ \\t]+', ' ', 'g')"
    gaps = rf"regexp_replace({lines}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(gaps)


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{W}')"


def tokens(x: str) -> str:
    return f"greatest(1, len({words(x)}))"


def upper(x: str) -> str:
    return rf"(regexp_matches({x}, '\p{{Lu}}') and not regexp_matches({x}, '[\p{{Ll}}\p{{Lt}}]'))"


def header(x: str) -> str:
    """Of a normalised text."""
    return rf"(length({x}) <= 120 and regexp_matches({x}, '^[\p{{L}}\p{{N}}_\s\-.,:/()|]+$') and regexp_matches({x}, '\p{{L}}'))"


def like(x: str) -> str:
    """Heading-like, of a normalised text."""
    n = f"len({words(x)})"
    titled = rf"len(list_filter({words(x)}, lambda w: regexp_matches(w, '^\p{{Lu}}')))"
    return f"({x} <> '' and {n} <= 14 and (regexp_matches({x}, '{NUM}') or (length({x}) <= 80 and {upper(x)} and {n} <= 10) or (length({x}) <= 70 and not regexp_matches({x}, '[.!?]') and {titled} >= greatest(1, {n} - 1))))"


def heading(x: str, font: str, bold: str, median: str) -> str:
    n = f"len({words(x)})"
    return f"({x} <> '' and {n} <= 18 and length({x}) <= 120 and (regexp_matches({x}, '{NUM}') or ({upper(x)} and {n} <= 10) or ({bold} and {font} >= {median} * 1.15 and {n} <= 12) or ({font} >= {median} * 1.35 and {n} <= 12) or ({like(x)} and {font} >= {median} * 1.20)))"


def slug(x: str) -> str:
    s = rf"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9.\- ]+', '', 'g'), '\s+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"(case when {s} = '' then 'section' else {s} end)"


def numbered(x: str) -> str:
    return f"(case when regexp_matches({x}, '{NUM}') then list_filter(string_split(regexp_replace(regexp_extract({x}, '{NUM}', 1), '[.)]+$', ''), '.'), lambda p: p <> '') end)"


def title(x: str) -> str:
    t = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    return f"(case when length({t}) > 90 then regexp_replace({t}[1:90], '{BLANK}+$', '') else {t} end)"


def truncate(x: str, n: int) -> str:
    t = strip(x)
    return f"(case when length({t}) <= {n} then {t} else regexp_replace({t}[1:{n - 3}], '{BLANK}+$', '') || '...' end)"


def paragraphs(x: str) -> str:
    parts = rf"list_filter(list_transform(string_split_regex({x}, '\n\s*\n'), lambda p: {strip('p')}), lambda p: p <> '')"
    return f"(case when len({parts}) > 0 then {parts} when {x} <> '' then [{x}] else [] end)"


def path_text(x: str) -> str:
    return f"array_to_string(list_filter({x}, lambda p: p <> ''), ' > ')"


def prefix_similarity(a: str, b: str) -> str:
    n = f"len(list_filter(range(1, 1 + least(len({a}), len({b}))), lambda i: {a}[1:i] = {b}[1:i]))"
    return f"(case when coalesce(len({a}), 0) = 0 or coalesce(len({b}), 0) = 0 then 0.0 when {a} = {b} then 1.0 else {n}::double / greatest(len({a}), len({b})) end)"


BODY = "('paragraph', 'bullet')"


def kind_bonus(a: str, b: str) -> str:
    return f"(case when {a} is null or {b} is null then 0.0 when {a} = {b} then case when {a} = 'section' then 1.0 else 0.6 end when {a} in {BODY} and {b} in {BODY} then 0.35 else -0.5 end)"


def size_bonus(a: str, b: str) -> str:
    return f"(0.05 * least(greatest({a}, 1), greatest({b}, 1)) / greatest(greatest({a}, 1), greatest({b}, 1)))"


def page_bonus(a: str, b: str) -> str:
    return f"(case when {a} is null or {b} is null then 0.0 when {a} = {b} then 0.03 when abs({a} - {b}) = 1 then 0.02 when abs({a} - {b}) <= 3 then 0.01 else 0.0 end)"


def bucket(x: str, dim: int) -> str:
    return f"(('0x' || substr(md5({x}), 1, 7))::bigint % {dim})"


LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents)"

FA_PAIRS = """
    fa_k as (select doc_id, string_split(text, chr(10)) as lines from documents where len(string_split(text, chr(10))) >= 3),
    fa_r as (select doc_id, lines, row_number() over (partition by lines[1] order by doc_id) as r, count(*) over (partition by lines[1]) as n, min(doc_id) over (partition by lines[1]) as first from fa_k),
    fa_p as (select first::varchar as pair_id, case r when 1 then 'legacy' else 'modern' end as doc_side, doc_id, lines from fa_r where n between 2 and 4 and r <= 2),
    fa_x as (select pair_id, doc_side, unnest(lines) as text, generate_subscripts(lines, 1) - 1 as line from fa_p)"""


_NAMED = """
    fa_d as (select doc_id, string_split(text, chr(10)) as lines, sha256(text) as digest, coalesce(doc_id::varchar, '~' || sha256(text)) as base from documents where text is not null),
    fa_c as (select *, row_number() over (partition by base order by digest) as copy from fa_d),
    fa_n as (select case copy when 1 then base else base || '#' || copy end as name, doc_id, lines from fa_c),"""

#: Every document by itself, in the place of FA_PAIRS.
SINGLE_DOCUMENTS = f"""{_NAMED}
    fa_x as (select name as pair_id, 'legacy' as doc_side, unnest(lines) as text, generate_subscripts(lines, 1) - 1 as line from fa_n)"""

#: Every document with the one before it that has the same first line, in the place of FA_PAIRS.
DOCUMENT_PAIRS = f"""{_NAMED}
    fa_b as (select *, lag(name) over (partition by lines[1] order by doc_id nulls first, name) as before from fa_n),
    fa_p as (select before as pair_id, 'modern' as doc_side, lines from fa_b where before is not null
             union all select b.before, 'legacy', n.lines from fa_b b join fa_n n on n.name = b.before),
    fa_x as (select pair_id, doc_side, unnest(lines) as text, generate_subscripts(lines, 1) - 1 as line from fa_p)"""

def fa_blocks(pitch: bool = False) -> str:
    y0 = "((line % 4) * 40" + (" - case when line % 3 <> 0 then 26 else 0 end" if pitch else "") + ")::double"
    return f"{FA_PAIRS},\n    blocks as (select pair_id, doc_side, (line // 4 + 1)::int as page, (line % 4)::int as block_pos, text, 50.0::double as x0, {y0} as y0, 550.0::double as x1, {y0} + 12 as y1, 10.0::double as font_size, false as is_bold from fa_x)"


_HTML = r"regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g')"
_HTML = rf"regexp_replace({_HTML}, '<(h1|p|li)(?: [^>]*)?>', chr(1) || '\1' || chr(2), 'g')"
_HTML = f"regexp_replace(regexp_replace({_HTML}, '</(h1|p|li|ul|nav|article|div|footer)>', chr(1), 'g'), '<[^>]*>', '', 'g')"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_e}', '{_c}')"

FB_BLOCKS = f"""
    fb_h as (select regexp_extract(html, '<html lang="([a-z]+)"', 1) as pair_id, case page_id % 2 when 0 then 'legacy' else 'modern' end as doc_side, page_id, {_HTML} as h from pages),
    fb_g as (select pair_id, doc_side, (row_number() over (partition by pair_id, doc_side order by page_id))::int as page, list_filter(string_split(h, chr(1)), lambda x: regexp_matches(x, '(?s)^(h1|p|li)' || chr(2))) as parts from fb_h where pair_id <> ''),
    fb_u as (select pair_id, doc_side, page, unnest(parts) as part, generate_subscripts(parts, 1) as i from fb_g),
    fb_t as (select pair_id, doc_side, page, i, split_part(part, chr(2), 1) as tag, {norm("split_part(part, chr(2), 2)")} as t from fb_u),
    fb_n as (select *, (row_number() over (partition by pair_id, doc_side, page order by i) - 1)::int as block_pos from fb_t where t <> ''),
    blocks as (select pair_id, doc_side, page, block_pos, case tag when 'li' then '• ' || t else t end as text, 50.0::double as x0, (block_pos * 40)::double as y0, 550.0::double as x1, (block_pos * 40 + 12)::double as y1, case tag when 'h1' then 18.0 else 10.0 end::double as font_size, tag = 'h1' as is_bold from fb_n)"""

LAYOUT = f"""
    page_counts as (select pair_id, doc_side, max(page) as page_count from blocks group by all),
    keyed as (select *, lower({norm("text")}) as key from blocks),
    headers as (select pair_id, doc_side, key from (select pair_id, doc_side, key, count(distinct page) as n from keyed where {header("key")} group by all) join page_counts using (pair_id, doc_side) where n >= greatest(2, floor(page_count * 0.35))),
    kept as (select k.* exclude (key) from keyed k anti join headers h using (pair_id, doc_side, key)),
    medians as (select pair_id, doc_side, coalesce((list_sort(list(font_size) filter (font_size > 0)))[len(list(font_size) filter (font_size > 0)) // 2 + 1], 0.0) as median from kept group by all),
    m1 as (select *, {norm("text")} as t from kept join medians using (pair_id, doc_side)),
    m2 as (select *, ({heading("t", "font_size", "is_bold", "median")} or regexp_matches(t, '{BULLET}')) as alone from m1 where t <> ''),
    m3 as (select *, (alone or coalesce(lag(alone) over w, true) or coalesce(abs(lag(x0) over w - x0) > 28 or y0 - lag(y1) over w > 18, false))::int as opens, row_number() over w as rn from m2 window w as (partition by pair_id, doc_side, page order by y0, x0, block_pos)),
    m4 as (select *, sum(opens) over (partition by pair_id, doc_side, page order by rn) as island, lead(opens) over (partition by pair_id, doc_side, page order by rn) as next_opens from m3),
    merged as (
        select pair_id, doc_side, page, (island - 1)::int as block_pos,
               case when bool_or(alone) then any_value(text) else {norm("string_agg(case when coalesce(next_opens, 1) = 1 then t when ends_with(t, '-') then t[1:length(t) - 1] else t || ' ' end, '' order by rn)")} end as text,
               min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, max(font_size) as font_size, bool_or(is_bold) as is_bold, any_value(median) as median
        from m4 group by pair_id, doc_side, page, island),
    cls as (select *, {heading("t", "font_size", "is_bold", "median")} as heading, row_number() over (partition by pair_id, doc_side order by page, block_pos) as pos from (select *, {norm("text")} as t from merged) where t <> ''),
    pathed as (
        select * exclude (np, sp), coalesce(last_value(np ignore nulls) over w, first_value(sp ignore nulls) over w, []) as path
        from (select *, case when heading then {numbered("t")} end as np, case when heading then [{slug("t")}] end as sp from cls)
        window w as (partition by pair_id, doc_side order by pos rows between unbounded preceding and current row))"""

NODES = f"""
    p1 as (select *, unnest({paragraphs("t")}) as ptext, generate_subscripts({paragraphs("t")}, 1) - 1 as part from pathed where not heading),
    p2 as (select *, {tokens("ptext")} as tokens, regexp_matches(ptext, '{BULLET}') as bullet from p1),
    p3 as (
        select *, (lag(ptext) over w is null or pos - lag(pos) over w > 1 or bullet or {like("ptext")}
                   or (regexp_matches(lag(ptext) over w, '[.!?;:]$') and regexp_matches(ptext, '^\\p{{Lu}}')))::int as broken
        from p2 window w as (partition by pair_id, doc_side, page order by pos, part)),
    p4 as (select *, sum(broken) over (partition by pair_id, doc_side, page order by pos, part) as run from p3),
    p5 as (select *, row_number() over (partition by pair_id, doc_side, page, run order by pos, part) as i from p4),
    fold as (
        select pair_id, doc_side, page, run, i, tokens as total, 0 as cur from p5 where i = 1
        union all
        select p5.pair_id, p5.doc_side, p5.page, p5.run, p5.i, case when f.total + p5.tokens <= 220 then f.total + p5.tokens else p5.tokens end, case when f.total + p5.tokens <= 220 then f.cur else f.cur + 1 end
        from fold f join p5 on f.pair_id = p5.pair_id and f.doc_side = p5.doc_side and f.page = p5.page and f.run = p5.run and p5.i = f.i + 1),
    chunks as (
        select pair_id, doc_side, page, arg_min(pos, i) as pos, arg_min(part, i) as part, case when arg_min(bullet, i) then 'bullet' else 'paragraph' end as kind, any_value(path) as path,
               {norm("string_agg(ptext, chr(10) || chr(10) order by i)")} as text, sum(tokens)::bigint as part_tokens, count(*) as n_parts, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1
        from p5 join fold using (pair_id, doc_side, page, run, i) group by pair_id, doc_side, page, run, cur),
    l1 as (
        select pair_id, doc_side, page, pos, 0 as part, 'section' as kind, path, t, {title("t")} as text, x0, y0, x1, y1 from pathed where heading
        union all select pair_id, doc_side, page, pos, part, kind, path, text as t, text, x0, y0, x1, y1 from chunks),
    l2 as (select *, row_number() over (partition by pair_id, doc_side, page, kind = 'section' order by pos, part) as n, row_number() over (partition by pair_id, doc_side order by page, pos, part) - 1 as leaf_pos from l1),
    l3 as (select *, printf('%s:p%02d:%s:%s%d', doc_side, page, case when len(path) > 0 then array_to_string(path, '.') else 'root' end, case kind when 'section' then 'section' else 'para' end, n) as node_id from l2),
    l4 as (
        select *, case kind when 'section' then printf('%s:p%02d:page', doc_side, page) else coalesce(last_value(case kind when 'section' then node_id end ignore nulls) over (partition by pair_id, doc_side order by leaf_pos rows between unbounded preceding and current row), doc_side || ':document') end as parent_id from l3),
    leaves as (
        select pair_id, doc_side, node_id, page, kind, path, text, parent_id, leaf_pos, 0 as start_char, length(t) as end_char,
               {tokens("t")} as token_count, sha1(t)[1:16] as stable_hash, x0, y0, x1, y1 from l4),
    below as (
        select pair_id, doc_side, node_id, page, kind, path, text, parent_id, leaf_pos, start_char, end_char, token_count, stable_hash from leaves
        union all select pair_id, doc_side, printf('%s:p%02d:page', doc_side, p), p, 'page', [], 'Page ' || p, doc_side || ':document', null, 0, 0, 0, '' from page_counts, lateral (select unnest(range(1, page_count + 1)) as p)),
    nodes as (
        select pair_id, doc_side, node_id, page, kind, path, text, parent_id, row_number() over (partition by pair_id, doc_side, parent_id order by page, leaf_pos nulls first) - 1 as child_pos, leaf_pos, start_char, end_char, token_count, stable_hash from below
        union all select pair_id, doc_side, doc_side || ':document', 0, 'document', [], pair_id || ':' || doc_side, null, null, null, 0, 0, 0, '' from page_counts)"""

GRAPH = f"""
    sections_of as (select l.pair_id, l.doc_side, l.node_id, case when l.kind = 'section' then l.node_id when p.kind = 'section' then p.node_id end as section_id from leaves l left join nodes p on l.pair_id = p.pair_id and l.doc_side = p.doc_side and l.parent_id = p.node_id),
    kids as (select pair_id, doc_side, parent_id as node_id, list(node_id order by child_pos) as children from nodes where parent_id is not null group by all),
    near1 as (select a.pair_id, a.doc_side, a.node_id, list(b.node_id order by b.leaf_pos) as ids, list({strip("b.text")} order by b.leaf_pos) as texts from leaves a join leaves b on a.pair_id = b.pair_id and a.doc_side = b.doc_side and abs(a.leaf_pos - b.leaf_pos) = 1 group by all),
    near2 as (select a.pair_id, a.doc_side, a.node_id, list(b.node_id order by b.leaf_pos) as ids from leaves a join leaves b on a.pair_id = b.pair_id and a.doc_side = b.doc_side and abs(a.leaf_pos - b.leaf_pos) between 1 and 2 group by all),
    chain as (
        select pair_id, doc_side, node_id, parent_id as p, 0 as d from nodes where parent_id is not null
        union all select c.pair_id, c.doc_side, c.node_id, n.parent_id, c.d + 1 from chain c join nodes n on c.pair_id = n.pair_id and c.doc_side = n.doc_side and c.p = n.node_id where n.parent_id is not null)"""

_CHILD = f"(select *, row_number() over v as rn, coalesce(sum(length(s)) over (v rows between unbounded preceding and 1 preceding), 0) as before from (select pair_id, doc_side, parent_id, child_pos, {strip('text')} as s from nodes where kind in {BODY}) where s <> '' window v as (partition by pair_id, doc_side, parent_id order by child_pos))"


def _named(label: str, x: str) -> str:
    return f"case when coalesce({x}, '') <> '' then '{label}: ' || {x} end"


_SEP = "chr(10) || chr(10)"
CONTEXTS = f"""
    previews as (select pair_id, doc_side, parent_id as node_id, string_agg(s, ' ' order by rn) as preview from {_CHILD} where rn <= 4 and before < 1200 group by all),
    section_context as (
        select pair_id, doc_side, node_id, {truncate("x", 2200)} as context_text from (
            select l.pair_id, l.doc_side, l.node_id, concat_ws({_SEP}, {_named("Heading path", path_text("l.path"))}, {_named("Section title", strip("l.text"))}, {_named("Preview", "preview")}) as x
            from leaves l left join previews using (pair_id, doc_side, node_id) where l.kind = 'section')),
    paragraph_context as (
        select pair_id, doc_side, node_id, {truncate("x", 1800)} as context_text from (
            select l.pair_id, l.doc_side, l.node_id, concat_ws({_SEP}, {_named("Section path", path_text("s.path"))}, {_named("Section heading", strip("s.text"))}, {_named("Node path", path_text("l.path"))},
                   upper(l.kind[1]) || l.kind[2:] || ': ' || {strip("l.text")}, {_named("Neighbor context", f"array_to_string(list_transform(list_filter(n.texts, lambda t: t <> '')[1:2], lambda t: {truncate('t', 320)}), ' ')")}) as x
            from leaves l join sections_of o using (pair_id, doc_side, node_id) left join leaves s on s.pair_id = l.pair_id and s.doc_side = l.doc_side and s.node_id = o.section_id
            left join near1 n on n.pair_id = l.pair_id and n.doc_side = l.doc_side and n.node_id = l.node_id where l.kind in {BODY}))"""

PLAIN_CONTEXT = truncate(f"concat_ws({_SEP}, case when len(path) > 0 then 'Path: ' || {path_text('path')} end, case when text <> '' then {strip('text')} end)", 1200)

PAIRS = f"""
    vec as (select pair_id, doc_side, node_id, bucket, c / sqrt(sum(c * c) over (partition by pair_id, doc_side, node_id)) as w from (
        select pair_id, doc_side, node_id, {bucket("token", 768)} as bucket, count(*) as c from (select pair_id, doc_side, node_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as token from leaves) group by all)),
    cos as (select a.pair_id, a.node_id as legacy_id, b.node_id as modern_id, sum(a.w * b.w) as cos from vec a join vec b on a.pair_id = b.pair_id and a.bucket = b.bucket and a.doc_side = 'legacy' and b.doc_side = 'modern' group by all),
    pairs as (
        select a.pair_id, a.node_id as legacy_id, b.node_id as modern_id, a.kind as lk, b.kind as mk, coalesce(cos, 0.0) as cos,
               {prefix_similarity("a.path", "b.path")} as heading, {kind_bonus("a.kind", "b.kind")} as kind_bonus, {size_bonus("a.token_count", "b.token_count")} as size_bonus, {page_bonus("a.page", "b.page")} as page_bonus
        from leaves a join leaves b on a.pair_id = b.pair_id and a.doc_side = 'legacy' and b.doc_side = 'modern' and (a.kind = 'section') = (b.kind = 'section')
        left join cos c on c.pair_id = a.pair_id and c.legacy_id = a.node_id and c.modern_id = b.node_id)"""

RAW = "(case when lk = 'section' then 0.74 * cos + 0.08 * heading + page_bonus + 0.05 + size_bonus else 0.82 * cos + 0.04 * heading + page_bonus + kind_bonus + size_bonus end)"


def layout(blocks: str) -> str:
    return f"with recursive {blocks},{LAYOUT}"


def tree(blocks: str) -> str:
    return f"{layout(blocks)},{NODES},{GRAPH},{CONTEXTS}"


def pairs(blocks: str) -> str:
    return f"{layout(blocks)},{NODES},{PAIRS}"
