"""SQL that the folds and clusterings are compared with: plain folds of whole recordings, without islands."""

from __future__ import annotations

from segmenta.plans.base import MEMO, SEG

_W = r"[\s\x{00a0}\x{3000}\x{2000}-\x{200a}\x{202f}]"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{_W}+|{_W}+$', '', 'g')"


def _han(t: str) -> str:
    return f"len(regexp_extract_all({t}, '[一-鿿]'))"


def _crumb(t: str) -> str:
    b = f"regexp_replace(regexp_replace({t}, '{_W}+', '', 'g'), '^[.,;:!?，。、；：！？…]+|[.,;:!?，。、；：！？…]+$', '', 'g')"
    return f"(length({b}) <= 4 OR ({_han(b)} = 0 AND length({b}) <= 6))"


def _joined(a: str, b: str) -> str:
    a, b = strip(a), strip(b)
    own = f"regexp_replace({b}, '^[,，、;；]{_W}*', '')"
    tight = f"({_han(a)} >= greatest(1, length({a}) // 3) OR {_han(own)} >= greatest(1, length({own}) // 3) OR NOT (regexp_matches({a}, '[\\p{{L}}\\p{{N}}]$') AND regexp_matches({own}, '^[\\p{{L}}\\p{{N}}]')))"
    return f"(CASE WHEN {a} = '' THEN {b} WHEN {b} = '' THEN {a} WHEN {tight} THEN {a} || {own} ELSE {a} || ' ' || {own} END)"


def _hangs(t: str) -> str:
    e = f"regexp_replace({t}, '[,，、;；]+$', '')"
    return f"""({e} <> '' AND NOT regexp_matches({e}, '[。！？.!?;；…]$') AND (regexp_matches({e}, '(?i)\\b(the|a|an|to|of|for|and|or|but|with|in|on|at|by|from|into|is|are|was|were|be|let''?s|we|i|you)$')
 OR regexp_matches({e}, '(把|将|將|还|還|分|不|太|的|了|着|過|过|和|与|與|对|對|从|從|在|是|有|要|会|會|能|可|就|都|也|很|更|再|先|来|來|去|给|給|说|說|话|話)$') OR {_han(e)} BETWEEN 1 AND 4))"""


def _goes_on(t: str) -> str:
    s = f"regexp_replace({t}, '^[,，、;；]+', '')"
    return f"""({s} <> '' AND (regexp_matches({s}, '^(太清|话人|話人|人分离|人分離|不同说话|不同說話|说话人|說話人|克隆质量|克隆質量|坐稳|坐穩|进度|進度|听感|聽感|也一般|分离|分離)')
 OR NOT regexp_matches({s}, '(?i)^(你好|您好|喂|嗯|啊|哦|好的|是的|对|對|今天|目前|那我们|那我們|然后|然後|所以|因为|因為|如果|但是|不过|不過|另外|首先|其次|再提升|接下来|接下來|下一步|同时|同時|Hello|Hi|Okay|Yes|No|Well|So|Then|Alright|Next|Also)')
 AND (regexp_matches({s}, '^\\p{{Ll}}') OR {_han(s)} BETWEEN 1 AND 8)))"""


_ROWS = f"WITH RECURSIVE {SEG}, r AS (SELECT rec_id, list({{'idx': idx, 's': start_ms, 'e': end_ms, 't': text, 'spk': speaker, 'n': 1::BIGINT}} ORDER BY idx) AS row FROM seg GROUP BY rec_id)"
_SINGLES = "list_transform({row}, lambda y: [y])"
_P, _N = "acc[-1]", "x[1]"
_WITH_NEXT = f"{{'idx': {_P}.idx, 's': {_P}.s, 'e': {_N}.e, 't': {_joined(_P + '.t', _N + '.t')}, 'spk': {_P}.spk, 'n': {_P}.n + {_N}.n}}"


def _fold(condition: str, row: str = "row") -> str:
    return f"list_reduce({_SINGLES.format(row=row)}, lambda acc, x: CASE WHEN {condition} THEN acc[1:len(acc) - 1] || [{_WITH_NEXT}] ELSE acc || x END)"


_A, _B = strip(_P + ".t"), strip(_N + ".t")
_CLOSED = f"regexp_matches({_A}, '[。！？.!?;；…]$')"
_BRIEF = f"(CASE WHEN {_han(_A)} > 0 AND {_han(_B)} > 0 THEN {_han(_A)} <= 12 AND {_han(_B)} <= 12 WHEN {_han(_A)} = 0 AND {_han(_B)} = 0 THEN length({_A}) <= 18 AND length({_B}) <= 18 ELSE false END)"
_BELONGS = f"""({_N}.s - {_P}.e <= 500 AND {_N}.e - {_P}.s <= 4800 AND CASE WHEN {_A} = '' OR {_B} = '' THEN ({_N}.s - {_P}.e) * 2 <= 500 WHEN {_CLOSED} AND NOT {_goes_on(_B)} THEN false WHEN {_hangs(_A)} OR {_goes_on(_B)} THEN true ELSE {_N}.s - {_P}.e <= 120 AND NOT {_CLOSED} AND {_BRIEF} END)"""
_OUT = "SELECT rec_id, u.idx AS idx, u.s AS start_ms, u.e AS end_ms, u.t AS text, u.n AS n FROM (SELECT rec_id, unnest(row) AS u FROM {src})"

PHRASE_MERGE = f"""{_ROWS}, sweep AS (SELECT rec_id, row, len(row) + 1 AS before FROM r UNION ALL SELECT rec_id, {_fold(_BELONGS)}, len(row) FROM sweep WHERE len(row) < before),
done AS (SELECT rec_id, row FROM sweep QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY len(row)) = 1) {_OUT.format(src='done')}"""
SHORT_FRAGMENT_MERGE = f"""{_ROWS}, done AS (SELECT rec_id, {_fold(f'{_N}.e - {_N}.s < 270 OR {_P}.e - {_P}.s < 270')} AS row FROM r) {_OUT.format(src='done')}"""

_AT = f"list_filter(range(1, len(acc) + 1), lambda i: {strip('acc[i].t')} <> '')[-1]"
_BRIDGED = f"({_crumb(_N + '.t')} AND {_AT} IS NOT NULL AND len(list_filter(acc[{_AT}:], lambda y: y.spk <> {_N}.spk OR {_N}.s - y.e > 800)) = 0)"
_GLUED = f"""acc[1:{_AT} - 1] || [{{'idx': acc[{_AT}].idx, 's': acc[{_AT}].s, 'e': greatest(acc[{_AT}].e, {_N}.e), 't': {strip(f"regexp_replace(acc[{_AT}].t, '{_W}+$', '') || {strip(_N + '.t')}")}, 'spk': acc[{_AT}].spk, 'n': acc[{_AT}].n}}] || acc[{_AT} + 1:]
 || [{{'idx': {_N}.idx, 's': {_N}.s, 'e': {_N}.e, 't': '', 'spk': {_N}.spk, 'n': {_N}.n}}]"""
CRUMB_GLUE = f"""{_ROWS}, done AS (SELECT rec_id, list_reduce({_SINGLES.format(row='row')}, lambda acc, x: CASE WHEN {_BRIDGED} THEN {_GLUED} ELSE acc || x END) AS row FROM r)
SELECT rec_id, u.idx AS idx, u.e AS end_ms, u.t AS text FROM (SELECT rec_id, unnest(row) AS u FROM done)"""

_ALL = r"[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TEXT_CHUNKS = rf"""WITH s AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^{_ALL}+|{_ALL}+$', '', 'g'), '([.!?。！？]){_ALL}+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^{_ALL}+|{_ALL}+$', '', 'g')), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[.!?。！？]$') THEN x ELSE x || '.' END) AS s FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_reduce(list_transform(s, lambda y: [{{'t': y, 'n': 1}}]), lambda acc, x: CASE WHEN length(acc[-1].t) + length(x[1].t) > 250 OR acc[-1].n >= 3 THEN acc || x ELSE acc[1:len(acc) - 1] || [{{'t': acc[-1].t || ' ' || x[1].t, 'n': acc[-1].n + 1}}] END) AS c FROM s WHERE len(s) > 0)
SELECT doc_id, CAST(unnest(range(len(c))) AS INT) AS chunk, unnest(list_transform(c, lambda y: y.t)) AS text FROM f"""

_LATIN = "regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9'']+')"
_DIAGONAL = "row[y[1]] + CASE WHEN r[i[1]] = h[y[1]] THEN 0 ELSE 1 END"
WER_PAIRS = f"""WITH {MEMO}, w AS (SELECT trans_id, {_LATIN.format(t='source_text')} AS r, {_LATIN.format(t='translated_text')} AS h FROM memo),
d AS (SELECT trans_id, r, h, list_reduce([list_transform(range(0, len(h) + 1), lambda k: CAST(k AS BIGINT))] || list_transform(range(1, len(r) + 1), lambda k: [CAST(k AS BIGINT)]),
  lambda row, i: list_reduce([[i[1]]] || list_transform(range(1, len(h) + 1), lambda k: [CAST(k AS BIGINT)]), lambda acc, y: acc || [least(acc[-1] + 1, row[y[1] + 1] + 1, {_DIAGONAL})])) AS row FROM w WHERE len(r) > 0)
SELECT trans_id, CASE WHEN len(w.r) = 0 THEN CASE WHEN len(w.h) > 0 THEN 1e0 ELSE 0e0 END ELSE CAST(d.row[-1] AS DOUBLE) / len(w.r) END AS wer FROM w LEFT JOIN d USING (trans_id)"""



def _bare(t: str) -> str:
    return f"lower(regexp_replace(coalesce({t}, ''), '{_W}+', '', 'g'))"


_BANNED = ["讨论科技、气候、河流与历史", "讨论科技、气候、河流", "科技、气候、河流与历史"]
_REPEATS = "list_filter(list_transform(range(1, length(p) - {n} + 2), lambda i: substr(p, i, {n})), lambda f: (length(t) - length(replace(t, f, ''))) // {n} >= 2)[1]"
PROMPT_OVERLAP = f"""WITH a0 AS (SELECT *, row_number() OVER (PARTITION BY asr_id ORDER BY created_at) AS rn FROM asr_results WHERE asr_id IS NOT NULL),
x AS (SELECT asr_id, {_bare('a.text')} AS t, {_bare('r.note')} AS p FROM a0 a JOIN recordings r USING (rec_id) WHERE a.rn = 1 AND r.note IS NOT NULL),
l AS (SELECT *, coalesce(list_max(list_transform(range(1, length(p) + 1), lambda i: len(list_filter(range(2, length(p) - i + 2), lambda n: contains(t, substr(p, i, n)))))), 0) AS m FROM x),
o AS (SELECT *, CASE WHEN t = '' OR p = '' OR m = 0 THEN 0e0 ELSE (m + 1) / length(t) END AS o,
 CASE WHEN p <> '' AND length(t) >= 12 THEN coalesce(CASE WHEN 8 / length(t) > 0.25e0 THEN {_REPEATS.format(n=8)} END, CASE WHEN 6 / length(t) > 0.25e0 THEN {_REPEATS.format(n=6)} END, CASE WHEN 4 / length(t) > 0.25e0 THEN {_REPEATS.format(n=4)} END) END AS again,
 list_filter([{', '.join(f"'{b}'" for b in _BANNED)}], lambda b: contains(t, b))[1] AS banned FROM l)
SELECT asr_id, banned IS NOT NULL OR (p <> '' AND o >= 0.45e0) OR again IS NOT NULL AS flagged, CASE WHEN banned IS NOT NULL THEN 1e0 WHEN p <> '' AND o >= 0.45e0 THEN o WHEN again IS NOT NULL THEN 0.9e0 ELSE o END AS score,
 CASE WHEN banned IS NOT NULL THEN 'banned:' || banned WHEN p <> '' AND o >= 0.45e0 THEN 'prompt_overlap' WHEN again IS NOT NULL THEN 'repeat:' || again ELSE 'ok' END AS reason FROM o"""

_UNIT = """v AS (SELECT label, vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL)"""
_FIRST_SEEN = """first AS (SELECT label, c, min(k) AS k FROM lab GROUP BY ALL), num AS (SELECT label, c, row_number() OVER (PARTITION BY label ORDER BY k) - 1 AS cluster FROM first)
SELECT lab.label, lab.vec_id, num.cluster FROM lab JOIN num USING (label, c)"""
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
FARTHEST_SPLIT = f"""WITH {_UNIT}, u AS (SELECT label, vec_id, k, list_transform(x, lambda e: e / greatest(sqrt(list_sum(list_transform(x, lambda q: q * q))), 1e-8)) AS x FROM v),
a AS (SELECT u.label, u.vec_id, u.k, u.x, {_DOT.format(a='u.x', b='o.x')} AS near FROM u JOIN u AS o ON u.label = o.label AND o.k = 1),
far AS (SELECT label, arg_min(x, (near, k)) AS x, count(*) AS n FROM a GROUP BY label),
lab AS (SELECT a.label, a.vec_id, a.k, CASE WHEN n > 1 AND {_DOT.format(a='a.x', b='far.x')} > near THEN 1 ELSE 0 END AS c FROM a JOIN far USING (label)), {_FIRST_SEEN}"""
GREEDY_CLUSTER = f"""WITH RECURSIVE {_UNIT}, u AS (SELECT label, vec_id, k, list_transform(x, lambda e: e / greatest(sqrt(list_sum(list_transform(x, lambda q: q * q))), 1e-8)) AS x FROM v),
g AS (SELECT label, vec_id, k, [x] AS sums, 1::BIGINT AS c FROM u WHERE k = 1
 UNION ALL SELECT label, vec_id, k, CASE WHEN c > len(sums) THEN sums || [x] ELSE sums[1:c - 1] || [list_transform(list_zip(sums[c], x), lambda z: z[1] + z[2])] || sums[c + 1:] END, c
 FROM (SELECT *, CASE WHEN most >= 0.6e0 OR len(sums) >= 8 THEN list_position(near, most) ELSE len(sums) + 1 END::BIGINT AS c FROM (SELECT *, list_max(near) AS most FROM (
  SELECT u.label, u.vec_id, u.k, g.sums, u.x, list_transform(g.sums, lambda s: {_DOT.format(a='u.x', b='s')} / greatest(sqrt({_DOT.format(a='s', b='s')}), 1e-8)) AS near FROM g JOIN u ON u.label = g.label AND u.k = g.k + 1)))),
lab AS (SELECT label, vec_id, k, c FROM g), {_FIRST_SEEN}"""
