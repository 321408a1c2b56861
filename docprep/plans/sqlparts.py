"""DuckDB SQL fragments for the oracle side of every registered query.

They restate the semantics relationally (lines as rows, windows for fence
parity and blank runs) so that the check is independent of the Spark kernels;
only the regex constants are shared.
"""

from __future__ import annotations

from docprep.functions import html as H
from docprep.functions import pii as P
from docprep.functions.compact import EMPTY_TABLE_ROW_RX, FENCE_RX, INVISIBLE_CHARS, NBSP
from docprep.functions.text import WS, sql_str
from docprep.functions.tokens import JS_NON_WS


def q(rx: str) -> str:
    """A regex as a DuckDB literal (RE2 understands the shared subset)."""
    return sql_str(rx)


def normalize_sql(t: str) -> str:
    x = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = f"translate({x}, {sql_str(NBSP + INVISIBLE_CHARS)}, ' ')"
    return f"regexp_replace({x}, {q('(?s)<!--.*?-->')}, '', 'g')"


def compact_ctes(src: str, prefix: str = "c") -> tuple[str, str]:
    """CTEs compacting ``src`` (a CTE with columns ``id``, ``t``) into ``{prefix}_out(id, out)``.

    Returns (cte_text, final_cte_name). Documents whose lines all vanish get ''.
    """
    p = prefix
    rstrip = f"regexp_replace(line, {q(WS + '+' + chr(92) + 'z')}, '')"
    ctes = f"""
{p}_norm AS (SELECT id, {normalize_sql('t')} AS t FROM {src}),
{p}_lines AS (SELECT id, unnest(parts) AS line, generate_subscripts(parts, 1) AS idx
              FROM (SELECT id, string_split(t, chr(10)) AS parts FROM {p}_norm WHERE t IS NOT NULL)),
{p}_cls AS (SELECT id, idx, line, regexp_matches(line, {q(FENCE_RX)}) AS is_f FROM {p}_lines),
{p}_par AS (SELECT *, coalesce(sum(CASE WHEN is_f THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY idx
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM {p}_cls),
{p}_tok AS (SELECT id, idx,
              CASE WHEN is_f OR inside THEN 'E' WHEN r = '' THEN 'B'
                   WHEN regexp_matches(r, {q(EMPTY_TABLE_ROW_RX)}) THEN 'T' ELSE 'E' END AS k,
              CASE WHEN is_f OR inside THEN line ELSE r END AS content
            FROM (SELECT *, {rstrip} AS r FROM {p}_par)),
{p}_em AS (SELECT id, idx, k, content, sum(CASE WHEN k = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY idx
              ROWS UNBOUNDED PRECEDING) AS cb FROM {p}_tok WHERE k <> 'T'),
{p}_ee AS (SELECT id, idx, content, cb, lag(cb) OVER (PARTITION BY id ORDER BY idx) AS pcb FROM {p}_em WHERE k = 'E'),
{p}_agg AS (SELECT id, string_agg(CASE WHEN pcb IS NOT NULL AND cb > pcb THEN chr(10) || content ELSE content END,
              chr(10) ORDER BY idx) AS out FROM {p}_ee GROUP BY id),
{p}_out AS (SELECT s.id, CASE WHEN s.t IS NULL THEN NULL ELSE coalesce(a.out, '') END AS out
            FROM {src} s LEFT JOIN {p}_agg a ON s.id = a.id)"""
    return ctes, f"{p}_out"


def utf16_len_sql(t: str) -> str:
    return f"CAST(coalesce(length({t}) + length(regexp_replace({t}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')), 0) AS BIGINT)"


def tokens_sql(t: str, cpt: str) -> str:
    n = utf16_len_sql(t)
    return f"(CASE WHEN {n} = 0 THEN CAST(0 AS BIGINT) ELSE CAST(ceil(CAST({n} AS DOUBLE) / CAST({cpt} AS DOUBLE)) AS BIGINT) END)"


def count_es_sql(n: str) -> str:
    return f"(CASE WHEN abs({n}) < 10000 THEN CAST({n} AS VARCHAR) ELSE replace(format('{{:,}}', {n}), ',', '.') END)"


def one_decimal_es_sql(x: str) -> str:
    tenths = f"CAST(floor(({x}) * 10 + 0.5) AS BIGINT)"
    whole = f"CAST(floor({tenths} / 10) AS BIGINT)"
    frac = f"({tenths} - {whole} * 10)"
    return f"(CASE WHEN {frac} = 0 THEN {count_es_sql(whole)} ELSE {count_es_sql(whole)} || ',' || CAST({frac} AS VARCHAR) END)"


def ratio_sql(tok: str, win: str) -> str:
    return f"(CASE WHEN {win} = 0 THEN 0.0 ELSE CAST({tok} AS DOUBLE) / CAST({win} AS DOUBLE) END)"


def pct_label_sql(tok: str, win: str) -> str:
    r = ratio_sql(tok, win)
    return f"(CASE WHEN {r} >= 0.001 THEN {one_decimal_es_sql(f'{r} * 100')} || '% de ' ELSE '' END)"


def abbreviate_tokens_sql(n: str) -> str:
    k = f"CAST(floor(({n} + 50) / 100) AS BIGINT)"
    m = f"CAST(floor(({n} + 50000) / 100000) AS BIGINT)"

    def fmt(t: str, unit: str) -> str:
        return f"(CAST(CAST(trunc({t} / 10) AS BIGINT) AS VARCHAR) || ',' || CAST({t} % 10 AS VARCHAR) || '{unit}')"

    return f"(CASE WHEN {n} < 1000 THEN CAST({n} AS VARCHAR) WHEN {n} < 1000000 THEN {fmt(k, 'k')} ELSE {fmt(m, 'M')} END)"


def abbreviate_window_sql(n: str) -> str:
    return (
        f"(CASE WHEN {n} >= 1000000 THEN {one_decimal_es_sql(f'{n} / 1000000.0')} || 'M' "
        f"WHEN {n} >= 1000 THEN CAST(CAST(floor({n} / 1000.0 + 0.5) AS BIGINT) AS VARCHAR) || 'k' "
        f"ELSE CAST({n} AS VARCHAR) END)"
    )


def fill_pct_sql(tok: str, win: str) -> str:
    return f"least(100.0, greatest(CASE WHEN {tok} > 0 THEN 2.0 ELSE 0.0 END, {ratio_sql(tok, win)} * 100))"


def words_sql(t: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({t}, ''), {q(JS_NON_WS + '+')}, 0)) AS BIGINT)"


def lines_sql(t: str) -> str:
    return f"CAST(CASE WHEN coalesce({t}, '') = '' THEN 0 ELSE len(string_split({t}, chr(10))) END AS BIGINT)"


# --------------------------------------------------------------------------- names


def safe_filename_sql(n: str) -> str:
    base = f"regexp_replace({n}, {q('(?s)^.*[/' + chr(92) * 2 + ']')}, '')"
    cut = f"substring(regexp_replace({base}, '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 255)"
    return f"(CASE WHEN {n} IS NULL OR {cut} = '' THEN 'file' ELSE {cut} END)"


def posix_name_sql(n: str) -> str:
    trimmed = f"regexp_replace(coalesce({n}, ''), {q('(?:/' + chr(92) + '.?)+' + chr(92) + 'z')}, '')"
    return f"(string_split({trimmed}, '/')[-1])"


def suffix_sql(base: str) -> str:
    return f"regexp_extract({base}, {q('(?s)^.+(' + chr(92) + '.[^.]+)' + chr(92) + 'z')}, 1)"


def extension_sql(n: str) -> str:
    return f"lower({suffix_sql(posix_name_sql(n))})"


def extension_lenient_sql(n: str) -> str:
    return f"lower(regexp_extract(coalesce({n}, ''), {q('(?s)(' + chr(92) + '.[^.]*)' + chr(92) + 'z')}, 1))"


def stem_sql(n: str) -> str:
    base = posix_name_sql(n)
    return f"(CASE WHEN {suffix_sql(base)} = '' THEN {base} ELSE regexp_replace({base}, {q('(?s)' + chr(92) + '.[^.]+' + chr(92) + 'z')}, '') END)"


def markdown_filename_sql(n: str) -> str:
    return f"({safe_filename_sql(stem_sql(n))} || '.md')"


def ensure_md_sql(n: str) -> str:
    return f"(CASE WHEN ends_with(lower({n}), '.md') THEN {n} ELSE {n} || '.md' END)"


def escape_html_sql(v: str) -> str:
    x = f"coalesce(CAST({v} AS VARCHAR), '')"
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = f"replace({x}, {sql_str(ch)}, {sql_str(ent)})"
    return x


# --------------------------------------------------------------------------- PII


def valid_sql(key: str, m: str) -> str:
    """The validator of an entity key as a DuckDB boolean expression over ``m``."""
    ws = q(WS + "+")
    strip = f"regexp_replace({m}, {q('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"
    if key == "dni_nie":
        u = f"upper({strip})"
        first = f"substr({u}, 1, 1)"
        num = f"(CASE WHEN {first} IN ('X','Y','Z') THEN translate({first}, 'XYZ', '012') || substr({u}, 2, 7) ELSE substr({u}, 1, 8) END)"
        ok = f"(length({u}) = 9 AND regexp_matches({num}, '^[0-9]{{8}}\\z'))"
        letter = f"substr({sql_str(P.DNI_LETTERS)}, CAST(CAST(CASE WHEN {ok} THEN {num} ELSE '0' END AS BIGINT) % 23 + 1 AS INTEGER), 1)"
        return f"coalesce({ok} AND substr({u}, 9, 1) = {letter}, false)"
    if key == "iban":
        s = f"upper(regexp_replace({m}, {ws}, '', 'g'))"
        ok = f"regexp_matches({s}, '^ES[0-9]{{22}}\\z')"
        re_ = f"(substr({s}, 5, 22) || '1428' || substr({s}, 3, 2))"
        return f"coalesce({ok} AND CAST(CASE WHEN {ok} THEN {re_} ELSE '0' END AS HUGEINT) % 97 = 1, false)"
    if key == "social_security":
        d = f"regexp_replace({m}, '[^0-9]', '', 'g')"
        ok = f"(length({d}) = 12)"
        head = f"CAST(CASE WHEN {ok} THEN substr({d}, 1, 10) ELSE '0' END AS BIGINT)"
        tail = f"CAST(CASE WHEN {ok} THEN substr({d}, 11, 2) ELSE '0' END AS BIGINT)"
        return f"coalesce({ok} AND {tail} = {head} % 97, false)"
    if key == "company_id":
        s = f"upper({strip})"
        ok = f"regexp_matches({s}, '^[ABCDEFGHJKLMNPQRSUVW][0-9]{{7}}[0-9A-J]\\z')"
        g = f"(CASE WHEN {ok} THEN {s} ELSE 'A00000000' END)"

        def dg(pos: int) -> str:
            return f"CAST(substr({g}, {pos}, 1) AS INTEGER)"

        even = f"({dg(3)} + {dg(5)} + {dg(7)})"
        odd = " + ".join(f"(({dg(p)} * 2) // 10 + ({dg(p)} * 2) % 10)" for p in (2, 4, 6, 8))
        dc = f"((10 - ({even} + {odd}) % 10) % 10)"
        control = f"substr({g}, 9, 1)"
        as_letter = f"({control} = substr('{P.CIF_CONTROL_LETTERS}', CAST({dc} + 1 AS INTEGER), 1))"
        as_digit = f"({control} = CAST({dc} AS VARCHAR))"
        org = f"substr({g}, 1, 1)"
        verdict = f"(CASE WHEN {org} IN ('P','Q','R','S','N','W') THEN {as_letter} WHEN {org} IN ('A','B','E','H') THEN {as_digit} ELSE {as_letter} OR {as_digit} END)"
        return f"coalesce({ok} AND {verdict}, false)"
    if key == "credit_card":
        d = f"regexp_replace({m}, '[^0-9]', '', 'g')"
        rev = f"reverse({d})"
        total = (
            f"list_reduce(list_transform(range(1, greatest(length({rev}), 1) + 1), lambda i: "
            f"CASE WHEN i % 2 = 0 THEN (CASE WHEN coalesce(TRY_CAST(substr({rev}, i, 1) AS INTEGER), 0) * 2 > 9 "
            f"THEN coalesce(TRY_CAST(substr({rev}, i, 1) AS INTEGER), 0) * 2 - 9 ELSE coalesce(TRY_CAST(substr({rev}, i, 1) AS INTEGER), 0) * 2 END) "
            f"ELSE coalesce(TRY_CAST(substr({rev}, i, 1) AS INTEGER), 0) END), lambda a, b: a + b, 0)"
        )
        return f"coalesce(length({d}) > 0 AND {total} % 10 = 0, false)"
    raise KeyError(key)


def validated_replace_sql(t: str, rx: str, key: str, tag: str) -> str:
    parts = f"regexp_split_to_array({t}, {q(rx)})"
    matches = f"list_concat(regexp_extract_all({t}, {q(rx)}, 0), [''])"
    zipped = (
        f"list_transform(list_zip({parts}, {matches}), lambda z: z[1] || "
        f"CASE WHEN z[2] = '' THEN '' WHEN {valid_sql(key, 'z[2]')} THEN {sql_str(tag)} ELSE z[2] END)"
    )
    return f"(CASE WHEN regexp_matches({t}, {q(rx)}) THEN array_to_string({zipped}, '') ELSE {t} END)"


def apply_recognizer_sql(t: str, rec: P.Recognizer) -> str:
    rx = rec.regex("re2")
    if rec.group == 2:
        return f"regexp_replace({t}, {q(rx)}, {sql_str(chr(92) + '1' + rec.tag + chr(92) + '3')}, 'g')"
    if rec.validator is None:
        return f"regexp_replace({t}, {q(rx)}, {sql_str(rec.tag)}, 'g')"
    return validated_replace_sql(t, rx, rec.key, rec.tag)


def redact_sql(t: str, keys: list[str]) -> str:
    wanted = set(P.known_keys(keys))
    for key in P.REDACTION_ORDER:
        if key in wanted:
            for rec in P.recognizers(key):
                t = apply_recognizer_sql(t, rec)
    return t


def redact_ctes(src: str, keys: list[str], prefix: str = "r") -> tuple[str, str]:
    """Sequential redaction as one CTE per recogniser (keeps the SQL text small)."""
    wanted = set(P.known_keys(keys))
    ctes, prev, i = [], src, 0
    for key in P.REDACTION_ORDER:
        if key in wanted:
            for rec in P.recognizers(key):
                name = f"{prefix}_{i}"
                ctes.append(f"{name} AS (SELECT * REPLACE ({apply_recognizer_sql('t', rec)} AS t) FROM {prev})")
                prev, i = name, i + 1
    return (",\n".join(ctes), prev)


def spans_sql(src: str, keys: list[str], recs: list | None = None) -> str:
    """R2 relationally: one row per span (id, entity, start, end, score, matched).

    Each recogniser's matches are numbered; a match starts after all earlier
    gaps and matches of the same recogniser (a window sum), plus its own gap
    and, for the label rule, the label group."""
    selects = []
    pairs = [(r.key, r) for r in recs] if recs is not None else [(k, r) for k in P.known_keys(keys) for r in P.recognizers(k)]
    for key, rec in pairs:
            rx = q(rec.regex("re2"))
            lead = f"regexp_extract_all(t, {rx}, 1)" if rec.group else "CAST([] AS VARCHAR[])"
            val = f"regexp_extract_all(t, {rx}, {rec.group})"
            valid = valid_sql(key, "v") if rec.validator is not None else "true"
            score = P.VALIDATED_SCORE if rec.validator is not None else rec.score
            selects.append(
                f"""SELECT id, '{rec.entity}' AS entity, '{rec.name}' AS rec, i, g, w, l, v, {valid} AS ok, CAST({score} AS DOUBLE) AS score
FROM (SELECT id, unnest(gs) AS g, unnest(ws) AS w, unnest(ls) AS l, unnest(vs) AS v, unnest(range(1, len(gs) + 1)) AS i
      FROM (SELECT id, regexp_split_to_array(t, {rx}) AS gs, regexp_extract_all(t, {rx}, 0) AS ws, {lead} AS ls, {val} AS vs
            FROM {src} WHERE regexp_matches(t, {rx})))"""
            )
    union = "\nUNION ALL\n".join(selects)
    return f"""SELECT id, entity, CAST(st AS INTEGER) AS "start", CAST(st + length(v) AS INTEGER) AS "end", score, v AS matched
FROM (SELECT *, coalesce(sum(length(g) + coalesce(length(w), 0)) OVER (PARTITION BY id, rec ORDER BY i
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(g) + coalesce(length(l), 0) AS st
      FROM ({union}) u0) u1
WHERE w IS NOT NULL AND ok"""


def _rewritten_sql(t: str, rules: list) -> str:
    for _, pattern, rep in rules:
        # $1 restores what the Java pattern takes beyond the RE2 one: nothing here
        t = f"regexp_replace({t}, {q(pattern)}, {sql_str(rep.replace('$1', ''))}, 'g')"
    return t


def _parts_sql(t: str, pattern: str, each: str, sep: str = "") -> str:
    """Cut at a pattern, rewrite each part ``p`` (numbered ``i`` from 1), join again."""
    return f"array_to_string(list_transform(string_split_regex({t}, {q(pattern)}), lambda p, i: {each}), {sql_str(sep)})"


def html_sql(t: str) -> str:
    nl = "chr(10)"
    strip = lambda x: f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"

    def unescaped(x: str) -> str:
        for name, char in H.ENTITIES:
            x = f"replace({x}, {sql_str(name)}, {sql_str(char)})"
        return x

    # links: the parts before a closing tag; the last part keeps its openings
    linked = f"regexp_replace(p, {q(H.LINK)}, {sql_str(H.re2_replacement('$1[$4]($2$3)'))})"
    ends = f"len(string_split_regex(o, {q(H.LINK_END)}))"
    links = _parts_sql("o", H.LINK_END, f"CASE WHEN i < {ends} THEN {linked} ELSE p END")
    tag = f"regexp_extract(p, {q(H.IMAGE_REST)}, 0)"
    src = f"regexp_extract({tag}, {q(H.SRC)}, 1)"
    image = f"CASE WHEN {src} <> '' THEN '![' || regexp_extract({tag}, {q(H.ALT)}, 1) || '](' || {src} || ')' ELSE '' END"
    images = _parts_sql(links, H.IMAGE, f"CASE WHEN i = 1 THEN p ELSE {image} || regexp_replace(p, {q(H.IMAGE_REST)}, '') END")
    numbered = f"array_to_string(list_transform(string_split_regex(e, {q(H.ITEM)}), lambda x, k: CASE WHEN k = 1 THEN x ELSE {nl} || (k - 1) || '. ' || x END), '')"
    two = f"{nl} || {nl}"
    ended = f"array_to_string(list_transform(string_split_regex(p, {q(H.LIST_END)}), lambda e, j: CASE WHEN j = 1 THEN {two} || {numbered} || {two} ELSE e || CASE WHEN j < len(string_split_regex(p, {q(H.LIST_END)})) THEN {two} ELSE '' END END), '')"
    lists = _parts_sql(images, H.LIST, f"CASE WHEN i = 1 THEN p ELSE {ended} END")
    outside = strip(_rewritten_sql(unescaped(_rewritten_sql(lists, H.RULES)), H.SPACE_RULES))
    body = f"regexp_replace({unescaped(f'regexp_replace(o, {q(H.ANY_TAG)}, {sql_str(str())}, {sql_str(chr(103))})')}, {q('^' + chr(10) + '|' + chr(10) + '+' + chr(92) + 'z')}, '', 'g')"
    fence = sql_str("```")
    code = f"CASE WHEN trim({body}, ' ') <> '' THEN {fence} || {nl} || {body} || {nl} || {fence} ELSE '' END"
    raw = _rewritten_sql(t, H.RAW_RULES)
    parts = f"list_transform(string_split_regex({raw}, {q(H.PRE_TAG)}), lambda o, m: CASE WHEN m % 2 = 0 THEN {code} ELSE {outside} END)"
    return f"array_to_string(list_filter({parts}, lambda y: y <> ''), {two})"


def csv_sql(t: str) -> str:
    """CSV text -> pipe table, on lists."""
    cell, record, quote = "chr(31)", "chr(30)", sql_str('"')
    parts = f"string_split(translate({t}, {cell} || {record}, '  '), {quote})"
    outside = f"translate(replace(replace(p, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ',' || chr(10), {cell} || {record})"
    each = f"CASE WHEN i % 2 = 0 THEN p WHEN p = '' AND i > 1 AND i < len({parts}) THEN {quote} ELSE {outside} END"
    joined = f"array_to_string(list_transform({parts}, lambda p, i: {each}), '')"
    rows = f"list_filter(string_split({joined}, {record}), lambda r: r <> '')"
    width = f"list_max(list_transform({rows}, lambda r: len(string_split(r, {cell}))))"
    shown = f"replace(replace(replace(replace(c, '|', {sql_str(chr(92) + '|')}), chr(13) || chr(10), ' '), chr(13), ' '), chr(10), ' ')"
    empty = "list_transform(range({n}), lambda e: '')"
    line = f"'| ' || array_to_string(list_concat(list_transform(string_split(r, {cell}), lambda c: {shown}), {empty.format(n=f'{width} - len(string_split(r, {cell}))')}), ' | ') || ' |'"
    rule = f"'| ' || array_to_string(list_transform(range({width}), lambda e: '---'), ' | ') || ' |'"
    lines = f"list_transform({rows}, lambda r, k: CASE WHEN k = 1 THEN {line} || chr(10) || {rule} ELSE {line} END)"
    return f"(CASE WHEN {t} IS NULL THEN NULL WHEN len({rows}) = 0 THEN '' ELSE array_to_string({lines}, chr(10)) END)"
