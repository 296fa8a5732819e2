"""SQL (DuckDB dialect) twins of the column functions, for the oracle.

Patterns come from ``fixed`` and are rewritten for RE2: no ``(?U)``/``(?d)``
flags, and the C2 backreference becomes a four-way alternation with one
content group per tag. Everything here builds text; nothing runs.
"""

from __future__ import annotations

from unveil.functions import fixed
from unveil.operators.planting import planted_sql, sql_str

WS_SET = sql_str(fixed.WHITESPACE_CHARS)
ENTRY = "STRUCT(category VARCHAR, n BIGINT, payload VARCHAR)"
EMPTY_LOG = f"[]::{ENTRY}[]"

RE2_HIDDEN = "(?is)" + "|".join(
    f"<{tag}{fixed.HIDDEN_STYLED_OPEN}(.*?)</{tag}>" for tag in fixed.HIDDEN_STYLED_TAGS
)
RE2_ALT = "(?i)" + fixed.IMAGE_ALT_BODY
RE2_ROLE = fixed.ROLE_LABEL.replace("(?imUd)", "(?im)")
RE2_BRACKET = fixed.ROLE_BRACKET.replace("(?iU)", "(?i)")
FULLWIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
FULLWIDTH_ASCII = "".join(chr(c) for c in range(0x21, 0x7F))


def q(s: str) -> str:
    return sql_str(s)


def count_entry(cat: str, n: str) -> str:
    return (
        f"CASE WHEN {n} > 0 THEN [{{'category': {q(cat)}, 'n': CAST({n} AS BIGINT), "
        f"'payload': NULL::VARCHAR}}] ELSE {EMPTY_LOG} END"
    )


def flag_entry(cat: str, flag: str) -> str:
    return (
        f"CASE WHEN {flag} THEN [{{'category': {q(cat)}, 'n': NULL::BIGINT, "
        f"'payload': NULL::VARCHAR}}] ELSE {EMPTY_LOG} END"
    )


def payload_entries(cat: str, arr: str) -> str:
    return (
        f"CAST(list_transform({arr}, lambda p: {{'category': {q(cat)}, 'n': NULL::BIGINT, "
        f"'payload': p}}) AS {ENTRY}[])"
    )


def py_strip(x: str) -> str:
    return f"trim({x}, {WS_SET})"


def native_repr(p: str) -> str:
    """Python repr of a printable-ASCII payload (same rule as the Spark side)."""
    dbl = f"(contains({p}, '''') AND NOT contains({p}, '\"'))"
    body = f"replace({p}, '\\', '\\\\')"
    body = f"CASE WHEN {dbl} THEN {body} ELSE replace({body}, '''', '\\''') END"
    for ch, esc in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = f"replace({body}, {q(ch)}, {q(esc)})"
    quote = f"CASE WHEN {dbl} THEN '\"' ELSE '''' END"
    return f"({quote} || {body} || {quote})"


def clean_ctes(src: str) -> str:
    """CTEs s0..s9 over CTE/view ``src`` (needs ``text``); final CTE is ``cleaned``.

    ``cleaned`` carries the source columns, stage texts t0..t8, cleaned_text,
    removed (list of struct seq/category/n/payload) and removed_items.
    """
    zw, ctl = q(fixed.ZERO_WIDTH_CHARS), q(fixed.INVISIBLE_CONTROL_CHARS)
    groups = ", ".join(f"regexp_extract_all(t1, {q(RE2_HIDDEN)}, {g})" for g in range(1, 5))
    render = (
        "list_transform(removed, lambda e: CASE "
        f"WHEN e.category = {q(fixed.CAT_INPUT_WAS_NONE)} THEN e.category "
        f"WHEN e.category = {q(fixed.CAT_UNICODE_NORMALIZED)} THEN e.category || ':NFKC' "
        "WHEN e.n IS NOT NULL THEN e.category || ':' || CAST(e.n AS VARCHAR) "
        f"ELSE e.category || ':' || {native_repr('e.payload')} END)"
    )
    return f"""
s0 AS (SELECT *, coalesce(text, '') AS t0,
              {flag_entry(fixed.CAT_INPUT_WAS_NONE, 'text IS NULL')} AS l0 FROM {src}),
s1 AS (SELECT *, regexp_replace(t0, {q(fixed.HTML_COMMENT)}, '', 'g') AS t1,
              {count_entry(fixed.CAT_HTML_COMMENTS, f"len(regexp_extract_all(t0, {q(fixed.HTML_COMMENT)}))")} AS l1
       FROM s0),
s2g AS (SELECT *, [{groups}] AS g2 FROM s1),
s2 AS (SELECT * EXCLUDE (g2),
              regexp_replace(t1, {q(RE2_HIDDEN)}, '', 'g') AS t2,
              list_transform(range(1, len(g2[1]) + 1),
                             lambda i: coalesce(g2[1][i], g2[2][i], g2[3][i], g2[4][i])) AS p2
       FROM s2g),
s3 AS (SELECT *, regexp_replace(t2, {q(RE2_ALT)}, '', 'g') AS t3,
              regexp_extract_all(t2, {q(RE2_ALT)}, 1) AS p3 FROM s2),
s4 AS (SELECT *, translate(t3, {zw}, '') AS t4 FROM s3),
s5 AS (SELECT *, translate(t4, {ctl}, '') AS t5 FROM s4),
s6 AS (SELECT *, translate(t5, {q(FULLWIDTH)}, {q(FULLWIDTH_ASCII)}) AS t6 FROM s5),
s7 AS (SELECT *, regexp_replace(t6, {q(RE2_ROLE)}, '', 'g') AS t7,
              regexp_extract_all(t6, {q(RE2_ROLE)}) AS p7 FROM s6),
s8 AS (SELECT *, regexp_replace(t7, {q(RE2_BRACKET)}, '', 'g') AS t8,
              regexp_extract_all(t7, {q(RE2_BRACKET)}) AS p8 FROM s7),
s9 AS (SELECT *,
              {py_strip("regexp_replace(regexp_replace(t8, '[ \t]+" + chr(10) + "', " + q(chr(10)) + ", 'g'), " + q(chr(10) + '{3,}') + ", " + q(chr(10) * 2) + ", 'g')")} AS cleaned_text,
              list_concat(list_concat(list_concat(list_concat(list_concat(list_concat(list_concat(list_concat(
                l0, l1),
                {payload_entries(fixed.CAT_HIDDEN_STYLED, 'p2')}),
                {payload_entries(fixed.CAT_IMAGE_ALT, f"list_filter(p3, lambda a: {py_strip('a')} <> '')")}),
                {count_entry(fixed.CAT_ZERO_WIDTH, 'length(t3) - length(t4)')}),
                {count_entry(fixed.CAT_INVISIBLE_CONTROL, 'length(t4) - length(t5)')}),
                {flag_entry(fixed.CAT_UNICODE_NORMALIZED, 't6 <> t5')}),
                {payload_entries(fixed.CAT_FAKE_ROLE, f"list_transform(p7, lambda m: {py_strip('m')})")}),
                {payload_entries(fixed.CAT_FAKE_ROLE, 'p8')}) AS log
       FROM s8),
s10 AS (SELECT * EXCLUDE (log),
               list_transform(log, lambda e, i: {{'seq': CAST(i AS INTEGER), 'category': e.category,
                                                  'n': e.n, 'payload': e.payload}}) AS removed
        FROM s9),
cleaned AS (SELECT *, {render} AS removed_items FROM s10)"""


def planted_clean_with(extra_ctes: str = "") -> str:
    """WITH clause: planted -> cleaned (+ extra CTEs appended)."""
    tail = ("," + extra_ctes) if extra_ctes else ""
    return f"WITH planted AS ({planted_sql()}),{clean_ctes('planted')}{tail}\n"


def conclusive_list(items: str) -> str:
    cats = ", ".join(q(c) for c in fixed.CONCLUSIVE_CATEGORIES)
    return f"list_filter({items}, lambda x: split_part(x, ':', 1) IN ({cats}))"


def advisory_list(items: str) -> str:
    cats = ", ".join(q(c) for c in fixed.ADVISORY_CATEGORIES)
    return f"list_filter({items}, lambda x: split_part(x, ':', 1) IN ({cats}))"


# --------------------------------------------------------------------------
# canary / judge / pipeline
# --------------------------------------------------------------------------

def synonym_map() -> str:
    pairs = ", ".join(f"{q(k)}: {q(v)}" for k, v in fixed.CATEGORY_SYNONYMS.items())
    return f"(MAP {{{pairs}}})"


def label_key_sql(raw: str) -> str:
    return f"regexp_replace(lower({raw}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def mapped_sql(raw: str) -> str:
    """Synonym of J1(raw), or NULL."""
    key = label_key_sql("coalesce(" + raw + ", 'None')")
    return f"{synonym_map()}[{key}]"


def normalize_sql(raw: str, det: str) -> str:
    """J2; evaluates the lookup once via a lambda over a one-element list."""
    return (
        f"(CASE WHEN NOT ({det}) THEN 'none' ELSE "
        f"list_transform([{mapped_sql(raw)}], lambda m: CASE WHEN coalesce(m, 'none') = 'none' "
        f"THEN 'unspecified' ELSE m END)[1] END)"
    )


def wellformed_sql(cat: str, det: str) -> str:
    ok = ", ".join(q(c) for c in (*fixed.MODEL_ATTACK_CATEGORIES, fixed.CATEGORY_UNSPECIFIED, fixed.CATEGORY_MALFORMED_RESPONSE))
    return f"coalesce(CASE WHEN {det} THEN {cat} IN ({ok}) ELSE {cat} = 'none' END, FALSE)"


def _tpl(template: str, *fields: str) -> list[str]:
    return [q(p) for p in fixed.template_parts(template, *fields)]


def prepare_ctes(src: str = "cleaned") -> str:
    """CTEs prep1..prep3 (seed, word, prompts) over ``cleaned``."""
    nul = "'\\x00'::BLOB"
    alpha = q(fixed.CANARY_ALPHABET)
    n = len(fixed.CANARY_ALPHABET)
    d0, d1, d2 = _tpl(fixed.DETECTION_TEMPLATE, "evidence", "removal_context")
    r0, r1 = _tpl(fixed.REMOVAL_CONTEXT_TEMPLATE, "items")
    k0, k1 = _tpl(fixed.CANARY_TEMPLATE, "document")
    w0, w1 = _tpl(fixed.TRAP_SENTENCE, "word")
    return f"""
prep1 AS (SELECT *, len({conclusive_list('removed_items')}) > 0 AS conclusive,
                 {advisory_list('removed_items')} AS advisory_items,
                 sha256(encode(sender) || {nul} || encode(scope) || {nul} || encode(CAST(chain_id AS VARCHAR))
                        || {nul} || encode(cleaned_text)) AS seed,
                 '0x' || sha256(cleaned_text) AS evidence_hash
          FROM {src}),
prep2 AS (SELECT *, {q(fixed.CANARY_PREFIX)} || array_to_string(list_transform(range({fixed.CANARY_LENGTH}),
                 lambda i: substr({alpha}, CAST(('0x' || substr(seed, 2 * i + 1, 2)) AS INTEGER) % {n} + 1, 1)), '')
                 AS canary_word FROM prep1),
prep AS (SELECT *,
                CASE WHEN len(advisory_items) > 0
                     THEN {r0} || array_to_string(list_transform(advisory_items, lambda x: '- ' || x), chr(10)) || {r1}
                     ELSE '' END AS removal_context,
                {w0} || canary_word || {w1} AS trap
         FROM prep2),
prepared AS (SELECT *, {d0} || cleaned_text || {d1} || removal_context || {d2} AS detection_prompt,
                    {k0} || cleaned_text || chr(10) || chr(10) || trap || {k1} AS canary_prompt
             FROM prep)"""


def json_truthy(doc: str, path: str) -> str:
    v = f"json_extract({doc}, {q(path)})"
    return f"""(CASE json_type({doc}, {q(path)})
      WHEN 'BOOLEAN' THEN CAST({v} AS BOOLEAN)
      WHEN 'NULL' THEN FALSE
      WHEN 'VARCHAR' THEN length(json_extract_string({doc}, {q(path)})) > 0
      WHEN 'BIGINT' THEN CAST({v} AS BIGINT) <> 0
      WHEN 'UBIGINT' THEN TRUE
      WHEN 'DOUBLE' THEN CAST({v} AS DOUBLE) <> 0
      WHEN 'ARRAY' THEN json_array_length({doc}, {q(path)}) > 0
      WHEN 'OBJECT' THEN len(json_keys({doc}, {q(path)})) > 0 END)"""


def json_pystr(doc: str, path: str) -> str:
    """Python str() of a JSON value (scalars and arrays of strings)."""
    v = f"json_extract({doc}, {q(path)})"
    return f"""(CASE WHEN NOT json_exists({doc}, {q(path)}) THEN ''
      ELSE CASE json_type({doc}, {q(path)})
        WHEN 'VARCHAR' THEN json_extract_string({doc}, {q(path)})
        WHEN 'NULL' THEN 'None'
        WHEN 'BOOLEAN' THEN CASE WHEN CAST({v} AS BOOLEAN) THEN 'True' ELSE 'False' END
        WHEN 'ARRAY' THEN '[' || array_to_string(list_transform(json_extract_string({doc}, {q(path + '[*]')}),
                                lambda s: '''' || s || ''''), ', ') || ']'
        ELSE CAST({v} AS VARCHAR) END END)"""


def parse_ctes(src: str, col: str) -> str:
    """CTEs pr0..parsed: J7 over reply column ``col`` -> well_formed, det, det_category, category_text."""
    ws = WS_SET
    return f"""
pr0 AS (SELECT *, trim(coalesce({col}, ''), {ws}) AS _r0 FROM {src}),
pr1 AS (SELECT *, starts_with(_r0, '```') AS _fenced,
               CASE WHEN starts_with(_r0, '```') THEN trim(_r0, '`') ELSE _r0 END AS _r1 FROM pr0),
pr2 AS (SELECT *, trim(CASE WHEN _fenced AND starts_with(lower(_r1), 'json') THEN substr(_r1, 5) ELSE _r1 END, {ws}) AS _rj
        FROM pr1),
pr3 AS (SELECT *, CASE WHEN _rj <> '' AND json_valid(_rj) THEN
                    json_type(_rj) = 'OBJECT' AND json_exists(_rj, '$.injection_detected') ELSE FALSE END AS well_formed
        FROM pr2),
pr4 AS (SELECT *, CASE WHEN well_formed THEN {json_truthy('_rj', '$.injection_detected')} END AS _truthy,
               CASE WHEN well_formed THEN {json_pystr('_rj', '$.category')} END AS category_text
        FROM pr3),
parsed AS (SELECT * EXCLUDE (_r0, _r1, _rj, _fenced, _truthy),
                  CASE WHEN well_formed THEN _truthy ELSE TRUE END AS det,
                  CASE WHEN well_formed THEN {normalize_sql('category_text', '_truthy')}
                       ELSE {q(fixed.CATEGORY_MALFORMED_RESPONSE)} END AS det_category
           FROM pr4)"""


def pipeline_with(extra: str = "") -> str:
    """WITH planted -> cleaned -> prepared -> prompts -> responses -> replies -> parsed -> verdict."""
    from unveil.plans.standins import stub_responses_sql

    ctes = (
        f"planted AS ({planted_sql()}),"
        + clean_ctes("planted")
        + ","
        + prepare_ctes()
        + f""",
prompts AS (SELECT evidence_id, doc_id, 'detection' AS kind, detection_prompt AS prompt FROM prepared
            UNION ALL SELECT evidence_id, doc_id, 'canary' AS kind, canary_prompt AS prompt FROM prepared),
responses AS ({stub_responses_sql('prompts')}),
replies AS (SELECT evidence_id, max(CASE WHEN kind = 'detection' THEN response END) AS detection_response,
                   max(CASE WHEN kind = 'canary' THEN response END) AS canary_response
            FROM responses GROUP BY evidence_id),
joined AS (SELECT p.*, r.detection_response, r.canary_response FROM prepared p LEFT JOIN replies r USING (evidence_id)),"""
        + parse_ctes("joined", "detection_response")
        + f""",
leak AS (SELECT *, coalesce(contains(canary_response, canary_word) AND length(canary_response) > 0, FALSE) AS leaked
         FROM parsed),
verdict AS (SELECT *, conclusive OR det AS injection_detected,
                   CASE WHEN conclusive THEN {q(fixed.CATEGORY_HIDDEN_CONTENT_REMOVED)}
                        WHEN NOT det AND leaked THEN {q(fixed.CATEGORY_JUDGE_UNRELIABLE)}
                        ELSE {normalize_sql('det_category', 'det')} END AS category,
                   NOT leaked AS judge_reliable, leaked AS canary_tripped, conclusive AS conclusive_tampering
            FROM leak)"""
    )
    tail = ("," + extra) if extra else ""
    return f"WITH {ctes}{tail}\n"
