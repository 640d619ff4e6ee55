"""DuckDB text of the shared inputs and of the detection and masking steps."""

from __future__ import annotations

from veilwork.functions.rules import BY_NAME
from veilwork.plans.inputs import WHITELIST

WL = "(" + ", ".join(f"'{w}'" for w in WHITELIST) + ")"
CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
ND = r"\p{Nd}"


def lp(expr: str, n: int) -> str:
    return f"lpad(CAST({expr} AS VARCHAR), {n}, '0')"


LEDGER = f"""ledger AS (
  SELECT 'ledger/' || o_custkey AS file, o_custkey AS file_ord, o_orderkey AS unit_ord,
    '甲方' || c_name || '（' || n_name || '）与Supplier#' || {lp('o_orderkey % 100', 9)} || '于' ||
    year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日签订' || o_orderkey || '号订单，合同价人民币 ' ||
    (cents // 100) || '.' || {lp('cents % 100', 2)} || '元，首付' || (cents // 1000000) || '.' || {lp('(cents // 10000) % 100', 2)} || '万元，电话' ||
    CASE WHEN o_orderkey % 5 = 0 THEN '+86' ELSE '' END || '1' || (3 + o_orderkey % 7) ||
    {lp('(o_custkey * 7919 + o_orderkey) % 1000000000', 9)} || '，证件11010119' || {lp('o_custkey % 100', 2)} || '0101' ||
    {lp('o_orderkey % 1000', 3)} || CASE WHEN o_orderkey % 11 = 10 THEN 'X' ELSE CAST(o_orderkey % 11 AS VARCHAR) END || '，卡号6222 0202 ' ||
    {lp('o_custkey % 10000', 4)} || ' ' || {lp('o_orderkey % 10000', 4)} || '，邮箱c' || o_custkey || '@example.com。' AS text
  FROM (SELECT *, {CENTS} AS cents FROM orders) o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

DOCS = r"""docs AS (SELECT source AS file, doc_id AS file_ord, CAST(0 AS BIGINT) AS unit_ord, text FROM documents
  WHERE regexp_matches(text, '[^\s\x{85}\x{a0}\x{3000}]'))"""

CONVS = r"""convs AS (SELECT 'conv/' || conv_id AS file, conv_id AS file_ord, turn AS unit_ord, text FROM conversations
  WHERE regexp_matches(text, '[^\s\x{85}\x{a0}\x{3000}]'))"""

LEXICON = """lexicon AS (
  SELECT 'company' AS category, 0 AS cat_ord, s_name AS word, s_suppkey AS word_ord FROM supplier
  UNION ALL SELECT 'person', 2, c_name, c_custkey FROM customer
  UNION ALL SELECT DISTINCT 'project', 3, p_brand, CAST(substr(p_brand, 7) AS BIGINT) FROM part
  UNION ALL SELECT 'location', 5, n_name, n_nationkey FROM nation
  UNION ALL SELECT 'location', 5, r_name, 100 + r_regionkey FROM region)"""

WORDS = f"""words AS (
  SELECT word, arg_min(category, rule) AS type, min(rule) AS rule FROM (
    SELECT word, category, CAST(cat_ord AS BIGINT) * 1099511627776 + word_ord AS rule FROM lexicon)
  WHERE word NOT IN {WL} GROUP BY word)"""

MEMO = """memo AS (SELECT 'memo/' || s_nationkey AS file, CAST(s_nationkey AS BIGINT) AS file_ord, s_suppkey AS unit_ord,
  '供方' || s_name || '（' || n_name || '）编号' || printf('[COMPANY_%03d]', s_suppkey * 2) || '，旧号' || printf('[LOCATION_%04d]', s_suppkey) ||
  '，备用' || printf('[LOCATION_%03d]', s_suppkey % 40) AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

TOKENED = """tokened AS (SELECT 'f/' || o_custkey AS file, o_custkey AS file_ord, o_orderkey AS unit_ord, o_orderstatus,
  CASE WHEN o_orderstatus = 'P' THEN '订单' || o_orderkey || '见[SUBJECT_007]'
  ELSE '客户' || printf('[PERSON_%03d]', o_custkey + 1) || '付' || printf('[AMOUNT_%03d]', o_orderkey + 1) || '，客户' ||
    printf('[PERSON_%03d]', o_custkey + 1) || '另见[SUBJECT_007]' END AS text FROM orders)"""

MAPPING = f"""mapping AS (
  SELECT printf('[PERSON_%03d]', c_custkey + 1) AS token, c_name AS original, 'person' AS type, CAST(0.95 AS DOUBLE) AS confidence, 'text' AS kind FROM customer
  UNION ALL SELECT printf('[AMOUNT_%03d]', o_orderkey + 1), ({CENTS} // 100) || '.' || {lp(CENTS + ' % 100', 2)}, 'amount', CAST(0.85 AS DOUBLE), 'number' FROM orders)"""

LISTING = f"""listing AS (SELECT r_name || '/' || n_name || '/' || c_name || '-合同' || CASE c_custkey % 4
    WHEN 0 THEN c_custkey || '万' WHEN 1 THEN '1380000' || {lp('c_custkey % 10000', 4)}
    WHEN 2 THEN '621700000000' || {lp('c_custkey % 10000', 4)} ELSE '' END ||
    CASE c_custkey % 5 WHEN 0 THEN '.docx' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.PDF' WHEN 3 THEN '.pptx' ELSE '' END AS path
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

PATHS = """paths AS (
  SELECT 'file' AS kind, c_name || '.docx' AS old_name, printf('[PERSON_%03d].docx', c_custkey // 2 * 2 + 1) AS new_name,
    n_name || '/' || c_name || '.docx' AS rel_old,
    printf('[LOCATION_%03d]', n_nationkey + 1) || '/' || printf('[PERSON_%03d].docx', c_custkey // 2 * 2 + 1) AS rel_new, 2 AS depth,
    CASE WHEN c_custkey % 9 = 0 THEN 'skipped' WHEN c_custkey % 2 = 1 THEN 'conflict_suffixed' ELSE 'renamed' END AS status, c_custkey + 1000 AS ord
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'dir', n_name, printf('[LOCATION_%03d]', n_nationkey + 1), n_name, printf('[LOCATION_%03d]', n_nationkey + 1), 1, 'renamed', n_nationkey
  FROM nation)"""

NUMBERS = """cells AS (SELECT l_orderkey * 10 + l_linenumber AS cell, l_partkey, l_suppkey, l_quantity, l_extendedprice * CAST(7.5 AS DOUBLE) AS value,
  CASE l_orderkey % 3 WHEN 0 THEN '¥#,##0.00' WHEN 1 THEN 'General' ELSE '[$€-407]#,##0' END AS number_format FROM lineitem)"""

WHOLES = """wholes AS (SELECT o_orderkey AS cell, CASE o_orderkey % 3 WHEN 0 THEN 4000000000000000 + o_orderkey * 7919
  WHEN 1 THEN 1000000000 + o_orderkey ELSE 12345678901234567 + o_orderkey END AS value,
  CASE WHEN o_orderkey % 7 = 0 THEN '$0' ELSE 'General' END AS number_format FROM orders)"""

TAGGED = """tagged AS (SELECT 'part' AS file, CAST(0 AS BIGINT) AS file_ord, p_partkey AS unit_ord, ord, word,
    ['nr','nrfg','nrt','ns','nsf','nt','ni','nis','nic','nz','x'][(length(word) + p_partkey) % 11 + 1] AS flag
  FROM (SELECT p_partkey, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS ord FROM (
    SELECT p_partkey, string_split(p_name || ' ' || p_type || CASE p_size % 3 WHEN 0 THEN '公司' WHEN 1 THEN '银行' ELSE '' END, ' ') AS ws FROM part)))"""

# The engine behind the check has no look-around, so bounded rules are restated on maximal runs.
RX = {
    "rmb_amount": ("amount", 0.90, 0, f"regexp_extract_all(text, '{BY_NAME['rmb_amount'].pattern}')"),
    "generic_amount": ("amount", 0.80, 1, rf"regexp_extract_all(text, '(?:^|[^{ND}.])({ND}[{ND},]*\.?{ND}*[万亿]元?)', 1)"),
    "mobile": ("custom", 0.85, 2, rf"""list_filter([CASE WHEN starts_with(r, '+86') THEN r ELSE ltrim(r, '+') END
        FOR r IN regexp_extract_all(text, '\+?{ND}+')], lambda r: regexp_full_match(r, '(\+?86)?1[3-9]{ND}{{9}}'))"""),
    "id_number": ("custom", 0.85, 3, rf"""list_filter([CASE WHEN regexp_full_match(r, '{ND}{{18}}([Xx].*)?') THEN left(r, 18)
        WHEN regexp_full_match(r, '{ND}{{17}}[Xx]') THEN r ELSE '' END
        FOR r IN regexp_extract_all(text, '{ND}+(?:[Xx]{ND}*)?')], lambda r: r <> '')"""),
    "email": ("custom", 0.75, 4, r"regexp_extract_all(text, '[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+')"),
    "cn_date": ("custom", 0.70, 5, rf"list_filter(regexp_extract_all(text, '{ND}+年{ND}{{1,2}}月{ND}{{1,2}}日{ND}*'), lambda r: regexp_full_match(r, '{ND}{{4}}年.*日'))"),
    "card": ("custom", 0.65, 6, rf"list_filter(regexp_extract_all(text, '{ND}+'), lambda r: length(r) BETWEEN 16 AND 19)"),
    "separated_card": ("custom", 0.65, 7, rf"regexp_extract_all(text, '(?:^|[^{ND}])({ND}{{4}}(?:[ -]{ND}{{4}}){{3}}(?:[ -]{ND}{{3}})?)(?:$|[^{ND}])', 1)"),
}
KEY = "file, file_ord, unit_ord"


def rx(units: str, names=None) -> str:
    """SELECT of all rule hits of a unit table, one per distinct text of a rule and unit."""
    parts = [f"""SELECT {KEY}, text AS body, unnest(list_distinct({e})) AS text, '{t}' AS text_type, 'regex' AS source,
  CAST({c} AS DOUBLE) AS confidence, 3 AS channel_ord, CAST({i} AS BIGINT) AS rule_ord FROM {units}"""
             for n, (t, c, i, e) in RX.items() if names is None or n in names]
    return "\n UNION ALL ".join(parts)


def det(units: str, dictionary: bool = True, whitelist: bool = True, manual: tuple[str, ...] = ()) -> str:
    """CTEs raw and det: all channels, one row per text of a unit."""
    parts = [rx(units)]
    if dictionary:
        parts.append(f"""SELECT {KEY}, u.text, w.word, w.type, 'dictionary', CAST(0.95 AS DOUBLE), 1, w.rule
  FROM {units} u JOIN words w ON contains(u.text, w.word)""")
    for i, m in enumerate(manual):
        parts.append(f"SELECT {KEY}, text, '{m}', 'custom', 'manual', CAST(0.95 AS DOUBLE), 0, {i} FROM {units} WHERE contains(text, '{m}')")
    wl = f"WHERE source = 'manual' OR text NOT IN {WL}" if whitelist else ""
    return f"""raw AS ({" UNION ALL ".join(parts)}),
det AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {KEY}, text ORDER BY channel_ord, rule_ord) AS rn
  FROM raw {wl}) WHERE rn = 1)"""


def status(mode: str) -> str:
    cuts = {"focused": (0.95, None), "strict": (0.95, 0.85), "smart": (0.85, 0.60), "aggressive": (0.70, 0.45)}
    auto, sug = cuts[mode]
    mid = f" WHEN confidence >= CAST({sug} AS DOUBLE) THEN 'suggest_mask'" if sug else ""
    return f"CASE WHEN confidence >= CAST({auto} AS DOUBLE) THEN 'auto_mask'{mid} ELSE 'hint_only' END"


def spans(mode: str, statuses: tuple[str, ...] = ("auto_mask",)) -> str:
    """CTEs act and spans: every occurrence of every actionable detection."""
    wanted = ", ".join(f"'{s}'" for s in statuses)
    return f"""act AS (SELECT * FROM det WHERE {status(mode)} IN ({wanted})),
spans AS (SELECT * EXCLUDE (starts), unnest(starts) AS s, unnest(starts) + length(text) AS e FROM (
  SELECT *, [CAST(list_sum([length(p) FOR p IN pieces[1:i]]) AS BIGINT) + (i - 1) * length(text) FOR i IN range(1, len(pieces))] AS starts
  FROM (SELECT *, string_split(body, text) AS pieces FROM act)))"""


RESOLVE = f"""walk AS (
  SELECT {KEY}, list(struct_pack(s := s, e := e, t := text, k := text_type, c := confidence, src := source)
    ORDER BY e - s DESC, confidence DESC, s) AS todo, list(struct_pack(s := s, e := e, t := text, k := text_type, c := confidence, src := source))[1:0] AS kept,
    list(struct_pack(s := s, e := e, t := text, k := text_type, c := confidence, src := source))[1:0] AS dropped
  FROM spans GROUP BY {KEY}
  UNION ALL
  SELECT {KEY}, list_filter(todo, lambda x: x.e <= todo[1].s OR x.s >= todo[1].e), list_append(kept, todo[1]),
    list_concat(dropped, list_filter(todo[2:], lambda x: NOT (x.e <= todo[1].s OR x.s >= todo[1].e)))
  FROM walk WHERE len(todo) > 0),
final AS (SELECT {KEY}, kept, dropped FROM walk WHERE len(todo) = 0),
kept AS (SELECT {KEY}, x.s AS s, x.e AS e, x.t AS text, x.k AS text_type, x.c AS confidence, x.src AS source
  FROM (SELECT {KEY}, unnest(kept) AS x FROM final)),
dropped AS (SELECT {KEY}, x.s AS s, x.e AS e, x.t AS text, x.k AS text_type, x.c AS confidence, x.src AS source
  FROM (SELECT {KEY}, unnest(dropped) AS x FROM final))"""

FIRST = """firsts AS (SELECT text AS original, arg_min(text_type, (file_ord, unit_ord, s)) AS type, arg_min(confidence, (file_ord, unit_ord, s)) AS confidence,
  arg_min(source, (file_ord, unit_ord, s)) AS source, min((file_ord, unit_ord, s)) AS spot FROM kept GROUP BY text)"""

ALLOC = """alloc AS (SELECT *, printf('[%s_%03d]', upper(type), row_number() OVER (PARTITION BY type ORDER BY spot)) AS token FROM firsts)"""


def rebuilt(units: str, new: str = "a.token", alloc: str = "alloc") -> str:
    """CTE masked: texts rebuilt from kept spans."""
    return f"""reps AS (SELECT k.*, {new} AS new_text, lag(k.e, 1, 0) OVER (PARTITION BY k.file, k.file_ord, k.unit_ord ORDER BY k.s) AS before
  FROM kept k LEFT JOIN {alloc} a ON k.text = a.original),
masked AS (SELECT u.file, u.file_ord, u.unit_ord, u.text, coalesce(m.head || substr(u.text, m.last + 1), u.text) AS masked_text FROM {units} u LEFT JOIN (
  SELECT r.file, r.file_ord, r.unit_ord, string_agg(substr(b.text, r.before + 1, r.s - r.before) || r.new_text, '' ORDER BY r.s) AS head, max(r.e) AS last
  FROM reps r JOIN {units} b USING (file, file_ord, unit_ord) GROUP BY ALL) m USING (file, file_ord, unit_ord))"""


def with_(*ctes: str, recursive: bool = True) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"
