"""DuckDB SQL oracles for the driver queries in ``sluice.plans.standins``.

Written by hand from the operator semantics (not generated from the Spark
plans): same stand-in mappings, NULL-tolerant rule predicates, pass rates
rounded to four places.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORDERS = ("SELECT o_orderkey AS transaction_id, o_custkey AS card_identifier, o_totalprice AS original_amount, "
          "o_orderdate AS transaction_ts, o_orderstatus AS status FROM orders")
CUSTOMER = ("SELECT c_custkey AS merchant_id, c_name AS business_name, c_mktsegment AS merchant_category, "
            "c_acctbal AS account_balance, c_nationkey AS nation_id FROM customer")
LINEITEM = ("SELECT l_orderkey AS withdrawal_id, l_linenumber AS line_no, l_partkey AS atm_id, l_suppkey AS location_id, "
            "l_quantity AS amount_sgd, l_shipdate AS withdrawal_ts, l_returnflag AS dispense_status FROM lineitem")
EVENTS = ("SELECT event_id AS flag_id, user_id AS reference, value AS score, event_type AS flag_type, ts AS flagged_at "
          "FROM events")
PART = "SELECT p_partkey AS part_id, p_brand AS brand, p_name AS part_name FROM part"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def metrics_sql(feed: str, rules: list[tuple]) -> str:
    """rules: (rule_id, rule_name, rule_type, expression_text, column, pass_predicate_sql, threshold)."""
    counts = ", ".join(
        f"count(*) FILTER (WHERE NOT ({pred})) AS f{i}" for i, (_, _, _, _, _, pred, _) in enumerate(rules)
    )
    parts = []
    for i, (rid, name, rtype, text, col, _, thr) in enumerate(rules):
        rate = f"(CASE WHEN total = 0 THEN 1.0 ELSE (total - f{i}) / total END)"
        parts.append(
            f"SELECT {_q(rid)} AS rule_id, {_q(name)} AS rule_name, {_q(rtype)} AS rule_type, "
            f"{_q(text)} AS rule_expression, {_q(col)} AS column_name, total AS total_rows, "
            f"total - f{i} AS passed_rows, f{i} AS failed_rows, round({rate}, 4) AS pass_rate, "
            f"CAST({thr} AS DOUBLE) AS threshold, {rate} >= CAST({thr} AS DOUBLE) AS rule_passed FROM c"
        )
    return f"WITH t AS ({feed}), c AS (SELECT count(*) AS total, {counts} FROM t) " + " UNION ALL ".join(parts)


ORDER_RULES_SQL = [
    ("q001", "transaction_id_not_null", "not_null", "transaction_id IS NOT NULL", "transaction_id", "transaction_id IS NOT NULL", 1.0),
    ("q002", "amount_positive", "range", "original_amount > 0 AND original_amount < 400000", "original_amount",
     "coalesce(original_amount > 0 AND original_amount < 400000, true)", 0.99),
    ("q003", "status_valid", "allowed_values", "status IN ('F', 'O')", "status", "coalesce(status IN ('F', 'O'), true)", 0.98),
    ("q004", "status_format", "regex", "status RLIKE '^[A-Z]$'", "status", "coalesce(regexp_matches(status, '^[A-Z]$'), true)", 0.99),
    ("q005", "card_even", "custom", "card_identifier % 2 = 0", "card_identifier", "coalesce(card_identifier % 2 = 0, true)", 0.4),
]
CUSTOMER_RULES_SQL = [
    ("m001", "merchant_id_not_null", "not_null", "merchant_id IS NOT NULL", "merchant_id", "merchant_id IS NOT NULL", 1.0),
    ("m002", "balance_positive", "range", "account_balance > 0", "account_balance", "coalesce(account_balance > 0, true)", 0.95),
    ("m003", "segment_valid", "allowed_values",
     "merchant_category IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')", "merchant_category",
     "coalesce(merchant_category IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'), true)", 0.5),
]
LINEITEM_RULES_SQL = [
    ("a001", "withdrawal_id_not_null", "not_null", "withdrawal_id IS NOT NULL", "withdrawal_id", "withdrawal_id IS NOT NULL", 1.0),
    ("a002", "amount_multiple_of_5", "custom", "amount_sgd % 5 = 0", "amount_sgd", "coalesce(amount_sgd % 5 = 0, true)", 0.2),
    ("a003", "amount_positive", "range", "amount_sgd > 0 AND amount_sgd <= 45", "amount_sgd",
     "coalesce(amount_sgd > 0 AND amount_sgd <= 45, true)", 0.99),
]

ORACLES["dq_metrics_all"] = metrics_sql(ORDERS, ORDER_RULES_SQL)

ORACLES["dq_not_null"] = metrics_sql(
    f"SELECT flag_id, reference, score, nullif(flag_type, 'error') AS flag_type, flagged_at FROM ({EVENTS})",
    [
        ("n001", "flag_type_not_null", "not_null", "flag_type IS NOT NULL", "flag_type", "flag_type IS NOT NULL", 0.75),
        ("n002", "flag_id_not_null", "not_null", "flag_id IS NOT NULL", "flag_id", "flag_id IS NOT NULL", 1.0),
    ],
)

ORACLES["dq_range"] = metrics_sql(ORDERS, [
    ("g001", "amount_open_range", "range", "original_amount > 0 AND original_amount < 400000", "original_amount",
     "coalesce(original_amount > 0 AND original_amount < 400000, true)", 0.8),
    ("g002", "amount_closed_range", "range", "original_amount >= 100000 AND original_amount <= 300000", "original_amount",
     "coalesce(original_amount >= 100000 AND original_amount <= 300000, true)", 0.5),
])

ORACLES["dq_allowed_values"] = metrics_sql(ORDERS, [
    ("v001", "status_final_or_open", "allowed_values", "status IN ('F', 'O')", "status", "coalesce(status IN ('F', 'O'), true)", 0.9),
    ("v002", "status_any", "allowed_values", "status IN ('F', 'O', 'P')", "status", "coalesce(status IN ('F', 'O', 'P'), true)", 1.0),
])

ORACLES["dq_regex"] = metrics_sql(PART, [
    ("x001", "brand_one_digit", "regex", "brand RLIKE '^Brand#[0-9]$'", "brand", "coalesce(regexp_matches(brand, '^Brand#[0-9]$'), true)", 0.5),
    ("x002", "brand_format", "regex", "brand RLIKE '^Brand#[0-9]+$'", "brand", "coalesce(regexp_matches(brand, '^Brand#[0-9]+$'), true)", 0.99),
])

ORACLES["dq_custom"] = metrics_sql(LINEITEM, [
    ("c001", "amount_multiple_of_5", "custom", "amount_sgd % 5 = 0", "amount_sgd", "coalesce(amount_sgd % 5 = 0, true)", 0.2),
    ("c002", "tax_small", "custom", "amount_sgd * 2 < 90", "amount_sgd", "coalesce(amount_sgd * 2 < 90, true)", 0.9),
])


def _failed_list_sql(rules: list[tuple]) -> str:
    """Comma-joined failed rule ids in rule order (NULL-skipping concat_ws)."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({r[5]}) THEN {_q(r[0])} END" for r in rules) + ")"


ORACLES["dq_row_verdict"] = (
    f"WITH t AS ({ORDERS}) SELECT transaction_id, {_failed_list_sql(ORDER_RULES_SQL)} AS failed_rules, "
    f"{_failed_list_sql(ORDER_RULES_SQL)} = '' AS dq_passed FROM t"
)

ORACLES["dq_sample_failures"] = (
    f"WITH t AS ({ORDERS}), f AS ("
    + " UNION ALL ".join(
        f"SELECT {_q(r[0])} AS rule_id, transaction_id, card_identifier, status FROM t WHERE NOT ({r[5]})"
        for r in ORDER_RULES_SQL
    )
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY transaction_id) AS rn FROM f) "
    "SELECT rule_id, '[' || string_agg('{\"transaction_id\":' || transaction_id || ',\"card_identifier\":' || card_identifier "
    "|| ',\"status\":\"' || status || '\"}', ',' ORDER BY rn) || ']' AS sample_failures FROM r WHERE rn <= 3 GROUP BY rule_id"
)


def _summary_sql(source_id: str, feed: str, rules: list[tuple], key: str) -> str:
    fails = " OR ".join(f"NOT ({r[5]})" for r in rules)
    gates = " + ".join(
        f"CAST((CASE WHEN total = 0 THEN 1.0 ELSE (total - f{i}) / total END) >= CAST({r[6]} AS DOUBLE) AS INTEGER)"
        for i, r in enumerate(rules)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE NOT ({r[5]})) AS f{i}" for i, r in enumerate(rules))
    # passed = rows failing no rule, minus extra copies of a key among them
    return (
        f"(WITH t AS ({feed}), c AS (SELECT count(*) AS total, {counts} FROM t), "
        f"g AS (SELECT count(DISTINCT {key}) + count(*) FILTER (WHERE {key} IS NULL) AS ok FROM t WHERE NOT ({fails})), "
        f"s AS (SELECT total, ok, CAST({gates} AS INTEGER) AS rp FROM c, g) "
        f"SELECT {_q(source_id)} AS source_id, total AS total_rows_ingested, ok AS total_rows_passed, "
        f"total - ok AS total_rows_rejected, round(CASE WHEN total = 0 THEN 1.0 ELSE ok / total END, 4) AS overall_pass_rate, "
        f"CAST({len(rules)} AS INTEGER) AS rules_checked, rp AS rules_passed, CAST({len(rules)} - rp AS INTEGER) AS rules_failed, "
        f"CASE WHEN ok = 0 THEN 'FAILED' WHEN {len(rules)} - rp > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS ingestion_status FROM s)"
    )


ORACLES["dq_summary"] = (
    _summary_sql("src_orders", ORDERS, ORDER_RULES_SQL, "transaction_id")
    + " UNION ALL "
    + _summary_sql("src_customer", CUSTOMER, CUSTOMER_RULES_SQL, "merchant_id")
)

ORACLES["column_mapping"] = (
    "SELECT o_orderkey AS transaction_id, o_custkey AS card_identifier, CAST(NULL AS VARCHAR) AS merchant_name, "
    "CAST(NULL AS DOUBLE) AS amount_usd, o_orderdate AS transaction_ts, o_orderstatus AS status, "
    "CAST(NULL AS INTEGER) AS is_international, CAST(NULL AS VARCHAR) AS source_currency, o_totalprice AS original_amount "
    "FROM orders"
)

INT_RE = "^[+-]?[0-9]+$"
DEC_RE = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _guarded(col: str, pattern: str, typ: str) -> str:
    return f"CASE WHEN regexp_matches(trim({col}), '{pattern}') THEN TRY_CAST(trim({col}) AS {typ}) END"


def _cast_fail(raw: str, typed: str, name: str) -> str:
    return f"CASE WHEN {raw} IS NOT NULL AND trim({raw}) <> '' AND {typed} IS NULL THEN 'cast:{name}' END"


ORACLES["safe_cast"] = (
    "WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS a, p_name AS b, CAST(p_size AS VARCHAR) AS c, "
    "CAST(p_retailprice AS VARCHAR) AS d FROM part), "
    f"x AS (SELECT a, b, c, d, {_guarded('a', INT_RE, 'BIGINT')} AS part_id, {_guarded('b', DEC_RE, 'DOUBLE')} AS part_name, "
    f"{_guarded('c', INT_RE, 'INTEGER')} AS size, {_guarded('d', DEC_RE, 'DOUBLE')} AS retail_price FROM r) "
    "SELECT part_id, part_name, size, retail_price, concat_ws(',', "
    f"{_cast_fail('a', 'part_id', 'part_id')}, {_cast_fail('b', 'part_name', 'part_name')}, "
    f"{_cast_fail('c', 'size', 'size')}, {_cast_fail('d', 'retail_price', 'retail_price')}) AS cast_failures FROM x"
)

_TEXT_DATES = (
    "SELECT o_orderkey AS transaction_id, CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m-%d') "
    "ELSE strftime(o_orderdate, '%d/%m/%Y %H:%M') END AS raw_ts FROM orders"
)
ORACLES["timestamp_parse"] = (
    f"SELECT transaction_id, raw_ts, try_strptime(raw_ts, '%d/%m/%Y %H:%M') AS transaction_ts FROM ({_TEXT_DATES})"
)
ORACLES["date_parse"] = (
    f"SELECT transaction_id, raw_ts, CAST(try_strptime(raw_ts, '%Y-%m-%d') AS DATE) AS onboarded_date FROM ({_TEXT_DATES})"
)
ORACLES["iso_fraction_parse"] = (
    "SELECT event_id AS flag_id, CASE WHEN event_id % 2 = 1 THEN ts ELSE date_trunc('second', ts) END AS flagged_at FROM events"
)
ORACLES["utc_normalise"] = (
    "SELECT event_id AS flag_id, ts AS flagged_at, ts - INTERVAL 330 MINUTE AS flagged_at_utc FROM events"
)
ORACLES["currency_convert"] = (
    "WITH r AS (SELECT currency, CAST(d AS DATE) AS as_of_date, CAST(rate AS DOUBLE) AS rate_to_usd FROM (VALUES "
    "('USD', '2020-01-01', 1.0), ('INR', '2020-01-01', 0.0125), ('INR', '2024-01-01', 0.012), "
    "('INR', '2025-01-01', 0.0115), ('SGD', '2020-01-01', 0.74)) v(currency, d, rate)), "
    "lr AS (SELECT currency, arg_max(rate_to_usd, as_of_date) AS rate FROM r WHERE as_of_date <= DATE '2024-06-30' GROUP BY currency), "
    "o AS (SELECT o_orderkey AS transaction_id, o_totalprice AS amt, CASE o_orderstatus WHEN 'F' THEN 'USD' "
    "WHEN 'O' THEN 'INR' WHEN 'P' THEN 'SGD' END AS cur FROM orders) "
    "SELECT transaction_id, cur AS source_currency, CASE WHEN cur = 'USD' THEN NULL ELSE amt END AS original_amount, "
    "CASE WHEN cur = 'USD' THEN amt ELSE CAST(round(CAST(amt AS DECIMAL(20,4)) * CAST(rate AS DECIMAL(20,8)), 2) AS DOUBLE) END "
    "AS amount_usd FROM o LEFT JOIN lr ON o.cur = lr.currency"
)
ORACLES["status_normalise"] = (
    "SELECT o_orderkey AS transaction_id, o_orderstatus AS raw_status, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' "
    "WHEN 'O' THEN 'PENDING' ELSE o_orderstatus END AS status FROM orders"
)
ORACLES["audit_columns"] = (
    "SELECT o_orderkey AS transaction_id, o_orderstatus AS status, true AS dq_passed, 'run-0001' AS run_id, "
    "TIMESTAMP '2024-01-01 06:00:00' AS ingested_at, '2024-01-01' AS processing_date, 'src_orders' AS source_id FROM orders"
)
ORACLES["mask_hash"] = (
    "SELECT c_custkey AS merchant_id, substr(sha256(c_name), 1, 16) AS name_hash, "
    "regexp_matches(substr(sha256(c_name), 1, 16), '^[0-9a-f]{16}$') AS hash_ok FROM customer"
)
ORACLES["filter_project"] = (
    "SELECT o_orderkey AS transaction_id, o_orderstatus AS status, 'card' AS feed, true AS stamped FROM orders "
    "WHERE o_orderstatus = 'F'"
)
ORACLES["json_object_parse"] = (
    "SELECT event_id, je.key AS prop_key, CASE WHEN json_type(je.value) = 'VARCHAR' THEN je.value ->> '$' "
    "ELSE CAST(je.value AS VARCHAR) END AS prop_value FROM events, json_each(props) AS je"
)


def _rules_union(source_id: str, feed: str, rules: list[tuple], has_q003: bool) -> list[str]:
    return [
        f"SELECT {_q(source_id)} AS source_id, {_q(r[0])} AS rule_id, {_q(r[2])} AS rule_type, "
        f"CAST({r[6]} AS DOUBLE) AS threshold, {str(has_q003).lower()} AS has_q003, "
        f"(SELECT count(*) FROM ({feed}) t WHERE NOT ({r[5]})) AS failed_rows"
        for r in rules
    ]


ORACLES["config_rules_parse"] = " UNION ALL ".join(
    _rules_union("src_orders", ORDERS, ORDER_RULES_SQL, True)
    + _rules_union("src_customer", CUSTOMER, CUSTOMER_RULES_SQL, False)
    + _rules_union("src_lineitem", LINEITEM, LINEITEM_RULES_SQL, False)
)

ORACLES["dedup_latest"] = (
    f"SELECT withdrawal_id, line_no, atm_id, location_id, amount_sgd, withdrawal_ts, dispense_status FROM ("
    f"SELECT *, row_number() OVER (PARTITION BY withdrawal_id, line_no ORDER BY withdrawal_ts DESC NULLS LAST, "
    f"atm_id DESC NULLS LAST, location_id DESC NULLS LAST) AS rn FROM ({LINEITEM})) WHERE rn = 1"
)
ORACLES["dup_report"] = (
    f"SELECT withdrawal_id, line_no, count(*) AS copies FROM ({LINEITEM}) GROUP BY withdrawal_id, line_no HAVING count(*) > 1"
)
ORACLES["key_uniqueness"] = (
    f"WITH k AS (SELECT withdrawal_id, line_no, count(*) AS n FROM ({LINEITEM}) GROUP BY withdrawal_id, line_no) "
    "SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS duplicate_keys, "
    "CAST(sum(n - 1) AS BIGINT) AS extra_copies FROM k"
)
ORACLES["union_sources"] = (
    "SELECT c_custkey AS party_id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'src_customer' AS source_id "
    "FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'src_supplier' FROM supplier"
)
_FLAGS = "SELECT l_orderkey AS transaction_ref, l_linenumber AS flag_line, l_quantity AS fraud_score FROM lineitem"
_TXNS = ("SELECT o_orderkey AS transaction_id, o_totalprice AS amount, o_orderstatus AS status FROM orders "
         "WHERE o_orderstatus <> 'P'")
ORACLES["fk_join"] = f"SELECT * FROM ({_FLAGS}) f JOIN ({_TXNS}) t ON f.transaction_ref = t.transaction_id"
ORACLES["fk_orphans"] = f"SELECT * FROM ({_FLAGS}) f WHERE NOT EXISTS (SELECT 1 FROM ({_TXNS}) t WHERE t.transaction_id = f.transaction_ref)"
ORACLES["fk_semi"] = f"SELECT * FROM ({_TXNS}) t WHERE EXISTS (SELECT 1 FROM ({_FLAGS}) f WHERE f.transaction_ref = t.transaction_id)"
ORACLES["dashboard_counts"] = (
    f"SELECT CAST(flagged_at AS DATE) AS flag_date, flag_type, count(*) AS rows, count(*) FILTER (WHERE score > 50) "
    f"AS high_score_rows FROM ({EVENTS}) GROUP BY 1, 2 ORDER BY 1, 2"
)
_LI_FAIL = " OR ".join(f"NOT ({r[5]})" for r in LINEITEM_RULES_SQL)
ORACLES["reconcile"] = (
    f"WITH t AS ({LINEITEM}), c AS (SELECT count(*) AS rows_read, "
    f"(SELECT count(*) FROM (SELECT DISTINCT withdrawal_id, line_no FROM t WHERE NOT ({_LI_FAIL}))) AS rows_written FROM t) "
    "SELECT rows_read, rows_written, rows_read - rows_written AS rows_rejected, true AS reconciled FROM c"
)


def _profile_sql(feed: str, cols: list[tuple[str, str, str]]) -> str:
    """cols: (name, logical type, text rendering of x)."""
    parts = []
    for name, typ, render in cols:
        parts.append(
            f"SELECT '{name}' AS column_name, '{typ}' AS column_type, count(*) FILTER (WHERE {name} IS NULL) > 0 AS is_nullable, "
            f"round(CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE {name} IS NULL) / count(*) END, 4) AS null_rate, "
            f"{render.format(x=f'min({name})')} AS min_value, {render.format(x=f'max({name})')} AS max_value FROM ({feed})"
        )
    return " UNION ALL ".join(parts)


TXT = "CAST({x} AS VARCHAR)"
TSTXT = "strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"
ORDER_PROFILE = [
    ("transaction_id", "integer", TXT), ("card_identifier", "integer", TXT), ("original_amount", "double", TXT),
    ("transaction_ts", "timestamp", TSTXT), ("status", "string", TXT),
]
ORACLES["profile_columns"] = _profile_sql(ORDERS, ORDER_PROFILE)

ORACLES["sample_values"] = (
    "WITH l AS (SELECT 'brand' AS c, p_brand AS v FROM part UNION ALL SELECT 'part_type', p_type FROM part "
    "UNION ALL SELECT 'size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT 'part_id', CAST(p_partkey AS VARCHAR) FROM part), "
    "n AS (SELECT c, v, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY c, v), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v ASC) AS r FROM n) "
    "SELECT c AS column_name, '[' || string_agg('\"' || v || '\"', ',' ORDER BY r) || ']' AS sample_values FROM r WHERE r <= 10 GROUP BY c"
)

BOOL_RE = "^(true|false)$"
TS_RE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?)?$"


def _infer_sql(tbl: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for name, expr in cols:
        x = f"trim({expr})"
        checks = {
            "integer": f"regexp_matches({x}, '{INT_RE}') AND TRY_CAST({x} AS BIGINT) IS NOT NULL",
            "double": f"regexp_matches({x}, '{DEC_RE}')",
            "boolean": f"regexp_matches(lower({x}), '{BOOL_RE}')",
            "timestamp": f"regexp_matches({x}, '{TS_RE}') AND TRY_CAST({x} AS TIMESTAMP) IS NOT NULL",
        }
        case = f"CASE WHEN count({expr}) = 0 THEN 'string' "
        for t, c in checks.items():
            case += f"WHEN coalesce(bool_and(CASE WHEN {expr} IS NOT NULL THEN {c} END), false) THEN '{t}' "
        case += "ELSE 'string' END"
        parts.append(f"SELECT '{name}' AS column_name, {case} AS column_type FROM {tbl}")
    return " UNION ALL ".join(parts)


ORACLES["infer_types"] = (
    _infer_sql("part", [("p_partkey", "CAST(p_partkey AS VARCHAR)"), ("p_name", "p_name"), ("p_brand", "p_brand"),
                        ("p_type", "p_type"), ("p_size", "CAST(p_size AS VARCHAR)"), ("p_retailprice", "CAST(p_retailprice AS VARCHAR)")])
    + " UNION ALL "
    + _infer_sql("orders", [("o_orderkey", "CAST(o_orderkey AS VARCHAR)"), ("o_orderdate", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"),
                            ("o_is_final", "CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END"),
                            ("o_totalprice", "CAST(o_totalprice AS VARCHAR)")])
)

_OLD = f"SELECT * FROM ({ORDERS}) WHERE year(transaction_ts) < 1998"
_NEW = (f"SELECT transaction_id, CAST(original_amount AS VARCHAR) AS original_amount, transaction_ts, "
        f"CASE WHEN status <> 'P' THEN status END AS status, 'web' AS channel FROM ({ORDERS}) WHERE year(transaction_ts) >= 1998")
_OLD_P = _profile_sql(_OLD, ORDER_PROFILE)
_NEW_P = _profile_sql(_NEW, [("transaction_id", "integer", TXT), ("original_amount", "string", TXT),
                             ("transaction_ts", "timestamp", TSTXT), ("status", "string", TXT), ("channel", "string", TXT)])
_PAIR = (f"SELECT coalesce(o.column_name, n.column_name) AS column_name, o.column_type AS old_column_type, "
         f"n.column_type AS new_column_type, o.is_nullable AS old_is_nullable, n.is_nullable AS new_is_nullable, "
         f"o.null_rate AS old_null_rate, n.null_rate AS new_null_rate, o.min_value AS old_min, n.min_value AS new_min, "
         f"o.max_value AS old_max, n.max_value AS new_max FROM ({_OLD_P}) o FULL OUTER JOIN ({_NEW_P}) n ON o.column_name = n.column_name")
_CHANGES = (
    "list_filter([CASE WHEN old_column_type IS NULL THEN 'added' END, CASE WHEN new_column_type IS NULL THEN 'removed' END, "
    "CASE WHEN old_column_type <> new_column_type THEN 'retyped' END, "
    "CASE WHEN old_is_nullable <> new_is_nullable THEN 'nullability_changed' END], lambda x: x IS NOT NULL)"
)
ORACLES["schema_drift"] = (
    f"SELECT column_name, unnest({_CHANGES}) AS change_type, old_column_type, new_column_type, old_is_nullable, new_is_nullable "
    f"FROM ({_PAIR})"
)
ORACLES["registry_append"] = " UNION ALL ".join(
    f"SELECT 'src_orders' AS source_id, {v} AS schema_version, column_name, column_type, is_nullable, null_rate, min_value, max_value FROM ({sql})"
    for v, sql in ((1, _OLD_P), (2, _NEW_P))
)
ORACLES["drift_from_registry"] = (
    f"SELECT 'src_orders' AS source_id, column_name, array_to_string({_CHANGES}, ',') AS changes, "
    "round(new_null_rate - old_null_rate, 4) AS null_rate_delta, "
    "CASE WHEN old_column_type IS NOT NULL AND new_column_type IS NOT NULL THEN old_min IS DISTINCT FROM new_min END AS min_changed, "
    "CASE WHEN old_column_type IS NOT NULL AND new_column_type IS NOT NULL THEN old_max IS DISTINCT FROM new_max END AS max_changed "
    f"FROM ({_PAIR})"
)
ORACLES["value_drift"] = (
    "SELECT column_name, round(new_null_rate - old_null_rate, 4) AS null_rate_delta, old_min IS DISTINCT FROM new_min AS min_changed, "
    f"old_max IS DISTINCT FROM new_max AS max_changed FROM ({_PAIR}) WHERE old_column_type IS NOT NULL AND new_column_type IS NOT NULL"
)
ORACLES["registry_version_match"] = (
    "SELECT 'src_orders' AS source_id, column_name, column_type, null_rate, min_value, max_value, 2 AS schema_version "
    f"FROM ({_profile_sql(f'SELECT * FROM ({ORDERS}) WHERE year(transaction_ts) >= 1998', ORDER_PROFILE)})"
)

ORACLES["snapshot_latest"] = (
    "WITH s AS (SELECT o.o_custkey AS merchant_id, strftime(o.o_orderdate, '%Y') AS processing_date, "
    "'seg_' || lower(c.c_mktsegment) AS source_id FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey), "
    "m AS (SELECT source_id, max(processing_date) AS processing_date FROM s GROUP BY source_id) "
    "SELECT s.source_id, s.processing_date, count(*) AS rows, count(DISTINCT merchant_id) AS merchants FROM s "
    "JOIN m ON s.source_id = m.source_id AND s.processing_date = m.processing_date GROUP BY 1, 2"
)
ORACLES["update_rows"] = (
    "SELECT merchant_id, CASE WHEN merchant_category = 'BUILDING' THEN upper(business_name) ELSE business_name END AS business_name, "
    "merchant_category, CASE WHEN merchant_category = 'BUILDING' THEN 0.0 ELSE account_balance END AS account_balance, nation_id "
    f"FROM ({CUSTOMER})"
)
ORACLES["delete_rows"] = f"SELECT * FROM ({CUSTOMER}) WHERE NOT coalesce(account_balance < 0, false)"
ORACLES["upsert_rows"] = (
    f"WITH t AS (SELECT * FROM ({CUSTOMER}) WHERE account_balance >= 0), "
    f"u AS (SELECT merchant_id, business_name, merchant_category, account_balance + 100 AS account_balance, nation_id "
    f"FROM ({CUSTOMER}) WHERE merchant_category = 'BUILDING') "
    "SELECT * FROM u UNION ALL SELECT * FROM t WHERE merchant_id NOT IN (SELECT merchant_id FROM u)"
)
ORACLES["truncate_reload"] = (
    "SELECT merchant_id, business_name, merchant_category, CASE WHEN merchant_category = 'MACHINERY' THEN 85000.0 "
    f"ELSE account_balance END AS account_balance, nation_id FROM ({CUSTOMER}) "
    "WHERE NOT coalesce(CASE WHEN merchant_category = 'MACHINERY' THEN 85000.0 ELSE account_balance END < 0, false)"
)


# ---------------------------------------------------------------------------
# Queries through files: the ingestion run over orders landed as CSV
# ---------------------------------------------------------------------------
_RUN = "'run-standin-0001'"
_ORD_FAILS = _failed_list_sql(ORDER_RULES_SQL)
_RUN_ROWS = f"SELECT *, {_ORD_FAILS} AS failed_rules FROM ({ORDERS})"
ORACLES["rejected_sink"] = (
    f"SELECT CAST(transaction_id AS VARCHAR) AS o_orderkey, status AS o_orderstatus, failed_rules, {_RUN} AS run_id "
    f"FROM ({_RUN_ROWS}) WHERE failed_rules <> ''"
)
ORACLES["silver_write"] = (
    "SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(card_identifier AS VARCHAR) AS card_identifier, "
    "CAST(round(CAST(original_amount AS DECIMAL(20,4)) * CAST(0.012 AS DECIMAL(20,8)), 2) AS DOUBLE) AS amount_usd, "
    "original_amount, 'INR' AS source_currency, status, transaction_ts, true AS dq_passed, "
    f"{_RUN} AS run_id, TIMESTAMP '2024-01-01 06:00:00' AS ingested_at, '2024-01-01' AS processing_date, "
    f"'src_orders_csv' AS source_id FROM ({_RUN_ROWS}) WHERE failed_rules = ''"
)


def _run_results_sql() -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE NOT ({r[5]})) AS f{i}" for i, r in enumerate(ORDER_RULES_SQL))
    parts = []
    for i, (rid, _, rtype, text, col, _, thr) in enumerate(ORDER_RULES_SQL):
        rate = f"(CASE WHEN total = 0 THEN 1.0 ELSE (total - f{i}) / total END)"
        parts.append(
            f"SELECT {_RUN} AS run_id, 'src_orders_csv' AS source_id, {_q(rid)} AS rule_id, {_q(rtype)} AS rule_type, "
            f"{_q(text)} AS rule_expression, {_q(col)} AS column_name, total AS total_rows, total - f{i} AS passed_rows, "
            f"f{i} AS failed_rows, round({rate}, 4) AS pass_rate, CAST({thr} AS DOUBLE) AS threshold, "
            f"{rate} >= CAST({thr} AS DOUBLE) AS rule_passed, f{i} > 0 AS has_samples FROM c"
        )
    return f"WITH t AS ({ORDERS}), c AS (SELECT count(*) AS total, {counts} FROM t) " + " UNION ALL ".join(parts)


ORACLES["run_results"] = _run_results_sql()
_S = _summary_sql("src_orders_csv", ORDERS, ORDER_RULES_SQL, "transaction_id")
ORACLES["run_summary"] = (
    f"SELECT {_RUN} AS run_id, source_id, '2024-01-01' AS processing_date, total_rows_ingested, total_rows_passed, "
    "total_rows_rejected, overall_pass_rate, rules_checked, rules_passed, rules_failed, ingestion_status, true AS timed "
    f"FROM {_S}"
)
_TLOG = ('{"column_mapping_applied":{"o_orderkey":"transaction_id","o_custkey":"card_identifier",'
         '"o_totalprice":"original_amount","o_orderdate":"transaction_ts","o_orderstatus":"status"},'
         '"dq_rules_applied":["q001","q002","q003","q004","q005"],"dedup_column":"transaction_id"}')
ORACLES["lineage_row"] = (
    f"SELECT {_RUN} AS run_id, source_id, 'card_transactions_silver' AS target_table, total_rows_ingested AS rows_read, "
    "total_rows_passed AS rows_written, total_rows_rejected AS rows_rejected, ingestion_status AS status, "
    f"{_q(_TLOG)} AS transformation_log, 0 AS unaccounted, total_rows_passed AS rows_found, true AS exact_partition, "
    f"'raw/orders/processing_date=2024-01-01/' AS source_folder FROM {_S}"
)
ORACLES["catalog_objects"] = (
    f"SELECT 'card_transactions_silver' AS table_name, 'EXTERNAL' AS table_type, total_rows_passed AS rows FROM {_S} "
    "UNION ALL SELECT 'dq_results', 'EXTERNAL', 5 UNION ALL SELECT 'dq_summary', 'EXTERNAL', 1 "
    "UNION ALL SELECT 'pipeline_lineage', 'EXTERNAL', 1 UNION ALL SELECT 'schema_registry', 'EXTERNAL', 0 "
    "UNION ALL SELECT 'merchant_silver', 'EXTERNAL', 0 UNION ALL SELECT 'atm_silver', 'EXTERNAL', 0 "
    "UNION ALL SELECT 'fraud_flags_silver', 'EXTERNAL', 0 UNION ALL SELECT 'ingestion_config', 'MANAGED', 4"
)
ORACLES["expectations"] = (
    "SELECT * FROM (VALUES ('config_table_managed', 'MANAGED', 'MANAGED', true), "
    "('results_table_external', 'EXTERNAL', 'EXTERNAL', true), ('active_sources', '3', '3', true), ('row_once_after_update', '1', '1', true), "
    "('rule_q003_present', 'true', 'true', true), ('config_problems', '0', '0', true), "
    "('silver_key_unique', 'true', 'true', true), "
    "('lineage_reconciled', '0', '0', true), ('silver_union_rejected_is_raw', '0', '0', true)) "
    "v(\"check\", expected, actual, ok)"
)
ORACLES["csv_scan"] = (
    "SELECT c_custkey AS merchant_id, c_name AS business_name, c_acctbal AS account_balance, "
    "c_mktsegment AS merchant_category, 0 AS cast_failures FROM customer"
)
ORACLES["headerless_scan"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders"
ORACLES["format_scan"] = "SELECT *, 'json' AS file_format FROM part UNION ALL SELECT *, 'orc' AS file_format FROM part"
ORACLES["skip_missing"] = (
    "SELECT '2024-01-01' AS processing_date, 'READ' AS status, count(*) AS rows FROM events "
    "UNION ALL SELECT '2024-01-02', 'SKIPPED', 0"
)
ORACLES["partition_scan"] = (
    "SELECT event_id AS flag_id, event_type AS flag_type, value AS score, ts AS flagged_at, "
    "strftime(ts, '%Y-%m-%d') AS processing_date FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-15'"
)


def _mapping_sql(source_id: str, tbl: str, pairs: list[tuple[str, str]]) -> list[str]:
    return [
        f"SELECT '{source_id}' AS source_id, '{raw}' AS raw_column, '{silver}' AS silver_column, "
        f"count({raw}) AS non_null_rows FROM {tbl}"
        for raw, silver in pairs
    ]


ORACLES["config_mapping_parse"] = " UNION ALL ".join(
    _mapping_sql("src_orders", "orders", [("o_orderkey", "transaction_id"), ("o_custkey", "card_identifier"),
                                          ("o_totalprice", "original_amount"), ("o_orderdate", "transaction_ts"),
                                          ("o_orderstatus", "status")])
    + _mapping_sql("src_customer", "customer", [("c_custkey", "merchant_id"), ("c_name", "business_name"),
                                                ("c_mktsegment", "merchant_category"), ("c_acctbal", "account_balance"),
                                                ("c_nationkey", "nation_id")])
    + _mapping_sql("src_lineitem", "lineitem", [("l_orderkey", "withdrawal_id"), ("l_linenumber", "line_no"),
                                                ("l_partkey", "atm_id"), ("l_suppkey", "location_id"),
                                                ("l_quantity", "amount_sgd"), ("l_shipdate", "withdrawal_ts"),
                                                ("l_returnflag", "dispense_status")])
    + _mapping_sql("src_events", "events", [("event_id", "flag_id"), ("user_id", "reference"), ("value", "score"),
                                            ("event_type", "flag_type"), ("ts", "flagged_at")])
)


# ---------------------------------------------------------------------------
# Queries of ``sluice.plans.standin_runs``
# ---------------------------------------------------------------------------
ORACLES["inr_from_config_table"] = (
    f"SELECT transaction_id, card_identifier, amount_usd, original_amount, source_currency, status, transaction_ts FROM ({ORACLES['silver_write']})"
)
ORACLES["malformed_scan"] = (
    "SELECT o_orderkey, o_orderkey % 7 = 0 AS malformed, CASE WHEN o_orderkey % 7 = 0 THEN concat_ws(',', o_orderkey, o_custkey, "
    "o_orderstatus, o_orderpriority, 'surplus') END AS line FROM orders"
)
ORACLES["malformed_counts"] = (
    "SELECT count(*) AS raw_rows, count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS silver_rows, count(*) FILTER (WHERE o_orderkey % 7 = 0) "
    "AS rejected_rows, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS malformed_rows FROM orders"
)
ORACLES["drifted_file"] = (
    "SELECT 'claimed' AS kind, count(*) AS rows FROM customer UNION ALL SELECT 'unclaimed', count(*) FROM supplier"
)
ORACLES["failed_source_summary"] = (
    "SELECT 'src_no_rate' AS source_id, 'FAILED' AS ingestion_status, CAST(NULL AS BIGINT) AS rows UNION ALL "
    "SELECT 'src_no_files', 'SKIPPED', NULL UNION ALL "
    f"SELECT 'src_orders_csv', CASE WHEN count(*) FILTER (WHERE failed_rules <> '') = 0 THEN 'SUCCESS' ELSE 'PARTIAL' END, count(*) FROM ({_RUN_ROWS})"
)
_HOT_LI = ("SELECT CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_orderkey END AS withdrawal_id, "
           "CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_linenumber END AS line_no, l_shipdate, l_partkey, l_suppkey FROM lineitem")
ORACLES["skew_dedup"] = (
    "SELECT withdrawal_id, line_no, max(l_shipdate) AS withdrawal_ts, count(*) AS copies "
    f"FROM ({_HOT_LI}) GROUP BY withdrawal_id, line_no"
)
ORACLES["skew_fk_join"] = (
    f"SELECT o_orderstatus, count(*) AS rows, count(DISTINCT l_partkey) AS parts, count(o_orderkey) AS matched FROM ({_HOT_LI}) l "
    "FULL JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l.withdrawal_id = o.o_orderkey GROUP BY o_orderstatus"
)
ORACLES["fraud_join"] = (
    "SELECT strftime(e.ts, '%Y-%m-%d') AS processing_date, e.event_id AS flag_id, o.o_orderkey AS transaction_id, o.o_orderstatus AS status "
    "FROM events e JOIN orders o ON e.user_id = o.o_orderkey"
)
ORACLES["config_mutation"] = (
    "SELECT 1 AS state, c_custkey AS source_id, c_acctbal >= 0 AS is_active, 1 AS schema_version, false AS modified FROM customer UNION ALL "
    "SELECT 2, c_custkey, c_acctbal >= 0 AND c_mktsegment <> 'BUILDING', CASE WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 1 END, "
    "(c_mktsegment = 'BUILDING' AND c_acctbal >= 0) OR c_mktsegment = 'MACHINERY' FROM customer UNION ALL "
    "SELECT 3, c_custkey, c_acctbal >= 0 AND c_mktsegment <> 'BUILDING', CASE WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 1 END, "
    "(c_mktsegment = 'BUILDING' AND c_acctbal >= 0) OR c_mktsegment = 'MACHINERY' FROM customer WHERE c_mktsegment <> 'FURNITURE'"
)
ORACLES["seed_listing"] = (
    "SELECT row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS nth, c_custkey AS source_id, c_mktsegment AS source_type, "
    "c_acctbal >= 0 AS is_active FROM customer"
)
ORACLES["config_problems"] = (
    "SELECT p_partkey AS source_id, problem, count(*) AS rows FROM (SELECT p_partkey, unnest(CASE p_partkey % 6 "
    "WHEN 0 THEN ['unknown rule type: odd', 'threshold outside [0, 1]'] WHEN 1 THEN ['expression missing'] WHEN 2 THEN ['values missing'] "
    "WHEN 3 THEN ['threshold outside [0, 1]'] WHEN 4 THEN ['column not mapped: nowhere'] ELSE ['duplicate rule id'] END) AS problem FROM part) "
    "GROUP BY p_partkey, problem"
)
ORACLES["landing_files"] = (
    "SELECT source_dir, processing_date, CAST(sum(n) AS BIGINT) AS total_bytes FROM ("
    "SELECT 'customer' AS source_dir, '2024-01-01' AS processing_date, strlen(CAST(c_custkey AS VARCHAR) || ',' || c_name) + 1 AS n FROM customer UNION ALL "
    "SELECT 'customer', '2024-01-02', strlen(CAST(c_custkey AS VARCHAR) || ',' || c_mktsegment) + 1 FROM customer UNION ALL "
    "SELECT 'supplier', '2024-01-01', strlen(CAST(s_suppkey AS VARCHAR) || ',' || s_name) + 1 FROM supplier) GROUP BY source_dir, processing_date"
)
ORACLES["scanned_files"] = "SELECT DISTINCT c_mktsegment AS segment FROM customer"

# ---------------------------------------------------------------------------
# Queries of ``sluice.plans.standin_feeds``
# ---------------------------------------------------------------------------
_MIXED = (
    "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS c_name, CASE WHEN c_custkey % 3 = 2 THEN c_name END AS c_label, c_mktsegment, "
    "CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal, 2) END AS c_acctbal, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_nationkey AS BIGINT) END AS c_nationkey FROM customer"
)
ORACLES["mixed_schema_scan"] = " UNION ALL ".join(f"SELECT '{f}' AS file_format, * FROM ({_MIXED})" for f in ("parquet", "orc"))
ORACLES["header_versions_scan"] = (
    "SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 3 = 2 THEN CAST(c_nationkey AS BIGINT) END AS c_nationkey FROM customer"
)
ORACLES["pattern_scan"] = " UNION ALL ".join(
    f"SELECT '{f}' AS file_format, CASE WHEN c_custkey % 2 = 1 THEN 'src_-odd-' ELSE 'src_-even-' END AS source_id, c_custkey, c_name FROM customer"
    for f in ("json", "parquet", "orc")
)
ORACLES["landing_counts"] = (
    "SELECT 'events' AS source_dir, strftime(ts, '%Y-%m-%d') AS processing_date, count(DISTINCT event_id % 3) AS file_count FROM events GROUP BY 2"
)
ORACLES["file_accounting"] = (
    f"SELECT left(o_orderpriority, 1) AS sent_as, {_RUN} AS run_id, 'src_orders_csv' AS source_id, count(*) AS rows_read, "
    "count(*) FILTER (WHERE failed_rules = '') AS rows_written, count(*) FILTER (WHERE failed_rules <> '') AS rows_rejected, "
    "count(*) AS rows_expected, true AS reconciled, true AS has_bytes "
    f"FROM ({_RUN_ROWS}) r JOIN orders o ON o.o_orderkey = r.transaction_id GROUP BY 1"
)
ORACLES["profile_merge"] = ORACLES["profile_columns"]
ORACLES["top_values"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, string_agg(DISTINCT {c}, '|' ORDER BY {c}) AS sample_values FROM orders" for c in ("o_orderstatus", "o_orderpriority")
)
_CHANGED = "SELECT 'src_parties' AS source_id, '{name}' AS column_name, '{changes}' AS changes, {low} AS min_changed, {high} AS max_changed FROM (SELECT *, c_custkey % 2 = 0 AS old FROM customer)"


def _ends(col: str) -> dict[str, str]:
    return {
        k: f"min(CAST({col} AS VARCHAR)) FILTER (WHERE old) <> min(CAST({col} AS VARCHAR))".replace("min(", f"{f}(")
        for k, f in (("low", "min"), ("high", "max"))
    }


_NATIONS = "min(CAST(c_nationkey AS VARCHAR)) FILTER (WHERE old) <> min('N' || c_nationkey)"
ORACLES["raw_drift"] = " UNION ALL ".join([
    *[_CHANGED.format(name=c, changes="", **_ends(c)) for c in ("c_custkey", "c_name", "c_mktsegment")],
    _CHANGED.format(name="c_nationkey", changes="retyped", low=_NATIONS, high=_NATIONS.replace("min(", "max(")),
    _CHANGED.format(name="c_acctbal", changes="removed", low="CAST(any_value(NULL) AS BOOLEAN)", high="CAST(any_value(NULL) AS BOOLEAN)"),
    _CHANGED.format(name="channel", changes="added", low="CAST(any_value(NULL) AS BOOLEAN)", high="CAST(any_value(NULL) AS BOOLEAN)"),
])
ORACLES["registry_run"] = (
    "SELECT 'src_bad' AS source_id, 'FAILED' AS ingestion_status, CAST(NULL AS BIGINT) AS total_rows_ingested, CAST(NULL AS VARCHAR) AS column_name, "
    "CAST(NULL AS VARCHAR) AS column_type, CAST(NULL AS BOOLEAN) AS is_nullable, CAST(NULL AS VARCHAR) AS min_value, CAST(NULL AS VARCHAR) AS max_value"
    + "".join(
        f" UNION ALL SELECT 'src_parties', 'SUCCESS', count(*), '{silver}', 'string', false, min(CAST({raw} AS VARCHAR)), max(CAST({raw} AS VARCHAR)) FROM customer"
        for raw, silver in (("c_custkey", "merchant_id"), ("c_name", "business_name"), ("c_mktsegment", "merchant_category"))
    )
)
_DAYS = "SELECT event_id, user_id, value, strftime(ts, '%Y-%m-%d') AS d FROM events"
ORACLES["partition_rewrite"] = (
    f"WITH e AS ({_DAYS}), now AS ("
    "SELECT d, event_id, CASE WHEN d = '2024-01-10' AND user_id % 2 = 0 THEN 1 ELSE 0 END AS up, CASE WHEN d = '2024-01-13' AND event_id % 2 = 0 THEN 1 ELSE 0 END AS ins "
    "FROM e WHERE NOT (d IN ('2024-01-11', '2024-01-12') AND event_id % 3 = 0) UNION ALL "
    "SELECT d, -event_id, 0, 1 FROM e WHERE d = '2024-01-13' AND event_id % 2 <> 0) "
    "SELECT d AS processing_date, count(*) AS rows, CAST(sum(up) AS BIGINT) AS updated, CAST(sum(ins) AS BIGINT) AS upserted, CAST(sum(event_id) AS BIGINT) AS ids, "
    "d NOT IN (SELECT '2024-01-10' FROM e WHERE d = '2024-01-10' AND user_id % 2 = 0 UNION ALL SELECT d FROM e WHERE d IN ('2024-01-11', '2024-01-12') AND event_id % 3 = 0 "
    "UNION ALL SELECT '2024-01-13') AS files_kept FROM now GROUP BY d"
)
