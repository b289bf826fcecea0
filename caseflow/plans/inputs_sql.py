"""The mapping of inputs.py in SQL, as common table expressions for the oracles."""

from __future__ import annotations

import re

from caseflow.functions import vocab
from caseflow.plans.inputs import DISTRICTS, EVENT_TYPES, PROOF_DATES


def words(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def in_list(values: list[str]) -> str:
    return "(" + words(values)[1:-1] + ")"


def pick(values: list[str], n: str) -> str:
    return f"({words(values)})[(({n}) % {len(values)} + 1)::INT]"


def address_of(key: str) -> str:
    return f"{pick(vocab.COUNTIES, key)} || {pick(DISTRICTS, key)} || '測試路' || ({key} % 300) || '號'"


def national_id_of(key: str) -> str:
    return (
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', ({key} % 26 + 1)::INT, 1) || ({key} % 2 + 1) || "
        f"printf('%08d', {key} % 100000000)"
    )


def national_id_sql_valid(code: str) -> str:
    letters = "".join(vocab.ID_LETTER_VALUES)
    value = f"({list(vocab.ID_LETTER_VALUES.values())})[strpos('{letters}', substr({code}, 1, 1))]"
    digits = " + ".join(f"substr({code}, {i}, 1)::INT * {10 - i}" for i in range(2, 10))
    return f"({value} // 10 + {value} % 10 * 9 + {digits} + substr({code}, 10, 1)::INT) % 10 = 0"


VIEWS = {
    "cases": f"""
      SELECT o_orderkey AS id,
        year(o_orderdate)::VARCHAR || '-' || printf('%03d', o_orderkey) AS case_number,
        o_orderdate::DATE AS received_date,
        'client-' || o_custkey AS client_name,
        'Customer#' || printf('%09d', o_custkey) AS company_name,
        printf('%08d', o_custkey % 100000000) AS tax_id,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '行號' ELSE '公司' END AS entity_type,
        CASE WHEN o_orderstatus = 'O' THEN '' ELSE printf('115%06d', o_orderkey % 1000000) END AS precheck_no,
        CASE WHEN o_orderstatus = 'F' THEN '新設立' ELSE '變更登記' END AS case_type,
        CASE WHEN o_orderpriority = '5-LOW' THEN '  ' ELSE o_orderpriority END AS case_content,
        {pick(vocab.STATUSES, 'o_orderkey')} AS status,
        CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS status_detail,
        floor(o_totalprice / 10)::BIGINT AS service_fee,
        o_orderkey % 50 * 100 AS government_fee,
        CASE WHEN o_orderstatus = 'P' THEN 0 ELSE floor(o_totalprice)::BIGINT END AS paid_amount,
        CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE + 40 END AS payment_date,
        NULL::DATE AS closed_date,
        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'note ' || o_orderkey END AS notes,
        CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'rep-' || o_custkey END AS representative,
        CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE {address_of('o_custkey')} END AS address,
        o_orderkey % 7 * 100000 AS capital,
        CASE WHEN o_orderkey % 2 = 0 THEN '臺北市政府' ELSE '' END AS authority,
        CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE printf('%09d', o_orderkey) END AS official_receipt_no,
        CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE {pick(['審查中', '補正', '核准發文中'], 'o_orderkey')} END AS official_status,
        CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE + 3 END AS submitted_date,
        {pick(vocab.TAX_OFFICE_VALUES, 'o_custkey')} AS tax_office_required,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE {pick(['A05', 'H01', 'B01', 'D01', 'E01'], 'o_orderkey')} END AS tax_bureau_code,
        CASE WHEN o_orderkey % 7 = 0 THEN printf('%010d', o_orderkey) ELSE '' END AS tax_receipt_no,
        CASE WHEN o_orderkey % 7 = 0 THEN '審核中' ELSE '' END AS tax_official_status,
        {pick(vocab.BILLING_STATUSES, 'o_orderkey')} AS billing_status,
        CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE + 20 END AS billing_date,
        CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate::DATE + 30 END AS next_follow_up_date,
        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '17' END AS reg_unit_code,
        o_orderdate AS updated_at
      FROM orders""",
    "items": """
      SELECT l_orderkey AS case_id, 'item-' || l_partkey AS item_name,
        floor(l_extendedprice * (1 - l_discount))::BIGINT AS amount, l_returnflag AS notes, l_linenumber AS sort_order
      FROM lineitem""",
    "history": f"""
      SELECT event_id AS id, user_id AS case_id, ts::DATE AS event_date,
        CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TYPES.items())} END AS event_type,
        {pick(vocab.STATUSES, 'event_id')} AS status, props AS detail
      FROM events""",
    "candidates": f"""
      SELECT l_orderkey AS case_id,
        CASE WHEN l_linenumber = 1 THEN printf('%09d', l_orderkey) WHEN l_partkey % 3 = 0 THEN (['A-', 'B', 'Z-9-'])[l_suppkey % 3 + 1] || l_partkey
          ELSE printf('%09d', l_partkey) END AS receipt_no,
        (year(l_shipdate) - 1911)::VARCHAR || '/' || strftime(l_shipdate, '%m/%d') AS received_date,
        {pick(['審查中', '補正通知', '核准發文中', '可自領', '已郵寄'], 'l_orderkey * 10 + l_linenumber')} AS official_status,
        '臺北市政府' AS authority, l_partkey AS part, l_suppkey AS supp
      FROM lineitem""",
    "offices": """
      SELECT s_suppkey AS id, s_name AS name,
        CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE printf('%08d', s_suppkey) END AS unified_number,
        CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'person-' || s_suppkey END AS responsible_person,
        CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'A1' || printf('%08d', s_suppkey) END AS responsible_person_id,
        'road ' || s_nationkey AS address,
        CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '02-0000' END AS phone,
        'M1' AS media_code,
        CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'L1' END AS license_number,
        s_acctbal > 5000 AS active, s_suppkey % 10 = 3 AS is_default
      FROM supplier""",
    "page_text": """
      SELECT conv_id AS file_id, turn + 1 AS page, text FROM conversations""",
    "preparation": f"""
      SELECT o_orderkey AS case_id,
        CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE printf('Prepared#%09d', o_custkey) END AS company,
        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'prep-' || o_custkey END AS representative,
        {national_id_of('o_custkey')} AS national_id,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE printf('114%06d', o_orderkey % 1000000) END AS precheck,
        CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'contact ' || o_orderkey END AS contact_address,
        CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE {address_of('o_orderkey')} END AS registration_address,
        CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE printf('09%08d', o_orderkey % 100000000) END AS contact_phone,
        CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE (o_orderkey % 900) || ',000' END AS capital_text
      FROM orders WHERE o_orderstatus <> 'P'""",
    "approvals": f"""
      SELECT o_orderkey AS case_id, agency, {pick(vocab.APPROVAL_STATUSES, 'o_custkey')} AS status,
        CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE + 10 END AS approval_date,
        CASE WHEN o_orderkey % 4 <> 0 THEN 'No-' || o_orderkey END AS document_number
      FROM orders JOIN (VALUES ('city_government'), ('national_tax')) a(agency)
        ON o_orderstatus = 'F' OR (o_orderstatus = 'O' AND agency = 'national_tax')""",
    "cards": """
      SELECT o_orderkey AS case_id, o_orderkey % 2 = 0 AS original_received, o_orderkey % 5 = 0 AS customer_copy_sent,
        o_orderdate AS updated_at FROM orders WHERE o_orderkey % 3 = 0""",
    "proofs": f"""
      SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 10 END AS office_id,
        CASE WHEN o_orderkey % 2 <> 0 THEN o_orderkey % 7 END AS page4_office_id,
        CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE printf('%09d', o_orderkey) END AS tax_registration_number,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE {national_id_of('o_orderkey')} END AS responsible_person_id,
        CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '02-1111' END AS business_phone,
        CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '北區' END AS tax_bureau_name,
        CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE '竹北分局' END AS branch_name,
        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'mail-' || o_orderkey END AS email,
        CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'S-' || o_orderkey END AS sales_document_number,
        CASE WHEN o_orderkey % 5 <> 0 THEN '1,' || (o_orderkey % 4 + 1) END AS selected_pages,
        CASE WHEN o_orderkey % 6 <> 0 THEN '{{"page1":' || o_orderkey || '}}' END AS checkboxes,
        {", ".join(f"CASE WHEN o_orderkey % {n} = 0 THEN '' ELSE (o_orderkey % {n})::VARCHAR END AS {part}" for n, part in PROOF_DATES)}
      FROM orders WHERE o_orderstatus = 'O'""",
    "catalogue": """
      SELECT printf('E%06d', p_partkey % 1000000) AS code, upper(replace(p_name, ' ', '')) AS name,
        p_type AS category, lower(p_type) AS category_name
      FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 1000000 ORDER BY p_partkey) = 1""",
    "regional_offices": """
      SELECT n_regionkey::VARCHAR AS bureau_code, n_name AS county, 'office ' || (s_suppkey % 20) AS office_name,
        'zone ' || (s_suppkey % 10) || ';' AS district,
        CASE WHEN s_suppkey % 10 = 3 THEN CASE WHEN s_suppkey % 20 = 3 THEN 'east' ELSE 'west' END ELSE '' END AS boundary,
        min(s_suppkey % 500) AS ordinal
      FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""",
    "regional_addresses": """
      SELECT c_custkey AS id, n_name || ' zone ' || (c_custkey % 13) || '; road ' || c_custkey || ' ' ||
        CASE c_custkey % 4 WHEN 0 THEN 'east side' WHEN 1 THEN 'west side' ELSE '' END AS address
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "bureau_county": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{code}', '{full}', '{short}', '{county}')"
        for i, (code, full, short, county) in enumerate(
            (code, full, short, county) for code, full, short, counties in vocab.BUREAUS for county in counties
        )
    ) + ") v(priority, bureau_code, bureau_name, short_name, county)",
    "branches": f"""
      SELECT b.bureau_code, b.county, {pick(DISTRICTS, 's_suppkey')} AS district, 'branch ' || (s_suppkey % 20) AS office_name, s_suppkey % 500 AS ordinal
      FROM supplier JOIN bureau_county b ON b.county = {pick(vocab.COUNTIES, 's_suppkey')}""",
    "due": """
      SELECT c.id, CASE WHEN b.case_id IS NOT NULL THEN b.total ELSE c.service_fee + c.government_fee END AS total_due
      FROM cases c LEFT JOIN (SELECT case_id, sum(amount)::BIGINT AS total FROM items GROUP BY case_id) b ON b.case_id = c.id""",
    "last_events": """
      SELECT case_id, max(event_date) AS last_event_date,
        max(CASE WHEN event_type = '進度' THEN event_date END) AS last_progress_date
      FROM history GROUP BY case_id""",
    "enriched": """
      SELECT c.*, year(c.received_date)::INT AS year, d.total_due, greatest(d.total_due - c.paid_amount, 0) AS outstanding,
        CASE WHEN c.billing_status = '未請款' THEN '未請款' WHEN c.billing_status = '已收款' THEN '已收款'
          WHEN d.total_due > 0 AND c.paid_amount >= d.total_due THEN '已收款'
          WHEN c.paid_amount > 0 THEN '部分收款' ELSE '待收款' END AS payment_status,
        e.last_event_date, e.last_progress_date
      FROM cases c JOIN due d ON d.id = c.id LEFT JOIN last_events e ON e.case_id = c.id""",
}


def with_inputs(sql: str) -> str:
    """Put the views that ``sql`` names, and the views those name, in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    views = ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed)
    body = sql.strip()
    if not views:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
