"""DuckDB SQL for the correctness oracle.

The stand-in registry tables are spelled out as CTEs over the driver's views
(the same mapping as ``sources.testdata``); each query's SQL follows them.
"""

from __future__ import annotations

APPLICANT = """applicant AS (
  SELECT
    concat('FN-', CAST(o.o_orderkey AS VARCHAR)) AS file_number,
    o.o_orderkey + 1 AS serial,
    c.c_name AS name,
    CASE WHEN o.o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
    CAST(o.o_orderdate AS DATE) - 10 AS birth_date,
    c.c_mktsegment AS place,
    concat('N', CAST(c.c_nationkey AS VARCHAR)) AS state_code,
    lower(o.o_orderpriority) AS name_of_father,
    concat('m ', lower(c.c_mktsegment)) AS name_of_mother,
    concat('unit ', CAST(o.o_custkey AS VARCHAR)) AS address_line_1,
    CASE WHEN o.o_orderkey % 10 = 3 THEN NULL ELSE o.o_orderpriority END AS address_line_2,
    c.c_mktsegment AS address_line_3,
    CAST(o.o_orderdate AS DATE) AS registration_date,
    CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 5 = 0 THEN ' printed '
         WHEN o.o_orderstatus = 'F' THEN 'PRINTED'
         WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 4 = 0 THEN NULL
         WHEN o.o_orderstatus = 'P' THEN 'in process'
         ELSE 'IN PROCESS' END AS status,
    CASE WHEN o.o_orderstatus = 'F' THEN CAST(o.o_orderdate AS DATE) + 30 END AS date_issued,
    CASE WHEN o.o_orderkey % 50 = 0 THEN NULL
         WHEN o.o_orderkey % 51 = 0 THEN 'MHA-missing'
         ELSE concat('MHA-', CAST(o.o_custkey AS VARCHAR)) END AS mha_file_number,
    CASE WHEN o.o_orderkey % 7 = 0 THEN NULL
         WHEN o.o_orderkey % 6 = 5 THEN 'IB-missing'
         ELSE concat('IB-', CAST(o.o_custkey // 15 AS VARCHAR)) END AS ib_staff_authority_id
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
)"""

MINISTRY = """ministryofhomeaffairs AS (
  SELECT concat('MHA-', CAST(c_custkey AS VARCHAR)) AS mha_file_number,
         DATE '1995-01-01' + CAST(c_custkey % 365 AS INTEGER) AS mha_date
  FROM customer
)"""

AUTHORITY = """ib_authority AS (
  SELECT concat('IB-', CAST(s_suppkey AS VARCHAR)) AS ib_staff_authority_id,
         s_name AS ib_staff_authority_name,
         concat('Desk ', CAST(s_nationkey AS VARCHAR)) AS ib_staff_authority_designation
  FROM supplier
)"""

STATE = """state AS (
  SELECT concat('N', CAST(n_nationkey AS VARCHAR)) AS state_code, n_name AS state_name
  FROM nation
)"""

REGISTRY = ",\n".join([APPLICANT, MINISTRY, AUTHORITY, STATE])


def with_registry(body: str, *extra_ctes: str) -> str:
    ctes = [REGISTRY, *extra_ctes]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def sheet(dirty: bool, year: int) -> str:
    """The processing sheet (see ``testdata.processing_sheet``)."""
    d = "TRUE" if dirty else "FALSE"
    name = "sheet_dirty" if dirty else "sheet_clean"
    return f"""{name} AS (
  SELECT
    CASE WHEN {d} AND o.o_orderkey % 101 = 1 THEN concat('FN-', CAST(o.o_orderkey - 1 AS VARCHAR))
         ELSE concat('FN-', CAST(o.o_orderkey AS VARCHAR)) END AS File_Number,
    CASE WHEN o.o_orderkey % 103 = 2 THEN concat(CAST(o.o_orderkey AS VARCHAR), '/', '{year - 1}')
         ELSE concat(CAST(o.o_orderkey + 1 AS VARCHAR), '/', '{year}') END AS Serial,
    upper(c.c_name) AS Name,
    CASE WHEN o.o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS Sex,
    concat(strftime(CAST(o.o_orderdate AS DATE) - 10, '%d/%m/%Y'), ', ', upper(c.c_mktsegment)) AS When_and_where_born,
    upper(o.o_orderpriority) AS Name_of_the_Father,
    CASE WHEN {d} AND o.o_orderkey % 97 = 5 THEN NULL
         WHEN {d} AND o.o_orderkey % 89 = 7 THEN '   '
         ELSE concat('m ', lower(c.c_mktsegment)) END AS Name_of_the_Mother,
    concat('UNIT ', CAST(o.o_custkey AS VARCHAR)) AS Description_and_residence_of_informant,
    CASE WHEN o.o_orderkey % 53 = 0 THEN 'not a date'
         WHEN o.o_orderkey % 2 = 0 THEN strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d')
         ELSE strftime(CAST(o.o_orderdate AS DATE), '%d/%m/%Y') END AS Registration_date,
    concat('MHA-', CAST(o.o_custkey AS VARCHAR)) AS MHA_File_And_date,
    concat('OFFICER ', CAST(o.o_orderkey % 12 AS VARCHAR)) AS Signing_Authority_Name,
    concat('OFFICER ', CAST(o.o_orderkey % 12 AS VARCHAR), ', DESK') AS Signing_Authority_Name_Designation,
    CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 5 = 0 THEN concat(' printed', chr(9))
         WHEN o.o_orderstatus = 'F' THEN 'PRINTED'
         WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 4 = 0 THEN NULL
         WHEN o.o_orderstatus = 'P' THEN 'In Process'
         ELSE 'IN PROCESS' END AS STATUS,
    CASE WHEN o.o_orderstatus = 'F' THEN strftime(CAST(o.o_orderdate AS DATE) + 30, '%d/%m/%Y') END AS Date_Issued,
    o.o_orderkey + 2 AS _row
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
)"""


def intake(state_codes, authority_texts, na_tokens: bool = False) -> str:
    """The flat intake sheet (see ``testdata.intake``); order columns o1..o6."""
    codes = ", ".join(f"'{c}'" for c in state_codes)
    auths = ", ".join("'" + t.replace("'", "''") + "'" for t in authority_texts)
    missing = "'N/A'" if na_tokens else "NULL"
    name = "intake_na" if na_tokens else "intake"
    return f"""{name} AS (
  SELECT
    concat('FN-', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)) AS File_Number,
    concat('Person ', CAST(l_partkey AS VARCHAR)) AS Name,
    CASE WHEN l_partkey % 89 = 0 THEN 'U' WHEN l_partkey % 2 = 0 THEN 'M' ELSE 'F' END AS Sex,
    CAST(l_shipdate AS DATE) - 20 AS Birth_Date,
    concat('Town ', CAST(l_suppkey % 50 AS VARCHAR)) AS Place,
    CASE WHEN l_suppkey % 97 = 0 THEN 'XX' ELSE [{codes}][l_suppkey % {len(state_codes)} + 1] END AS State,
    concat('F ', CAST(l_partkey AS VARCHAR)) AS Name_Of_Father,
    concat('M ', CAST(l_suppkey AS VARCHAR)) AS Name_Of_Mother,
    concat('unit ', CAST(l_linenumber AS VARCHAR)) AS Address_line_1,
    CASE WHEN l_orderkey % 10 = 3 THEN {missing} ELSE l_linestatus END AS Address_line_2,
    concat('street ', CAST(l_suppkey AS VARCHAR)) AS Address_line_3,
    CAST(l_shipdate AS DATE) AS Registration_Date,
    CASE WHEN l_orderkey % 3 = 0 THEN concat('MHA-N', CAST(l_orderkey AS VARCHAR))
         ELSE concat('MHA-', CAST(l_orderkey // 10 AS VARCHAR)) END AS MHA_FILE_NUMBER,
    DATE '1995-01-01' + CAST(l_partkey % 3 AS INTEGER) AS MHA_DATE,
    [{auths}, 'UNKNOWN PERSON, CLERK'][l_partkey % {len(authority_texts) + 1} + 1] AS Signing_Authority,
    l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_suppkey AS o4, l_extendedprice AS o5, l_shipdate AS o6
  FROM lineitem
)"""


INTAKE_COLS = ("File_Number, Name, Sex, Birth_Date, Place, State, Name_Of_Father, Name_Of_Mother, "
               "Address_line_1, Address_line_2, Address_line_3, Registration_Date, MHA_FILE_NUMBER, "
               "MHA_DATE, Signing_Authority")
INTAKE_ORDER = "o1, o2, o3, o4, o5, o6"

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)
