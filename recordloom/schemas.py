"""Schemas, field lists and the fixed values the record semantics depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the documented behaviour; do not reorder).
# ---------------------------------------------------------------------------

# Status values of the registry.
STATUS_PRINTED = "PRINTED"
STATUS_IN_PROCESS = "IN PROCESS"
ALLOWED_STATUS = ("IN PROCESS", "PRINTED")
ALLOWED_SEX = ("M", "F")

# Sheet columns that may be empty (check 4 skips them).
OPTIONAL_SHEET_COLUMNS = ("STATUS", "Date_Printed", "Date_Issued")

# Text a spreadsheet reader treats as a missing cell.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Default dimension rows loaded with every intake: state code -> state name.
STATE_MASTER = (
    ("ACT", "Australian Capital Territory"),
    ("NSW", "New South Wales"),
    ("NT", "Northern Territory"),
    ("QLD", "Queensland"),
    ("SA", "South Australia"),
    ("TAS", "Tasmania"),
    ("VIC", "Victoria"),
    ("WA", "Western Australia"),
)

# Default signing authorities: "NAME,DESIGNATION" text as found on intake -> authority id.
AUTHORITY_MAP = (
    ("MONSHI G KATARI,VICE CONSUL", "MEA/IB/405/003"),
    ("GIRIRAJ SINGH KULSHEKHARA,VICE CONSUL AND ADMIN", "MEA/IB/405/004"),
    ("SHEESHACHELLAM SWAMINI, HOC AND CONSUL", "MEA/IB/405/002"),
    ("VEENA SAI RAJJAN KUMAR,CONSUL GENERAL", "MEA/IB/405/001"),
)

# Column length limits of the table schema.
LENGTH_LIMITS = (
    ("file_number", 30),
    ("state_code", 3),
    ("mha_file_number", 50),
    ("ib_staff_authority_id", 50),
)

# NOT NULL columns of the applicant table.
APPLICANT_NOT_NULL = (
    "file_number", "name", "birth_date", "place", "state_code",
    "name_of_father", "name_of_mother", "registration_date", "status",
)

# Output record handed to the template (order is the contract).
RECORD_FIELDS = (
    "File_Number", "Serial", "Name", "Sex", "When_and_where_born",
    "Name_of_the_Father", "Name_of_the_Mother",
    "Description_and_residence_of_informant", "Registration_date",
    "MHA_File_And_date", "Signing_Authority_Name",
    "Signing_Authority_Name_Designation",
)

# Date formats accepted from sheets, tried in this order.
SHEET_DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy")
OUTPUT_DATE_FORMAT = "dd/MM/yyyy"
RUN_ID_FORMAT = "ddMMyyyy_HHmmss"

# Partition column that splits a stored registry table into printed history
# and rows still to print (the stored form of an index on upper(status)).
STATUS_CLASS = "status_class"
STATUS_CLASS_ACTIVE = "ACTIVE"

# Separators used when documents are assembled.
PAGE_BREAK = "\f"

# Default sizes.
DEFAULT_BATCH_SIZE = 250
DEFAULT_POLL_SECONDS = 30

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------

STATE_SCHEMA = T.StructType([
    T.StructField("state_code", T.StringType(), False),
    T.StructField("state_name", T.StringType(), False),
])

MHA_SCHEMA = T.StructType([
    T.StructField("mha_file_number", T.StringType(), False),
    T.StructField("mha_date", T.DateType(), False),
])

IB_SCHEMA = T.StructType([
    T.StructField("ib_staff_authority_id", T.StringType(), False),
    T.StructField("ib_staff_authority_name", T.StringType(), False),
    T.StructField("ib_staff_authority_designation", T.StringType(), False),
])

APPLICANT_SCHEMA = T.StructType([
    T.StructField("file_number", T.StringType(), False),
    T.StructField("serial", T.LongType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("sex", T.StringType(), True),
    T.StructField("birth_date", T.DateType(), True),
    T.StructField("place", T.StringType(), True),
    T.StructField("state_code", T.StringType(), True),
    T.StructField("name_of_father", T.StringType(), True),
    T.StructField("name_of_mother", T.StringType(), True),
    T.StructField("address_line_1", T.StringType(), True),
    T.StructField("address_line_2", T.StringType(), True),
    T.StructField("address_line_3", T.StringType(), True),
    T.StructField("registration_date", T.DateType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("date_issued", T.DateType(), True),
    T.StructField("mha_file_number", T.StringType(), True),
    T.StructField("ib_staff_authority_id", T.StringType(), True),
])

# Flat intake sheet consumed by the loader.
INTAKE_COLUMNS = (
    "File_Number", "Name", "Sex", "Birth_Date", "Place", "State",
    "Name_Of_Father", "Name_Of_Mother", "Address_line_1", "Address_line_2",
    "Address_line_3", "Registration_Date", "MHA_FILE_NUMBER", "MHA_DATE",
    "Signing_Authority",
)

LEDGER_SCHEMA = T.StructType([
    T.StructField("file_number", T.StringType(), False),
    T.StructField("serial", T.LongType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("date_issued", T.DateType(), True),
    T.StructField("run_id", T.StringType(), False),
])


def schema_of(table: str) -> T.StructType:
    return {
        "state": STATE_SCHEMA,
        "ministryofhomeaffairs": MHA_SCHEMA,
        "ib_authority": IB_SCHEMA,
        "applicant": APPLICANT_SCHEMA,
        "ledger": LEDGER_SCHEMA,
    }[table]

# Columns we add to a sheet ourselves; no other name is exempt from the checks.
SHEET_HELPERS = ("_file", "_row", "_input_order")

# Required columns of the dimension tables.
DIMENSION_NOT_NULL = {
    "state": ("state_code", "state_name"),
    "ministryofhomeaffairs": ("mha_file_number", "mha_date"),
    "ib_authority": ("ib_staff_authority_id", "ib_staff_authority_name", "ib_staff_authority_designation"),
}
