"""Schemas and fixed values.

Everything here is data.  The lists and patterns are fixed values: results
depend on them, so they are written out plainly and in their natural order.
"""

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Schemas
# --------------------------------------------------------------------------

CONTRACTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("contract_number", T.StringType()),
        T.StructField("org_type", T.StringType()),
        T.StructField("ministry", T.StringType()),
        T.StructField("department", T.StringType()),
        T.StructField("org_name", T.StringType()),
        T.StructField("office_zone", T.StringType()),
        T.StructField("buyer_designation", T.StringType()),
        T.StructField("buying_mode", T.StringType()),
        T.StructField("contract_date", T.StringType()),
        T.StructField("total_value", T.DoubleType()),
        T.StructField("contract_status", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("quantity", T.StringType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("scraped_at", T.TimestampType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("from_date", T.DateType()),
        T.StructField("to_date", T.DateType()),
        T.StructField("contracts", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("note", T.StringType()),
    ]
)

# Columns of the clean view, in order.
CLEAN_COLUMNS = [
    "id", "contract_number", "org_type", "ministry", "department", "org_name",
    "office_zone", "buyer_designation", "buying_mode", "contract_date",
    "year", "month", "hour", "contract_type", "total_value", "quantity",
    "unit_price", "contract_status", "product_name", "brand", "model",
    "scraped_at",
]

# --------------------------------------------------------------------------
# Text that counts as missing in a CSV file
# --------------------------------------------------------------------------

MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --------------------------------------------------------------------------
# Date formats, tried in order (day first wins)
# --------------------------------------------------------------------------

# each with the shape a text must have before it is tried
DATE_FORMATS = {
    "d/M/yyyy H:mm": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{3,9} \d{4}$",
    "yyyy-M-d H:mm:ss": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$",
    "d/M/yyyy H:mm:ss": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$",
    "yyyy-M-d H:mm": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$",
    "d-M-yyyy H:mm": r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}$",
    "d-M-yyyy H:mm:ss": r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}:\d{2}$",
    "yyyy-M-d'T'H:mm:ss": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$",
}

# --------------------------------------------------------------------------
# Page extraction
# --------------------------------------------------------------------------

# white space in full, as a class's content: with the no-break space and the like
SPACE = r"\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# the same, one by one
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

NUMBER_PATTERN = rf"(GEMC-\d+|GEM/[^{SPACE}]+)"
STATUS_PATTERN = rf"(?i)Status[{SPACE}]*(?:of[{SPACE}]*the[{SPACE}]*Contract[{SPACE}]*)?[:\-]?[{SPACE}]*(.+)"
TOTAL_PATTERN = rf"(?i)Total[{SPACE}]*[:{SPACE}]*[₹]?[{SPACE}]*([\d,.]+)"

BLOCK_CLASS = "border block"
HEADER_CLASS = "block_header"
ORG_TYPE_CLASS = "ajxtag_buyer_dept_org"
TABLE_CLASS = "table-striped"

# output column -> label text looked for in the bold elements of a block
LABELS = {
    "ministry": "Ministry",
    "department": "Department",
    "org_name": "Organization Name",
    "office_zone": "Office Zone",
    "buyer_designation": "Buyer Designation",
    "buying_mode": "Buying Mode",
    "contract_date": "Contract Date",
}
TOTAL_LABEL = "Total"

NO_RESULT_PHRASES = [
    "no record found", "no records found", "no data found",
    "no contract found", "no contracts found", "no result found",
    "no results found", "record not found", "records not found",
    "no matching record", "data not available", "0 record",
    "no data available", "nothing found", "no record(s) found",
]

CAPTCHA_ERROR_PHRASES = [
    "invalid captcha", "wrong captcha", "captcha incorrect",
    "please enter valid", "captcha error", "verification failed",
    "invalid code", "wrong code", "incorrect captcha",
    "captcha does not match", "captcha mismatch",
]

# --------------------------------------------------------------------------
# Analysis scope
# --------------------------------------------------------------------------

# LIKE patterns, any case, of product names that are not products
JUNK_PRODUCTS = ["%false%", "Title%", "Item %", "FEPL%", "PBB%"]

SUSPECT_PRODUCTS = [
    "HIT Mosquito Repellant Spray",
    "Uniball Blue Roller Ball Pen",
    "Unbranded Type -I (Pocket Shape) Envelope",
]

# Money is reported in crore
CRORE = 10_000_000
