import pytest
from pyspark.sql import functions as F

from sqlcurate.functions import text

REPLIES = [
    ("The two tables meet on the port.\n```sql\nSELECT p.name FROM ports p JOIN boats b ON b.port = p.no\n```\nDone.",
     "SELECT p.name FROM ports p JOIN boats b ON b.port = p.no"),
    ("```SqL\nselect max(length) from boats\n```", "select max(length) from boats"),
    ("Reasoning: the longest one.\nSQL: SELECT name FROM boats ORDER BY length DESC LIMIT 1\n\nThat should do.", "SELECT name FROM boats ORDER BY length DESC LIMIT 1"),
    ("I would ask SELECT no FROM boats WHERE length IS NULL; and look.", "SELECT no FROM boats WHERE length IS NULL"),
    ("", ""),
    ("No idea, sorry.", ""),
    # A prefix keeps its semicolon, a bare query loses it.
    ("SQL: SELECT 1;", "SELECT 1;"),
    ("sql:\n select a\nfrom t\n\nselect 2", "select a\nfrom t"),
    # An empty fence goes on to the bare form, never to the prefix.
    ("```sql\n```\nSQL: SELECT 1;", "SELECT 1"),
    ("```sql ```", ""),
    # A fence may hold anything, also when it is not a query.
    ("```sql\nDELETE FROM t\n```", "DELETE FROM t"),
    ("first SELECT a FROM t\n\nthen SELECT b", "SELECT a FROM t"),
    ("SELECT a ``` SELECT b", "SELECT a"),
    ("two ```sql\nSELECT 1\n``` and ```sql\nSELECT 2\n```", "SELECT 1"),
    ("SELECT ;", "SELECT"),
    ("SELECTION of\nSELECT\tx", "SELECT\tx"),
    (" SELECT x ", "SELECT x"),
]


def test_extract_sql(column):
    assert column(text.extract_sql, [reply for reply, _ in REPLIES]) == [sql for _, sql in REPLIES]


def test_extract_sql_from_a_long_reply(column):
    filler = "lorem ipsum\n" * 300_000
    assert column(text.extract_sql, [filler + "```sql\nSELECT 1\n```" + filler, filler + "SELECT 2; " + filler]) == [
        "SELECT 1", "SELECT 2",
    ]


REASONING = [
    ("One row per port. SQL: SELECT 1", "One row per port."),
    ("Reasoning: only boats with a length.\nSQL: SELECT 1", "only boats with a length."),
    ("SQL: SELECT 1", "SQL: SELECT 1"),
    ("Look.\n```sql\nSELECT 1\n```", "Look."),
    ("```\nSELECT 1\n```", ""),
    ("  plain text kept as it is ", "  plain text kept as it is "),
    ("REASONING:   because ", "because"),
    ("", ""),
]


def test_extract_reasoning(column):
    assert column(text.extract_reasoning, [reply for reply, _ in REASONING]) == [out for _, out in REASONING]


@pytest.mark.parametrize("sql, expected", [
    ("Select Name From Boats", "select name from boats"),
    ("select\tname \r\n from   boats", "select name from boats"),
    ("\n select 'A  b' ", "select 'a b'"),
    ("A\x1c　B ", "a b"),
])
def test_normalize_sql(column, sql, expected):
    assert column(text.normalize_sql, [sql]) == [expected]


def test_exact_match(column):
    assert column(lambda v: text.exact_match(v, F.lit("select  A\nfrom t")), ["SELECT a FROM t ", "SELECT b FROM t"]) == [True, False]


def test_strip_knows_unicode_whitespace(column):
    spaces = [chr(code) for code in range(0x10000) if chr(code).isspace()]
    assert column(text.strip, [f"{space}a b{space}" for space in spaces]) == ["a b"] * len(spaces)


def test_blank(column):
    assert column(text.is_blank, ["", " \n\t", None, "x"]) == [True, True, True, False]


def test_error_class(column):
    messages = [
        "Query timed out after 4s", "interrupted", 'near "FROM": syntax error', "near timeout", "no such table: t", "disk full",
        "[TABLE_OR_VIEW_NOT_FOUND] The table or view `t` cannot be found", "[PARSE_SYNTAX_ERROR] Syntax error at or near 'x'",
    ]
    assert column(text.error_class, messages) == [
        "TIMEOUT", "TIMEOUT", "SYNTAX", "TIMEOUT", "SCHEMA", "ERROR", "SCHEMA", "SYNTAX",
    ]


def test_error_preview(column):
    assert column(text.error_preview, ["x" * 150, "", None]) == ["x" * 100, "Unknown", "Unknown"]
