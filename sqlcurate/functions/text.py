"""Reading SQL and reasoning out of free-text model replies."""

from pyspark.sql import Column, functions as F

# What counts as whitespace when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java character class; needs the (?U) flag.
_WS = r"[\s\x1c-\x1f]"

# The three shapes a reply may carry its SQL in.
FENCED = r"(?is)```sql.*?```"
PREFIXED = rf"(?isU)SQL:{_WS}*(SELECT.*?)(?:\n\n|$)"
BARE = rf"(?isU)(SELECT{_WS}+.+?)(?:;|```|\n\n|$)"


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace, Unicode whitespace included."""
    return F.trim(text, F.lit(WHITESPACE))


def extract_sql(response: Column) -> Column:
    """SQL carried by a reply, or ''.

    A fenced block wins. Only a reply without any fenced block is searched for a ``SQL:`` prefix.
    If that leaves nothing, the first bare SELECT is taken, up to ``;``, a fence, a blank line or
    the end.
    """
    block = F.regexp_extract(response, FENCED, 0)
    fenced = strip(F.substring(block, F.lit(7), F.length(block) - 9))
    prefixed = strip(F.regexp_extract(response, PREFIXED, 1))
    bare = strip(F.regexp_extract(response, BARE, 1))
    bare = F.when(bare.endswith(";"), strip(F.substring(bare, F.lit(1), F.length(bare) - 1))).otherwise(bare)
    return (
        F.when((block != "") & (fenced != ""), fenced)
        .when((block == "") & (prefixed != ""), prefixed)
        .otherwise(bare)
    )


def extract_reasoning(response: Column) -> Column:
    """Text ahead of the SQL: before ``sql:``, else before the first fence, else the whole reply."""
    label = F.instr(F.lower(response), "sql:")
    fence = F.instr(response, "```")
    text = (
        F.when(label > 1, strip(F.substring(response, F.lit(1), label - 1)))
        .when(fence > 0, strip(F.substring(response, F.lit(1), fence - 1)))
        .otherwise(response)
    )
    return F.when(
        F.lower(text).startswith("reasoning:"), strip(F.substring(text, F.lit(11), F.length(text)))
    ).otherwise(text)


def normalize_sql(sql: Column) -> Column:
    """Lower-case, whitespace runs as one blank, stripped."""
    return strip(F.regexp_replace(F.lower(sql), rf"(?U){_WS}+", " "))


def exact_match(left: Column, right: Column) -> Column:
    return normalize_sql(left) == normalize_sql(right)


def is_blank(sql: Column) -> Column:
    return F.coalesce(strip(sql) == "", F.lit(True))


def error_class(message: Column) -> Column:
    """Coarse class of an execution error; the first class that fits wins.

    The upper-case alternatives are the conditions Spark reports for the same faults.
    """
    def mentions(pattern: str) -> Column:
        return message.rlike("(?i)" + pattern)

    return (
        F.when(mentions("timeout|timed out|interrupt"), "TIMEOUT")
        .when(mentions("syntax|near"), "SYNTAX")
        .when(mentions("no such|TABLE_OR_VIEW_NOT_FOUND|UNRESOLVED_COLUMN"), "SCHEMA")
        .otherwise("ERROR")
    )


def error_preview(message: Column, width: int = 100) -> Column:
    return F.when(F.coalesce(message, F.lit("")) == "", "Unknown").otherwise(F.substring(message, 1, width))
