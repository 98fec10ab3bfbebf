"""Text rules as Column expressions (all JVM-side, no Python per row).

Whitespace follows Python's ``str.split()`` / ``strip()`` (Unicode aware)
through the ``(?U)`` flag of Java regular expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the source rules
HASH_ANSWER_RE = r"#### (-?[0-9.,]+)"
INT_TOKEN_RE = r"(?U)\b\d{1,6}\b"
DECIMAL_RE = r"\d+\.\d+"
BOXED_OPEN = "\\boxed{"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python ``str.strip()``: leading/trailing Unicode whitespace removed."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def is_blank(x) -> Column:
    return F.coalesce(py_strip(x) == F.lit(""), F.lit(True))


def words(x) -> Column:
    """Python ``str.split()`` pieces."""
    return F.regexp_extract_all(_c(x), F.lit(r"(?U)\S+"), 0)


def word_count(x) -> Column:
    return F.regexp_count(_c(x), F.lit(r"(?U)\S+"))


def chunks(x) -> Column:
    r"""``\S+\s*`` chunks (spacing kept, leading whitespace dropped)."""
    return F.regexp_extract_all(_c(x), F.lit(r"(?U)\S+\s*"), 0)


def is_int_text(x) -> Column:
    """``int(x.strip())`` succeeds (plain decimal integers; see README on ``1_0``)."""
    s = py_strip(x)
    return F.coalesce(s.rlike(r"^[+-]?[0-9]+$") & s.try_cast("bigint").isNotNull(), F.lit(False))


# ------------------------------------------------------------ answer extraction

def extract_hash_answer(x) -> Column:
    """First ``#### <number>`` with commas removed; NULL when absent."""
    got = F.regexp_extract(_c(x), HASH_ANSWER_RE, 1)
    return F.when(got == F.lit(""), F.lit(None).cast("string")).otherwise(F.regexp_replace(got, ",", ""))


def canonical_int(x) -> Column:
    """``str(int(x))`` when x is an integer string, else x unchanged."""
    v = F.when(_c(x).rlike(r"^[+-]?[0-9]+$"), _c(x).try_cast("bigint"))
    return F.coalesce(v.cast("string"), _c(x))


def last_boxed(x) -> Column:
    r"""Content of the last ``\boxed{...}`` with balanced braces (any depth).

    Finds the last opening marker, then scans the tail with a brace-depth
    fold; NULL when there is no marker or the braces never close.
    """
    s = _c(x)
    rpos = F.locate(BOXED_OPEN[::-1], F.reverse(s))
    start = F.length(s) - rpos - F.lit(len(BOXED_OPEN)) + 2          # 1-based index of the marker
    tail = F.substr(s, start + F.lit(len(BOXED_OPEN)))
    chars = F.split(tail, "")
    init = F.struct(F.lit(1).alias("d"), F.lit(0).alias("i"), F.lit(-1).alias("end"))

    def step(acc, ch):
        d = F.when(acc["end"] >= 0, acc["d"]) \
             .when(ch == "{", acc["d"] + 1).when(ch == "}", acc["d"] - 1).otherwise(acc["d"])
        end = F.when(acc["end"] >= 0, acc["end"]).when((ch == "}") & (acc["d"] == 1), acc["i"]).otherwise(acc["end"])
        return F.struct(d.alias("d"), (acc["i"] + 1).alias("i"), end.alias("end"))

    end = F.aggregate(chars, init, step)["end"]
    return F.when((rpos > 0) & (end >= 0), F.substr(tail, F.lit(1), end))


# ------------------------------------------------------------ number rewrites

def _rewrite_tokens(x, fn) -> Column:
    """Replace every 1-6 digit token by ``fn(token)``: split on the token
    pattern, rewrite the matches, interleave."""
    s = _c(x)
    pieces = F.split(s, INT_TOKEN_RE, -1)
    toks = F.regexp_extract_all(s, F.lit(INT_TOKEN_RE), 0)
    # zip_with pads the (one shorter) token list with NULL; no lambda captures an outer array
    return F.array_join(F.zip_with(pieces, toks, lambda p, t: F.concat(
        F.coalesce(p, F.lit("")), F.coalesce(fn(t), F.lit("")))), "")


def base7_rewrite(x) -> Column:
    return F.when(_c(x).isNotNull(), _rewrite_tokens(x, lambda t: F.conv(t, 10, 7)))


def mod7_rewrite(x) -> Column:
    return F.when(_c(x).isNotNull(), _rewrite_tokens(x, lambda t: (t.cast("bigint") % 7).cast("string")))


def int_token_count(x) -> Column:
    return F.size(F.regexp_extract_all(_c(x), F.lit(INT_TOKEN_RE), 0))


def to_base7_signed(v) -> Column:
    return F.when(v < 0, F.concat(F.lit("-"), F.conv(F.abs(v).cast("string"), 10, 7))) \
            .otherwise(F.conv(v.cast("string"), 10, 7))


def base7_final_answer(x) -> Column:
    """Rewrite only the number after ``####`` to base 7 (sign kept, commas dropped)."""
    s = _c(x)
    num = F.regexp_extract(s, HASH_ANSWER_RE, 1)
    val = F.regexp_replace(num, ",", "").try_cast("bigint")
    # position of the captured number = end of '#### ' marker of the first match
    m = F.regexp_extract(s, r"(#### -?[0-9.,]+)", 1)
    pos = F.position(m, s) + F.lit(5)  # 1-based start of the number
    out = F.concat(F.substr(s, F.lit(1), pos - 1), to_base7_signed(val),
                   F.substr(s, pos + F.length(num)))
    # a marker whose number does not parse leaves the text as it is
    return F.when((num == "") | val.isNull(), s).otherwise(out)


def has_decimal(x) -> Column:
    return F.coalesce(_c(x).rlike(DECIMAL_RE), F.lit(False))


# ------------------------------------------------------------ solution picking

def pick_solution(solution, generations, flags) -> Column:
    """First non-empty of: stripped solution; first flagged non-blank
    generation (pairs stop at the shorter array); first non-blank
    generation; ''."""
    sol = py_strip(F.coalesce(_c(solution), F.lit("")))
    gens = F.coalesce(_c(generations), F.array().cast("array<string>"))
    flg = F.coalesce(_c(flags), F.array().cast("array<boolean>"))
    n = F.least(F.size(gens), F.size(flg))
    paired = F.arrays_zip(F.slice(gens, 1, n), F.slice(flg, 1, n))
    flagged = F.transform(F.filter(paired, lambda p: F.coalesce(p.getField("1"), F.lit(False))
                                   & ~is_blank(p.getField("0"))), lambda p: py_strip(p.getField("0")))
    nonblank = F.transform(F.filter(gens, lambda g: ~is_blank(g)), lambda g: py_strip(g))
    return F.coalesce(F.when(sol != "", sol), F.try_element_at(flagged, F.lit(1)),
                      F.try_element_at(nonblank, F.lit(1)), F.lit(""))


def regex_escape(sep: str) -> str:
    return re.escape(sep)
