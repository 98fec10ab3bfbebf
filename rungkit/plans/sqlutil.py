"""Small helpers for writing DuckDB oracle SQL."""


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def base7(v: str) -> str:
    """Base-7 digits of a non-negative integer < 7**8, via digit arithmetic."""
    terms = " + ".join(f"({v} // {7 ** i} % 7) * {10 ** i}" for i in range(8))
    return f"CAST(({terms}) AS VARCHAR)"


def hash_extract(e: str) -> str:
    return f"nullif(replace(regexp_extract({e}, '#### (-?[0-9.,]+)', 1), ',', ''), '')"


INT_TOKEN = "\\b\\d{1,6}\\b"


def rewrite_tokens(e: str, conv) -> str:
    """Interleave regex split pieces with converted digit tokens."""
    tok = f"regexp_extract_all({e}, '{INT_TOKEN}')[i]"
    return (f"array_to_string(list_transform(regexp_split_to_array({e}, '{INT_TOKEN}'), "
            f"lambda p, i: p || coalesce({conv(tok)}, '')), '')")


def last_boxed(e: str) -> str:
    pat = "\\\\boxed\\{((?:[^{}]|\\{(?:[^{}]|\\{[^{}]*\\})*\\})*)\\}"
    return f"regexp_extract_all({e}, '{pat}', 1)[-1]"
