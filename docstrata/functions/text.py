"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"

# Redaction patterns, in the order they apply.
REDACTIONS = (
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", "[key]"),
    (r"://[^/\s:@]+:[^/\s@]+@", "://[credentials]@"),
    (r"(?i)\b(bearer|basic)[ \t]+[A-Za-z0-9+/._~=-]{8,}", "$1 [secret]"),
    (r"\b(?:AKIA[A-Z0-9]{16}|gh[a-z]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{12,}|sk-[A-Za-z0-9_-]{16,}|AIza[A-Za-z0-9_-]{30,}|xox[a-z]-[A-Za-z0-9-]{10,}|hf_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", "[secret]"),
    (r"(?i)(password|passwd|secret|token|api_?key)([\"']? *[:=] *[\"']?)[^\s\"']+", "$1$2[secret]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[email]"),
    (r"[0-9]{12,}", "[number]"),
)


def tokens(text: Column) -> Column:
    """Lower-case word tokens of more than one character."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) > 1)


def n_tokens(text: Column) -> Column:
    """How many tokens a text has, without making them."""
    return F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"))


TOKENS_SQL = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 1)"


# Words that lexical search leaves out, and letters with marks beside those without.
STOPWORDS = (
    "a an the is are was were be been being what which who whom whose when where why how "
    "of to in on at by for with from as into and or not do does did this that these those"
).split()
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿœæ", "aaaaaaceeeeiiiinoooooouuuuyyoa"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def stem(t: Column) -> Column:
    """A word without its plural s, if it has more than three letters."""
    return F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.left(t, F.length(t) - 1)).otherwise(t)


def plain(t: Column) -> Column:
    """A lower-case text without marks."""
    return F.when(F.octet_length(t) > F.length(t), F.translate(t, MARKED, PLAIN)).otherwise(t)


def indexed(text: Column) -> Column:
    """Tokens that lexical search indexes, as they stand in the text: no marked letter ends a token, so marks go later."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda t: ~plain(t).isin(STOPWORDS))


def term(token: Column) -> Column:
    """What an indexed token is asked for by: its stem without marks."""
    return stem(plain(token))


def terms(text: Column) -> Column:
    """What lexical search indexes and asks for: stems of tokens without marks and stop words."""
    return F.transform(indexed(text), term)


STEM_SQL = "CASE WHEN length({0}) > 3 AND {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN left({0}, length({0}) - 1) ELSE {0} END"
TERMS_SQL = (
    f"list_transform(list_filter(regexp_extract_all(translate(lower({{0}}), '{MARKED}', '{PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'), "
    f"lambda t: length(t) > 1 AND NOT list_contains({STOP_SQL}, t)), lambda t: {STEM_SQL.format('t')})"
)


def redact(text: Column) -> Column:
    for pattern, put in REDACTIONS:
        text = F.regexp_replace(text, pattern, put)
    return text


def redact_sql(expr: str) -> str:
    for pattern, put in REDACTIONS:
        put = put.replace("$1", r"\1").replace("$2", r"\2")
        expr = f"regexp_replace({expr}, '{pattern.replace(chr(39), chr(39) * 2)}', '{put}', 'g')"
    return expr


def normal_name(name: Column) -> Column:
    """Lower case, & as and, no apostrophes, single spaces, no leading article."""
    x = F.regexp_replace(F.lower(name), "&", " and ")
    x = F.regexp_replace(x, "['’]", "")
    x = F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(x, "^the ", "")


# Corporate suffixes, as they end a normal name.
SUFFIXES = "inc incorporated corp corporation co company ltd limited llc llp lp plc gmbh ag sa bv nv".split()


def core_name(name: Column) -> Column:
    """The normal name without trailing corporate suffixes."""
    return F.regexp_replace(normal_name(name), f"( ({'|'.join(SUFFIXES)}))+$", "")


def column_letters(n: Column) -> Column:
    """Spreadsheet column letters of a number from 1 to 18278."""
    letter = lambda x: F.char(F.lit(65) + x)
    a, b, c = F.floor((n - 1) / 1) % 26, F.floor((n - 27) / 26), F.floor((n - 703) / 676)
    return F.concat(F.when(n > 702, letter(c % 26)).otherwise(""), F.when(n > 26, letter(b % 26)).otherwise(""), letter(a))


def column_number(letters: Column) -> Column:
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)
