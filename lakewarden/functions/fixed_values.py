"""Word lists, patterns and limits that decide results.

Everything a result depends on literally is kept here, as text.
"""

from __future__ import annotations

# Fixed value: what stands in the place of a protected value.
REDACTED = "<redacted>"

# A column or JSON key is sensitive when its lowercased name
# contains one of these words.
PII_KEYWORDS: tuple[str, ...] = (
    "first_name", "last_name", "firstname", "lastname",
    "given_name", "family_name", "full_name", "maiden_name",
    "birth_date", "birthdate", "date_of_birth", "dob",
    "birth_place", "birthplace",
    "nationality",
    "email",
    "phone",
    "address",
    "postal_code", "postcode",
    "ssn",
    "passport",
    "national_id",
    "tax_id",
    "account_number",
    "iban",
    "card_number",
    "password", "passwd", "pwd",
    "secret",
    "token",
    "api_key", "key",
    "hash",
    "salt",
    "vault",
    "ip_address", "ip_addr",
    "payload",
    "s3_url",
)

# Fixed value: the characters ECMAScript counts as white space, as the inside
# of a regular-expression class. Java's and RE2's own \s are smaller.
SPACE_CLASS = (
    r"\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
# Fixed value: the same characters as plain text, for trimming.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Value shapes. Each must cover the whole value, but for the
# password hash, which only has to start it.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{1,}"
JWT = r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]*"
PASSWORD_HASH = (
    r"(?:\$2[abxy]\$\d+\$|\$argon2[id]+\$|\$scrypt\$|scrypt:\d+:\d+:\d+\$"
    r"|\{S?SHA\d*\}[A-Za-z0-9+/=]{20,})"
)
IPV4 = r"(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2})?"
IPV6 = r"(?=.{5})[0-9a-fA-F]*:[0-9a-fA-F:]*"
HEX_SECRET = r"[0-9a-f]{32,}"
BASE64_SECRET = r"[A-Za-z0-9\-_+/]{40,}={0,2}"
# Shapes read after leaving out white space (IBAN), white space
# and "-().", (phone) or white space and "-" (card); the ignored characters are
# written into the pattern, so the value is read once.
IBAN_CORE = r"[A-Z]{2}\d{2}[A-Z0-9]{4,30}"
IBAN = (
    rf"[{SPACE_CLASS}]*+(?:[A-Z][{SPACE_CLASS}]*+){{2}}(?:\d[{SPACE_CLASS}]*+){{2}}"
    rf"(?:[A-Z0-9][{SPACE_CLASS}]*+){{4,30}}"
)
PHONE = (
    rf"[{SPACE_CLASS}\-().]*+\+[{SPACE_CLASS}\-().]*+[1-9][{SPACE_CLASS}\-().]*+"
    rf"(?:\d[{SPACE_CLASS}\-().]*+){{7,14}}"
)
CARD_DIGITS = rf"[{SPACE_CLASS}\-]*+(?:\d[{SPACE_CLASS}\-]*+){{13,19}}"

# Punctuation cut from the ends of a word of running text, and
# the spans that may cross words.
WORD_LEAD = r"(\[<\"'`"
WORD_TRAIL = r")\]>\"'`.,;:!?"
# 8 to 15 digits with at most two separators between them; the longest run that
# does not end inside a number, so a number that follows costs no hit.
PHONE_SPAN = r"\+[1-9](?:[ \-().]{0,2}[0-9]){7,14}(?![0-9])"
# The lookbehind stands after the first digit, where it is rarely reached.
CARD_SPAN = (
    r"[0-9](?<![0-9][0-9])[0-9]{3} (?:[0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{6} [0-9]{4,5})(?![0-9])"
)

# Statement guard.
ALLOWED_PREFIXES: tuple[str, ...] = (
    "select", "show", "explain", "vacuum", "analyze", "create extension",
    "with ", "deallocate", "declare", "fetch", "close",
)
FORBIDDEN_WORDS: tuple[str, ...] = (
    "insert", "update", "delete", "drop", "alter", "truncate", "grant", "revoke",
)

# Limits of the diagnostics.
SHARE_LIMIT = 0.05
TOP_N = 10
MIN_BLOAT_BYTES = 104_857_600
MAX_RARE_SCANS = 50
MAX_CONNECTIONS = 500
MAX_IDLE_IN_TRANSACTION = 100
MAX_XID = 2_146_483_648
MIN_XID_LEFT = 10_000_000
SEQUENCE_LIMIT = 0.9
HIT_RATE_LIMIT = 0.95
INTEGER_MAX = 2_147_483_647
SMALLINT_MAX = 32_767
BIGINT_MAX = 9_223_372_036_854_775_807
# Width of a column without statistics, page header, and the
# tuple constants of the index-size estimate.
DEFAULT_WIDTH = 2048
PAGE_HEADER = 24
BLOCK_SIZE = 8192
MAX_ALIGN = 8

# How definitions, defaults and statements are read.
INDEX_COLUMNS = r"(?s)^[^(]*[(](.*)[)]\z"
INDEX_PREDICATE = r"(?s)^(.*?)\) WHERE \("
INDEX_METHOD = r"(?s).* USING ([^ ]*) [(].*"
SEQUENCE_DEFAULT = r"nextval\(\(?'([^']+)'"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENT = r"--[^\n]*"
