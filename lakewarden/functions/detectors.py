"""Detectors of sensitive names and values, as boolean Column expressions.

Names are tested against keywords, values against shapes. A detector is a
name and a function ``Column -> Column``; those that are one regular
expression also carry the pattern, so that testing a value against all of
them costs a single pass over the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as fv


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def name_is_pii(name: str, keywords: Iterable[str] = fv.PII_KEYWORDS) -> bool:
    """Whether a column name known at plan time is sensitive."""
    lowered = name.lower()
    return any(word in lowered for word in keywords)


def keyword_pattern(keywords: Iterable[str] = fv.PII_KEYWORDS) -> str:
    # an empty list must match nothing; "(?!)" never matches
    return "|".join(re.escape(word) for word in keywords) or "(?!)"


def is_pii_name(col: Column, keywords: Iterable[str] = fv.PII_KEYWORDS) -> Column:
    """Whether a column *of names* (a catalog snapshot) holds a sensitive one."""
    return F.coalesce(F.lower(col).rlike(keyword_pattern(keywords)), F.lit(False))


@dataclass(frozen=True)
class Detector:
    """A name and a test of values; `pattern` if the test is one regular expression, `vector` if it is a function of Arrow arrays."""

    name: str
    test: Callable[[Column], Column]
    pattern: str | None = None
    vector: Callable[[pa.Array], pa.Array] | None = None


def vector_detector(name: str, function: Callable[[pa.Array], pa.Array]) -> Detector:
    """A detector of one's own that is given many values at a time, as an Arrow array of strings.

    `function` returns booleans, one per value; NULL counts as no hit. It runs
    in Python workers, over columns and over all texts inside nested columns.
    """
    found = F.arrow_udf(lambda values: verdicts(function, values), "boolean")
    return Detector(name, found, vector=function)


def verdicts(function: Callable[[pa.Array], pa.Array], values: pa.Array) -> pa.Array:
    out = function(values)
    if isinstance(out, pa.ChunkedArray):
        out = out.combine_chunks()
    if len(out) != len(values):
        raise ValueError(f"a detector gave {len(out)} verdicts for {len(values)} values")
    return pc.fill_null(out.cast(pa.bool_()), False)


def _matching(name: str, pattern: str) -> Detector:
    return Detector(name, lambda col: col.rlike(f"^(?:{pattern})"), pattern)


def _is_card(col: Column) -> Column:
    digits = F.regexp_replace(col, rf"[{fv.SPACE_CLASS}\-]", "")
    shaped = col.rlike(rf"^(?:{fv.CARD_DIGITS})\z")
    # `when` keeps the digit sum away from values of another shape
    return F.when(shaped, F.call_function("luhn_check", digits)).otherwise(F.lit(False))


DETECTORS: tuple[Detector, ...] = (
    _matching("email", fv.EMAIL + r"\z"),
    _matching("jwt", fv.JWT + r"\z"),
    _matching("iban", fv.IBAN + r"\z"),
    _matching("password_hash", fv.PASSWORD_HASH),
    _matching("ipv4", fv.IPV4 + r"\z"),
    _matching("ipv6", fv.IPV6 + r"\z"),
    _matching("phone", fv.PHONE + r"\z"),
    _matching("hex_secret", fv.HEX_SECRET + r"\z"),
    _matching("base64_secret", fv.BASE64_SECRET + r"\z"),
    Detector("card", _is_card),
)


def detect(name: str, col: Column, detectors: Iterable[Detector] = DETECTORS) -> Column:
    """Apply one registered detector; NULL counts as no hit."""
    for detector in detectors:
        if detector.name == name:
            return F.coalesce(detector.test(col), F.lit(False))
    raise KeyError(f"no detector named {name!r}")


def value_is_pii(col: Column, detectors: Iterable[Detector] = DETECTORS) -> Column:
    """Whether any detector matches, all plain patterns in one regular expression."""
    patterns, tests = [], []
    for detector in detectors:
        if detector.pattern is None:
            tests.append(detector.test(col))
        else:
            patterns.append(detector.pattern)
    if patterns:
        tests.insert(0, col.rlike("^(?:" + "|".join(patterns) + ")"))
    verdict = F.lit(False)
    for test in reversed(tests):
        verdict = F.coalesce(test, F.lit(False)) | verdict
    return verdict


# What a JSON string holds, and what makes of a string a key.
_JSON_INSIDE, _JSON_COLON = r'(?:[^"\\]++|\\.)*+', r"[ \t\r\n]*+:"
_STRICT_JSON = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}
# Well-formed strings and numbers, which stubs replace before the text is
# parsed: so no limit of the parser on their length can matter.
_GOOD_STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
# Where no number can start nothing behind is looked at, which takes far longer.
_GOOD_NUMBER = r"(?=[\-0-9])(?<![0-9A-Za-z.+\-_])-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+\-]?+[0-9]++)?+(?![0-9A-Za-z.+\-_])"
# Brackets the parser may open inside each other. A text that it refuses and that
# has more of them may be a document too deep for it: its brackets are folded
# with a stack, which knows no depth.
_PARSED_DEPTH = 900


def escaped_keyword_pattern(keywords: Iterable[str] = fv.PII_KEYWORDS) -> str:
    """Like `keyword_pattern`, for lower-cased JSON text: each letter may be written as an escape."""
    # lower case of the Kelvin sign is k, of the dotted capital I an i with a dot
    more = {"k": "|212a", "i": "|0130"}

    def letter(c: str) -> str:
        codes = "|".join(sorted({f"{ord(x):04x}" for x in (c, c.upper())}))
        return rf"(?:{re.escape(c)}|\\u(?:{codes}{more.get(c, '')}))"

    return "|".join("".join(map(letter, word.lower())) for word in keywords) or "(?!)"


def _sensitive_key(keywords: Iterable[str]) -> str:
    """Finds a key with a keyword in lower-cased JSON text, in one pass that ends at the first.

    An escaped backslash starts no escape: the text is read string by string, and
    a string letter by letter.
    """
    without = rf'(?:(?!{escaped_keyword_pattern(keywords)})(?:[^"\\]|\\.))*+'
    # what stops the loop is a string that is a key and not without a keyword
    return rf'\A(?:[^"]++|"{_JSON_INSIDE}"(?!{_JSON_COLON})|"{without}")*+"{_JSON_INSIDE}"'


def _parses(json: Column) -> Column:
    return F.from_json(json, "k string", _STRICT_JSON)["k"].isNotNull()


# Characters that no stubbed document holds.
_JSON_FOREIGN = r"[^\[\]{},:0\x22aeflnrstu \t\r\n]"
# Words and strings as one letter each, then, without blanks, keys with their colon as k.
_JSON_WORDS = (("true", "0"), ("false", "0"), ("null", "0"), ('""', "k"))
_JSON_KEYS = (("k:", "s"), ("k", "0"), ("s", "k"))
# Tokens each of which may follow the one before it. Here k is a key with its colon and
# 0 any other string, number or word; "," may be followed by either, which the bracket
# around it decides. Runs of opening and of closing brackets are one step each.
_JSON_PLACED = r"\A(?:(?:\[?+\{k)++(?=[0\[{])|[0\]}][\]}]*+(?=,|\z)|\[(?=[0\[{\]])|\{(?=[k}])|k(?=[0\[{])|,(?=[k0\[{]))*+\z"
# Brackets, and commas before a key (o) or a value (a), which stand for the rest: what
# holds no other bracket, and runs that the fold takes in one step.
_JSON_INNERMOST = r"\[a*+\]|\{o*+\}"
_JSON_RUNS = r"[\[{]++|[\]}]++|a++|o++"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once; what stands behind CASE Spark computes wherever it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _folded(stubs: Column) -> Column:
    """Whether the tokens of a stubbed text make one JSON value.

    What follows what is a matter of neighbours, one pattern and one pass. What is left are
    brackets and commas, whose runs are folded with a stack of open brackets: a
    run of closing ones must be the top of the stack.
    """
    tokens = stubs
    for word, short in _JSON_WORDS:
        tokens = F.replace(tokens, F.lit(word), F.lit(short))
    tokens = F.regexp_replace(tokens, r"[ \t\r\n]++", "")
    for word, short in _JSON_KEYS:
        tokens = F.replace(tokens, F.lit(word), F.lit(short))

    def step(stack: Column, run: Column) -> Column:
        first = F.left(run, F.lit(1))
        wanted = F.when(first == "a", "[").when(first == "o", "{").otherwise(F.replace(F.replace(run, F.lit("]"), F.lit("[")), F.lit("}"), F.lit("{")))
        kept = F.when(first.isin("a", "o"), stack).otherwise(F.call_function("substring", stack, F.length(run) + 1))
        return F.when(first.isin("[", "{"), F.concat(F.reverse(run), stack)).when(F.startswith(stack, wanted), kept).otherwise("x")

    def closed(tokens: Column) -> Column:
        brackets = F.replace(F.replace(tokens, F.lit(",k"), F.lit("o")), F.lit(","), F.lit("a"))
        brackets = F.replace(F.replace(brackets, F.lit("k"), F.lit("")), F.lit("0"), F.lit(""))
        for _ in range(2):  # wide documents shrink to a few brackets
            brackets = F.regexp_replace(brackets, _JSON_INNERMOST, "")
        runs = F.regexp_extract_all(brackets, F.lit(_JSON_RUNS), F.lit(0))
        return F.when(tokens.rlike(_JSON_PLACED), F.aggregate(runs, F.lit(""), step) == "").otherwise(False)

    return F.when(stubs.rlike(_JSON_FOREIGN), False).otherwise(_let(tokens, closed))


def _folded_sql(stubs: str) -> str:
    """`_folded` as SQL text."""
    tokens = stubs
    for word, short in _JSON_WORDS:
        tokens = f"replace({tokens}, '{word}', '{short}')"
    tokens = f"regexp_replace({tokens}, {_quoted(f'[ {chr(92)}t{chr(92)}r{chr(92)}n]++')}, '')"
    for word, short in _JSON_KEYS:
        tokens = f"replace({tokens}, '{word}', '{short}')"
    brackets = "replace(replace(replace(replace(w, ',k', 'o'), ',', 'a'), 'k', ''), '0', '')"
    for _ in range(2):
        brackets = f"regexp_replace({brackets}, {_quoted(_JSON_INNERMOST)}, '')"
    wanted = "CASE left(t, 1) WHEN 'a' THEN '[' WHEN 'o' THEN '{' ELSE replace(replace(t, ']', '['), '}', '{') END"
    kept = "CASE WHEN left(t, 1) IN ('a', 'o') THEN f ELSE substring(f, length(t) + 1) END"
    step = f"CASE WHEN left(t, 1) IN ('[', '{{') THEN concat(reverse(t), f) WHEN startswith(f, {wanted}) THEN {kept} ELSE 'x' END"
    fold = f"aggregate(regexp_extract_all({brackets}, {_quoted(_JSON_RUNS)}, 0), '', (f, t) -> {step}) = ''"
    closed = f"CASE WHEN w RLIKE {_quoted(_JSON_PLACED)} THEN {fold} ELSE false END"
    return f"CASE WHEN {stubs} RLIKE {_quoted(_JSON_FOREIGN)} THEN false ELSE get(transform(array({tokens}), w -> {closed}), 0) END"


def is_json_document(col: Column) -> Column:
    """Whether the text is one JSON object or array and nothing else.

    Strings and numbers are checked by pattern and may have any length, and
    documents any depth: what is too deep for Spark's reader is folded run by
    run of brackets. The reader ignores what follows the first value, but text
    closed by junk cannot pass both inside an object and inside an array.
    """
    starts = col.startswith("{") | col.startswith("[")
    stubs = F.regexp_replace(F.regexp_replace(col, _GOOD_STRING, '""'), _GOOD_NUMBER, "0")

    def verdict(stubs: Column) -> Column:
        whole = _parses(F.concat(F.lit('{"k":'), stubs, F.lit("}"))) & _parses(F.concat(F.lit('{"k":['), stubs, F.lit("]}")))
        deep = F.length(stubs) - F.length(F.replace(F.replace(stubs, F.lit("["), F.lit("")), F.lit("{"), F.lit(""))) > _PARSED_DEPTH
        return F.when(F.coalesce(whole, F.lit(False)), True).when(deep, _folded(stubs)).otherwise(False)

    return F.coalesce(F.when(starts, _let(stubs, verdict)), F.lit(False))


def json_has_pii_key(col: Column, keywords: Iterable[str] = fv.PII_KEYWORDS) -> Column:
    """Whether the text is JSON with a sensitive key at any depth."""
    # Cheap tests first: most cells do not start like JSON, most JSON holds no
    # keyword at all, and only what is left is taken apart. `when` and not "&":
    # Spark computes what "&" repeats beforehand, needed or not.
    starts = col.startswith("{") | col.startswith("[")
    worth_reading = F.when(starts, F.lower(col).rlike(keyword_pattern(keywords)) | col.contains("\\u"))
    has_key = F.when(worth_reading, F.lower(col).rlike(_sensitive_key(keywords)))
    return F.coalesce(F.when(has_key, is_json_document(col)), F.lit(False))


def should_redact(
    name: str,
    col: Column,
    keywords: Iterable[str] = fv.PII_KEYWORDS,
    detectors: Iterable[Detector] = DETECTORS,
) -> Column:
    """Verdict for a string cell: sensitive by name, JSON key or value shape."""
    if name_is_pii(name, keywords):
        return F.lit(True)
    # a custom detector might match the empty string, which is never redacted
    verdict = value_is_pii(col, detectors) | json_has_pii_key(col, keywords)
    return F.when(col != "", verdict).otherwise(F.lit(False))


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def should_redact_sql(column: str, keywords: Iterable[str] = fv.PII_KEYWORDS) -> str:
    """The verdict of `should_redact` by all `DETECTORS`, as SQL text over a named column.

    One call to the JVM where the Column form takes dozens, which counts for
    tables of many columns. Most cells fail the first pattern, which admits
    what any test could accept, and are read only once.
    """
    patterns = "|".join(d.pattern for d in DETECTORS if d.pattern)
    card = rf"{fv.CARD_DIGITS}\z"
    words = _quoted(keyword_pattern(keywords))
    strict = ", ".join(f"'{k}', '{v}'" for k, v in _STRICT_JSON.items())
    stubs = f"""regexp_replace(regexp_replace({column}, {_quoted(_GOOD_STRING)}, '""'), {_quoted(_GOOD_NUMBER)}, '0')"""
    whole = " AND ".join(
        f"from_json(concat('{left}', s, '{right}'), 'k string', map({strict})).k IS NOT NULL"
        for left, right in (('{"k":', "}"), ('{"k":[', "]}"))
    )
    deep = f"length(s) - length(replace(replace(s, '[', ''), '{{', '')) > {_PARSED_DEPTH}"
    json = f"CASE WHEN coalesce({whole}, false) THEN true WHEN {deep} THEN {_folded_sql('s')} ELSE false END"
    # nested CASE: Spark computes what AND repeats beforehand, needed or not
    return f"""CASE WHEN {column} RLIKE {_quoted(rf"^(?:{patterns}|{card}|[{{\[])")} THEN CASE
        WHEN {column} RLIKE {_quoted(f"^(?:{patterns})")} THEN true
        WHEN {column} RLIKE {_quoted(f"^(?:{card})")}
            THEN luhn_check(regexp_replace({column}, {_quoted(rf"[{fv.SPACE_CLASS}" + r"\-]")}, ''))
        WHEN startswith({column}, '{{') OR startswith({column}, '[') THEN CASE
            WHEN lower({column}) RLIKE {words} OR contains({column}, {_quoted(chr(92) + "u")}) THEN CASE
                WHEN lower({column}) RLIKE {_quoted(_sensitive_key(keywords))}
                THEN get(transform(array({stubs}), s -> {json}), 0) ELSE false END
            ELSE false END
        ELSE false END ELSE false END"""
