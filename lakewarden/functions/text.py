"""Sensitive values inside running text and log lines.

Most shapes are looked for word by word. Phones and spaced card numbers cross
word limits and are looked for as spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .detectors import detect

_SPACE = f"[{fv.SPACE_CLASS}]"
_NO_SPACE = f"[^{fv.SPACE_CLASS}]"
_WORD_SHAPES = (
    fv.EMAIL,
    fv.JWT,
    fv.IBAN_CORE,
    rf"{fv.PASSWORD_HASH}{_NO_SPACE}*?",
    fv.IPV4,
    r"(?=[0-9a-fA-F:]{4,}[0-9a-fA-F])[0-9a-fA-F]*:[0-9a-fA-F:]*",
    fv.HEX_SECRET,
    fv.BASE64_SECRET,
)
_CARD_WORD = r"-*[0-9](?:-*[0-9]){12,18}-*"


def _word(core: str, group: str = "(") -> str:
    """The rest of a word whose inside, without outer punctuation, is `core`.

    Groups: leading punctuation, core, trailing punctuation. A word keeps no
    trailing punctuation, so its core must not end in any.
    """
    return (
        rf"{group}[{fv.WORD_LEAD}]*+){group}{core})(?<![{fv.WORD_TRAIL}])"
        rf"{group}[{fv.WORD_TRAIL}]*+)(?!{_NO_SPACE})"
    )


def _words(core: str) -> str:
    """All words of a text with that inside, found in one pass.

    Each match starts where the last one ended, runs over the words that do
    not fit and ends with one that does, so no character is tried twice. Plain
    words are passed quickly: letters only and too short for a secret, or
    short and without any of the characters the other shapes need.
    Groups: all that is passed over, then those of `_word`.
    """
    plain = rf"[a-zA-Z\x{{c0}}-\x{{ff}}]{{1,31}}+[{fv.WORD_TRAIL}]*+(?:[ \n]|{_SPACE})"
    dull = r"[^\x00-\x{20}0-9@$:{]{1,24}+[ \n]"
    other = rf"(?!{_word(core, '(?:')}){_NO_SPACE}++"
    return rf"\G((?:{plain}|{dull}|{_SPACE}++|{other})*+){_word(core)}"


_ANY_WORD = _words("|".join((*_WORD_SHAPES, _CARD_WORD)))
_PATTERN_WORD = _words("|".join(_WORD_SHAPES))
_CARD_TOKEN = rf"(?<!{_NO_SPACE}){_word(_CARD_WORD)}"
_CARD_HINT = r"[0-9](?:[ \-]*+[0-9]){12}"

WORD_DETECTORS: tuple[str, ...] = (
    "email", "jwt", "iban", "password_hash", "ipv4", "ipv6",
    "hex_secret", "base64_secret", "card",
)


def candidate_words(text: Column) -> Column:
    """Words shaped like a sensitive value, without outer punctuation.

    One pass over the text; only what is found leaves it.
    """
    return F.regexp_extract_all(text, F.lit(_ANY_WORD), F.lit(3))


def phone_spans(text: Column) -> Column:
    spans = F.regexp_extract_all(text, F.lit(fv.PHONE_SPAN), F.lit(0))
    return F.when(text.contains("+"), spans).otherwise(F.array().cast("array<string>"))


def card_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fv.CARD_SPAN), F.lit(0))


def _replace_spans(text: Column, pattern: str, replace: Callable[[Column], Column]) -> Column:
    """Rewrite every match of `pattern` by a Column function of the match."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(
        F.zip_with(
            pieces,
            matches,
            lambda piece, found: F.concat(piece, F.coalesce(replace(found), F.lit(""))),
        ),
        "",
    )


def _when_detected(name: str) -> Callable[[Column], Column]:
    return lambda s: F.when(detect(name, s), F.lit(fv.REDACTED)).otherwise(s)


def _card_word(word: Column) -> Column:
    is_card = detect("card", F.regexp_replace(word, r"[^0-9\-]", ""))
    return F.when(is_card, F.regexp_replace(word, _CARD_WORD, fv.REDACTED)).otherwise(word)


# Cheap tests guard the rewriting: few texts hold a "+" or that many digits.


def _redact_phones(text: Column) -> Column:
    rewritten = _replace_spans(text, fv.PHONE_SPAN, _when_detected("phone"))
    return F.when(text.contains("+"), rewritten).otherwise(text)


def _redact_cards(text: Column) -> Column:
    spaced = _replace_spans(text, fv.CARD_SPAN, _when_detected("card"))
    rewritten = _replace_spans(spaced, _CARD_TOKEN, _card_word)
    return F.when(text.rlike(_CARD_HINT), rewritten).otherwise(text)


def _redact_words(text: Column) -> Column:
    return F.regexp_replace(text, _PATTERN_WORD, f"$1$2{fv.REDACTED}$4")


# Steps of a span redaction, to be applied one after another as separate
# columns: nested in one expression each step would repeat the one before.
REDACTION_STEPS = (_redact_phones, _redact_cards, _redact_words)


def mask_credentials(text: Column) -> Column:
    """Replace passwords in connection strings by ``****``.

    A leading URL is masked from the user name to the last ``@`` of its
    authority. A value that is nothing but that URL is then done; in other
    text the usual spellings are masked one after another.
    """
    space = fv.SPACE_CLASS
    # A URL with a password, a database URL inside text, and the
    # key=value spellings, plain and quoted.
    part = rf"[^/?#\\<>\^|\[\]{space}]"
    url = (
        rf"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^:@/?#\\<>\^|\[\]{space}]*:)"
        rf"({part}+)(@{part}+)"
    )
    chain = (
        rf"(?i)(password=)([^{space}&;\"']++)()",
        rf"(?i)(password[{space}]*+=[{space}]*+')([^']++)(')",
        rf"(?i)(password[{space}]*+=[{space}]*+\")([^\"]++)(\")",
    )
    replacement = "$1****$3"
    first = F.regexp_replace(text, url, replacement)
    masked = F.when(first.contains("postgres"), _mask_database_urls(first)).otherwise(first)
    for pattern in chain:
        masked = F.regexp_replace(masked, pattern, replacement)
    only_url = text.rlike(url) & ~text.rlike(f"[{space}]")
    return F.when(only_url, first).otherwise(masked)


def _mask_database_urls(text: Column) -> Column:
    """Mask passwords of database URLs inside text, each character read a bounded number of times.

    A password ends at the next ``@``, which a host must follow. So the text is
    cut at its ``@`` signs, and within a piece that a host follows all behind
    the first user part is masked. A user name may hold an ``@`` itself: then
    the piece before ends inside it.
    """
    scheme = r"postgres(?:ql)?://"
    user_part = rf"(?s)^((?:(?!{scheme}[^:]).)*+{scheme}[^:]++:).++$"
    rest_of_user = r"(?s)^([^:]*+:).++$"
    open_user = rf"{scheme}[^:]*+\z"

    def within(pieces: Column) -> Column:
        def piece(part: Column, i: Column) -> Column:
            host = F.get(pieces, i + 1).rlike(f"^[^/{fv.SPACE_CLASS}]")
            began = (i > 0) & F.get(pieces, i - 1).rlike(open_user)
            continued = F.when(began, F.regexp_replace(part, rest_of_user, "$1****"))
            return F.when(host, F.coalesce(continued, F.regexp_replace(part, user_part, "$1****"))).otherwise(part)

        return F.transform(pieces, piece)

    # the pieces are bound once; named in the lambda directly they would be cut anew for each piece
    return F.array_join(F.get(F.transform(F.array(F.split(text, "@", -1)), within), F.lit(0)), "@")
