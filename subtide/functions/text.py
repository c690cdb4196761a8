"""Text functions of the transcript pipeline, as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Texts that only fill a pause.
FILLERS = ["ehm", "euh", "uh", "um", "uhm", "hm", "hmm", "mmm", "ja ehm", "nou ehm"]
# Dutch words that announce a continuation.
CONNECTORS = ["en", "maar", "want", "omdat", "doordat", "terwijl", "dat", "als", "dus", "of", "waarbij", "waardoor", "zodat", "wanneer", "toen", "dan", "ook", "met", "voor", "van", "naar", "in", "op", "bij", "over", "onder", "tussen"]
# Codes, names and FLORES codes of the supported languages.
LANGUAGES = [
    ("nl", "Dutch", "nld_Latn"),
    ("en", "English", "eng_Latn"),
    ("de", "German", "deu_Latn"),
    ("fr", "French", "fra_Latn"),
    ("es", "Spanish", "spa_Latn"),
    ("it", "Italian", "ita_Latn"),
    ("pt", "Portuguese", "por_Latn"),
    ("pl", "Polish", "pol_Latn"),
    ("tr", "Turkish", "tur_Latn"),
    ("ru", "Russian", "rus_Cyrl"),
    ("uk", "Ukrainian", "ukr_Cyrl"),
    ("ar", "Arabic", "arb_Arab"),
    ("hi", "Hindi", "hin_Deva"),
    ("zh", "Chinese", "zho_Hans"),
    ("ja", "Japanese", "jpn_Jpan"),
    ("ko", "Korean", "kor_Hang"),
    ("sv", "Swedish", "swe_Latn"),
    ("da", "Danish", "dan_Latn"),
    ("no", "Norwegian", "nob_Latn"),
    ("fi", "Finnish", "fin_Latn"),
]
# Classes of error messages and their keywords, in the order in which they are tried.
ERROR_CLASSES = [("model_missing", ["model not found", "no such file"]), ("cuda_unavailable", ["cuda", "cudnn", "cublas"]), ("translation_runtime_error", ["ctranslate2", "translation"]), ("asr_runtime_error", ["whisper", "asr", "transcrib"])]
TERMINALS = [".", "!", "?", "…"]
#: For character classes of regular expressions, here and in SQL: white space of all scripts, and the characters of words.
WHITE = r"\t-\r\x1C-\x20\x{85}\p{Z}"
#: A word has a letter, digit or underscore; marks at its ends are not part of it.
MARKS = "'×÷-"
WORD = rf"[{MARKS}]*[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_{MARKS}]*"


def normalize(text: Column) -> Column:
    """Single spaces; none before , . ; : ! ? nor after inverted marks; trimmed."""
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    text = F.regexp_replace(text, r" +([,.;:!?])", "$1")
    return F.trim(F.regexp_replace(text, r"([¿¡]) +", "$1"))


def correct(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered case-insensitive replacements between two normalisations; replacements use $1."""
    text = normalize(text)
    for pattern, replacement in rules:
        text = F.regexp_replace(text, f"(?i){pattern}", replacement)
    return normalize(text)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def sentences(text: Column) -> Column:
    """Pieces that end in a terminal mark with its closing quotes, split at the white space after it."""
    marked = F.regexp_replace(text, f"([.!?…][\"”’)\\]]*)[{WHITE}]+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.rlike(s, F.lit(f"[^{WHITE}]")))


def finish(text: Column) -> Column:
    return F.when(F.right(text, F.lit(1)).isin(TERMINALS), text).otherwise(F.concat(text, F.lit(".")))


def filler_only(text: Column) -> Column:
    """Whether the text without punctuation is one of the fillers."""
    return F.trim(F.regexp_replace(F.lower(normalize(text)), r"[^\p{L}\p{N}]+", " ")).isin(FILLERS)


def should_drop(text: Column, least_words: int = 3) -> Column:
    short = (word_count(text) < least_words) & ~F.right(F.trim(text), F.lit(1)).isin("?", "!")
    return (F.trim(text) == "") | filler_only(text) | short


def ends_with_connector(text: Column, language: Column | None = None) -> Column:
    """Whether the last word announces a continuation in Dutch; with a language, in Dutch texts only."""
    last = F.try_element_at(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.lit(-1))
    waits = F.coalesce(F.regexp_replace(last, f"^[{MARKS}]+|[{MARKS}]+$", "").isin(CONNECTORS), F.lit(False))
    return waits if language is None else waits & F.coalesce(language == "nl", F.lit(False))


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` over the fields of one struct, each of them evaluated once however often the body, or a lambda in it, reads it."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def overlap(left: Column, right: Column, most: int) -> Column:
    """The longest k for which the last k words of ``left`` are the first k of ``right``, in lower case."""

    def longest(x: Column) -> Column:
        end, head = x["end"], x["head"]
        ks = F.sequence(F.lit(0), F.least(F.size(end), F.size(head), F.lit(most)))
        fits = F.filter(ks, lambda k: (k == 0) | (F.slice(end, F.size(end) - k + 1, F.greatest(k, F.lit(1))) == F.slice(head, F.lit(1), F.greatest(k, F.lit(1)))))
        return F.array_max(fits)

    end = F.slice(left, F.greatest(F.size(left) - (most - 1), F.lit(1)), most)
    return _let(longest, end=F.transform(end, F.lower), head=F.transform(F.slice(right, 1, most), F.lower))


def join_overlap(left: Column, right: Column, most: int = 8) -> Column:
    """Fragments joined without the words that both have at the seam."""

    def joined(x: Column) -> Column:
        rest = F.array_join(F.slice(x["b"], overlap(x["a"], x["b"], most) + 1, F.size(x["b"])), " ")
        return F.trim(F.concat_ws(" ", x["left"], rest))

    def seam(x: Column) -> Column:
        left, right = x["left"], x["right"]
        return F.when(F.endswith(left, right), left).otherwise(_let(joined, left=left, a=F.split(left, " "), b=F.split(right, " ")))

    return _let(seam, left=collapsed(left), right=collapsed(right))


def runs(text: Column) -> Column:
    """Word and other runs in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}'’-]+|[^\p{L}\p{N}'’-]+"), F.lit(0))


@F.pandas_udf(StringType())
def _unicode_evaluation_text(texts: pd.Series) -> pd.Series:
    def normal(text: str) -> str:
        text = unicodedata.normalize("NFKC", text).lower().replace("’", "'")
        return " ".join(re.sub(r"[^\w\s']+", " ", text).split())

    return texts.map(normal, na_action="ignore")


def evaluation_text(text: Column) -> Column:
    """NFKC, lower case, straight apostrophes, everything else than words as single spaces; rows with non-ASCII characters in Python."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9_']+", " "))
    return F.coalesce(_unicode_evaluation_text(F.when(text.rlike(r"[^\x00-\x7F]"), text)), plain)


def timestamp(ms: Column, separator: str = ",") -> Column:
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def short_timestamp(ms: Column) -> Column:
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def collapsed(text: Column) -> Column:
    """Words of all scripts between single spaces."""
    return F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))


def cache_key(text: Column, source: Column, target: Column, version: str = "v1") -> Column:
    return F.sha2(F.concat_ws("\u001f", collapsed(text), source, target, F.lit(version)), 256)


def cue_body(source: Column, translation: Column) -> Column:
    return F.concat_ws("\n", F.trim(source), F.when(F.trim(translation) != "", F.trim(translation)))


def error_class(message: Column) -> Column:
    """The first class whose keywords the message has."""
    low = F.lower(message)
    found = F.lit("runtime_error")
    for name, words in reversed(ERROR_CLASSES):
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        found = F.when(hit, name).otherwise(found)
    return found


def without_paths(message: Column) -> Column:
    """The message with single spaces and every path reduced to its last name, ``<path>`` where it has none."""

    def name(token: Column) -> Column:
        parts = F.filter(F.split(token, "/"), lambda c: (c != "") & (c != "."))
        return F.when(F.contains(token, F.lit("/")), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("<path>"))).otherwise(token)

    return F.array_join(F.transform(F.split(collapsed(message), " "), name), " ")


def merge_overlap(left: Column, right: Column, most: int = 10) -> Column:
    """Partials joined at a common seam of words, else the longer one."""

    def merged(x: Column) -> Column:
        a, b, k, left, right = (x[c] for c in ("a", "b", "k", "left", "right"))
        return F.when(k > 0, F.array_join(F.concat(a, F.slice(b, k + 1, F.size(b))), " ")).when(F.length(right) > F.length(left), right).otherwise(left)

    a, b = (F.filter(F.split(x, r"\s+"), lambda w: w != "") for x in (left, right))
    with_seam = lambda x: _let(merged, a=x["a"], b=x["b"], left=x["left"], right=x["right"], k=overlap(x["a"], x["b"], most))
    return _let(with_seam, a=a, b=b, left=left, right=right)


def stabilize(previous: Column, following: Column) -> Column:
    """The partial to show after ``following`` arrives."""

    def shown(x: Column) -> Column:
        p, n, low_p, low_n = (x[c] for c in ("p", "n", "low_p", "low_n"))
        size_p, size_n = F.length(p), F.length(n)
        short = (size_n < size_p * 0.72) & ~F.right(p, F.lit(1)).isin(".", "?", "!")
        whole = _let(lambda y: F.when(F.length(y["merged"]) >= F.greatest(size_p, size_n) - 4, y["merged"]).otherwise(n), merged=merge_overlap(p, n))
        return (
            F.when(n == "", p)
            .when(p == "", n)
            .when(low_n == low_p, p)
            .when(F.startswith(low_n, low_p), n)
            .when(F.contains(low_p, low_n) & (size_n + 10 < size_p), p)
            .when(short, p)
            .otherwise(whole)
        )

    plain = (F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")) for x in (previous, following))
    lowered = lambda x: _let(shown, p=x["p"], n=x["n"], low_p=F.lower(x["p"]), low_n=F.lower(x["n"]))
    return _let(lowered, **dict(zip("pn", plain, strict=True)))
