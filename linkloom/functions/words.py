"""Word columns: tokens, fillers, folded forms, index keys, inflected equality, language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .urls import path_of

# white space as Unicode sees it; Java's \s alone knows ASCII only
_OTHER_SPACE = r"\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = rf"[\s{_OTHER_SPACE}]+"
# the runs of it that are not one plain space: most are, and stay as they are
_ODD_SPACE = rf" {SPACE}|[\t\n\x0B\f\r{_OTHER_SPACE}][\s{_OTHER_SPACE}]*"
WORD = f"[{fixed.WORD_CLASS}]+"


def escape_class(chars: str) -> str:
    return "".join("\\" + c if c in "[]()-^\\.\"'" else c for c in chars)


PUNCT = f"[{escape_class(fixed.PUNCT)}]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a lambda evaluates what it captures per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(text: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, _ODD_SPACE, " "))


def tokens(text: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def strip_punct(text: Column) -> Column:
    return F.regexp_replace(text, f"^{PUNCT}|{PUNCT}$", "")


def words(text: Column) -> Column:
    """Lower-case alphanumeric runs in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def first_word(token: Column) -> Column:
    """First alphanumeric run of one token, '' when it has none."""
    return F.regexp_extract(F.lower(token), WORD, 0)


def fold(word: Column) -> Column:
    """Word without diacritics (exact on the letters of `words`)."""
    return F.translate(word, fixed.FOLD_FROM, fixed.FOLD_TO)


def one_of(word: Column, values: list[str]) -> Column:
    """Membership in a word list, as one literal (a hundred literals per use make plans slow to build)."""
    return F.find_in_set(word, F.lit(",".join(values))) > 0


def by_lang(lang: Column, table: dict[str, list[str]], test) -> Column:
    """test(values of the row's language); False for a language without an entry."""
    out = F.lit(False)
    for code, values in table.items():
        out = F.when(lang == code, test(values)).otherwise(out)
    return out


def is_filler(word: Column, lang: Column, stopwords: dict[str, list[str]] = fixed.STOPWORDS) -> Column:
    return by_lang(lang, stopwords, lambda s: one_of(word, s)) | word.rlike("^[0-9]+$")


def content_words(text: Column, lang: Column, stopwords: dict[str, list[str]] = fixed.STOPWORDS) -> Column:
    """Distinct folded words of a text that carry meaning, in order of appearance."""
    kept = F.filter(words(text), lambda w: (F.length(w) > 2) & ~is_filler(w, lang, stopwords))
    return F.array_distinct(F.transform(kept, fold))


def word_key(folded: Column) -> Column:
    """Equal for any two words `same_word` accepts."""
    return F.left(folded, F.lit(4))


def text_keys(text: Column, lang: Column) -> Column:
    return F.array_distinct(F.transform(content_words(text, lang), word_key))


def same_word(a: Column, b: Column) -> Column:
    """Same word in another inflected form: a long common stem, endings of at most three letters."""
    longest = F.greatest(F.length(a), F.length(b))
    stem = F.greatest(F.lit(4), longest - 3)
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= stem) & (F.left(a, stem) == F.left(b, stem)))


def same_form(a: Column, b: Column) -> Column:
    """`same_word` for lambdas over lists: the keys are compared first, most words differ there."""
    return (word_key(a) == word_key(b)) & same_word(a, b)


def close_form(a: Column, b: Column) -> Column:
    """Closer than `same_word`: five shared letters (or the whole shorter word), or a short ending."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    shared = F.least(F.lit(fixed.STRONG_PREFIX), shorter)
    tail = F.greatest(longer - fixed.SHORT_ENDING, F.lit(0))
    return (F.left(a, shared) == F.left(b, shared)) | ((shorter >= tail) & (F.left(a, tail) == F.left(b, tail)))


def name_key(text: Column, lang: Column) -> Column:
    """The same for two names built from the same content words."""
    return F.array_join(F.array_sort(content_words(text, lang)), " ")


def detect_lang(lang: Column, url: Column, text: Column, markers: dict[str, list[str]] = fixed.LANG_MARKERS) -> Column:
    """Declared language if supported, else the first path segment, else the one whose function words
    are frequent enough in the text; '' when none applies."""
    codes = list(markers)
    prefix = F.lower(F.regexp_extract(path_of(url), "^/*([^/]*)", 1))

    def has(listed: list[str]):
        return lambda w: one_of(w, listed)

    def guessed(sample: Column) -> Column:
        hits = F.array(*[F.size(F.filter(sample, has(m))) for m in markers.values()])
        return bind(F.struct(hits.alias("hits"), F.greatest(F.lit(3.0), F.size(sample) * 0.03).alias("floor")), chosen)

    def chosen(x: Column) -> Column:
        guess = F.lit("")
        for i, code in reversed(list(enumerate(codes))):
            n = x["hits"][i]
            guess = F.when((n == F.array_max(x["hits"])) & (n >= x["floor"]), code).otherwise(guess)
        return guess

    # the words are found once, and only where they decide
    guess = bind(words(text), guessed)
    return F.when(lang.isin(codes), lang).when(prefix.isin(codes), prefix).otherwise(guess)


def edge_word(token: Column, word: Column, lang: Column) -> Column:
    """May a link text start or end here: a topic word, not a filler, not a Polish infinitive."""
    bare = strip_punct(token)
    shouted = (bare == F.upper(bare)) & (F.lower(bare) != F.upper(bare))
    return ((word != "") & ~is_filler(word, lang) & ~((lang == "pl") & word.endswith("ć"))
            & ((F.length(word) >= 3) | word.rlike("[0-9]") | shouted))
