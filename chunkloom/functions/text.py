"""Text functions by built-in expressions: no text leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)[^\s\x1c-\x1f]+"
MARK, ESCAPE = "\u0001", "\u0002"  # MARK stands before a word that begins a paragraph
_PARAGRAPH = r"(?U)\s*\n[\t\f\x0B ]*\n\s*"
STOP_WORDS = tuple("a an and are at be by do does for how in is it of on or the to what when where which with".split())


def nfc(text: Column) -> Column:
    """Unicode NFC by the ICU library that Spark brings along; a text of ASCII letters only is left alone."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[^\x00-\x7f]"), composed).otherwise(text)


def unify_breaks(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def words(text: Column) -> Column:
    """Maximal runs of anything but Unicode white space."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def marked_words(text: Column) -> Column:
    """Words in their order; one that follows a blank line, unless it is the first, begins with MARK.

    A text's own MARK and ESCAPE are escaped, and come back in join_words.
    """
    safe = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(MARK), F.lit(ESCAPE + "a"))
    clean = F.regexp_replace(unify_breaks(safe), r"(?U)^\s+|\s+$", "")
    marked = words(F.regexp_replace(clean, _PARAGRAPH, " " + MARK))
    # most texts have no blank line and skip all that
    return F.when(safe.rlike("[\n\r][\t\f\x0B ]*[\n\r]"), marked).otherwise(words(safe))


def join_words(marked: Column) -> Column:
    """Canonical text: words by one space, paragraphs by a blank line; no mark before the first word."""
    plain = F.regexp_replace(F.replace(F.array_join(marked, " "), F.lit(" " + MARK), F.lit("\n\n")), "^" + MARK, "")
    return F.replace(F.replace(plain, F.lit(ESCAPE + "a"), F.lit(MARK)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))


def normalized(text: Column) -> Column:
    return join_words(marked_words(nfc(text)))


def is_sentence_end(word: Column) -> Column:
    return word.rlike(r"""[.!?](?:["')\]}]+)?$""")


def _folds() -> tuple[str, str, dict[str, str]]:
    """What full case folding does to characters that lower case leaves: one to one, and one to several."""
    left = {c: c.casefold() for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) if c.lower() == c != c.casefold()}
    one = {c: f for c, f in left.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in left.items() if len(f) > 1}


_ONE, _TO, _MANY = _folds()


def _near(least: int = 16) -> str:
    """The other characters, in long ranges, as a class: lower case and ß are all that is to be done to a text of these only."""
    def far(c: str) -> bool:
        return any(x in _ONE or x in _MANY and x != "ß" for x in c + c.lower()) or c == "Σ"  # a last one becomes ς

    ends = [-1, *(i for i in (*range(0x80, 0xD800), *range(0xE000, 0x20000)) if far(chr(i))), 0x110000]
    return "".join(rf"\x{{{a + 1:x}}}-\x{{{b - 1:x}}}" for a, b in zip(ends, ends[1:]) if b - a > least)


_NEAR = _near()


def folded(text: Column) -> Column:
    """Full Unicode case folding by built-in functions; only a text that has one of the rare letters that become several goes through all of them."""
    low = F.translate(F.lower(text), _ONE, _TO)
    many = low
    for c, f in _MANY.items():
        many = F.replace(many, F.lit(c), F.lit(f))
    usual = F.replace(low, F.lit("ß"), F.lit("ss"))
    rare = "[" + "".join(c for c in _MANY if c != "ß") + "]"
    return F.when(~text.rlike(f"[^{_NEAR}]"), F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))).when(low.rlike(rare), many).otherwise(usual)


def features(text: Column) -> Column:
    """Letters-and-digits tokens, case folded."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Adjacent tokens joined by the unit separator."""
    return F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat(F.element_at(tokens, i), F.lit("\u001f"), F.element_at(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))


def lexical_terms(text: Column) -> Column:
    return F.filter(features(text), lambda w: ~w.isin(*STOP_WORDS))


def word_set(text: Column) -> Column:
    """The different case-folded words."""
    return F.array_distinct(words(folded(text)))


def jaccard(x: Column, y: Column) -> Column:
    """Of two arrays without repeated values; two empty ones are equal."""
    common = F.size(F.array_intersect(x, y))
    return F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(common / (F.size(x) + F.size(y) - common))


def lexical_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of case-folded words; two empty texts are equal."""
    return jaccard(word_set(a), word_set(b))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def holds_evidence(text: Column, passages: Column) -> Column:
    """Whether any passage occurs in text, both case folded with white space collapsed."""
    plain = squeezed(folded(text))
    return F.exists(passages, lambda p: F.contains(plain, squeezed(folded(p))))


def preview(text: Column, most: int = 240) -> Column:
    plain = squeezed(text)
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most - 3), F.lit("..."))).otherwise(plain)
