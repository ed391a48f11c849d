"""Text functions as ``Column -> Column``; none leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Contractions in the order in which they are replaced.
CONTRACTIONS = (
    ("don't", "do not"), ("doesn't", "does not"), ("didn't", "did not"), ("isn't", "is not"), ("aren't", "are not"),
    ("wasn't", "was not"), ("weren't", "were not"), ("can't", "cannot"), ("couldn't", "could not"), ("won't", "will not"),
    ("wouldn't", "would not"), ("shouldn't", "should not"), ("hasn't", "has not"), ("haven't", "have not"), ("hadn't", "had not"),
    ("mustn't", "must not"), ("needn't", "need not"),
)
# Words and word beginnings that negate a sentence.
NEGATIONS = (
    "not", "no", "never", "neither", "nor", "without", "cannot", "ن", "نه", "نیست", "نیستم", "نیستی", "نیستیم", "نیستید", "نیستند",
    "نبود", "نبودم", "نبودی", "نبودیم", "نبودید", "نبودند", "هرگز", "هیچ", "هیچوقت", "هیچگاه", "بدون", "نرو", "نیا", "نگو", "نبین", "نبر", "نخور",
)
NEGATION_STARTS = ("نمی", "ندار", "نخواه", "نکرد", "نکن", "نباید", "نتوان")
# Stop words of phrase mining and of name candidates.
NAME_STOPWORDS = (
    "a", "an", "and", "as", "at", "but", "chapter", "epilogue", "for", "he", "her", "his", "i", "if", "in", "it", "its", "my", "no", "not", "of", "on",
    "or", "our", "prologue", "she", "so", "that", "the", "their", "then", "there", "they", "this", "to", "we", "what", "when", "where", "who", "why", "you", "your",
)
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "doctor", "sir", "lady", "lord", "professor")

ARABIC_LETTERS, PERSIAN_LETTERS = "يىك", "ییک"
ARABIC_DIGITS, PERSIAN_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹"
TATWEEL, ZWNJ = "ـ", "‌"
ARABIC_BLOCKS = r"؀-ۿݐ-ݿࢠ-ࣿ"
SPACING_PUNCTUATION = r"،؛؟!?,.:;\)\]\}»…"
EMPTY = "array<string>"
# Letters whose upper case is several letters, and their single upper-case forms.
SEVERAL_LETTERS = "ß" + "".join(map(chr, (*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8), 0x1FB3, 0x1FC3, 0x1FF3)))
SINGLE_LETTERS = "ẞ" + "".join(map(chr, (*range(0x1F88, 0x1F90), *range(0x1F98, 0x1FA0), *range(0x1FA8, 0x1FB0), 0x1FBC, 0x1FCC, 0x1FFC)))


def upper_letters(text: Column) -> Column:
    """Upper case letter by letter: a letter whose upper case is several letters (ß) takes its single form, or stays."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, SEVERAL_LETTERS, SINGLE_LETTERS))
    # texts without such a letter are mapped at once
    return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def tokens(normalized: Column) -> Column:
    """Words of a normalised text; the empty text has none."""
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def expand_contractions(text: Column) -> Column:
    """Lower case, straight apostrophes, negative contractions spelt out."""
    plain = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    spelt = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), CONTRACTIONS, plain)
    return F.when(F.contains(plain, F.lit("n't")), spelt).otherwise(plain)


def normalize(text: Column) -> Column:
    """Lower-case words of letters, marks and digits joined by one space; Persian forms of Arabic letters. Null stays null."""
    mapped = F.translate(expand_contractions(text), ARABIC_LETTERS, PERSIAN_LETTERS)
    return F.trim(F.regexp_replace(mapped, r"[^\p{IsAlphabetic}\p{N}]+", " "))


def normalize_case_insensitive(text: Column) -> Column:
    return F.lower(normalize(text))


def normalize_identity(text: Column) -> Column:
    """Lower case with punctuation deleted rather than spaced; whitespace collapsed."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}\s]+", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def has_negation(normalized: Column) -> Column:
    starts = lambda x: reduce(lambda a, b: a | b, [F.startswith(x, F.lit(s)) for s in NEGATION_STARTS])
    return F.exists(tokens(normalized), lambda x: x.isin(*NEGATIONS) | starts(x))


def similarity_normalized(a: Column, b: Column) -> Column:
    """Jaccard of word sets, plus 0.2 where one text holds the other, times 0.35 where only one is negated; at most 1."""
    ta, tb = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.size(F.array_intersect(ta, tb))
    jaccard = F.try_divide(both.cast("double"), F.size(ta) + F.size(tb) - both)
    bonus = F.when(F.contains(a, b) | F.contains(b, a), 0.20).otherwise(0.0)
    polarity = F.when(has_negation(a) == has_negation(b), 1.0).otherwise(0.35)
    score = F.least(F.lit(1.0), (F.coalesce(jaccard, F.lit(0.0)) + bonus) * polarity)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(score)


def similarity(a: Column, b: Column) -> Column:
    return similarity_normalized(normalize(a), normalize(b))


def contains_phrase(normalized_text: Column, normalized_term: Column) -> Column:
    """Whole-word containment; an empty term is contained nowhere."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return (normalized_term != "") & F.contains(pad(normalized_text), pad(normalized_term))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def split_paragraphs(text: Column) -> Column:
    """Blocks between blank lines, their trimmed lines joined by a space; empty blocks are dropped."""
    join = lambda block: F.trim(F.array_join(F.transform(F.split(block, "\n"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", "")), " "))
    return F.filter(F.transform(F.split(unix_lines(text), "\n\n"), join), lambda x: x != "")


def is_chapter_heading(line: Column) -> Column:
    """A short line (120 bytes at most) that starts with a division word."""
    t = F.trim(line)
    return (t != "") & (F.octet_length(t) <= 120) & F.rlike(t, F.lit(r"^(?i:chapter|part|book) |^(فصل|بخش) "))


def contains_persian_letters(text: Column) -> Column:
    return F.rlike(text, F.lit(rf"[\p{{IsAlphabetic}}&&[{ARABIC_BLOCKS}]]"))


def polish_persian(text: Column) -> Column:
    """Persian letters and digits, no tatweel, and no zero-width non-joiner at an end, beside space, spacing punctuation or another one."""
    mapped = F.replace(F.translate(text, ARABIC_LETTERS + ARABIC_DIGITS, PERSIAN_LETTERS + PERSIAN_DIGITS), F.lit(TATWEEL), F.lit(""))
    edge = rf"\s{SPACING_PUNCTUATION}"
    return F.regexp_replace(mapped, rf"(?U)(?<![^{edge}{ZWNJ}]){ZWNJ}|{ZWNJ}(?![^{edge}])", "")


def words(text: Column) -> Column:
    """Whitespace-separated words without the punctuation around them; apostrophes and hyphens stay."""
    trim = lambda x: F.regexp_replace(x, r"^[^\p{IsAlphabetic}\p{N}'’-]+|[^\p{IsAlphabetic}\p{N}'’-]+$", "")
    return F.filter(F.transform(F.split(text, r"(?U)\s+"), trim), lambda x: x != "")


def count_sentences(text: Column) -> Column:
    """Closing marks, at least 1; 0 for blank text."""
    return F.when(F.trim(text) == "", 0).otherwise(F.greatest(F.regexp_count(text, F.lit("[.!?؟]")), F.lit(1)))


def dialogue_conventions(text: Column) -> Column:
    """Names of the dialogue marks of a paragraph, in a fixed order."""
    t = F.trim(text)
    return F.array_compact(
        F.array(
            F.when(F.rlike(t, F.lit('^["“]')), F.lit("double_quotes")),
            F.when(F.rlike(t, F.lit("^['‘]")), F.lit("single_quotes")),
            F.when(F.rlike(t, F.lit("^[—-]")), F.lit("leading_dash")),
            F.when(F.rlike(t, F.lit("[«»]")), F.lit("guillemets")),
        )
    )


def ngrams(words_: Column, n: int) -> Column:
    """Runs of ``n`` words joined by a space; none where there are fewer."""
    if n == 1:
        return F.coalesce(words_, F.array().cast(EMPTY))
    last = F.size(words_) - n + 1
    parts = lambda x, i: [y for k in range(1, n) for y in (F.lit(" "), F.get(words_, i + k))]
    return F.when(last >= 1, F.transform(F.slice(words_, 1, F.greatest(last, F.lit(0))), lambda x, i: F.concat(x, *parts(x, i)))).otherwise(F.array().cast(EMPTY))


def phrase_tokens(text: Column) -> Column:
    """Words normalised one by one: a contraction or compound stays one token, its parts joined by a space.

    The whole text is mapped at once; a mark that no word has holds the place
    of what stands inside a token until the text is split.
    """
    plain = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    spelt = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1].replace(" ", "\x01"))), CONTRACTIONS, plain)
    mapped = F.translate(F.when(F.contains(plain, F.lit("n't")), spelt).otherwise(plain), ARABIC_LETTERS, PERSIAN_LETTERS)
    marked = F.regexp_replace(mapped, r"(?U)[^\p{IsAlphabetic}\p{N}\s]+", "\x01")
    return F.filter(F.transform(F.split(marked, r"(?U)\s+"), lambda x: F.translate(F.btrim(x, F.lit("\x01")), "\x01", " ")), lambda x: x != "")


def truncate(text: Column, n: int, marker: str = "") -> Column:
    """The first ``n`` code points, and ``marker`` where something was cut."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(marker))).otherwise(text)


def head(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def dense_chars(text: Column) -> Column:
    """Characters that are not whitespace."""
    return F.length(F.regexp_replace(text, r"(?U)\s+", ""))


def block_paragraphs(text: Column) -> Column:
    """Number of non-blank blocks between blank lines."""
    return F.size(F.filter(F.split(text, "\n\n"), lambda x: F.trim(x) != ""))


def sanitize_score(score: Column) -> Column:
    """0 to 1; null, NaN and infinite scores are 0."""
    odd = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(odd, 0.0).otherwise(F.least(F.greatest(score.cast("double"), F.lit(0.0)), F.lit(1.0)))


def script_shares(text: Column) -> Column:
    """Shares of Arabic-script and Latin letters among all letters, and whether a long Latin run leaks into Arabic-script text."""
    letters = F.regexp_count(text, F.lit(r"\p{IsAlphabetic}"))
    arabic = F.regexp_count(text, F.lit(rf"[\p{{IsAlphabetic}}&&[{ARABIC_BLOCKS}]]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    share = lambda n: F.coalesce(F.try_divide(n.cast("double"), letters), F.lit(0.0))
    run = F.rlike(text, F.lit(r"(?:[A-Za-z][\s,.'-]*){12}"))
    return F.struct(share(arabic).alias("persian"), share(latin).alias("english"), (run & (arabic > 0)).alias("leak"))


def ranked_lines(*parts: tuple[str, Column]) -> Column:
    """``label: value`` lines of the parts that are not blank."""
    line = lambda label, value: F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.concat(F.lit(f"{label}: "), F.trim(value)))
    return F.concat_ws("\n", *[line(k, v) for k, v in parts])
