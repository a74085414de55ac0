"""Column functions over page text, labels and printed numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of retrieval.
STOP_WORDS = tuple(
    "what was were the and which that this with for from how much many are did does has have page "
    "vad var och det den som för hur mycket till med av på är vilken vilket sida".split()
)
#: Legal words of company names, and names that stand for others.
LEGAL_WORDS = ("ab", "oyj", "plc", "ltd", "inc", "group", "publ", "svenska")
ALIASES = {
    "swedish orphan biovitrum": "sobi",
    "skandinaviska enskilda banken": "seb",
    "molnlycke health care": "molnlycke",
    "grand": "the grand",
    "vectura fastigheter": "vectura",
    "hi3g scandinavia": "3 scandinavia",
    "hi3g holdings": "3 scandinavia",
    "ai revenue assistant software stockholm": "ai revenue assistant software",
    "arenit industrie se": "arenit industrie",
}
TERM_LENGTH = 7


def named_once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` of a value that is made once for a row: a lambda that reads a column's array by position makes the array anew for
    each element."""
    return F.get(F.transform(F.array(value), of), 0)


def normalize_ws(c: Column) -> Column:
    """Collapse white space, make dashes plain, and drop every space that touches a digit."""
    dashes = F.replace(F.replace(c, F.lit("–"), F.lit("-")), F.lit("−"), F.lit("-"))
    plain = F.trim(F.regexp_replace(dashes, r"[\s\u00a0]+", " "))
    return F.regexp_replace(F.regexp_replace(plain, r"([0-9]) ", "$1"), r" ([0-9])", "$1")


def terms(c: Column) -> Column:
    """Lower-case runs of digits or letters over two long, without stop words, cut to TERM_LENGTH."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+|\p{L}+)"), 1)
    kept = F.filter(found, lambda x: (F.length(x) > 2) & ~x.isin(*STOP_WORDS))
    return F.transform(kept, lambda x: F.substring(x, 1, TERM_LENGTH))


def digit_share(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", "")) / F.greatest(F.length(c), F.lit(1))


def redact_paths(c: Column) -> Column:
    """Mask user and local paths inside free text."""
    return F.regexp_replace(c, r"(/home/|/Users/|[A-Z]:\\Users\\)[^\s]*", "[path]")


#: What follows a number that belongs to its label ("Within 1 year"): a lower-case word.
AMOUNT_STARTS = r"\s+[-(–−]?\d[\d,.']*+(?!\s*[a-zåäöæø])"


def row_label(c: Column) -> Column:
    """The printed label before the first amount, without trailing punctuation. A number that a lower-case word follows is part
    of the label."""
    row = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    label = F.regexp_replace(row, f"{AMOUNT_STARTS}(?s:.*)", "")  # a split would build its pattern for each row
    return F.regexp_replace(label, r"[ ,.:;*]+$", "")


#: Currency codes, other names of currencies, words of scale and the factors they stand for.
CURRENCIES = ("SEK", "EUR", "USD", "NOK", "DKK", "ISK", "GBP", "CHF", "JPY", "CAD", "AUD")
CURRENCY_NAMES = {"kronor": "SEK", "euro": "EUR", "kr": "SEK", "€": "EUR", "$": "USD", "£": "GBP"}
SCALE_WORDS = {"bn": ("billions", "billion", "bn", "mrd", "mdr", "md"), "m": ("millions", "million", "miljoner", "miljon", "mn", "m"), "k": ("thousands", "thousand", "tusen", "000", "k", "t")}
FACTORS = {"bn": 1e9, "m": 1e6, "k": 1e3, "": 1.0}
CURRENCY_CODES = "|".join(CURRENCIES)
#: A reference to a note.
NOTE = r"[A-Z]{1,3}\.?\d{1,2}(?:[-–]\d{1,2})?"
#: What labels carry besides their words: marks of footnotes, figures of notes in brackets, units, and the word for loss.
_UNIT_IN_LABEL = rf"(?i:,?\s*\(?\b(?:[kmbt]?(?:{CURRENCY_CODES})|kr)\b\)?)"
LABEL_NOISE = "|".join((r"(?<=\p{L})[\u2070\u00b9\u00b2\u00b3\u2074-\u2079]+", r"(?i:\s*[/(]\s*\(?loss\)?|/förlust)", r"(?<=\p{L})\d{1,2}\)", r"\s*\[\d{1,2}\]", _UNIT_IN_LABEL))
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: What labels with noise or ligatures have, before anything is made of them.
_UNUSUAL = rf"[/()\[\u2070\u00b9\u00b2\u00b3\u2074-\u2079{''.join(LIGATURES)}]|\b(?i:[kmbt]?(?:{CURRENCY_CODES})|kr)\b"


def clean_label(c: Column) -> Column:
    """A label as labels are compared: lower-case words with digits glued to them, "result" as "profit", without LABEL_NOISE, references to
    notes at the end and figures after the last word. Ligatures are spelled out. Noise is looked for in unusual labels alone."""
    text = F.coalesce(c, F.lit(""))
    spelled = text
    for mark, letters in LIGATURES.items():
        spelled = F.replace(spelled, F.lit(mark), F.lit(letters))
    bare = F.when(text.rlike(_UNUSUAL), F.regexp_replace(normalize_ws(spelled), LABEL_NOISE, "")).otherwise(normalize_ws(text))
    ended = F.regexp_replace(F.regexp_replace(bare, rf"(?:\s+{NOTE},?)+$", ""), r"[\s\d,.:;*)(]+$", "")
    return F.regexp_replace(F.lower(ended), r"\bresult\b", "profit")


def dedupe_doubled_tokens(c: Column) -> Column:
    """A text layer that prints nearly every token twice, once: at least eight neighbours are equal, and a quarter of all
    tokens. Of equal neighbours on a line the first stays, however many there are."""
    text = F.coalesce(c, F.lit(""))
    tokens = F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), F.lower)
    doubled = named_once(tokens, lambda t: F.struct(F.size(t).alias("n"), F.size(F.filter(t, lambda x, i: F.coalesce(F.get(t, i - 1) == x, F.lit(False)))).alias("twice")))
    parts = F.regexp_extract_all(text, F.lit(r"(\S+|[ \t]+|[^\S \t]+)"), 1)

    def once(p: Column) -> Column:
        gap = lambda i: F.get(p, i).rlike(r"^[ \t]+$")
        repeats = lambda i: F.coalesce(gap(i - 1) & (F.lower(F.get(p, i - 2)) == F.lower(F.get(p, i))), F.lit(False))
        return F.array_join(F.filter(p, lambda x, i: ~F.when(x.rlike(r"^\S"), repeats(i)).otherwise(repeats(i + 1) & gap(i))), "")

    mostly = named_once(doubled, lambda d: (d["twice"] >= 8) & (d["twice"] * 4 >= d["n"]))
    return F.when(mostly, named_once(parts, once)).otherwise(c)


def parse_number(c: Column) -> Column:
    """A printed number with spaces as group marks and a comma or point before decimals, else null."""
    bare = F.regexp_replace(F.translate(c, " −", " -"), r"\s", "")
    return F.when(bare.rlike(r"^-?[0-9]+([.,][0-9]+)?$"), F.translate(bare, ",", ".")).try_cast("double")


#: Fixed value: a footnote mark glued to an amount.
FOOTNOTE = r"(?<=\d{3})\d\)(?=\s|$)"


#: Marks between groups of three digits.
GROUP_MARK = r"[\s,.'\u00a0]?"


def _printed_decimal(value: Column) -> Column:
    """A number without its sign, as text with four decimals."""
    return F.abs(value).cast("decimal(38,4)").cast("string")


def printed_pattern(value: Column) -> Column:
    """A pattern of a number as it can be printed: any group mark, a point or comma before decimals, bounded by what can't
    continue it; the sign doesn't matter. Null for null."""
    number = _printed_decimal(value)
    part = F.rtrim(F.substring_index(number, ".", -1), F.lit("0"))
    mark = GROUP_MARK.replace("\\", "\\\\")  # as a replacement
    groups = F.regexp_replace(F.substring_index(number, ".", 1), r"(?<=\d)(?=(?:\d{3})+$)", mark)
    decimals = F.when(part == "", "").otherwise(F.concat(F.lit("[.,]"), part, F.lit("0*")))
    return F.concat(F.lit(r"(?<![\d.,])"), groups, decimals, F.lit(r"(?!\d)"))


def value_in_text(value: Column, text: Column) -> Column:
    """Whether a number is printed in a text; null values and texts are not.

    Most numbers stand between spaces in a usual form, or their digits, group marks aside, don't stand in the text at all, which
    plain searches tell; a pattern is built for the others alone."""
    bare = F.when(F.contains(text, F.lit(")")), F.regexp_replace(text, FOOTNOTE, "")).otherwise(text)
    number, commas = _printed_decimal(value), F.format_number(F.abs(value), 2)
    spaces = F.replace(commas, F.lit(","), F.lit(" "))
    forms = (commas, spaces, F.replace(commas, F.lit(","), F.lit("")), F.replace(spaces, F.lit("."), F.lit(",")))
    apart = F.concat(F.lit(" "), F.replace(bare, F.lit("\n"), F.lit(" ")), F.lit(" "))
    usual = F.lit(False)
    for form in forms:
        usual = usual | F.contains(apart, F.concat(F.lit(" "), form, F.lit(" ")))
    digits = F.replace(F.rtrim(number, F.lit("0")), F.lit("."), F.lit(""))
    possible = F.contains(F.translate(bare, " \t\n\x0b\f\r,.'\u00a0", ""), digits)
    found = F.when(F.endswith(number, F.lit("00")) & usual, F.lit(True)).otherwise(possible & F.regexp_like(bare, printed_pattern(value)))
    return F.coalesce(found, F.lit(False))


def repaired_scale(value: Column, quote: Column) -> Column:
    """The printed number where a value isn't in its quote, but a tenth, hundredth or thousandth of it is, with decimals or
    of two digits at least; else null. The nearest power of ten counts."""
    smaller = F.transform(F.array(*map(F.lit, (10, 100, 1000))), lambda by: F.round(value / by, 4))
    telling = lambda x: (F.pmod(x, F.lit(1.0)) != 0) | (F.abs(x) >= 10)
    printed = F.filter(smaller, lambda x: telling(x) & value_in_text(x, quote))
    return F.when(value.isNotNull() & ~value_in_text(value, quote), F.get(printed, 0))


def name_words(c: Column) -> Column:
    """Accent-free, lower-case words of a name."""
    folded = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " ")), " "), lambda w: w != "")


def company_key(c: Column) -> Column:
    """Words of a name without legal ones, by its alias where it has one."""
    key = F.array_join(F.filter(name_words(c), lambda w: ~w.isin(*LEGAL_WORDS)), " ")
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, key), key)


#: Words that name no company by themselves.
GENERIC_WORDS = ("holding", "holdings", "corp", "corporation", "international", "aktiebolag", "aktiebolaget", "the", "and")


def name_tokens(c: Column) -> Column:
    """At most two identifying words of three letters or more; a name without any stands whole."""
    bare = F.regexp_replace(c, r"(?i)\(publ\)|\bAB\b|\bLtd\.?\b|\bplc\b|\bGroup\b|\bCompany\b", "")
    words = F.filter(name_words(bare), lambda w: (F.length(w) >= 3) & ~w.isin(*GENERIC_WORDS))
    return F.when(F.size(words) > 0, F.slice(words, 1, 2)).otherwise(F.array(F.lower(c)))


def acronym(c: Column) -> Column:
    """A name's initials, where there are three at least."""
    bare = F.regexp_replace(c, r"(?i)\(publ\)|\bLtd\b|\bplc\b|\bAB\b", "")
    letters = F.array_join(F.transform(F.filter(name_words(bare), lambda w: w.rlike("^[a-z]")), lambda w: F.substring(w, 1, 1)), "")
    return F.when(F.length(letters) >= 3, letters)


def slug(c: Column) -> Column:
    return F.array_join(name_words(F.regexp_replace(c, r"(?i)\(publ\)|\bAB\b|\bLtd\.?\b|\bplc\b|\bGroup\b|\bCompany\b", "")), "_")


def unit_parts(unit: Column) -> tuple[Column, Column]:
    """Currency code (null where none is named) and scale (bn, m, k, "" for none; null for other words) of a printed unit. Without white
    space, marks and connecting words, a unit is a currency's code or name with a word of scale before or after it."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(unit), r"\b(?:of|in|per)\b", ""), r"[\s'’.,]", "")
    names = {code.lower(): code for code in CURRENCIES} | CURRENCY_NAMES
    found = F.regexp_extract(bare, "(" + "|".join("\\" + n if n == "$" else n for n in sorted(names, key=len, reverse=True)) + ")", 1)
    words = {w: scale for scale, of in SCALE_WORDS.items() for w in of} | {"": ""}
    known = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return known(names, found), known(words, F.replace(bare, found, F.lit("")))


def currency_of(unit: Column) -> Column:
    """The currency that a unit names, without its scale; "" where it names none."""
    return F.coalesce(unit_parts(unit)[0], F.lit(""))


def unit_key(unit: Column) -> Column:
    """Scale (bn, m, k or none) and currency of a printed unit, as one text; null where one can't be read."""
    currency, scale = unit_parts(unit)
    return F.concat(scale, F.lit(" "), currency)


def unit_scale(unit: Column) -> Column:
    """The factor that a unit names: thousands, millions, billions, else 1."""
    factors = F.create_map(*[F.lit(x) for pair in FACTORS.items() for x in pair])
    return F.coalesce(F.try_element_at(factors, unit_parts(unit)[1]), F.lit(1.0))


def unit_currency(unit: Column) -> Column:
    """The currency that a unit names, else null; never guessed."""
    return unit_parts(unit)[0]
