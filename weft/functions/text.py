"""Column functions over one line of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators and markers of the file formats.
CODE_END = "<eoc>"
SENTENCE_START = "<s>"
SENTENCE_END = "</s>"
NBEST_SEPARATOR = "|||"
MISSING_CODE = "NULL"
MISSING_MERGE = "<ERR>"

# The characters that count as white space (Unicode, and the four separators
# of ASCII).
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set inside a regular expression that starts with (?U); much faster than a list.
SPACE_CLASS = r"\s\x1c-\x1f"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def split_space(c: Column | str) -> Column:
    """Tokens between single spaces; neighbouring spaces give empty tokens."""
    return F.split(_col(c), " ", -1)


def split_ws(c: Column | str) -> Column:
    """Tokens between runs of white space; never empty ones."""
    return F.filter(F.split(_col(c), f"(?U)[{SPACE_CLASS}]+", -1), lambda token: token != "")


def split_chars(c: Column | str) -> Column:
    """One token per code point."""
    return F.regexp_extract_all(_col(c), F.lit(r"(?s)."), F.lit(0))


def field(c: Column | str, k: int, delim: str = "\t") -> Column:
    """Field ``k`` (from 0) of a delimited line; a line that is too short is an error."""
    parts = F.split(_col(c), _quote(delim), -1)
    return F.when(F.size(parts) > k, F.get(parts, F.lit(k))).otherwise(
        F.raise_error(F.concat(F.lit(f"no field {k} in line: "), _col(c)))
    )


def _quote(text: str) -> str:
    return r"\Q" + text + r"\E"


def split_code(c: Column | str) -> Column:
    """``code<eoc>sentence`` as ``struct(code, sent)``.

    Only a separator that occurs exactly once counts. The sentence then loses a closing
    ``</s>``; otherwise the code is NULL and the sentence is the whole field. A code written
    as the marker of a missing one is NULL as well.
    """
    parts = F.split(_col(c), CODE_END, -1)
    single = F.size(parts) == 2
    return F.struct(
        F.when(single, F.nullif(F.get(parts, F.lit(0)), F.lit(MISSING_CODE))).alias("code"),
        F.when(single, F.regexp_replace(F.get(parts, F.lit(1)), rf"{SENTENCE_END}\z", ""))
        .otherwise(_col(c))
        .alias("sent"),
    )


def normalise_brackets(c: Column | str) -> Column:
    """Write ``(x)`` as ``(x x)`` for one character and ``(tag word more)`` as ``(tag word)``."""
    word = f"[^{SPACE_CLASS}()]+"
    doubled = F.regexp_replace(strip(c), r"(?d)\((.)\)", "($1 $1)")
    return F.regexp_replace(doubled, rf"(?U)\(({word}) ({word}) {word}\)", "($1 $2)")


def wrap(tokens: Column | str) -> Column:
    """Put the sentence markers around a token array."""
    return F.concat(F.array(F.lit(SENTENCE_START)), _col(tokens), F.array(F.lit(SENTENCE_END)))


def crop(tokens: Column | str, length: int = 150) -> Column:
    """The first ``length`` tokens."""
    return F.slice(_col(tokens), 1, length)


def code_tokens(c: Column | str) -> Column:
    """Codes separated by white space as marker tokens: ``37`` becomes ``<c38>``."""
    return F.array_join(
        F.transform(
            split_ws(c),
            lambda x: F.concat(F.lit("<c"), (x.cast("bigint") + 1).cast("string"), F.lit(">")),
        ),
        " ",
    )


def with_code(code: Column | str, target: Column | str) -> Column:
    """Target text with its code in front."""
    return F.concat_ws(" ", _col(code), F.lit(CODE_END), _col(target))


def shard_name(c: Column | str, width: int = 2) -> Column:
    """Shard number padded with zeros on the left; longer numbers stay whole."""
    text = _col(c).cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


# The public mteval-13a tokenisation, in order of application.
TOKENISE_13A = [
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]
PUNCTUATION_13A = r"([{-~\[-` -&(-+:-@/])"


def tokens_13a(c: Column | str, lowercase: bool = True) -> Column:
    """mteval-13a tokens of a line, lowercased first unless told otherwise."""
    text = F.lower(_col(c)) if lowercase else _col(c)
    text = F.replace(text, F.lit("<skipped>"), F.lit(""))
    text = F.replace(text, F.lit("-\n"), F.lit(""))
    text = F.replace(text, F.lit("\n"), F.lit(" "))
    for entity, plain in TOKENISE_13A:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    text = F.regexp_replace(text, PUNCTUATION_13A, " $1 ")
    text = F.regexp_replace(text, r"([^0-9])([.,])", "$1 $2 ")
    text = F.regexp_replace(text, r"([.,])([^0-9])", " $1 $2")
    text = F.regexp_replace(text, r"([0-9])(-)", "$1 $2 ")
    return split_ws(text)


# Typographic characters and their plain forms (public punctuation rules),
# first those of one character each, then the others.
PLAIN_CHARACTERS = [
    ("\u00a0", " "),
    ("„", '"'),
    ("“", '"'),
    ("”", '"'),
    ("«", '"'),
    ("»", '"'),
    ("‘", "'"),
    ("’", "'"),
    ("‚", "'"),
    ("–", "-"),
]
PLAIN_PUNCTUATION = [
    ("\r", ""),
    ("``", '"'),
    ("''", '"'),
    ("—", " - "),
    ("…", "..."),
    ("(", " ("),
    (")", ") "),
]
# Languages that write the decimal sign as a comma, and that elide before a noun.
DECIMAL_COMMA = ["de", "es", "fr"]
ELIDING = ["fr"]


def normalise(c: Column | str, lang: Column | str) -> Column:
    """Plain punctuation: quotes, dashes, dots and spaces, with rules chosen by language.

    A documented subset of the public rules: the replacements of the lists
    above, the space between two digits (decimal sign of the language), the order of a closing
    quote and a comma or full stop (English), blanks next to brackets and before marks.
    """
    text, lang = _col(c), _col(lang)
    text = F.regexp_replace(
        text,
        F.lit("([0-9])\u00a0([0-9])"),
        F.when(lang.isin(DECIMAL_COMMA), F.lit("$1,$2")).otherwise(F.lit("$1.$2")),
    )
    text = F.translate(text, "".join(a for a, _ in PLAIN_CHARACTERS), "".join(b for _, b in PLAIN_CHARACTERS))
    for mark, plain in PLAIN_PUNCTUATION:
        text = F.replace(text, F.lit(mark), F.lit(plain))
    text = F.regexp_replace(text, r" +", " ")
    text = F.regexp_replace(text, r"\) ([.!:?;,])", ")$1")
    text = F.replace(F.replace(text, F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")"))
    text = F.regexp_replace(text, r" ([:;,?!])", "$1")
    text = F.when(lang == "en", F.regexp_replace(text, r'"([,.]+)', '$1"')).otherwise(text)
    return F.trim(text)


def tokenise(c: Column | str, lang: Column | str) -> Column:
    """Separate punctuation by blanks, with the apostrophe rule of the language.

    A documented subset of the public rules: every mark but ``. , ' -`` stands alone,
    commas and full stops do so unless inside a number, a hyphen inside a word becomes
    ``@-@``, an apostrophe goes with the right part (English), the left part (French) or
    stands alone.
    """
    text, lang = F.concat(F.lit(" "), _col(c), F.lit(" ")), _col(lang)
    text = F.regexp_replace(text, r"([^\p{L}\p{N}\s.,'-])", " $1 ")
    for _ in range(2):  # twice: neighbours such as a-b-c share a letter
        text = F.regexp_replace(text, r"([\p{L}\p{N}])-([\p{L}\p{N}])", "$1 @-@ $2")
    text = F.regexp_replace(text, r"([^0-9])([.,])", "$1 $2 ")
    text = F.regexp_replace(text, r"([.,])([^0-9])", " $1 $2")
    for _ in range(2):
        text = F.regexp_replace(
            text,
            F.lit(r"(\p{L})'(\p{L})"),
            F.when(lang == "en", F.lit("$1 '$2"))
            .when(lang.isin(ELIDING), F.lit("$1' $2"))
            .otherwise(F.lit("$1 ' $2")),
        )
    return F.trim(F.regexp_replace(text, r"\s+", " "))
