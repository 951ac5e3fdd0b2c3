"""Scalar text functions as Spark columns. A null gives a null unless said otherwise."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from docframe.functions import nodes


#: What divides words: all blanks of Unicode, named one by one, which is matched faster
#: than by property; and first of all what may be one, which spares most letters the list.
BLANKS = r"[\x00-\x20\x7F-\x{10FFFF}&&[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]+"


def words(text: Column) -> Column:
    """Runs without blanks, in order; none for a blank or null text."""
    cut = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return F.filter(cut, lambda w: w != "")


def clean_words(text: Column) -> Column:
    """clean_word of each of words(text), in order; none for a blank or null text."""
    blank = F.coalesce(F.regexp_replace(text, BLANKS, ""), F.lit("")) == ""
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.split(clean_lines(text), "\n"))


def clean_lines(text: Column) -> Column:
    """clean_word of each of words(text) on a line of its own, by three passes over the
    whole text instead of one over each word: blanks become single line ends, and what
    doesn't count vanishes. An empty line is a word of which nothing counts, and so is
    the one line of a blank text."""
    flat = F.btrim(F.regexp_replace(text, BLANKS, "\n"), F.lit("\n"))
    return F.lower(F.regexp_replace(flat, r"[^a-zA-Z0-9_\n\p{IsAlphabetic}\p{N}-]", ""))


def clean_word(w: Column) -> Column:
    """Letters, digits, '_' and '-' only, in lower case."""
    return F.lower(F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}_-]", ""))


def stem(w: Column) -> Column:
    """Without the first of 'ing', 'ed', 's' that ends the word and leaves
    something: the word has more than 4, 3 or 2 bytes."""
    n = F.octet_length(w)

    def cut(k: int) -> Column:
        return F.substring(w, F.lit(1), F.length(w) - k)

    return F.when(w.endswith("ing") & (n > 4), cut(3)).when(w.endswith("ed") & (n > 3), cut(2)).when(w.endswith("s") & (n > 2), cut(1)).otherwise(w)


def stem_of(w: str) -> str:
    """stem() of a word on the driver."""
    n = len(w.encode())
    return w[:-3] if w.endswith("ing") and n > 4 else w[:-2] if w.endswith("ed") and n > 3 else w[:-1] if w.endswith("s") and n > 2 else w


def term(w: Column, language: str = "en") -> Column:
    """The index term of a word; other languages than English are only lower-cased."""
    return stem(clean_word(w)) if language == "en" else clean_word(w)


def collapse(s: Column) -> Column:
    """Blanks as one space each, none at the ends."""
    return F.trim(F.regexp_replace(s, BLANKS, " "))


def normal_name(s: Column) -> Column:
    """The name under which labels and sections are looked up."""
    return F.lower(collapse(s))


def escape_text(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(s: Column) -> Column:
    return F.replace(escape_text(s), F.lit('"'), F.lit("&quot;"))


def strip_tags(s: Column) -> Column:
    return F.regexp_replace(s, "<[^>]*>", "")


def escape_serial(s: Column) -> Column:
    """Backslashes doubled, and a backslash before each space."""
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit(" "), F.lit("\\ "))


def snippet(s: Column, most: int = 60) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def occurrences(s: Column, piece: str) -> Column:
    """How often piece stands in s, without overlaps."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def braces_balance(s: Column) -> Column:
    return occurrences(s, "{") == occurrences(s, "}")


def byte_size(n: Column) -> Column:
    """Bytes with a unit of 1024s and one decimal."""
    out = None
    for k, unit in enumerate(["B", "KB", "MB", "GB"]):
        this = F.format_string(f"%.1f {unit}", (n / 1024**k).cast("double")) if k else F.format_string("%d B", n.cast("long"))
        out = F.when(n < 1024 ** (k + 1), this) if out is None else out.when(n < 1024 ** (k + 1), this)
    return out.otherwise(F.format_string("%.1f TB", (n / 1024**4).cast("double")))


def duration(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("long")
    return F.when(seconds >= 1, F.format_string("%d.%03ds", F.floor(ms / 1000), ms % 1000)).otherwise(F.format_string("%dms", ms))


def title_and_target(s: Column) -> tuple[Column, Column]:
    """Of 'Title <target>': the title (null without one) and the target, by the last '<'."""
    hit = s.rlike(r"(?s)^.*\S\s*<[^<]*>$")
    return F.when(hit, F.trim(F.regexp_extract(s, r"(?s)^(.*)<[^<]*>$", 1))), F.when(hit, F.trim(F.regexp_extract(s, r"<([^<]*)>$", 1))).otherwise(F.trim(s))


def make_id_ascii(s: Column) -> Column:
    """An identifier of an ASCII text: lower case, runs of others than letters and
    digits as '-', no digits or '-' at the start, no '-' at the end."""
    x = F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.regexp_replace(x, "^[-0-9]+", ""), "-+$", "")


@F.pandas_udf(StringType())
def _id(s: pd.Series) -> pd.Series:
    return s.map(nodes.make_id, na_action="ignore")


def make_id(s: Column) -> Column:
    """make_id_ascii of any text: letters lose their accents, what has no ASCII form
    vanishes. Only texts with other characters than ASCII go through Python."""
    return F.when(s.rlike(r"^\p{ASCII}*$"), make_id_ascii(s)).otherwise(_id(s))


def escape_marks(s: Column) -> Column:
    """Each backslash with what follows it as a NUL with that."""
    return F.regexp_replace(s, r"(?s)\\(.?)", "\0$1")


def unescape_marks(s: Column, restore: bool = False) -> Column:
    """The text of escape_marks without the NULs, or with the backslashes again; an
    escaped blank or line end vanishes."""
    return F.replace(s, F.lit("\0"), F.lit("\\")) if restore else F.replace(F.regexp_replace(s, "\0[ \n]", ""), F.lit("\0"), F.lit(""))


def without_colons(s: Column) -> Column:
    """A paragraph's text where '::' at its end announces a literal block: null where it
    is '::' alone, without it after a blank, else with one colon."""
    return F.when(~s.endswith("::"), s).when(s == "::", F.lit(None)).when(s.rlike(r"[ \n]::$"), F.rtrim(F.regexp_replace(s, r"\s*::$", ""))).otherwise(F.substring(s, F.lit(1), F.length(s) - 1))


@F.pandas_udf(IntegerType())
def display_width(s: pd.Series) -> pd.Series:
    """Columns that a text takes: wide letters two, marks over others none."""
    from docframe.functions.doctree import width

    return s.map(width, na_action="ignore").astype("Int32")


@F.pandas_udf(StringType())
def quoted(s: pd.Series) -> pd.Series:
    """A string as a Python literal."""
    return s.map(repr, na_action="ignore")


@F.pandas_udf(StringType())
def code_point(s: pd.Series) -> pd.Series:
    """The character that '65', '0x41', 'U+41' or '&#x41;' names; null where there is none of that number."""
    from docframe.functions import directives

    def one(x: str) -> str | None:
        try:
            return directives.code_point(x)
        except directives.Wrong:
            return None

    return s.map(one, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def uris(s: pd.Series) -> pd.Series:
    """The URIs and e-mail addresses (as mailto:) that stand alone in a text."""
    from docframe.functions.inlines import standalone

    return s.map(standalone, na_action="ignore")


def whole_number(s: Column) -> Column:
    """An integer as Python reads it, of up to 38 digits: a sign, and '_' between digits; null for others."""
    t = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    return F.when(t.rlike(r"^[-+]?\d+(_\d+)*$"), F.replace(t, F.lit("_"), F.lit("")).try_cast("decimal(38,0)"))


UNITS = ("em", "ex", "ch", "rem", "vw", "vh", "vmin", "vmax", "cm", "mm", "Q", "in", "pc", "pt", "px", "%")


def measure(s: Column) -> Column:
    """A number with a unit of style sheets, or none, without blanks; null for others."""
    form = r"^\s*(\d+\.?\d*|\.\d+) *(" + "|".join(UNITS) + r")?\s*$"
    return F.when(s.rlike(form), F.concat(F.regexp_extract(s, form, 1), F.regexp_extract(s, form, 2)))


def class_list(s: Column) -> Column:
    """The words of a text, each as an identifier; null where one has none."""
    ids = F.transform(words(s), make_id_ascii)
    return F.when(~F.exists(ids, lambda x: x == ""), ids)


def simple_name(s: Column) -> Column:
    """Whether a text is a reference name: words joined by single marks."""
    return s.rlike(r"^(?U)(?:(?!_)\w)+(?:[-._+:](?:(?!_)\w)+)*$")


DATES = {"iso": "yyyy-MM-dd'T'HH:mm:ss'Z'", "date": "yyyy-MM-dd", "time": "HH:mm:ss", "datetime": "yyyy-MM-dd HH:mm:ss"}
_CODES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}


def date_text(at: Column, form: str) -> Column:
    """A time in one of the named forms, or by %Y %m %d %H %M %S; other signs stand for themselves."""
    if form in DATES:
        return F.date_format(at, DATES[form])
    parts = [p for p in re.split("(%.)", form) if p]
    return F.concat(*[F.date_format(at, _CODES[p[1]]) if p[0] == "%" and p[1:] in _CODES else F.lit(p) for p in parts]) if parts else F.lit("")


def line_numbers(spec: Column, total: Column) -> Column:
    """The lines that '1,3-5,-4,4-' names of `total`, in the order named; null where
    a part is no number or range, or runs backwards."""
    parts = F.split(F.replace(spec, F.lit(" "), F.lit("")), ",")
    ok = F.forall(parts, lambda p: p.rlike(r"^(\d+|\d+-\d*|-\d+)$"))

    def bound(p: Column, group: int, other: Column) -> Column:
        return F.coalesce(F.regexp_extract(p, r"^(\d*)-(\d*)$", group).try_cast("int"), other)

    def span(p: Column) -> Column:
        lo = F.when(p.contains("-"), bound(p, 1, F.lit(1))).otherwise(p.try_cast("int"))
        hi = F.when(p.contains("-"), bound(p, 2, total)).otherwise(p.try_cast("int"))
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    spans = F.transform(parts, span)
    forward = F.forall(spans, lambda x: x["lo"] <= x["hi"])
    lists = F.transform(spans, lambda x: F.sequence(x["lo"], F.greatest(x["lo"], F.least(x["hi"], total))))
    return F.when(ok & forward, F.filter(F.flatten(lists), lambda n: (n >= 1) & (n <= total)))


def ordinal(marker: Column, kind: Column) -> Column:
    """The value of an enumerator 'arabic', 'loweralpha', 'upperalpha', 'lowerroman'
    or 'upperroman'; null where it isn't one, or a roman number isn't canonical."""
    text = F.lower(marker)
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    each = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.element_at(F.create_map(*[F.lit(z) for p in value.items() for z in p]), c))
    sums = F.aggregate(each, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, n: F.struct((a["sum"] + n - F.when(n > a["last"], 2 * a["last"]).otherwise(0)).alias("sum"), n.alias("last")))["sum"]
    roman = F.when(text.rlike("^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (text != ""), sums)
    alpha = F.when(text.rlike("^[a-z]$"), F.ascii(text) - 96)
    lower, upper = marker.rlike("^[a-z]+$"), marker.rlike("^[A-Z]+$")
    return F.when(kind == "arabic", F.when(marker.rlike(r"^\d{1,9}$"), marker.try_cast("int"))).when(kind == "loweralpha", F.when(lower, alpha)).when(kind == "upperalpha", F.when(upper, alpha)).when(kind == "lowerroman", F.when(lower, roman)).when(kind == "upperroman", F.when(upper, roman))


def enumerator_kind(marker: Column) -> Column:
    """The kind of an enumerator: a single 'i' or 'I' is roman, other single letters are
    letters, more letters roman; null for others."""
    roman = marker.rlike("^([ivxlcdm]+|[IVXLCDM]+)$")
    upper = F.when(marker.rlike("^[A-Z]"), F.lit("upper")).otherwise(F.lit("lower"))
    letters = F.when(F.lower(marker) == "i", F.lit("roman")).when(F.length(marker) == 1, F.lit("alpha")).when(roman, F.lit("roman"))
    return F.when(marker.rlike(r"^\d+$"), F.lit("arabic")).when(marker.rlike("^([a-z]+|[A-Z]+)$"), F.concat(upper, letters))


def option_target(s: Column) -> tuple[Column, Column]:
    """(title, target) where a title must stand before '<target>'; otherwise all is target."""
    form = r"(?s)^(.*\S)\s*<([^<>]*)>$"
    hit = s.rlike(form)
    return F.when(hit, F.trim(F.regexp_extract(s, form, 1))), F.when(hit, F.regexp_extract(s, form, 2)).otherwise(s)
