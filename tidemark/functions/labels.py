"""Labels, dates and cells as column expressions: quarters, vintages, release months, serial dates, redaction."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
# Words that may stand beside a release month.
BESIDE = ["st", "nd", "rd", "th", "of"]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def folded(x: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(x), r"\s+", " "))


def parse_quarter(x: Column) -> Column:
    """Quarter index 4*year + quarter - 1 of a label that says one year 1000-2999, one quarter 1-4 and one word for quarter, and
    nothing else; NULL otherwise.

    The label is cut into runs of letters, runs of digits and single marks, and each gets a kind.  The year stands at an end.
    The word comes before the quarter, unless an ordinal ending is fixed to the quarter, which then comes first.  A point
    may follow QUARTER or QTR, a dash may stand between Q and the year, a comma before a year that comes last."""
    t = folded(x)
    token = F.regexp_extract_all(t, F.lit(r"([A-Z]+|[0-9]+|[\s\S])"), F.lit(1))
    digits = lambda w: w.rlike("^[0-9]")
    kind = lambda w: (
        F.when(digits(w) & (F.length(w) == 4) & w.between("1000", "2999"), "year").when(w.isin("1", "2", "3", "4"), "number").when(w == "Q", "letter")
        .when(w.isin("QUARTER", "QTR"), "name").when(w.isin("ST", "ND", "RD", "TH"), "ending").when(w.isin(".", ",", "-", " "), w).otherwise("other")
    )

    def read(spaced, kinds, said):
        at, raw = lambda k: F.array_position(kinds, k), lambda k: F.array_position(spaced, k)  # noqa: E731  1-based; 0 if there is none
        once = F.size(F.array_distinct(kinds)) == F.size(kinds)
        whole = once & (at("year") > 0) & (at("number") > 0) & ((at("letter") > 0) != (at("name") > 0)) & (at("other") == 0)
        word, first, last = at("letter") + at("name"), at("year") == 1, at("year") == F.size(kinds)
        order = F.when(at("ending") > 0, last & (at("name") > at("number")) & (at("number") == 1) & (raw("ending") == raw("number") + 1)).otherwise((first | last) & (word < at("number")) & (~last | (word == 1)))
        apart = ~first | (at("letter") > 0) | (F.get(spaced, 1) == " ")
        point = (at(".") == 0) | ((at("name") > 0) & (raw(".") == raw("name") + 1))
        comma = (at(",") == 0) | (last & (at(",") == F.size(kinds) - 1))
        dash = (at("-") == 0) | ((at("letter") > 0) & (at(",") == 0) & (at("-") == F.when(first, 2).otherwise(F.size(kinds) - 1)))
        number = lambda k: F.get(said, raw(k) - 1).cast("int")
        return F.when(whole & order & apart & point & comma & dash, 4 * number("year") + number("number") - 1)

    likely = t.rlike("^[A-Z0-9 .,-]{6,24}$")  # the longest has 21
    read_token = lambda w: let(F.transform(w, kind), lambda spaced: let(F.filter(spaced, lambda k: k != " "), lambda kinds: read(spaced, kinds, w)))
    return F.when(likely, let(token, read_token))


def quarter_label(index: Column) -> Column:
    return F.concat(F.floor(index / 4).cast("int").cast("string"), F.lit(" Q"), (index % 4 + 1).cast("int").cast("string"))


def quarter_end(index: Column) -> Column:
    return F.last_day(F.make_date(F.floor(index / 4).cast("int"), (3 * (index % 4) + 3).cast("int"), F.lit(1)))


def months_between_index(later: Column, earlier: Column) -> Column:
    """Whole months between two 12*year + month - 1 indices."""
    return later - earlier


def parse_release_month(x: Column) -> Column:
    """12*year + month - 1 of a date in digits (2016-03, 2016/03/15, 03/2016, with or without a time of day), or of a
    text of one month name and one year 1000-2999 with at most one day of a month and the words of BESIDE; else NULL."""
    t = F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    # in words: every word or number is worth a letter, and what is left without the words beside must be a month and a year
    names = [n for m in MONTHS for n in {m, m[:3], "sept" if m == "september" else m}]
    number = lambda w: F.coalesce(w.try_cast("int"), F.lit(0))
    letter = lambda w: (
        F.when(w.isin(*BESIDE), "").when(w.isin(*names), "m").when(~w.rlike("^[0-9]"), "x").when(F.length(w) == 4, "y").when(number(w).between(1, 31), "d").otherwise("x")
    )
    token = F.regexp_extract_all(t, F.lit("([a-z]+|[0-9]+)"), F.lit(1))
    spelt = F.array_join(F.array_sort(F.filter(F.transform(token, letter), lambda k: k != "")), "").isin("my", "dmy")
    one = lambda k: F.get(F.filter(token, lambda w: letter(w) == k), 0)
    by_name = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.substring(one("m"), 1, 3)).cast("int")
    # in digits: the fields of the day, with a time behind it or not
    day, time = F.get(F.split(t, "[ t]"), 0), F.get(F.split(t, "[ t]"), 1)
    field = F.split(day, "[-/]")
    width = F.transform(field, lambda w: F.when(w.rlike("^[0-9]+$"), F.length(w)).otherwise(0))
    short = lambda k: F.get(width, k).between(1, 2)
    fields = F.size(field)
    timed = (F.size(F.split(t, "[ t]")) <= 2) & (time.isNull() | time.rlike(r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$"))
    down = (F.get(width, 0) == 4) & short(1) & ((fields == 2) | ((fields == 3) & short(2))) & timed
    up = (fields == 2) & short(0) & (F.get(width, 1) == 4) & time.isNull()
    digits = lambda k: F.get(field, k).cast("int")
    year = F.when(down, digits(0)).when(up, digits(1)).when(spelt, one("y").cast("int"))
    month = F.when(down, digits(1)).when(up, digits(0)).when(spelt, by_name)
    return F.when(year.between(1000, 2999) & month.between(1, 12), 12 * year + month - 1)


def read_vintage_label(x: Column, pivot: int = 50) -> Column:
    """Mon-YY with an optional [dddd prices] and code: 12*year + month - 1, with the century by pivot."""
    p = r"^([A-Z][a-z]{2})-(\d{2})(?: \[\d{4} prices\])?(?: [A-Z0-9]+)?$"
    order = F.array(*(F.lit(m[:3].capitalize()) for m in MONTHS))
    month, yy = F.array_position(order, F.regexp_extract(x, p, 1)).cast("int"), F.regexp_extract(x, p, 2).cast("int")
    return F.when(x.rlike(p) & (month > 0), 12 * (F.when(yy >= pivot, 1900).otherwise(2000) + yy) + month - 1)


def parse_day(x: Column) -> Column:
    return F.try_to_timestamp(x, F.lit("d MMMM yyyy")).cast("date")


def parse_time_of_day(x: Column) -> Column:
    """Minutes after midnight of "7:00am"; NULL where it isn't a time."""
    p = r"^(\d{1,2}):(\d{2}) ?(am|pm)$"
    t = F.lower(F.trim(x))
    h, m = F.regexp_extract(t, p, 1).cast("int"), F.regexp_extract(t, p, 2).cast("int")
    return F.when(t.rlike(p) & h.between(1, 12) & (m < 60), (h % 12) * 60 + m + F.when(F.regexp_extract(t, p, 3) == "pm", 720).otherwise(0))


def serial_to_date(serial: Column, date1904: bool = False) -> Column:
    """Spreadsheet serial days; serials 0 and 60 of the 1900 system are refused (NULL)."""
    s = serial.cast("int")
    if date1904:
        return F.date_add(F.lit("1904-01-01").cast("date"), s)
    return F.when(s.isin(0, 60) | (s < 0), None).otherwise(F.date_add(F.lit("1899-12-31").cast("date"), s - F.when(s > 60, 1).otherwise(0)))


def is_date_format(code: Column) -> Column:
    """A number format that shows a date: d, m, y, h or s outside quotes, brackets and escapes."""
    bare = F.regexp_replace(F.regexp_replace(code, r'"[^"]*"|\[[^\]]*\]|[\\_*].', ""), r"(?i)general", "")
    return bare.rlike(r"(?i)[dmyhs]")


def kind_of(kind: Column, text: Column) -> Column:
    """A cell's kind: empty, numeric, marker or other."""
    blank = text.isNull() | (F.trim(text) == "")
    return (
        F.when(kind == "number", "numeric").when((kind == "empty") | ((kind == "text") & blank), "empty")
        .when(kind.isin("boolean", "error", "date") | text.rlike(r"\p{Nd}"), "other").otherwise("marker")
    )


def mask_digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\p{Nd}", "#")


# Signs, currencies, scales and shares that belong to a number.
SIGNS, SYMBOLS, CODES = "-+\u2212", "£$€", ["GBP", "USD", "EUR"]
SCALES, SHARES = ["bn", "billion", "m", "million", "k", "thousand"], [r"per[\t\n\f\r ]?cent", r"percentage[\t\n\f\r ]+points?", "pp"]
HIDDEN = "[num]"
# Characters written in ASCII afterwards.
ASCII = {"\u2013": "-", "\u2014": "--", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2026": "...", "\u00a0": " ", "\u2212": "-", "\u2022": "*", "£": "GBP"}


# White space and words in ASCII, as Java's own classes depend on its version.
_GAP, _STARTS, _STOPS = r"[\t\n\f\r ]?", "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
_AMOUNT = r"[0-9][0-9,]*(?:\.[0-9]+)?"
_GROUPED = rf"(\A|[^0-9.,])[{SIGNS}]?[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\.[0-9]+)?(\z|[^0-9])"
_HIDE = [
    (rf"(?iu)(?:[{SYMBOLS}]|{_STARTS}(?:{'|'.join(CODES)}){_GAP}){_GAP}[{SIGNS}]?{_AMOUNT}(?:{_GAP}(?:{'|'.join(SCALES)}){_STOPS})?", HIDDEN),
    (rf"(?iu)[{SIGNS}]?{_AMOUNT}{_GAP}(?:%|(?:{'|'.join(SHARES)}){_STOPS})", HIDDEN),
    *[(_GROUPED, f"$1{HIDDEN}$2")] * 2,  # a find takes the marks beside it, so that its neighbour is met the second time
    (rf"[{SIGNS}]?[0-9]*\.[0-9]+", HIDDEN), ("[0-9]{5,}", HIDDEN),
]


def blank_numbers(x: Column) -> Column:
    """The text without currency amounts, shares, grouped thousands, decimals and numbers of five or more digits, each shown as
    [num], and in ASCII where it is typographic; NULL is empty.  The kinds are hidden in this order, each in what the ones
    before it left, so a number of many points and commas is cut the same way wherever it stands."""
    hidden = reduce(lambda t, rule: F.regexp_replace(t, *(F.lit(v) for v in rule)), _HIDE, F.coalesce(x, F.lit("")))
    single = {k: v for k, v in ASCII.items() if len(v) == 1}
    hidden = F.translate(hidden, "".join(single), "".join(single.values()))
    return reduce(lambda t, k: F.replace(t, F.lit(k), F.lit(ASCII[k])), [k for k in ASCII if k not in single], hidden)


def column_index(ref: Column) -> Column:
    """1-based index of a spreadsheet column's letters."""
    return F.aggregate(F.split(F.upper(ref), ""), F.lit(0), lambda n, ch: F.when(ch == "", n).otherwise(n * 26 + F.ascii(ch) - 64))


def split_ref(ref: Column) -> Column:
    p = r"^([A-Za-z]+)([1-9]\d*)$"
    return F.when(ref.rlike(p), F.struct(column_index(F.regexp_extract(ref, p, 1)).alias("col"), F.regexp_extract(ref, p, 2).cast("int").alias("row")))


def column_letters(index: Column) -> Column:
    """Letters of a 1-based column index, up to ZZZ."""
    n = index.cast("int")
    one = F.char(65 + (n - 1) % 26)
    two = F.when(n > 26, F.char(65 + F.floor((n - 27) / 26).cast("int") % 26)).otherwise("")
    three = F.when(n > 702, F.char(65 + F.floor((n - 703) / 676).cast("int"))).otherwise("")
    return F.concat(three, two, one)
