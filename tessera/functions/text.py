"""Scalar text functions over columns: folding, tokens, keys, numbers, dates, HTML.

All are built-in expressions and stay in generated code. Spark has no Unicode normalisation, so folding maps
every precomposed Latin letter, and ``nfc`` composes letters and marks, by tables built from ``unicodedata``;
``nfc_exact`` and ``nfd`` are Arrow functions.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Words that search ignores (fixed values), already folded.
STOP_WORDS = (
    "va", "hoac", "cua", "la", "co", "cho", "theo", "tai", "trong", "voi", "ve", "duoc", "cac", "nhung", "mot",
    "nay", "do", "khi", "thi", "de", "tu", "den", "bi", "toi", "minh", "roi", "nhi", "a", "khong", "gi",
)

#: White space as the patterns of the data model see it: also no-break space and byte-order mark.
#: Most characters are below U+1680 and are settled by the first range.
WS = r"[\s\x{00A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"


@cache
def _fold_map() -> tuple[str, str]:
    """Letters that decompose into one base letter and marks, and their base letters."""
    source, target = [], []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if not c.isalpha():
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M"))
        if base != c and len(base) == 1 and code < 0x2000:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


def strip_marks(c: Column, source: str = "", target: str = "") -> Column:
    """Letters without their diacritics, and those of ``source``, none of ASCII, as in ``target``; combining marks are
    dropped. Texts of ASCII alone are left as they are."""
    letters, bases = _fold_map()
    plain = F.regexp_replace(F.translate(c, letters + source, bases + target), r"\p{M}+", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), plain).otherwise(c)


def fold(c: Column) -> Column:
    """Text as search sees it: no marks, the letter d for its barred form, lower case."""
    return F.lower(strip_marks(c, "Đđ", "dd"))


#: Characters whose normal form is another single character lie in here, as a pattern's class has it.
_SINGLES = r"\x{0340}-\x{0343}\x{0374}\x{037E}\x{0387}\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{F900}-\x{FAD9}\x{2F800}-\x{2FA1D}"


@cache
def _composition():
    """Tables of the normal form: for each mark the letters that compose with it and what they become; the marks, and
    letters in the order of their classes; letters that are composed themselves with what they consist of; and
    single characters that another one stands for, with that one."""
    pairs, whole, classes, singles = {}, {}, {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if rank := unicodedata.combining(c):
            classes[c] = chr(0x100 + rank)
        parts = unicodedata.decomposition(c).split()
        if not parts or parts[0].startswith("<"):
            continue
        form = unicodedata.normalize("NFC", c)
        if form == c and len(parts) == 2:
            a, b = (chr(int(x, 16)) for x in parts)
            if unicodedata.combining(b) and not unicodedata.combining(a):
                pairs.setdefault(b, []).append((a, c))
                whole[c] = unicodedata.normalize("NFD", c)
        elif len(form) == 1 and form != c:
            singles[c] = form
    by_mark = [(m, *map("".join, zip(*found))) for m, found in sorted(pairs.items(), key=lambda x: -len(x[1]))]
    return by_mark, ("".join(classes), "".join(classes.values())), whole, ("".join(singles), "".join(singles.values()))


def nfc(c: Column) -> Column:
    """Text in its composed normal form: a letter and the marks behind it become one character where there is one.

    Texts without a combining mark or a character that another one stands for, found by one search, are
    returned as they are. Left as they are: marks of class 0, which a few Indic letters consist of, conjoining Hangul letters,
    and the characters that the form takes apart; ``nfc_exact`` knows these.
    """
    by_mark, (marks, ranks), whole, (source, target) = _composition()

    def table(entries):  # a constant to the planner
        return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in entries)), F.lit("\x01"), F.lit("\x02"))

    def with_mark(letter: Column, mark: Column) -> Column:
        letters, becomes = table((m, a) for m, a, _ in by_mark), table((m, b) for m, _, b in by_mark)
        return bound(F.instr(F.coalesce(F.element_at(letters, mark), F.lit("")), letter), lambda k: F.when(k > 0, F.substring(F.element_at(becomes, mark), k, F.lit(1))).otherwise(letter))

    def apart(letter: Column) -> Column:
        return F.coalesce(F.element_at(table(whole.items()), F.substring(letter, 1, 1)), F.substring(letter, 1, 1))

    def composed(letter: Column) -> Column:
        # a letter that is composed already is taken apart; plain ones are most, and cost nothing
        plain = F.when(F.ascii(letter) < 128, letter).otherwise(F.concat(apart(letter), F.substr(letter, F.lit(2))))

        def fold_marks(chars: Column) -> Column:
            ranked = F.transform(F.slice(chars, 2, F.size(chars)), lambda m, i: F.struct(F.translate(m, marks, ranks).alias("rank"), i.alias("i"), m.alias("mark")))

            def step(done: Column, m: Column) -> Column:
                free = (done["rest"] == "") | (done["last"] < m["rank"])

                def joined(one: Column) -> Column:
                    fits = one != done["letter"]
                    return F.struct(one.alias("letter"), F.when(fits, done["rest"]).otherwise(F.concat(done["rest"], m["mark"])).alias("rest"), F.when(fits, done["last"]).otherwise(m["rank"]).alias("last"))

                return bound(F.when(free, with_mark(done["letter"], m["mark"])).otherwise(done["letter"]), joined)

            start = F.struct(F.element_at(chars, 1).alias("letter"), F.lit("").alias("rest"), F.lit("").alias("last"))
            fold = lambda m: F.when(~F.exists(m, lambda x: x["rank"] == x["mark"]), F.aggregate(m, start, step, lambda d: F.concat(d["letter"], d["rest"])))
            return F.coalesce(bound(F.array_sort(ranked), fold), letter)

        return bound(F.split(plain, ""), fold_marks)

    def compose(t: Column) -> Column:
        letters = F.transform(F.regexp_extract_all(t, F.lit(r"(\P{M}\p{M}+)"), F.lit(1)), composed)
        return F.array_join(F.flatten(F.zip_with(F.split(t, r"\P{M}\p{M}+"), letters, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")

    single = F.replace(F.translate(c, source, target), F.lit("\u0344"), F.lit("\u0308\u0301"))
    # marks start at U+0300: what is below is settled by one comparison
    return F.when(c.rlike(rf"[\x{{0300}}-\x{{10FFFF}}&&[\p{{M}}{_SINGLES}]]"), bound(single, compose)).otherwise(c)


def words(c: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def folded_words(c: Column) -> Column:
    """The words of the folded text as one text with single blanks between them; one may stand at either end."""
    return F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " ")


def tokens(c: Column) -> Column:
    """Folded words of two or more characters that are no stop words, then pairs of kept neighbours."""
    kept = F.filter(words(fold(c)), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))

    def with_pairs(k: Column) -> Column:
        return F.concat(k, F.when(F.size(k) > 1, F.zip_with(F.slice(k, 1, F.size(k) - 1), F.slice(k, 2, F.size(k)), lambda a, b: F.concat_ws("_", a, b))).otherwise(F.array().cast("array<string>")))

    return bound(kept, with_pairs)


def bound(c: Column, f) -> Column:
    """``f`` of a column that is evaluated once, however often ``f`` uses it."""
    return F.transform(F.array(c), f)[0]


def citation_key(c: Column) -> Column:
    """A document number in one spelling: no marks, D for its barred form, letters and digits only, upper case."""
    return F.upper(F.regexp_replace(F.translate(strip_marks(c), "Đđ", "Dd"), r"[^\p{L}\p{N}]", ""))


def compact(c: Column) -> Column:
    """In normal form, without white space, in upper case; marks are kept."""
    return F.upper(F.regexp_replace(nfc(c), WS + "+", ""))


def collapse(c: Column) -> Column:
    # a single blank stays: only other runs are replaced
    return F.trim(F.regexp_replace(c, WS + "{2,}|[" + WS + "&&[^ ]]", " "))


def collapse_lines(c: Column) -> Column:
    """As ``collapse`` for each line, but that a blank may be left at either end of a line."""
    return F.regexp_replace(c, "[" + WS + r"&&[^\n]]{2,}|[" + WS + r"&&[^ \n]]", " ")


def normalise_line(c: Column) -> Column:
    """In normal form, runs of blanks as one blank, none at either end."""
    return F.trim(F.regexp_replace(nfc(c), r"[ \t\x{00A0}]{2,}|[\t\x{00A0}]", " "))


def running_key(c: Column) -> Column:
    """A line with every number replaced, so that page numbers do not tell running lines apart."""
    return F.regexp_replace(c, r"[0-9]+", "#")


def slug(c: Column) -> Column:
    """The ASCII letters and digits of a number, lower case, 40 at most; ``vanban`` if there are none."""
    kept = F.substring(F.regexp_replace(F.lower(nfc(c)), "[^a-z0-9]", ""), 1, 40)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("vanban"))


def _number(text: Column) -> Column:
    value = F.expr("try_cast(null as long)") if text is None else text.try_cast("long")
    return F.when(value > 0, value)


def heading_article_number(c: Column) -> Column:
    """Article number at the start of a heading; a word character of ASCII after it makes it none."""
    return _number(F.nullif(F.regexp_extract(nfc(c), r"^Điều" + WS + r"+([0-9]+)(?![0-9A-Za-z_])", 1), F.lit("")))


def own_article_number(c: Column) -> Column:
    """Article number at the start, blanks before it allowed, whatever follows."""
    return _number(F.nullif(F.regexp_extract(c, "^" + WS + "*Điều" + WS + "+([0-9]+)", 1), F.lit("")))


def referenced_article_number(c: Column) -> Column:
    """The last article number in a heading behind its own."""
    body = F.regexp_replace(c, "^" + WS + "*Điều" + WS + "+[0-9]+" + WS + "*[.:]?", "")
    return _number(F.try_element_at(F.regexp_extract_all(body, F.lit("Điều" + WS + "+([0-9]+)"), F.lit(1)), F.lit(-1)))


def gazette_article_number(c: Column) -> Column:
    """Article number of a line that opens an article: a point or colon must follow."""
    return _number(F.nullif(F.regexp_extract(c, r"^Điều" + WS + r"+([0-9]+)" + WS + r"*[.:]", 1), F.lit("")))


def _iso(c: Column, pattern: str) -> Column:
    def part(k):
        return F.regexp_extract(c, pattern, k)

    return F.when(part(3) != "", F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))


def iso_from_spoken_date(c: Column) -> Column:
    """ISO text of the first date written out in words, else of the first with slashes or dashes; not checked
    against the calendar."""
    return F.coalesce(
        _iso(c, "(?iu)ngày[ ]+([0-9]{1,2})[ ]+tháng[ ]+([0-9]{1,2})[ ]+năm[ ]+([0-9]{4})"),
        _iso(c, "(?iu)ngày[ ]+([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})"),
    )


def iso_from_day_month_year(c: Column) -> Column:
    return _iso(F.trim(c), "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$")


def date_part(c: Column) -> Column:
    return F.when(F.length(c) >= 10, F.substring(c, 1, 10))


def decode_entities(c: Column) -> Column:
    """Numeric entities first, then the named ones, the ampersand last."""

    def char(e: Column) -> Column:
        hex_digits = F.regexp_extract(e, "^&#x([0-9a-fA-F]+);$", 1)
        code = F.when(hex_digits != "", F.conv(hex_digits, 16, 10).try_cast("int")).otherwise(F.regexp_extract(e, "^&#([0-9]+);$", 1).try_cast("int"))
        low, mid, high = code.bitwiseAND(0x3F), F.shiftright(code, 6).bitwiseAND(0x3F), F.shiftright(code, 12)
        top = F.shiftright(code, 18)
        return (
            F.when(code < 0x80, F.decode(F.unhex(F.lpad(F.hex(code), 2, "0")), "UTF-8"))
            .when(code < 0x800, F.decode(F.unhex(F.concat(F.hex(F.shiftright(code, 6) + 0xC0), F.hex(low + 0x80))), "UTF-8"))
            .when(code < 0x10000, F.decode(F.unhex(F.concat(F.hex(high + 0xE0), F.hex(mid + 0x80), F.hex(low + 0x80))), "UTF-8"))
            .when(code < 0x110000, F.decode(F.unhex(F.concat(F.hex(top + 0xF0), F.hex(high.bitwiseAND(0x3F) + 0x80), F.hex(mid + 0x80), F.hex(low + 0x80))), "UTF-8"))
            .otherwise(e)
        )

    pattern = r"(&#x[0-9a-fA-F]+;|&#[0-9]+;)"
    plain = F.split(c, pattern)
    marks = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), char)
    joined = F.array_join(F.flatten(F.zip_with(plain, marks, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    out = F.when(c.contains("&#"), joined).otherwise(c)
    for name, char_ in (("&nbsp;", " "), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char_))
    return out


def html_to_text(c: Column) -> Column:
    """Line breaks for br, tags dropped, entities decoded, blanks before line ends and at both ends removed."""
    plain = decode_entities(F.regexp_replace(F.regexp_replace(c, r"<br\s*/?>", "\n"), "<[^>]+>", ""))
    return F.regexp_replace(F.regexp_replace(F.translate(plain, " ", " "), "[ \t]+\n", "\n"), f"^{WS}+|{WS}+$", "")


def plain_text(c: Column) -> Column:
    """Text of a page in normal form: scripts, styles and tags as blanks, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(c, r"(?s)<script.*?</script>", " "), r"(?s)<style.*?</style>", " ")
    return nfc(collapse(F.replace(F.regexp_replace(out, "<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" "))))


def subject_of(c: Column) -> Column:
    """The first eight words, a final point or semicolon taken off before."""
    return F.array_join(F.slice(F.split(F.regexp_replace(c, "[.;]$", ""), WS + "+"), 1, 8), " ")


def round_half_up(c: Column, places: int = 3) -> Column:
    scale = 10**places
    return F.floor(c * scale + 0.5) / scale


def match_band(similarity: Column) -> Column:
    """How well a quotation matches: not checked, exact from .995, close from .9, else different."""
    return F.when(similarity.isNull(), "not_checked").when(similarity >= 0.995, "exact").when(similarity >= 0.9, "close").otherwise("different")


def extension_for(content_type: Column, url: Column) -> Column:
    """File extension by content type, else by the path of the URL, else bin."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    tail = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"\.([A-Za-z0-9]{1,5})$", 1)
    out = F.when(kind.contains("application/pdf"), "pdf").when(kind.contains("text/html"), "html").when(kind.contains("text/x-component"), "rsc.txt")
    return out.when(kind.contains("text/plain"), "txt").when(kind.contains("application/json"), "json").when(tail != "", F.lower(tail)).otherwise("bin")


def looks_like_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def permanent_citation(path: Column) -> Column:
    """(article, valid_at) of the last part of a permanent citation path, ``dieu-<n>@<date>``."""
    n = F.regexp_extract(path, r"dieu-([0-9]+)@([0-9]{4}-[0-9]{2}-[0-9]{2})$", 1)
    return F.struct(F.nullif(n, F.lit("")).try_cast("int").alias("article"), F.nullif(F.regexp_extract(path, r"dieu-([0-9]+)@([0-9]{4}-[0-9]{2}-[0-9]{2})$", 2), F.lit("")).alias("valid_at"))


def _normaliser(form: str):
    @arrow_udf("string")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in text.to_pylist()], pa.string())

    return run


def nfc_exact(c: Column) -> Column:
    return _normaliser("NFC")(c)


def nfd(c: Column) -> Column:
    return _normaliser("NFD")(c)
