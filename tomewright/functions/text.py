"""Text predicates and transforms as Column expressions.

Missing values are false in predicates, never unknown: a negated term must match
rows that lack the field.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sure(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def infix(hay: Column, needle: str) -> Column:
    """Case-insensitive substring."""
    return sure(F.contains(F.lower(hay), F.lit(needle.lower())))


def infix_word(hay: Column, needle: str) -> Column:
    """The same between ends of the text or characters outside A-Z, a-z, 0-9 and _."""
    quoted = re.sub(r"[^\w\s]", lambda m: "\\" + m[0], needle)
    return sure(hay.rlike(rf"(?iu)(^|\W){quoted}($|\W)"))


def without_case(a: Column) -> Column:
    """A text that compares by letters and accents, however these are coded, not by case."""
    return F.collate(a, "UNICODE_CI")


def in_language(a: Column) -> Column:
    """A text that sorts by letters first, then by accents, then small before capital."""
    return F.collate(a, "UNICODE")


def same(a: Column, b: str) -> Column:
    """Equal but for case, and as long; accents count."""
    return sure((F.length(a) == len(b)) & (without_case(a) == without_case(F.lit(b))))


def truthy(c: Column, kind: str) -> Column:
    """Set and neither false, zero, NaN nor empty."""
    if kind == "boolean":
        return sure(c)
    if kind == "string":
        return sure(c != "")
    if kind in ("float", "double"):
        return sure((c != 0) & ~F.isnan(c))
    if kind.startswith(("int", "bigint", "smallint", "tinyint", "decimal")):
        return sure(c != 0)
    return c.isNotNull()


def full_text(term: str, *fields: Column) -> Column:
    """``/x`` finds the substring x, ``//x`` the word x, in any field."""
    if not term.startswith("/"):
        return F.lit(False)
    hits = [infix_word(f, term[2:]) if term.startswith("//") else infix(f, term[1:]) for f in fields]
    return sure(F.coalesce(F.greatest(*hits, F.lit(False), F.lit(False)), F.lit(False))) if hits else F.lit(False)


def slug(name: Column) -> Column:
    """Spaces, slashes and colons to hyphens; ASCII without apostrophes; lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "[ /:]", "-"), r"[^\x00-\x7E]|'", ""))


def content_tag(content: Column) -> Column:
    """The first three bytes of the MD5 in upper-case hexadecimal."""
    return F.upper(F.substring(F.md5(content), 1, 6))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def unwrap_links(html: Column) -> Column:
    """Without anchors (their content stays), white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?i)</?a(\s[^>]*)?>", ""), r"[ \t\r\n]+", " "))


def links(html: Column, part: str) -> Column:
    """Trimmed texts of anchors whose address contains ``part``; names that end
    in a closing parenthesis are variants and left out."""
    found = F.regexp_extract_all(html, F.lit(rf'<a [^>]*href="[^"]*{re.escape(part)}[^"]*"[^>]*>([^<]*)</a>'), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: ~x.endswith(")"))


def squeeze(text: Column) -> Column:
    """Runs of one character become one."""
    return F.regexp_replace(text, r"(?s)(.)\1+", "$1")


def occurrences(text: Column, needle: str) -> Column:
    """The places, from 0, at which ``needle`` stands, overlapping ones too."""
    last = F.length(text) - len(needle)
    here = lambda i: F.substring(text, i.cast("int") + 1, F.lit(len(needle))) == needle
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0).cast("long"), last.cast("long")), here)).otherwise(F.array().cast("array<bigint>"))


def split_first(text: Column, separator: str) -> Column:
    """``left`` and ``right`` of the first ``separator``, without the white space
    around them; without a separator ``right`` is null."""
    at = F.instr(text, separator)
    bare = lambda x: F.regexp_replace(x, r"^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+\z", "")
    left = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    return F.struct(bare(left).alias("left"), F.when(at > 0, bare(F.substring(text, at + len(separator), F.length(text)))).alias("right"))


def indices_where(items: Column, holds: Callable[[Column], Column]) -> Column:
    """The places, from 0, of the items for which ``holds`` is true; null for a null array."""
    return F.array_compact(F.transform(items, lambda x, i: F.when(holds(x), i)))


def first_index(items: Column, holds: Callable[[Column], Column]) -> Column:
    """The first of these places, -1 where there is none."""
    return (F.array_position(F.transform(items, holds), True) - 1).cast("int")


#: Characters and their entities.
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}


def html_encode(text: Column) -> Column:
    """The five markup characters and U+00A0 to U+00FF as entities."""
    for char, entity in ENTITIES.items():
        text = F.replace(text, F.lit(char), F.lit(entity))
    high = lambda c: F.when(c.between("\u00a0", "\u00ff") & (F.length(c) == 1), F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c)
    coded = F.array_join(F.transform(F.split(text, ""), high), "")
    return F.when(text.rlike(r"[\u00a0-\u00ff]"), coded).otherwise(text)


def ordinal(i: Column) -> Column:
    """1st, 2nd, 3rd, 4th ...; beyond 20 the last digit decides, so 111st."""
    d = F.when(i <= 20, i).otherwise(i % 10)
    ending = F.when(d == 1, "st").when(d == 2, "nd").when(d == 3, "rd").otherwise("th")
    return F.concat(i.cast("string"), ending)


def camel_to_title(word: str) -> str:
    """``castingTime`` to ``Casting Time``."""
    parts = re.split(r"(?=[A-Z])", word)
    return " ".join([parts[0][:1].upper() + parts[0][1:], *parts[1:]])


def natural_join(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    last = F.element_at(items, -1)
    return F.when(n == 0, "").when(n == 1, last).when(n == 2, F.concat_ws(" and ", items)).otherwise(F.concat(head, F.lit(", and "), last))


def key_values(pairs: list[tuple[str, Column]]) -> Column:
    """``key: value`` lines of the fields that are set."""
    each = F.array(*[F.when(sure(v.cast("string") != ""), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in pairs])
    return F.array_join(F.array_compact(each), "\n")


def markdown_inline(text: Column) -> Column:
    """Links, strong, emphasis and backslash escapes of one line as HTML."""
    for pattern, into in (
        (r"\[([^\]\[]*)\]\([^()]*\)", "$1"),
        (r"(\*\*|__)(.+?)\1", "<strong>$2</strong>"),
        (r"(\*|_)(.+?)\1", "<em>$2</em>"),
        (r"\\([\\*_\[\]()#!-])", "$1"),
    ):
        text = F.regexp_replace(text, pattern, into)
    return text


def markdown_lines(text: Column) -> Column:
    """Line by line: rules, headings, list items (ordered ones too go into <ul>)
    and paragraphs; empty lines vanish."""

    def line(x: Column) -> Column:
        inner = markdown_inline(F.trim(x))
        head = F.regexp_extract(x, r"^(#{1,6}) +(.*)$", 1)
        item = F.regexp_extract(x, r"^[ \t]*(?:[*-]|[1-9][0-9]*\.) +(.*)$", 1)
        level = F.length(head).cast("string")
        title = markdown_inline(F.trim(F.regexp_extract(x, r"^(#{1,6}) +(.*)$", 2)))
        return (
            F.when(F.trim(x) == "", "")
            .when(x.rlike(r"^-{3,}[ \t]*$"), "<hr/>")
            .when(head != "", F.concat(F.lit("<h"), level, F.lit(">"), title, F.lit("</h"), level, F.lit(">")))
            .when(item != "", F.concat(F.lit("<ul><li>"), markdown_inline(item), F.lit("</li></ul>")))
            .otherwise(F.concat(F.lit("<p>"), inner, F.when(x.endswith("  "), "<br/>").otherwise(""), F.lit("</p>")))
        )

    return F.array_join(F.array_remove(F.transform(F.split(text, "\n"), line), ""), "")


def latex_plain(text: Column) -> Column:
    """Comments, macro names, braces and dollar signs out; white space squeezed
    inside lines. Line ends add no space."""
    for pattern, into in ((r"(?m)(?<!\\)%.*$", ""), (r"\\[A-Za-z0-9]+[ \t]*", ""), (r"\\([{}%&$#_])", "$1"), (r"[{}$]", ""), (r"[ \t]+", " "), (r"\n", "")):
        text = F.regexp_replace(text, pattern, into)
    return text


def entry_url(name: Column, source: Column) -> Column:
    """The address of an entry's page, its parts coded with %20 for spaces."""
    coded = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("details.html?name="), coded(name), F.lit("&from="), coded(source))


def after_rule(text: Column) -> Column:
    """What stands after the first ``---``, the body of a stored hit; null without one."""
    at = F.locate("---", text)
    return F.when(at > 0, F.substring(text, at + 3, F.length(text)))


#: Tags that stay as they are.
PLAIN_TAGS = ["br", "ol", "ul", "li", "tr", "td", "table"]


def tags_as_html(text: Column) -> Column:
    """Titles, action costs, rows and documents as plain tags. ``ok`` is false
    where a tag is left that has no meaning, or one has other attributes than its own."""
    into = [  # fixed values: what each tag becomes
        (r'<title\s+level="[^"]*"\s*>', "<h4>"), ("</title>", "</h4>"), (r'<actions\s+string="([^"]*)"\s*/>', '<img src="/img/$1.png" />'),
        (r"<row(\s[^<>]*)?>", "<br/>"), ("</row>", ""), (r"<document(\s[^<>]*)?>", ""),
    ]
    html, rest = text, F.regexp_replace(text, rf"</?({'|'.join(PLAIN_TAGS)})(\s[^<>]*)?/?>", "")
    for pattern, new in into:
        html, rest = F.regexp_replace(html, pattern, new), F.regexp_replace(rest, pattern, "")
    return F.struct((~rest.rlike("</?[A-Za-z][^<>]*>")).alias("ok"), html.alias("html"))


def find_window(text: Column, options: list[tuple[str, str, str]], hidden: str = "") -> Column:
    """(at, width) of the first place where an option (before, pattern, after)
    fits, without what stands before and after; null without one. ``#`` is no
    letter or digit, ``.`` anything, a space white space; other characters stand
    for themselves in any case. At one place the first option counts. The character
    ``hidden`` fits nothing: with ``levels.base_level`` windows are found at the
    base level only."""
    special = {"#": rf"[^\p{{L}}\p{{N}}{hidden}]", ".": f"[^{hidden}]" if hidden else "(?s:.)", " ": r"\s"}
    places = []
    for i, option in enumerate(options):
        fits = "(?iu)" + "".join(special.get(c) or re.escape(c) for c in "".join(option))
        start = F.regexp_instr(text, F.lit(fits)) - 1
        places.append(F.when(start >= 0, F.struct(start.alias("start"), F.lit(i).alias("i"), (start + len(option[0])).alias("at"), F.lit(len(option[1])).alias("width"))))
    first = F.array_min(F.array(*places))
    return F.when(first.isNotNull(), F.struct(first["at"].alias("at"), first["width"].alias("width")))


def split_by(items: Column, separator, no_empty: bool = False) -> Column:
    """Groups of a short array of strings between separators. A last group counts
    if it has items. With ``no_empty`` a separator that would end an empty group
    is an item itself."""
    none, word = F.array().cast("array<array<string>>"), F.array().cast("array<string>")
    state = lambda done, now: F.struct(done.alias("done"), now.alias("now"))

    def step(acc: Column, x: Column) -> Column:
        ends = separator(x) & (F.size(acc["now"]) > 0) if no_empty else separator(x)
        return F.when(ends, state(F.concat(acc["done"], F.array(acc["now"])), word)).otherwise(state(acc["done"], F.concat(acc["now"], F.array(x))))

    return F.aggregate(items, state(none, word), step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))
