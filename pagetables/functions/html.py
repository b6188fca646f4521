"""HTML as Spark expressions: a stored page becomes marked text, and marked text is
split into tables, rows, cells, tags and lines. Built-in functions only, so every step
is narrow.

Marked text is the page without scripts, styles and comments, with entities decoded
and each tag written as OPEN + tag + SHUT. OPEN and SHUT occur nowhere else, so '<',
'>' and '&' in the text need no more care.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetables.functions.text import let, nonblank, strip

OPEN, SHUT = "\u0001", "\u0002"

# A tag up to its '>'; a '>' inside a quoted value does not count.
TAG = r"""<(/?[a-zA-Z][^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+)>"""
COMMENT = r"(?s)<!(?:--.*?(?:-->|\z)|[^>]*+>)"
HIDDEN = (r"(?is)<(?=[s!\u017f])(?:script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)"
          r"|!--.*?(?:-->|\z)|![^>]*+>)")
HEAD = rf"(?is){OPEN}head\b.*?{OPEN}/head\s*{SHUT}"
BLOCKS = ("br|p|div|li|ul|ol|tr|table|tbody|thead|tfoot|caption|h[1-6]|section|article|header"
          "|footer|main|aside|nav|form|hr|dl|dt|dd|blockquote|pre|address|body|html|figure"
          "|fieldset|option|select")
BLOCK_TAG = rf"(?i){OPEN}/?(?!t[dh]\b)(?:{BLOCKS})\b[^{SHUT}]*{SHUT}"
CELL_TAG = rf"(?i){OPEN}/?t[dh]\b[^{SHUT}]*{SHUT}"
SPACE_RUN = r"[ \t\r\n\f]{2,}|[\t\r\n\f]"
ANY_TAG = f"{OPEN}[^{SHUT}]*{SHUT}"


# --- marked text ---------------------------------------------------------------

def marked(html: Column, hidden: str = HIDDEN) -> Column:
    """Marked text of a page; ``hidden`` is the pattern of what is left out."""
    # 'translate' looks up character by character, so it is left to pages that need it
    taken = F.contains(html, F.lit(OPEN)) | F.contains(html, F.lit(SHUT))
    clear = F.when(taken, F.translate(html, OPEN + SHUT, "")).otherwise(html)
    bare = F.regexp_replace(clear, hidden, "")
    return decode_entities(F.regexp_replace(bare, TAG, f"{OPEN}$1{SHUT}"))


def decode_entities(c: Column) -> Column:
    """Named (HTML 4) and numeric entities in one pass; a no-break space becomes a space."""
    return let(c, lambda x: F.replace(
        F.when(F.contains(x, F.lit("&")), _decode(x)).otherwise(x), F.lit("\u00a0"), F.lit(" ")))


def _decode(c: Column) -> Column:
    common = c
    for name, char in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"),
                       ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        common = F.replace(common, F.lit(name), F.lit(char))
    other = c.rlike(r"&(?!(?:nbsp|lt|gt|quot|amp|#39);)#?[0-9a-zA-Z]+;")
    return F.when(other, F.array_join(F.transform(F.split(c, "&"), _decode_piece), "")).otherwise(
        common)


def _decode_piece(piece: Column, i: Column) -> Column:
    """What follows an '&'; the first piece follows none."""
    name = F.substring_index(piece, ";", 1)
    char = F.when(F.contains(piece, F.lit(";")), F.coalesce(
        F.try_element_at(_named_characters(), name), _numbered_character(name)))
    return F.when(i == 0, piece).otherwise(F.coalesce(
        F.concat(char, F.substr(piece, F.length(name) + 2)),
        F.concat(F.lit("&"), piece)))


def _named_characters() -> Column:
    pairs = " ".join(f"{n}={chr(code)}" for n, code in name2codepoint.items())
    return F.str_to_map(F.lit(pairs), F.lit(" "), F.lit("="))


def _numbered_character(name: Column) -> Column:
    n = F.when(
        name.rlike("^#[xX][0-9a-fA-F]{1,6}$"),
        F.conv(F.substring(name, 3, 6), 16, 10).try_cast("int"),
    ).when(name.rlike("^#[0-9]{1,7}$"), F.substring(name, 2, 7).try_cast("int"))
    valid = n.between(3, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


# --- text ------------------------------------------------------------------------

def inner_text(fragment: Column) -> Column:
    """Text as laid out: block tags and <br> end a line, cells are one space apart."""
    flat = F.regexp_replace(fragment, SPACE_RUN, " ")
    lines = F.regexp_replace(flat, BLOCK_TAG, "\n")
    text = F.regexp_replace(F.regexp_replace(lines, CELL_TAG, " "), ANY_TAG, "")
    return strip(F.regexp_replace(F.regexp_replace(text, " *\n[ \n]*", "\n"), "  +", " "))


def stored_text(fragment: Column) -> Column:
    """Text as stored: tags removed, nothing put in their place."""
    return F.regexp_replace(fragment, ANY_TAG, "")


def body_text(page: Column) -> Column:
    """Text of the body as laid out."""
    return inner_text(F.regexp_replace(page, HEAD, ""))


def text_lines(text: Column) -> Column:
    """Non-empty trimmed lines."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def title(page: Column) -> Column:
    return F.regexp_extract(
        page, rf"(?is){OPEN}title\b[^{SHUT}]*{SHUT}(.*?){OPEN}/title", 1)


# --- tables, rows, cells -----------------------------------------------------------

def _from_second(pieces: Column) -> Column:
    return F.slice(pieces, 2, F.size(pieces))


def tables(page: Column) -> Column:
    """Table fragments in the order of their tags. A row belongs to the innermost
    table around it."""
    def cut(opened):
        return F.transform(_from_second(opened), lambda s: F.concat(
            F.lit(f"{OPEN}table"), F.get(F.split(s, f"(?i){OPEN}/table", 2), F.lit(0))))

    def each_closed_before_next(opened):
        return F.forall(
            F.slice(opened, 2, F.greatest(F.size(opened) - 2, F.lit(0))),
            lambda s: s.rlike(f"(?i){OPEN}/table"))

    return let(F.split(page, rf"(?i){OPEN}table\b"), lambda opened: F.when(
        each_closed_before_next(opened), cut(opened)).otherwise(
        _nested_tables(F.split(page, rf"(?i)(?={OPEN}/?table\b)"))))


def _nested_tables(pieces: Column) -> Column:
    """Give every piece between table tags to the innermost open table."""
    start = F.struct(F.array().cast("array<int>").alias("open"),
                     F.lit(0).alias("seen"),
                     F.array().cast("array<struct<piece:string,owner:int>>").alias("owned"))

    def step(acc, piece):
        opens = piece.rlike(f"(?i)^{OPEN}table")
        closes = piece.rlike(f"(?i)^{OPEN}/table")
        stack = (F.when(opens, F.concat(acc["open"], F.array(acc["seen"])))
                 .when(closes & (F.size(acc["open"]) > 0),
                       F.slice(acc["open"], 1, F.greatest(F.size(acc["open"]) - 1, F.lit(0))))
                 .otherwise(acc["open"]))
        return let(stack, lambda s: F.struct(
            s.alias("open"),
            (acc["seen"] + opens.cast("int")).alias("seen"),
            F.concat(acc["owned"], F.array(F.struct(
                piece.alias("piece"),
                F.coalesce(F.get(s, F.size(s) - 1), F.lit(-1)).alias("owner")))).alias("owned")))

    return let(F.aggregate(pieces, start, step), lambda o: F.transform(
        F.filter(F.sequence(F.lit(0), o["seen"]), lambda t: t < o["seen"]),
        lambda t: F.array_join(F.transform(
            F.filter(o["owned"], lambda p: p["owner"] == t), lambda p: p["piece"]), "")))


def rows(table: Column) -> Column:
    """Row fragments of a table; a missing </tr> ends at the next <tr>."""
    return F.transform(
        _from_second(F.split(table, rf"(?i){OPEN}tr\b")),
        lambda r: F.concat(F.lit(f"{OPEN}tr"), F.get(F.split(r, rf"(?i){OPEN}/tr\b", 2), F.lit(0))))


def cell_pieces(row: Column) -> Column:
    """Cells of a row as 'td ..' or 'th ..' fragments without OPEN; a missing end tag
    ends the cell at the next cell."""
    return F.transform(
        _from_second(F.split(row, rf"(?i){OPEN}(?=t[dh]\b)")),
        lambda c: F.get(F.split(c, rf"(?i){OPEN}/t[dh]\b", 2), F.lit(0)))


def cell_kind(piece: Column) -> Column:
    return F.lower(F.substring(piece, 1, 2))


def cell_text(piece: Column) -> Column:
    """Text after the cell's own tag; most cells hold no further tag."""
    content = F.substr(piece, F.locate(SHUT, piece) + 1)
    return let(content, lambda c: F.when(F.contains(c, F.lit(OPEN)), inner_text(c)).otherwise(
        strip(F.regexp_replace(c, SPACE_RUN, " "))))


def cells(row: Column) -> Column:
    """array<struct<kind, text>>, kind 'td' or 'th'."""
    return F.transform(cell_pieces(row), lambda c: F.struct(
        cell_kind(c).alias("kind"), cell_text(c).alias("text")))


def data_cells(row: Column) -> Column:
    """Texts of the td cells."""
    return F.transform(F.filter(cell_pieces(row), lambda c: cell_kind(c) == "td"), cell_text)


def data_cell_count(row: Column) -> Column:
    return F.size(F.split(row, rf"(?i){OPEN}td\b")) - 1


def header_cells(row: Column) -> Column:
    """Lower-case texts of the th cells, else of the td cells."""
    kind = F.when(row.rlike(rf"(?i){OPEN}th\b"), "th").otherwise("td")
    return F.transform(F.filter(cell_pieces(row), lambda c: cell_kind(c) == kind),
                       lambda c: F.lower(cell_text(c)))


# --- tags, attributes, links ---------------------------------------------------------

def tags(page: Column) -> Column:
    """array<struct<tag, text>> of all opening tags in page order; ``text`` is what
    stands directly after the tag."""
    return F.transform(
        _from_second(F.split(page, f"{OPEN}(?=[a-zA-Z])")),
        lambda p: F.struct(
            F.substring_index(p, SHUT, 1).alias("tag"),
            strip(F.substring_index(F.substring_index(
                F.substring_index(p, OPEN, 1), SHUT, 2), SHUT, -1)).alias("text")))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, NULL if absent or empty."""
    pattern = rf"""(?is)^[^{SHUT}]*?[\s"'/]{name}\s*=\s*(?:(["'])(.*?)\1|([^\s"'{SHUT}]+))"""
    return F.coalesce(nonblank(F.regexp_extract(tag, pattern, 2)),
                      nonblank(F.regexp_extract(tag, pattern, 3)))


def attribute_contains(name: str, words: str) -> str:
    """Pattern of a tag with an attribute that contains one of ``words`` ('a|b')."""
    return (rf"""[^{SHUT}]*?[\s"']{name}\s*=\s*(?:"[^"{SHUT}]*?(?:{words})"""
            rf"""|'[^'{SHUT}]*?(?:{words})|[^\s"'{SHUT}]*?(?:{words}))""")


def class_is(word: str) -> str:
    return (rf"""[^{SHUT}]*?[\s"']class\s*=\s*(?:"(?:[^"{SHUT}]*?\s)?{word}[\s"]"""
            rf"""|'(?:[^'{SHUT}]*?\s)?{word}[\s']|{word}(?![^\s{SHUT}]))""")


def first_href(fragment: Column) -> Column:
    """href of the first <a>; NULL if there is none or it has no href."""
    return attribute(F.get(F.split(fragment, rf"(?i){OPEN}(?=a\b)", 3), F.lit(1)), "href")


def resolve_url(href: Column, page_url: Column) -> Column:
    """``href`` as an absolute URL, relative to the page it stands on."""
    return let(strip(href), lambda h: F.when(h.isNotNull(), _resolve(h, page_url)))


def _resolve(href: Column, page_url: Column) -> Column:
    scheme = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    origin = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    no_fragment = F.substring_index(page_url, "#", 1)
    no_query = F.substring_index(no_fragment, "?", 1)
    folder = F.when(no_query.rlike("://[^/]*/"),
                    F.regexp_replace(no_query, "[^/]*$", "")).otherwise(
        F.concat(no_query, F.lit("/")))
    path = (F.when(F.startswith(href, F.lit("/")), F.concat(origin, href))
            .otherwise(F.concat(folder, href)))
    return (F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
            .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
            .when(F.startswith(href, F.lit("#")), F.concat(no_fragment, href))
            .when(F.startswith(href, F.lit("?")), F.concat(no_query, href))
            .when(href.rlike(r"(?:^|/)\.\.?(?:[/?#]|$)"), _without_dots(path))
            .otherwise(path))


def _without_dots(url: Column) -> Column:
    """Resolve '.' and '..' steps of the path."""
    base = F.regexp_extract(url, "^([^?#]*)", 1)
    tail = F.regexp_extract(url, "^[^?#]*(.*)$", 1)

    def step(acc, part):
        return (F.when((part == "..") & (F.size(acc) > 3),
                       F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                .when(part.isin(".", ".."), acc)
                .otherwise(F.concat(acc, F.array(part))))

    parts = F.aggregate(F.split(base, "/"), F.array().cast("array<string>"), step)
    slash = F.when(base.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.concat(F.array_join(parts, "/"), slash, tail)


# --- elements ------------------------------------------------------------------------

def elements(page: Column, names: Column, wanted: Column) -> Column:
    """Fragments of all elements whose name matches the pattern ``names`` and whose tag
    matches ``wanted``; each up to its own end tag, or to the end of the page. Elements
    inside each other are all returned."""
    def starts(pieces):
        return F.filter(
            F.transform(pieces, lambda x, i: F.when(
                ~F.startswith(x, F.lit("/")) & (i > 0) & F.regexp_like(x, wanted), i)),
            lambda i: i.isNotNull())

    def fragment(pieces, i):
        name = F.lower(F.regexp_extract(F.get(pieces, i), "^([a-zA-Z][a-zA-Z0-9]*)", 1))
        rest = F.slice(pieces, i + 2, F.size(pieces))

        def step(acc, x):
            own = F.lower(F.regexp_extract(x, "^/?([a-zA-Z][a-zA-Z0-9]*)", 1)) == acc["name"]
            depth = acc["depth"] + F.when(~own, 0).when(F.startswith(x, F.lit("/")), -1).otherwise(1)
            return F.when(acc["depth"] == 0, acc).otherwise(F.struct(
                acc["name"].alias("name"), depth.alias("depth"),
                (acc["taken"] + F.when(depth == 0, 0).otherwise(1)).alias("taken")))

        start = F.struct(name.alias("name"), F.lit(1).alias("depth"), F.lit(1).alias("taken"))
        taken = F.when(
            F.lower(F.get(pieces, i + 1)).eqNullSafe(F.concat(F.lit("/"), name, F.lit(SHUT))),
            1).otherwise(F.aggregate(rest, start, step)["taken"])
        return F.concat(F.lit(OPEN), F.array_join(F.slice(pieces, i + 1, taken), OPEN))

    cut = F.concat(F.lit(f"(?i){OPEN}(?=/?(?:"), names, F.lit(r")\b)"))
    return let(F.split(page, cut), lambda pieces: F.transform(
        starts(pieces), lambda i: fragment(pieces, i)))


RESULT_KINDS = [
    ("div", attribute_contains("class", "result")),
    ("tr", attribute_contains("class", "result")),
    ("div", attribute_contains("class", "property")),
    ("div", attribute_contains("class", "record")),
    ("[a-zA-Z][a-zA-Z0-9]*", class_is("search-result")),
    ("[a-zA-Z][a-zA-Z0-9]*", class_is("property-result")),
    ("[a-zA-Z][a-zA-Z0-9]*", attribute_contains("id", "result")),
]


def result_kind(page: Column) -> Column:
    """Number of the first kind of result element with more than one member, else NULL."""
    kind = F.lit(None).cast("int")
    for k, (name, where) in reversed(list(enumerate(RESULT_KINDS))):
        members = F.regexp_count(page, F.lit(rf"(?s){OPEN}(?i:{name})\b{where}"))
        kind = F.when(members > 1, k).otherwise(kind)
    return F.when(page.rlike("result|property|record"), kind)


def result_blocks(page: Column, kind: Column) -> Column:
    """Fragments of the result elements of the given kind (``result_kind``)."""
    names = F.array(*[F.lit(name) for name, _ in RESULT_KINDS])
    patterns = F.array(*[F.lit(rf"(?s)^(?i:{name})\b{where}") for name, where in RESULT_KINDS])
    return let(kind, lambda k: F.when(k.isNotNull(), let(F.get(patterns, k), lambda wanted: elements(
        page, F.get(names, k), wanted))).otherwise(F.array().cast("array<string>")))
