"""Text, JSON and list expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_or_csv(c: Column) -> Column:
    """A column that holds a JSON list or words with commas, as an array; null and empty give an empty one."""
    parsed = F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, r"\s*,\s*"))
    return F.filter(F.coalesce(F.when(F.coalesce(c, F.lit("")) != "", parsed), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def first_wins(items: Column) -> Column:
    """SET-03. The items in order, without those that an earlier one equals in lower case; by sorting, so that long lists do too."""
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    firsts = F.transform(F.array(keyed), lambda a: F.filter(a, lambda x, i: F.coalesce(F.get(a, i - 1)["k"] != x["k"], F.lit(True))))[0]
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda x: x["x"])


def tsv_cell(c: Column, drop_returns: bool = False) -> Column:
    """SNK-04. A cell without tabs and line ends."""
    return F.translate(F.coalesce(c, F.lit("")), "\t\n\r", "  " if drop_returns else "   ")


def tsv_line(*cells: Column, drop_returns: bool = False) -> Column:
    return F.concat_ws("\t", *(tsv_cell(c.cast("string"), drop_returns) for c in cells))


def escaped(c: Column) -> Column:
    """Text as HTML; the ampersand first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def links(html: Column) -> Column:
    """SRC-08. The targets and texts of a page's links."""
    pattern = F.lit(r'<a href="([^"]*)">([^<]*)</a>')
    return F.arrays_zip(F.regexp_extract_all(html, pattern, 1).alias("href"), F.regexp_extract_all(html, pattern, 2).alias("label"))


def extension(path: Column) -> Column:
    """FLT-13. The extension in lower case with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


#: Endings of a name that mark an edit, after a hyphen, underscore or space.
EDIT_MARKS = ["edit", "edited", "edits", "final", "export", "exported", r"v\d+", "hires", "hi-res", "web", "print", "color", "bw", "b&w", "retouched", "enhanced"]


def stem(path: Column) -> Column:
    """The file's name in lower case without its extension and one edit mark at its end; a name that is nothing but a mark stays."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    base = F.regexp_replace(name, rf"(?i)[-_\s]({'|'.join(EDIT_MARKS)})$", "")
    return F.lower(F.when(base == "", name).otherwise(base))


def unescaped(c: Column) -> Column:
    """Text with its character references decoded, each once: by decimal or hexadecimal number, and by HTML 4's names and apos.

    A reference ends in a semicolon; others, and names that there aren't, stay as they are. Numbers that are no character give U+FFFD.
    """
    signs = {"amp": 38, "lt": 60, "gt": 62, "quot": 34, "nbsp": 160, **name2codepoint, "apos": 39}  # a map is searched from its start
    names = F.create_map(*(F.lit(x) for name, n in signs.items() for x in (name, chr(n))))

    # each step is asked for once: an expression that stands in several places of a lambda is computed in each

    def cut(part: Column, i: Column) -> Column:
        return F.struct(part.alias("part"), F.when(i > 0, F.regexp_extract(part, r"^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)).alias("ref"))

    def numbered(x: Column) -> Column:
        number = F.when(x["ref"].startswith("#"), F.when(x["ref"].rlike("^#[xX]"), F.conv(F.substring(x["ref"], 3, 9), 16, 10)).otherwise(F.substring(x["ref"], 2, 9)).cast("long"))
        return F.struct(x["part"].alias("part"), x["ref"].alias("ref"), number.alias("number"))

    def decoded(x: Column) -> Column:
        valid = x["number"].between(1, 0x10FFFF) & ~x["number"].between(0xD800, 0xDFFF)
        number = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, x["number"]).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        sign = F.when(x["number"].isNotNull(), number).when(x["ref"] != "", F.element_at(names, x["ref"]))
        return F.when(x["ref"].isNull(), x["part"]).otherwise(F.coalesce(F.concat(sign, F.substr(x["part"], F.length(x["ref"]) + 2)), F.concat(F.lit("&"), x["part"])))

    return F.array_join(F.transform(F.transform(F.transform(F.split(c, "&"), cut), numbered), decoded), "")


def embedded_json(c: Column) -> Column:
    """The part of a text from its first opening to its last closing brace, as a model's answer holds JSON; null without one."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def caption_issues(caption: Column, hashtags: Column, most: int = 2200, most_tags: int = 30) -> Column:
    """What keeps a post from being published."""
    body = F.concat_ws("\n\n", F.nullif(caption, F.lit("")), F.nullif(F.concat_ws(" ", hashtags), F.lit("")))
    found = [
        F.when(F.coalesce(F.trim(caption), F.lit("")) == "", "no caption"),
        F.when(F.length(body) > most, "too long"),
        F.when(F.size(hashtags) > most_tags, "too many hashtags"),
    ]
    return F.array_compact(F.array(*found))


def money(x: Column) -> Column:
    return F.format_number(x, 2)
