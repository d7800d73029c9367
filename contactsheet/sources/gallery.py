"""SRC-08, SNK-05. Galleries as they stand in a page: figures to rows in their order, and rows to figures; each undoes the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactsheet.functions.text import unescaped

#: Layouts, which are also the classes of their figures but for standard, which has none.
LAYOUTS = ["wide", "tall", "reveal-x", "standard"]
BLOCK = r'(?s)<div class="gallery">(.*?)\n\s*</div>'
FIGURE = r'(?s)<figure(?:\s+class="([^"]*)")?><img\s+src="media/([^/]+)/([^"?]+)(?:\?v=([^"]*))?"\s+alt="([^"]*)"([^>]*?)><figcaption>(.*?)</figcaption></figure>'
INDENT = "      "
#: Numbers of sort_index whose figures are put in order and set side by side at once.
PIECE = 4096
PARTS = ["class", "in_section", "file_name", "version", "alt", "extra", "caption"]


def parse_galleries(pages: DataFrame) -> DataFrame:
    """section, sort_index, slug, file_name, layout, alt, caption, version, width, height and error of each figure of pages (section, html).

    sort_index counts from 0 in the page's order. Texts are decoded; a version that isn't there is 2, width and height are null where the
    figure has none. error says what is wrong: another section's file or an unknown class; and a page without a gallery, or with an empty
    one, gives one row with that error alone.
    """
    found = F.regexp_extract_all(F.regexp_extract("html", BLOCK, 1), F.lit(FIGURE), F.lit(0))
    has = F.coalesce(F.col("html").rlike(BLOCK), F.lit(False))
    cut = pages.select("section", has.alias("has"), F.when(has, found).alias("figures"))  # once for a page: beside its figures it would be once for each
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut.select("section", "has", F.posexplode_outer("figures").alias("sort_index", "figure")).repartition(tasks, "section", "sort_index")
    rows = rows.select("*", *(F.regexp_extract("figure", FIGURE, i + 1).alias(f"part_{name}") for i, name in enumerate(PARTS)))
    part = {name: F.col(f"part_{name}") for name in PARTS}
    layout = F.when(part["class"] == "", "standard").otherwise(part["class"])
    size = lambda name: F.nullif(F.regexp_extract(part["extra"], rf'\b{name}="(\d+)"', 1), F.lit("")).cast("int")
    error = F.when(~F.col("has"), "no gallery").when(F.col("figure").isNull(), "no figures").when(part["in_section"] != F.col("section"), "another section's file").when(~layout.isin(LAYOUTS), "unknown class")
    here = F.col("figure").isNotNull()
    value = lambda x: F.when(here, x)
    return rows.select(
        "section", "sort_index", value(F.regexp_replace(part["file_name"], r"(?<=.)\.[^.]*$", "")).alias("slug"), value(part["file_name"]).alias("file_name"), value(layout).alias("layout"),
        value(unescaped(part["alt"])).alias("alt"), value(unescaped(part["caption"])).alias("caption"), value(F.coalesce(F.nullif(part["version"], F.lit("")), F.lit("2"))).alias("version"),
        size("width").alias("width"), size("height").alias("height"), error.alias("error"),
    )


def escape(c: Column, quote: bool) -> Column:
    """Text as it stands in a page; quotes too where it is an attribute."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&#x27;")] if quote else [])):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def figure(with_size: bool = False) -> Column:
    """One figure's line from section, file_name, layout, alt, caption, version, width and height; nulls are empty texts, a null version is 2."""
    text = lambda name, quote=False: escape(F.coalesce(name, F.lit("")), quote)
    opened = F.when(F.coalesce("layout", F.lit("standard")) == "standard", "<figure>").otherwise(F.concat(F.lit('<figure class="'), "layout", F.lit('">')))
    src = F.concat(F.lit("media/"), "section", F.lit("/"), "file_name", F.lit("?v="), F.coalesce("version", F.lit("2")))
    size = F.when(F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0)) != 0, F.concat(F.lit(' width="'), F.col("width").cast("string"), F.lit('" height="'), F.col("height").cast("string"), F.lit('"')))
    size = F.coalesce(size, F.lit("")) if with_size else F.lit("")
    return F.concat(F.lit(INDENT), opened, F.lit('<img src="'), src, F.lit('" alt="'), text("alt", True), F.lit('"'), size, F.lit(' loading="lazy"><figcaption>'), text("caption"), F.lit("</figcaption></figure>"))


def render_galleries(assets: DataFrame, with_size: bool = False) -> DataFrame:
    """section and html: a gallery block of each section, figures by sort_index, then slug; what parse_galleries() gives, it takes."""
    lines = assets.select("section", "sort_index", "slug", figure(with_size).alias("line"))
    of = F.floor(F.col("sort_index") / PIECE).alias("piece")  # so that a large section is sorted in many tasks, and its page made of a few texts
    joined = lambda name: F.array_join(F.transform("f", lambda x: x[name]), "\n")
    pieces = lines.groupBy("section", of).agg(F.sort_array(F.collect_list(F.struct("sort_index", "slug", "line"))).alias("f")).select("section", "piece", F.nullif(joined("line"), F.lit("")).alias("lines"))
    by = pieces.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("piece", "lines"))).alias("f"))
    return by.select("section", F.concat(F.lit('<div class="gallery">\n'), joined("lines"), F.lit("\n    </div>")).alias("html"))
