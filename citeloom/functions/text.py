"""Text and key columns. Null texts count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Col) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def strip(c: Col) -> Column:
    """Trim all Unicode white space (the SQL trim knows the space alone)."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def clean_text(c: Col) -> Column:
    return strip(F.regexp_replace(text(c), r"(?U)\s+", " "))


def fetch_key(c: Col) -> Column:
    """Key of records within a fetch: lower case, without DOI resolver prefixes wherever they stand."""
    key = F.lower(strip(c))
    for prefix in ("https://doi.org/", "http://doi.org/"):
        key = F.replace(key, F.lit(prefix), F.lit(""))
    return key


def merge_key(c: Col) -> Column:
    """Key of records across batches: lower case alone; resolver prefixes count."""
    return F.lower(strip(c))


def match_text(*parts: Col) -> Column:
    """The lower-cased text that keywords are sought in as substrings."""
    joined = text(parts[0])
    for p in parts[1:]:
        joined = F.concat(joined, F.lit(" "), text(p))
    return F.lower(joined)


def authors_short(authors: Col, most: int, joiner: str = ", ", none: str = "Unknown", shown: int | None = None) -> Column:
    """Up to `most` names in full, else the first `shown` (1) and `et al.`."""
    names = F.coalesce(_col(authors), F.array().cast("array<string>"))
    few = F.array_join(names, joiner)
    many = F.concat(F.array_join(F.slice(names, 1, shown or 1), joiner), F.lit(" et al."))
    return F.when(F.size(names) == 0, none).when(F.size(names) <= most, few).otherwise(many)


def authors_readme(c: Col) -> Column:
    return authors_short(c, 2)


def authors_digest(c: Col) -> Column:
    return authors_short(c, 1)


def authors_entry(c: Col) -> Column:
    return authors_short(c, 3, none="", shown=3)


def authors_search(c: Col) -> Column:
    return authors_short(c, 1, none="?")


def authors_email(c: Col) -> Column:
    return authors_short(c, 1)


def authors_template(c: Col) -> Column:
    return authors_short(c, 1, none="")


def authors_page(c: Col) -> Column:
    return authors_short(c, 2)


def truncated(c: Col, limit: int, kept: int) -> Column:
    """Texts over `limit` code points keep `kept` of them and an ellipsis."""
    return F.when(F.length(_col(c)) > limit, F.concat(F.substring(_col(c), 1, kept), F.lit("..."))).otherwise(_col(c))


def escaped_cell(c: Col) -> Column:
    """A Markdown table cell: pipes escaped, line feeds as spaces."""
    return F.replace(F.replace(text(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def title_cell(c: Col) -> Column:
    return truncated(escaped_cell(c), 100, 97)


def anchor(c: Col) -> Column:
    out = F.lower(_col(c))
    for old, new in ((" ", "-"), ("&", ""), ("/", ""), ("--", "-")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def links(url: Col, doi: Col) -> Column:
    paper = F.when(text(url) != "", F.concat(F.lit("[Paper]("), _col(url), F.lit(")")))
    resolver = F.when(text(doi) != "", F.concat(F.lit("[DOI](https://doi.org/"), _col(doi), F.lit(")")))
    return F.coalesce(F.nullif(F.concat_ws(" / ", paper, resolver), F.lit("")), F.lit("-"))


def bar(n: Col, cap: int) -> Column:
    return F.repeat(F.lit("█"), F.least(_col(n), F.lit(cap)).cast("int"))


def percent_of(n: Col, most: Column) -> Column:
    return F.floor(F.lit(100.0) * _col(n) / most + 0.5).cast("long")


def tag_size(n: Col) -> Column:
    return F.least(F.greatest(10 + 2 * _col(n), F.lit(12)), F.lit(24)).cast("long")


def insight_colour(c: Col) -> Column:
    """The colours of rapidly growing, actively researched, and other categories."""
    return F.when(_col(c).contains("rapidly"), "#34d399").when(_col(c).contains("actively"), "#fbbf24").otherwise("#94a3b8")


def html_escaped(c: Col) -> Column:
    out = text(c)
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def year_of(date: Col, default: int | Column) -> Column:
    default = F.lit(default) if isinstance(default, int) else default
    return F.coalesce(F.substring(_col(date), 1, 4).try_cast("int"), default)


def ratio_percent(part: Col, whole: Col) -> Column:
    """One decimal, ties to even; 0 without a whole."""
    return F.coalesce(F.bround(_col(part) / F.nullif(_col(whole), F.lit(0)) * 100, 1), F.lit(0.0))


def terms_of(query: str) -> list[str]:
    """Lower-cased words of a query; repeated words stay and count each time."""
    return query.lower().split()
