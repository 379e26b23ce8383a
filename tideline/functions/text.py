"""Text keys and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with accents and the letters they fold to.
ACCENTED = "áàãâäéèêëíìîïóòõôöúùûüçñắằẳẵặăấầẩẫậạảếềểễệẹẻẽịỉĩốồổỗộớờởỡợọỏơứừửữựụủưýỳỵỷỹđšśćčžźżłęąőűřůīāē"
PLAIN = "aaaaaeeeeiiiiooooouuuucnaaaaaaaaaaaaaeeeeeeeeiiiooooooooooooouuuuuuuuyyyyydsscczzzleaouruiae"
#: Letters that lose a mark when they are decomposed.
ALSO, TO = "åōūďťňÿ", "aoudtny"


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTED + ALSO, PLAIN + TO)


def city_key(c: Column) -> Column:
    return F.regexp_replace(fold(c), "[^a-z0-9]+", "")


def normalize_key(c: Column) -> Column:
    """As ``city_key``, but an ampersand is the word 'and'."""
    return city_key(F.replace(c, F.lit("&"), F.lit("and")))


#: Fixed value: a challenger's mark at the end of a name, with or without a number.
CHALLENGER_TAIL = r"\s+ch(\s+\d+)?$"


def strict_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), CHALLENGER_TAIL, ""), "[^a-z0-9]+", "")


def base_key(c: Column) -> Column:
    return F.regexp_replace(strict_key(c), "[0-9]+$", "")


def schedule_name_key(c: Column) -> Column:
    """Without a bracketed part, a challenger number, a trailing number or a trailing two-letter state."""
    bare = F.regexp_replace(fold(c), r"\s*\([^)]*\)", "")
    for pattern in (CHALLENGER_TAIL, r"\s+\d+$", r",\s*[a-z]{2}$"):
        bare = F.regexp_replace(bare, pattern, "")
    return F.regexp_replace(bare, "[^a-z0-9]+", "")


def place_key(c: Column) -> Column:
    """The place without brackets, a state and an event's number, arabic or roman."""
    bare = F.regexp_replace(fold(c), r"\([^)]*\)", " ")
    bare = F.regexp_replace(F.trim(bare), r",[ ]*[a-z][a-z]$", "")
    return F.regexp_replace(F.regexp_replace(F.trim(bare), r"[ ]+([0-9]+|i{1,3}|iv|v)$", ""), "[^a-z0-9]+", "")


def contains_key(a: Column, b: Column) -> Column:
    return (F.length(a) >= 5) & (F.length(b) >= 5) & (F.contains(a, b) | F.contains(b, a))


def name_parts(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(fold(c), "[^a-z0-9]+", " "), " "), lambda x: x != ""))


def sorted_name_key(c: Column) -> Column:
    return F.array_join(F.array_sort(name_parts(c)), " ")


def display_name(c: Column) -> Column:
    """'Last, First' to 'First Last'."""
    return F.trim(F.regexp_replace(c, r"^([^,]+),[ ]*(.+)$", "$2 $1"))


def series_number(c: Column) -> Column:
    """The trailing number of one or two digits, else null."""
    return F.nullif(F.regexp_extract(c, r"(?:^|[^0-9])([0-9]{1,2})$", 1), F.lit("")).cast("int")


def differently_numbered(a: Column, b: Column) -> Column:
    return F.coalesce(series_number(a), F.lit(1)) != F.coalesce(series_number(b), F.lit(1))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def deslug(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))


def fingerprint(*parts: Column) -> Column:
    """sha256 of the parts joined by '|'; null counts as ''."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def append_once(old: Column, new: Column, sep: str = " | ") -> Column:
    empty = F.coalesce(old, F.lit("")) == ""
    return F.when(empty, new).when(F.contains(old, new), old).otherwise(F.concat(old, F.lit(sep), new))


def surface_of_code(c: Column) -> Column:
    """Codes IH, H, C, IC, G and 'Clay - Outdoor' forms."""
    code = F.upper(F.trim(F.regexp_replace(c, " - .*$", "")))
    return F.when(code.isin("IH", "H", "HARD"), "Hard").when(code.isin("C", "IC", "CLAY"), "Clay").when(code.isin("G", "GRASS"), "Grass").otherwise(F.trim(c))


def category_code(c: Column) -> Column:
    """'M15K' and 'M25+H' to M15, M25."""
    return F.nullif(F.regexp_extract(F.upper(c), "(M15|M25)", 1), F.lit(""))


def cut_token(c: Column) -> Column:
    """'*123' is a rank of another ranking; UR, NR and BYE are statuses."""
    t = F.upper(F.trim(c))
    rank = F.nullif(F.regexp_extract(t, r"^\*?([0-9]+)$", 1), F.lit("")).cast("int")
    return F.struct(rank.alias("rank"), t.startswith("*").alias("foreign"), F.when(t.isin("UR", "NR", "BYE"), t).alias("status"))


def url_year_matches(url: Column, year: Column) -> Column:
    """Whether the year in the path is the edition's or the one before; null without a year."""
    seen = F.nullif(F.regexp_extract(url, r"/([12][0-9]{3})/", 1), F.lit("")).cast("int")
    return (seen == year) | (seen == year - 1)


def search_pattern(q: str) -> str:
    """Trimmed, spaces collapsed, at most 60 characters."""
    return " ".join(q.split())[:60]
