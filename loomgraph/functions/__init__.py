"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URI_SCHEME = "loom"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def meta(column: Column | str, key: str) -> Column:
    """A key of a JSON map column, as a string; null if it isn't there."""
    return F.get_json_object(_c(column), f"$.{key}")


def haystack() -> Column:
    """What search looks in: id, kind, label, path, section, text and the metadata's text."""
    return F.concat_ws(" ", *(blank(c) for c in ("id", "kind", "label", "path", "section", "text", "metadata")))


def tokens(x: Column | str) -> Column:
    """Distinct lower-case runs of ASCII letters, digits and underscores."""
    return F.array_remove(F.array_distinct(F.split(F.lower(_c(x)), "[^a-zA-Z0-9_]+")), "")


def snippet() -> Column:
    return F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("text", "label", "path")), F.col("id"))


def relative_path(x: Column | str) -> Column:
    """Slashes forward; empty and `.` segments dropped, `..` kept."""
    return F.array_join(F.filter(F.split(F.replace(F.trim(_c(x)), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".")), "/")


def quoted(x: Column) -> Column:
    """Percent-encoding of UTF-8 bytes that leaves letters, digits and /:@#.-_~ alone."""
    out = F.url_encode(x)
    for plain, code in ((" ", r"\+"), ("/", "%2F"), (":", "%3A"), ("@", "%40"), ("#", "%23"), ("~", "%7E")):
        out = F.regexp_replace(out, code, "%20" if plain == " " else plain)
    return F.regexp_replace(out, r"\*", "%2A")


def uri(namespace: Column | str, kind: Column, key: Column) -> Column:
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    return F.concat(F.lit(f"{URI_SCHEME}://"), quoted(space), F.lit("/"), quoted(kind), F.lit("/"), quoted(key))


def edge_uri(namespace: Column | str, source: Column, kind: Column, target: Column) -> Column:
    return uri(namespace, F.lit("edge"), F.concat_ws("|", source, kind, target))


def one_line(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def slug(x: Column | str) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", F.lit("section")).otherwise(out)


def module_name(path: Column | str) -> Column:
    """Dotted module of a source path: suffix, leading `src` and trailing `__init__` dropped."""
    bare = F.regexp_replace(F.regexp_replace(_c(path), r"\.[^./]+$", ""), "^src/", "")
    return F.replace(F.regexp_replace(bare, "(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def rename_parts(x: Column | str) -> tuple[Column, Column]:
    """Old and new path of `a/{x => y}/b` or `x => y`; both the path itself if it isn't a rename."""
    c = _c(x)
    braces = r"^(.*)\{(.*) => (.*)\}(.*)$"
    tidy = lambda p: F.regexp_replace(p, "/+", "/")
    old = F.when(c.rlike(braces), tidy(F.concat(F.regexp_extract(c, braces, 1), F.regexp_extract(c, braces, 2), F.regexp_extract(c, braces, 4)))).when(c.contains(" => "), F.substring_index(c, " => ", 1)).otherwise(c)
    new = F.when(c.rlike(braces), tidy(F.concat(F.regexp_extract(c, braces, 1), F.regexp_extract(c, braces, 3), F.regexp_extract(c, braces, 4)))).when(c.contains(" => "), F.substring_index(c, " => ", -1)).otherwise(c)
    return old, new


def requirement(x: Column | str) -> tuple[Column, Column]:
    """Name and constraint of a requirement line."""
    pattern = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(.*?)\s*$"
    return F.regexp_extract(_c(x), pattern, 1), F.regexp_extract(_c(x), pattern, 2)


def line_of(text: Column | str, offset: Column) -> Column:
    """1-based line of a character offset."""
    return F.regexp_count(F.substring(_c(text), F.lit(1), offset), F.lit("\n")) + 1


def file_kind(path: Column | str) -> Column:
    suffix = F.lower(F.regexp_extract(_c(path), r"\.([^./]+)$", 1))
    kinds = {"python": ("py",), "script": ("js", "jsx", "ts", "tsx", "mjs", "cjs"), "markdown": ("md", "markdown"), "config": ("json", "toml", "yaml", "yml")}
    out = F.when(suffix.isin(*kinds["python"]), "python")
    for kind in ("script", "markdown", "config"):
        out = out.when(suffix.isin(*kinds[kind]), kind)
    return out.otherwise("file")


def graph_profile(nodes: Column) -> Column:
    return F.when(nodes <= 15, "small").when(nodes <= 120, "medium").otherwise("large")


def level_of_detail(nodes: Column) -> Column:
    return F.when(nodes > 1_000_000, "meta").when(nodes > 50_000, "cluster").when(nodes > 2_000, "sampled").otherwise("raw")


def related_bucket(kind: Column, path: Column) -> Column:
    return F.when(kind == "file", "files").when(kind.startswith("doc") | F.lower(path).endswith(".md"), "docs").when(is_symbol(kind), "symbols").otherwise("other")


def is_symbol(kind: Column) -> Column:
    return (kind == "symbol") | kind.rlike("_(function|class|method|export|symbol)$")


def absolute(path: Column | str) -> Column:
    return _c(path).startswith("/")


def source_ref_id() -> Column:
    place = F.when(F.col("path") != "", F.col("path")).otherwise(F.col("id"))
    tag = lambda name, c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(name), F.col(c).cast("string")))
    return F.concat_ws("#", place, tag("section=", "section"), tag("L", "line"), tag("C", "col"))
