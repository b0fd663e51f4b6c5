"""Column expressions on text, paths and links. All are built-in functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
#: Line ends: CR LF, or one of ten single characters.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
SNIPPET = 400
EVIDENCE = 140


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f) -> Column:
    """f(x) with x computed once: an expression named within a lambda would be computed for every element."""
    return F.get(F.transform(F.array(x), f), 0)


def tokenize(x: Column | str) -> Column:
    """Lower-case ASCII letters and digits in runs."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(TOKEN), F.lit(0))


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def collapse(x: Column | str) -> Column:
    """White space trimmed and collapsed to single spaces."""
    return strip(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def snippet(x: Column | str, size: int = SNIPPET) -> Column:
    return F.substring(collapse(x), 1, size)


def split_lines(x: Column | str) -> Column:
    """Lines without their ends; a final line end starts no line."""
    parts = F.split(_c(x), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(x: Column | str) -> Column:
    return F.size(F.split(_c(x), "\n", -1)).cast("long")


def word_count(x: Column | str) -> Column:
    return F.size(F.array_remove(F.split(_c(x), r"(?U)\s+"), "")).cast("long")


def line_slice(x: Column | str, start: int, end: int) -> Column:
    """Lines start to end, counted from 1, both included."""
    return F.array_join(F.slice(F.split(_c(x), "\n", -1), F.lit(start), F.lit(max(0, end - start + 1))), "\n")


def occurrences(x: Column | str, needle: str) -> Column:
    """Non-overlapping occurrences of a text."""
    c = _c(x)
    return (F.call_function("div", F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit(""))), F.lit(len(needle)))).cast("long") if needle else F.lit(0).cast("long")


def replace_unique(x: Column | str, old: str, new: str) -> Column:
    """old replaced if it occurs exactly once, else null."""
    return F.when(occurrences(x, old) == 1, F.replace(_c(x), F.lit(old), F.lit(new)))


def truncate_evidence(x: Column | str, size: int = EVIDENCE) -> Column:
    c = _c(x)
    return F.when(F.length(c) > size, F.concat(F.regexp_replace(F.substring(c, 1, size - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(c)


def normalized(x: Column | str) -> Column:
    """For comparing wording: lower case, white space collapsed."""
    return F.lower(collapse(x))


def folded(x: Column | str) -> Column:
    """normalized(), and letters that differ in case only by length or place in a word (ß and ss, final sigma, ligatures) are equal."""
    c = normalized(F.upper(_c(x)))
    return F.replace(F.replace(c, F.lit("ς"), F.lit("σ")), F.lit("ß"), F.lit("ss"))


def clip(x: Column | str, size: int = 1000) -> Column:
    """The first characters; code points are never split."""
    return F.substring(_c(x), 1, size)


def bounded(items: Column | str, size: int = 16_000, each: int = 1000) -> Column:
    """The leading items, each clipped, whose JSON array stays within a size."""
    sized = F.transform(_c(items), lambda x: let(clip(x, each), lambda y: F.struct(y.alias("x"), (F.length(F.to_json(F.array(y))) - 1).alias("n"))))
    # one pass: the running size of those kept so far, -1 once it was too much
    start = F.struct(F.lit(2).alias("n"), F.array().cast("array<string>").alias("kept"))
    step = lambda s, x: F.when((s["n"] < 0) | (s["n"] + x["n"] > size), F.struct(F.lit(-1).alias("n"), s["kept"].alias("kept"))).otherwise(F.struct((s["n"] + x["n"]).alias("n"), F.concat(s["kept"], F.array(x["x"])).alias("kept")))
    return F.aggregate(sized, start, step)["kept"]


def byte_range(data: Column | str, offset: int, length: int) -> Column:
    """A slice of binary data as text between whole UTF-8 characters, or else in base64.

    encoding, offset, length (of what is returned), total_bytes, more, text, data; null beyond the end.
    """
    c = _c(data)
    total = F.octet_length(c)
    raw = F.substr(c, F.lit(offset + 1), F.lit(length))
    n = F.octet_length(raw)
    byte = lambda i: F.conv(F.hex(F.substr(raw, i, F.lit(1))), 16, 10).cast("int")
    follows = lambda i: F.coalesce((byte(i) >= 128) & (byte(i) < 192), F.lit(False))
    lead = F.when(follows(F.lit(1)) & follows(F.lit(2)) & follows(F.lit(3)), 3).when(follows(F.lit(1)) & follows(F.lit(2)), 2).when(follows(F.lit(1)), 1).otherwise(0) if offset else F.lit(0)
    back = F.when(follows(n) & follows(n - 1) & follows(n - 2), 3).when(follows(n) & follows(n - 1), 2).when(follows(n), 1).otherwise(0)
    first = byte(n - back)
    need = F.when(first >= 240, 4).when(first >= 224, 3).when(first >= 192, 2).otherwise(0)
    cut = (F.lit(offset) + n < total) & (need > back + 1)
    body = F.substr(raw, lead + 1, n - lead - F.when(cut, back + 1).otherwise(0))
    text = F.try_validate_utf8(body.cast("string"))
    size, at = F.when(text.isNotNull(), F.octet_length(body)).otherwise(n), F.when(text.isNotNull(), F.lit(offset) + lead).otherwise(F.lit(offset))
    out = F.struct(
        F.when(text.isNotNull(), "utf-8").otherwise("base64").alias("encoding"), at.cast("long").alias("offset"), size.cast("long").alias("length"), total.cast("long").alias("total_bytes"),
        (at + size < total).alias("more"), text.alias("text"), F.when(text.isNull(), F.base64(raw)).alias("data"),
    )
    return F.when((F.lit(offset) < total) | (total == 0), out)


def contains_evidence(body: Column | str, evidence: Column | str) -> Column:
    e = normalized(evidence)
    return (e != "") & normalized(body).contains(e)


def escape_xml(x: Column | str, quotes: bool = True, breaks: bool = False) -> Column:
    """Text for XML or HTML; quotes too where it goes into an attribute, and line breaks and tabs in one of an XML file."""
    c = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *[('"', "&quot;")] * quotes, *[("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")] * breaks):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def heading_slug(x: Column | str) -> Column:
    """An id for a heading: lower case, other characters than letters, digits, - and _ gone, spaces to hyphens."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(_c(x))), r"[^\p{L}\p{N}\s_-]", ""), r"\s+", "-")


# --- paths and links


def slug_of(path: Column | str) -> Column:
    """A path's file name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"(?<=.)\.[^.]*$", "")


def without_md(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), r"(?i)\.md$", "")


def wikilinks(body: Column | str) -> Column:
    """Targets of [[target]] and [[target|alias]] in order, trimmed, repeats kept."""
    return F.transform(F.regexp_extract_all(_c(body), F.lit(WIKILINK), F.lit(1)), strip)


def clean_target(link: Column | str) -> Column:
    """A link's path: no alias, anchor, surrounding slashes or .md."""
    c = F.substring_index(F.substring_index(_c(link), "|", 1), "#", 1)
    c = F.regexp_replace(strip(F.replace(c, F.lit("\\"), F.lit("/"))), r"^/+|/+$", "")
    return strip(F.regexp_replace(c, r"(?i)\.md$", ""))


def link_stem(link: Column | str) -> Column:
    """A link's last path component, for counts that don't resolve links."""
    return F.element_at(F.split(clean_target(link), "/"), -1)


def path_error(path: Column | str, max_bytes: int = 512) -> Column:
    """Why a page path isn't valid, or null."""
    c = _c(path)
    parts = F.split(c, "/", -1)
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(F.octet_length(c) > max_bytes, "too_long")
        .when(c.contains("\\"), "backslash")
        .when(c.rlike(r"[\x00-\x1F\x7F]"), "control_character")
        .when(c.startswith("/"), "not_relative")
        .when(F.exists(parts, lambda p: p == ""), "empty_component")
        .when(F.exists(parts, lambda p: (p == ".") | (p == "..")), "bad_component")
        .when(F.exists(parts, lambda p: p.startswith(".")) & ~c.rlike(r"^\.[a-z0-9-]+-template\.(md|json)$"), "hidden_component")
    )


def searchable(path: Column | str, skip_files: tuple[str, ...], skip_dirs: tuple[str, ...]) -> Column:
    """Whether a page takes part in search: its name isn't hidden, nor its first component among those left out."""
    parts = F.split(_c(path), "/")
    top = F.element_at(parts, 1)
    named = top.isin(*skip_files) if skip_files else F.lit(False)
    inside = top.isin(*skip_dirs) if skip_dirs else F.lit(False)
    return ~F.element_at(parts, -1).startswith(".") & ~named & ~inside


# --- dates, hashes, sets, probabilities


def iso_date(x: Column | str) -> Column:
    """The date in the first ten characters, or null."""
    return F.to_date(F.try_to_timestamp(F.substring(_c(x), 1, 10), F.lit("yyyy-MM-dd")))


def age_days(x: Column | str, today: str) -> Column:
    return F.datediff(F.lit(today).cast("date"), iso_date(x))


def since(x: Column | str, when: str | None) -> Column:
    """updated >= when; an unreadable date fails, an unreadable or missing bound passes all."""
    bound = F.to_date(F.try_to_timestamp(F.lit((when or "")[:10]), F.lit("yyyy-MM-dd")))
    return F.coalesce(iso_date(x) >= bound, bound.isNull())


def edge_id(subject, predicate, object_, source=None, evidence=None) -> Column:
    """96 bits of SHA-256 over the parts, as hex."""
    part = lambda x: F.lit("") if x is None else F.coalesce(_c(x).cast("string"), F.lit(""))
    return F.substring(F.sha2(F.concat_ws("\x1f", *[part(x) for x in (subject, predicate, object_, source, evidence)]), 256), 1, 24)


def content_hash(model: str, text: Column | str) -> Column:
    return F.sha2(F.concat(F.lit(model + "\n"), _c(text)), 256)


def has_all(wanted: list[str], have: Column | str) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), _c(have))) == 0 if wanted else F.lit(True)


def types_match(allowed: Column | str, actual: Column | str) -> Column:
    a = _c(allowed)
    return a.isNull() | (F.size(a) == 0) | F.array_contains(a, F.lit("*")) | F.coalesce(F.array_contains(a, _c(actual)), F.lit(False))


def renormalize(probabilities: Column | str, labels: list[str]) -> Column:
    """A map's finite, non-negative entries of known labels, scaled to sum 1; null if nothing is left.

    Of two labels one may be missing: it gets the rest to 1.
    """
    kept = F.map_filter(_c(probabilities), lambda k, v: k.isin(*labels) & (v >= 0) & (v < float("inf")) & ~F.isnan(v))
    if len(labels) == 2:
        rest = F.transform_values(kept, lambda k, v: 1 - v)
        other = F.transform_keys(rest, lambda k, v: F.when(k == labels[0], labels[1]).otherwise(F.lit(labels[0])))
        kept = F.when((F.size(kept) == 1) & (F.get(F.map_values(kept), 0) <= 1), F.map_concat(kept, other)).otherwise(kept)
    total = F.aggregate(F.map_values(kept), F.lit(0.0), lambda s, v: s + v)
    return F.when(total > 0, F.transform_values(kept, lambda k, v: v / total))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)
