"""Symbols, truncation, bands, and text out of markup, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are never symbol candidates.
COMMON_WORDS = tuple(
    (
        "the a an and or but in on at to for of with by from as is was are were be been being have has had do "
        "does did will would could should may might must can this that these those it its not no yes all any "
        "some find get set how what where when why which "
    ).split()
)
#: Names of primitive types.
PRIMITIVES = ("bool", "byte", "char", "decimal", "double", "float", "int", "long", "object", "sbyte", "short", "string", "uint", "ulong", "ushort", "void")


def pascal_symbols(text: Column) -> Column:
    """Distinct PascalCase words of two parts at least, the longest first, else in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(I?[A-Z][a-z]+(?:[A-Z][a-z0-9]+)+)\b"), F.lit(1)))
    ranked = F.transform(F.filter(found, lambda s: F.length(s) >= 3), lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s")))
    return F.transform(F.sort_array(ranked), lambda x: x["s"])


def looks_like_identifier(word: Column) -> Column:
    return word.rlike(r"^[\p{L}_][\p{L}\p{Nd}_]*$")


def is_common_word(word: Column) -> Column:
    return F.lower(word).isin(*COMMON_WORDS)


def symbol_candidates(query: Column) -> Column:
    """Distinct words of a query that could name a symbol."""
    parts = F.split(query, r"[\s,;:()\[\]{}]+")
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 2) & ~is_common_word(w) & looks_like_identifier(w)))


def truncate(text: Column, n: int) -> Column:
    """At most n characters, the last three dots where something is cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def preview(text: Column, n: int = 120) -> Column:
    """The trimmed text; its first n characters and dots if it is longer."""
    t = F.trim(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def namespace_of(full_name: Column) -> Column:
    """What stands before the last dot; the name itself without one."""
    head = F.regexp_extract(full_name, r"^(.+)\.[^.]*$", 1)
    return F.when(head != "", head).otherwise(full_name)


def first_sentence(text: Column) -> Column:
    """Up to the first stop if it comes within 200 characters, else the first line, cut at 200."""
    at = F.instr(text, ".")
    line = F.trim(F.substring_index(text, "\n", 1))
    cut = F.when(F.length(line) > 200, F.concat(F.substring(line, 1, 200), F.lit("..."))).otherwise(line)
    return F.when((at > 1) & (at <= 200), F.substring(text, F.lit(1), at)).otherwise(cut)


def base_type(name: Column) -> Column:
    """A type's name without pointer and nullable marks, generics and array brackets."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"[*&?]", ""), r"(<.*>)|(\[.*\])", ""))


def is_primitive(name: Column) -> Column:
    return F.lower(base_type(name)).isin(*PRIMITIVES)


def type_references(types: Column) -> Column:
    """Distinct base types of an array of type names that aren't primitive; null for none."""
    found = F.array_distinct(F.filter(F.transform(types, base_type), lambda t: (t != "") & ~F.lower(t).isin(*PRIMITIVES)))
    return F.when(F.size(found) > 0, found)


def accessibility(modifiers: Column) -> Column:
    """The first of public, private, protected and internal among the modifiers; private by default."""
    out = F.lit("private")
    for word in ("internal", "protected", "private", "public"):
        out = F.when(F.contains(F.coalesce(modifiers, F.lit("")), F.lit(word)), word).otherwise(out)
    return out


def budget_band(percent: Column) -> Column:
    return F.when(percent >= 90, "complete_now").when(percent >= 70, "spawn_subagent").when(percent >= 50, "summarize").otherwise("continue")


def severity_priority(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(s == "critical", "Critical").when(s == "error", "High").when(s == "warning", "Medium").otherwise("Low")


def node_label(name: Column) -> Column:
    """A diagram's node id: letters, digits and underscores of a name."""
    return F.regexp_replace(name, r"[^\p{L}\p{Nd}_]", "")


def embedding_input(text: Column, limit: int = 30_000) -> Column:
    return F.substring(text, 1, limit)


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100 / total).cast("int")).otherwise(0)


def json_map(text: Column) -> Column:
    """A JSON object as a map of strings; null for null, empty or malformed text."""
    return F.when(F.length(F.trim(text)) > 0, F.from_json(text, "map<string,string>"))


def map_int(m: Column, key: str) -> Column:
    """An integer out of a map; null if it isn't there or isn't one."""
    return F.try_element_at(m, F.lit(key)).try_cast("int")


def merged_map(base: Column, over: Column) -> Column:
    """Entries of both, those of over first where keys meet; null values are left out."""
    kept = F.map_filter(base, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(over), k), F.lit(False)))
    return F.map_filter(F.map_concat(kept, over), lambda k, v: v.isNotNull())


def json_path_field(arguments: Column) -> Column:
    """The path in a tool call's arguments, under any of its names; null where it is malformed."""
    return F.coalesce(*[F.get_json_object(arguments, f"$.{k}") for k in ("filePath", "path", "file")])


def _decoded(text: Column) -> Column:
    """The five entities of markup and the blank, the ampersand last."""
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    return text


def html_title(html: Column) -> Column:
    """Title element, else og:title, else the first heading; null without any."""
    tried = [r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)[\"']", r"(?is)<h1[^>]*>(.*?)</h1>"]
    clean = [F.trim(_decoded(F.regexp_replace(F.regexp_extract(html, p, 1), "<[^>]+>", ""))) for p in tried]
    return F.coalesce(*[F.when(c != "", c) for c in clean])


def html_author(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<meta[^>]*name=[\"']author[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    return F.when(found != "", _decoded(found))


def html_text(html: Column) -> Column:
    """Text without scripts, styles and tags, with single blanks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(_decoded(F.regexp_replace(bare, "<[^>]+>", " ")), r"[ \t\n\r\f]+", " "))


def arxiv_id(text: Column) -> Column:
    found = F.regexp_extract(text, r"(\d{4}\.\d{4,5})(?:v\d+)?", 1)
    return F.when(found != "", found)


#: Patterns of papers as extracted text.
PDF_PATTERNS = {
    "doi": r"10\.\d{4,}/[^\s]+",
    "authors": r"(?i)(?:Authors?|By)[:\s]+(.+)",
    "name_list": r"^([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s*,\s*[A-Z][a-z]+\s+[A-Z][a-z]+)+)",
    "abstract": r"(?s)(?:Abstract|ABSTRACT)\s*\n(.+?)(?=\n\s*(?:1\.?\s+Introduction|I\.?\s+Introduction|Keywords|1\s+INTRODUCTION))",
    "heading": r"^\s*(\d+(?:\.\d+)*)\s+([A-Z][^\n]{5,80})$",
    "references": r"(?s)(?:References|REFERENCES|Bibliography)\s*\n(.+?)$",
    "reference": r"(?s)\[(\d+)\]\s*([^\[]+?)(?=\[\d+\]|$)",
    "figure": r"(?is)(?:Figure|Fig\.?)\s*(\d+)[:\.]?\s*(.+?)(?=\n\n|\z)",
}


def _present(found: Column) -> Column:
    return F.when(found != "", found)


def _blank_free(text: Column) -> Column:
    """text without white space at its ends."""
    return F.btrim(text, F.lit(" \t\r\n\f\x0b"))


def doi(text: Column) -> Column:
    return _present(F.regexp_extract(text, PDF_PATTERNS["doi"], 0))


def pdf_title(text: Column, metadata_title: Column | None = None) -> Column:
    """The metadata's title, else of the first ten lines that aren't empty the first of 11 to 199 characters that doesn't name an archive, else Untitled."""
    lines = F.transform(F.slice(F.filter(F.split(text, "\n"), lambda x: x != ""), 1, 10), _blank_free)
    found = F.get(F.filter(lines, lambda x: (F.length(x) > 10) & (F.length(x) < 200) & ~F.startswith(F.lower(x), F.lit("arxiv"))), 0)
    own = [] if metadata_title is None else [_present(_blank_free(metadata_title))]
    return F.when(text.isNotNull(), F.coalesce(*own, found, F.lit("Untitled")))


def pdf_authors(text: Column) -> Column:
    """Names of 3 to 49 characters in the first of 30 lines that says Authors or By, or lists names; apart by commas, `and` or `&`."""
    lines = F.slice(F.split(text, "\n"), 1, 30)
    told = F.transform(lines, lambda x: F.coalesce(*[_present(F.regexp_extract(x, PDF_PATTERNS[k], 1)) for k in ("authors", "name_list")]))
    names = F.transform(F.split(F.get(F.filter(told, lambda x: x.isNotNull()), 0), r",| and | & "), _blank_free)
    return F.coalesce(F.filter(names, lambda x: (F.length(x) > 2) & (F.length(x) < 50)), F.array().cast("array<string>"))


def pdf_abstract(text: Column) -> Column:
    """What follows a line that ends with Abstract, up to the introduction or the keywords, in single blanks; over 2000 characters are cut and marked."""
    found = _present(F.regexp_extract(text, PDF_PATTERNS["abstract"], 1))
    flat = F.regexp_replace(_blank_free(found), r"\s+", " ")
    return F.when(F.length(flat) > 2000, F.concat(F.substring(flat, 1, 2000), F.lit("..."))).otherwise(flat)


def pdf_dois(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PDF_PATTERNS["doi"]), F.lit(0)))


def pdf_citations(text: Column) -> Column:
    """Array of (number, text, doi) of the `[n] ...` entries after the heading References or Bibliography."""
    tail = F.regexp_extract(text, PDF_PATTERNS["references"], 1)
    entries = F.regexp_extract_all(tail, F.lit(PDF_PATTERNS["reference"]), F.lit(0))

    def entry(e: Column) -> Column:
        own = _blank_free(F.regexp_replace(e, r"^\[\d+\]", ""))
        return F.struct(F.regexp_extract(e, r"^\[(\d+)\]", 1).try_cast("int").alias("number"), own.alias("text"), doi(own).alias("doi"))

    return F.transform(F.coalesce(entries, F.array().cast("array<string>")), entry)


def pdf_figures(text: Column) -> Column:
    """Array of (number, caption) of figures; a caption reaches to the next blank line."""
    found = F.regexp_extract_all(text, F.lit(PDF_PATTERNS["figure"]), F.lit(0))
    parts = [F.regexp_extract, PDF_PATTERNS["figure"]]
    return F.transform(found, lambda x: F.struct(parts[0](x, parts[1], 1).try_cast("int").alias("number"), _blank_free(parts[0](x, parts[1], 2)).alias("caption")))


def pdf_sections(text: Column) -> Column:
    """Array of (line, page, number, level, title) of numbered headings. Lines are trimmed before form feeds count pages, as a form feed at a line's edge is lost."""
    lines = F.transform(F.split(text, "\n"), _blank_free)
    pages = F.aggregate(
        lines,
        F.struct(F.lit(1).alias("page"), F.array().cast("array<int>").alias("all")),
        lambda a, x: F.struct((a["page"] + F.when(F.contains(x, F.lit("\f")), 1).otherwise(0)).alias("page"), F.concat(a["all"], F.array(a["page"] + F.when(F.contains(x, F.lit("\f")), 1).otherwise(0))).alias("all")),
    )["all"]
    rows = F.zip_with(F.transform(lines, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), pages, lambda r, p: F.struct(r["i"].alias("line"), p.alias("page"), r["x"].alias("x")))
    heads = F.filter(rows, lambda r: r["x"].rlike(PDF_PATTERNS["heading"]))

    def section(r: Column) -> Column:
        number = F.regexp_extract(r["x"], PDF_PATTERNS["heading"], 1)
        level = F.least(F.lit(3), F.regexp_count(number, F.lit(r"\.")) + 1)
        return F.struct(r["line"].alias("line"), r["page"].alias("page"), number.alias("number"), level.alias("level"), F.trim(F.regexp_extract(r["x"], PDF_PATTERNS["heading"], 2)).alias("title"))

    return F.transform(heads, section)


def pdf_markdown(text: Column) -> Column:
    """The text without its abstract, with numbered headings as markdown headings one level below their own, and at most one blank line in a row."""
    out = F.regexp_replace(text, PDF_PATTERNS["abstract"], "")
    for dots in range(5):
        number = r"\d+" + (rf"(?:\.\d+){{{dots}}}" if dots < 4 else r"(?:\.\d+){4,}")
        out = F.regexp_replace(out, "(?m)" + PDF_PATTERNS["heading"].replace(r"\d+(?:\.\d+)*", number), "\n" + "#" * (dots + 2) + " $1 $2\n")
    return _blank_free(F.regexp_replace(out, "\n{3,}", "\n\n"))


def pdf_document(text: Column, metadata_title: Column | None = None) -> Column:
    """A paper as one markdown document: title, authors, abstract, body and figures."""
    title, authors, abstract, figures = pdf_title(text, metadata_title), pdf_authors(text), pdf_abstract(text), pdf_figures(text)
    none = F.lit("")
    parts = [
        F.concat(F.lit('---\ntitle: "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"\n')),
        F.when(F.size(authors) > 0, F.concat(F.lit("authors: ["), F.array_join(F.transform(authors, lambda a: F.concat(F.lit('"'), a, F.lit('"'))), ", "), F.lit("]\n"))).otherwise(none),
        F.concat(F.lit("---\n\n# "), title, F.lit("\n\n")),
        F.when(F.size(authors) > 0, F.concat(F.lit("**Authors:** "), F.array_join(authors, ", "), F.lit("\n\n"))).otherwise(none),
        F.coalesce(F.concat(F.lit("## Abstract\n\n"), abstract, F.lit("\n\n---\n\n")), none),
        F.concat(pdf_markdown(text), F.lit("\n")),
        F.when(
            F.size(figures) > 0,
            F.concat(F.lit("\n---\n\n## Figures\n\n"), F.array_join(F.transform(figures, lambda f: F.concat(F.lit("> **figure-"), f["number"].cast("string"), F.lit("**: "), f["caption"], F.lit("\n> *See original PDF*\n\n"))), "")),
        ).otherwise(none),
    ]
    return F.concat(*parts)
