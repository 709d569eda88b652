"""Scans: fallbacks, wrapped JSON, shards, headed and headless exports, XML, HTML tables, front matter and text blocks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_readable(spark: SparkSession, paths: list[tuple[str, str]], schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """The first of the (name, path) candidates that exists, with its name as source_mode."""
    problem: Exception | None = None
    for name, path in paths:
        reader = spark.read.format(fmt)
        try:
            return (reader.schema(schema) if schema else reader).load(path).withColumn("source_mode", F.lit(name))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            problem = e
    raise FileNotFoundError(f"none of {[p for _, p in paths]} exists") from problem


def wrapped_json(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of text files whose lines assign a JSON object to a global: `window.NAME = {...};`. Other lines are left out."""
    body = F.regexp_extract("value", rf"^\s*window\.{name}\s*=\s*(.*?);?\s*$", 1)
    return spark.read.text(path).select(F.from_json(F.nullif(body, F.lit("")), schema).alias("j")).where("j is not null").select("j.*")


def headless_table(spark: SparkSession, path: str, aliases: dict[str, str], key: str, width: int, least: int = 2, within: int = 30) -> DataFrame:
    """Rows of delimited files whose header stands somewhere near the top, under any of its known names.

    A file's header is the first of its first `within` rows with at least `least` cells that the alias table knows (letters and digits, lower case), the key among them.
    Columns are named by it; rows before it, and those without a key, are left out. Files may be read in splits by any tasks in any order: a row stands after
    the header if it is of a later split, or follows it in the first one.
    """
    cells = F.array(*[F.col(f"_c{i}") for i in range(width)])
    raw = spark.read.schema(", ".join(f"_c{i} string" for i in range(width))).csv(path).select(cells.alias("cells"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return under_header(raw, aliases, key, least, within)


def under_header(raw: DataFrame, aliases: dict[str, str], key: str, least: int = 2, within: int = 30) -> DataFrame:
    """The step of headless_table that finds headers, over rows (cells, file, block, at): block is where a row's split begins, at grows within a split."""
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    known = F.transform("cells", lambda c: F.try_element_at(m, F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")))
    named = raw.withColumn("names", known)
    is_header = (F.size(F.filter("names", lambda n: n.isNotNull())) >= least) & F.array_contains("names", key)
    first = named.where("block = 0")
    begins = first.groupBy("file").agg(F.min("at").alias("begin"))
    # a row for each file
    heads = first.where(is_header).join(begins, "file").where(F.col("at") - F.col("begin") < within).groupBy("file").agg(F.min("at").alias("head"), F.min_by("names", "at").alias("columns"))
    rows = raw.join(heads, "file").where("block > 0 or at > head")
    value = lambda target: F.get("cells", F.array_position("columns", F.lit(target)).cast("int") - 1)
    out = rows.select(*[F.nullif(F.trim(value(t)), F.lit("")).alias(t) for t in dict.fromkeys(aliases.values())])
    return out.where(F.col(key).isNotNull())


#: Entities of HTML that exports use without declaring them; others are kept as they are written.
ENTITIES = {"nbsp": " ", "middot": "·", "deg": "°", "plusmn": "±", "times": "×", "le": "≤", "ge": "≥", "ndash": "–", "mdash": "—"}


def declared_entities(xml: Column) -> Column:
    """XML text whose undeclared entities are replaced, or escaped where unknown."""
    for name, char in ENTITIES.items():
        xml = F.replace(xml, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(xml, r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)", "&amp;")


def spreadsheet_table(spark: SparkSession, path: str, aliases: dict[str, str], key: str, least: int = 2, within: int = 30) -> DataFrame:
    """Rows of SpreadsheetML files (Row, Cell, Data) under a header that is found as in headless_table. Files are split at row ends, so a large one is read by many tasks."""
    body = F.regexp_extract("value", r"(?s)<Row\b[^>]*>(.*)$", 1)
    xml = F.concat(F.lit("<Row>"), declared_entities(F.regexp_replace(body, r"\bss:", "")), F.lit("</Row>"))
    parsed = F.from_xml(xml, "Cell array<struct<Data: string>>", {"excludeAttribute": "true"})
    raw = spark.read.text(path, lineSep="</Row>").where(body != "")
    rows = raw.select(F.transform(parsed["Cell"], lambda c: c["Data"]).alias("cells"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return under_header(rows, aliases, key, least, within)


def bibliographic_rows(spark: SparkSession, path: str, row_tag: str, extra: str = "") -> DataFrame:
    """Article and book records as flat rows: id, kind, title, abstract (a line per section, its label first), keywords (distinct, in order), doi, published (as exact as given)."""
    labelled, typed = "array<struct<_Label: string, _VALUE: string>>", "array<struct<_IdType: string, _VALUE: string>>"
    schema = f"Id long, ArticleTitle string, BookTitle string, AbstractText {labelled}, PubDate struct<Year: string, Month: string, Day: string>, ArticleId {typed}, Keyword array<string>"
    x = xml_rows(spark, path, row_tag, schema + (f", {extra}" if extra else ""))
    sections = F.transform("AbstractText", lambda s: F.concat(F.when(s["_Label"].isNotNull(), F.concat(s["_Label"], F.lit(": "))).otherwise(""), s["_VALUE"]))
    doi = F.get(F.filter("ArticleId", lambda i: i["_IdType"] == "doi"), F.lit(0))["_VALUE"]
    known = [F.col("Id").alias("id"), F.when(F.col("ArticleTitle").isNull() & F.col("BookTitle").isNotNull(), "book").otherwise("article").alias("kind"), F.coalesce("ArticleTitle", "BookTitle").alias("title")]
    words = F.array_sort(F.array_distinct(F.coalesce("Keyword", F.array().cast("array<string>"))))
    own = [F.col(c) for c in x.columns[7:]]
    return x.select(*known, F.array_join(sections, "\n").alias("abstract"), words.alias("keywords"), doi.alias("doi"), F.concat_ws("-", "PubDate.Year", "PubDate.Month", "PubDate.Day").alias("published"), *own)


EMAIL = r"[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)+"


def author_rows(papers: DataFrame, key: str, authors: str) -> DataFrame:
    """A row per author of array<struct<author, affiliations array<string>, equal boolean>>: position from 1, e-mails in the affiliations, roles.

    First authors are the first one and, if they are marked equal, all others that are. Corresponding are the authors with an e-mail, without any the last;
    corresponding_by says which. Null affiliations count as none; papers without authors give no rows.
    """
    at = lambda a: F.filter(a["affiliations"], lambda t: F.contains(t, F.lit("@")))
    mails = lambda a: F.when(F.size(at(a)) > 0, F.sort_array(F.array_distinct(F.flatten(F.transform(at(a), lambda t: F.regexp_extract_all(t, F.lit(EMAIL), F.lit(0))))))).otherwise(F.array().cast("array<string>"))
    numbered = F.transform(authors, lambda a, i: F.struct(a["author"].alias("author"), (i + 1).alias("pos"), a["affiliations"].alias("affiliations"), mails(a).alias("emails"), a["equal"].alias("equal")))
    once = papers.select(key, numbered.alias("d"), F.get(authors, F.lit(0))["equal"].alias("lead"))
    d = once.select(key, F.explode("d").alias("a"), F.size("d").alias("last"), "lead", F.exists("d", lambda a: F.size(a["emails"]) > 0).alias("mailed"))
    corresponding = F.when(F.col("mailed"), F.size("a.emails") > 0).otherwise(F.col("a.pos") == F.col("last"))
    is_first = (F.col("a.pos") == 1) | (F.coalesce("a.equal", F.lit(False)) & F.coalesce("lead", F.lit(False)))
    source = F.when(F.col("mailed"), "email").otherwise("last author")
    return d.select(key, "a.author", "a.pos", "a.affiliations", "a.emails", is_first.alias("is_first"), (F.col("a.pos") == F.col("last")).alias("is_last"), corresponding.alias("is_corresponding"), source.alias("corresponding_by"))


TRIAL = (
    "section struct<identification: struct<id: string, title: string>, status: struct<status: string, firstPost: struct<date: string>>, sponsors: struct<lead: struct<name: string>>,"
    " design: struct<phases: array<string>, enrollment: struct<count: long>>, conditions: struct<conditions: array<string>>, arms: struct<interventions: array<struct<type: string, name: string>>>,"
    " contacts: struct<locations: array<struct<site: long>>>, description: struct<text: string>>"
)


def trial_rows(spark: SparkSession, path: str, id_pattern: str) -> DataFrame:
    """Nested trial documents as flat rows. Of the interventions those of type DRUG stay, placebos go; cross_ids are the ids, other than its own, that a document names anywhere."""
    d = spark.read.schema(TRIAL).json(path)
    s = lambda name: F.col(f"section.{name}")
    drugs = F.filter(s("arms.interventions"), lambda i: (F.upper(i["type"]) == "DRUG") & ~F.lower(i["name"]).contains("placebo"))
    names = F.array_sort(F.array_distinct(F.transform(drugs, lambda i: i["name"])))
    others = F.array_remove(F.array_sort(F.array_distinct(F.regexp_extract_all(F.to_json("section"), F.lit(id_pattern), F.lit(0)))), s("identification.id"))
    return d.select(
        s("identification.id").alias("id"), s("identification.title").alias("title"), s("status.status").alias("status"), F.coalesce(s("sponsors.lead.name"), F.lit("Unknown")).alias("sponsor"), s("status.firstPost.date").alias("first_post"),
        F.array_join(s("design.phases"), "/").alias("phases"), s("design.enrollment.count").alias("enrollment"), F.coalesce(F.array_join(names, ";"), F.lit("")).alias("drugs"), F.array_join(s("conditions.conditions"), ";").alias("conditions"),
        F.coalesce(F.array_size(s("contacts.locations")), F.lit(0)).cast("long").alias("locations"), F.array_join(others, ";").alias("cross_ids"),
    )


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def html_cells(html: Column, tag: str) -> Column:
    """The inner texts of all elements of a tag, markup inside removed."""
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1)
    return F.transform(F.coalesce(inner, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"(?s)<[^>]*>", "")))


def html_rows(html: Column) -> Column:
    """array<array<string>>: the cells (th and td) of every table row, markup inside removed."""
    inner = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1))
    return F.transform(F.coalesce(inner, F.array().cast("array<string>")), lambda r: F.transform(cells(r), lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]*>", ""))))


def first_values(rows: Column) -> Column:
    """map(label, value) of rows of two or more cells: labels by their letters and digits in lower case; of a repeated label the first row wins."""
    pairs = F.transform(F.filter(rows, lambda r: F.size(r) >= 2), lambda r: F.struct(F.regexp_replace(F.lower(r[0]), r"[^\p{L}\p{N}]+", "").alias("k"), r[1].alias("v")))
    labels = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(labels, F.transform(labels, lambda k: F.get(F.filter(pairs, lambda p: p["k"] == k), F.lit(0))["v"]))


def year_in(name: Column) -> Column:
    """The first year (1900 to 2099) that stands in a file name as a number of its own; null without one."""
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"(?<!\d)((?:19|20)\d\d)(?!\d)", 1), F.lit("")), F.lit("9999")).cast("int")


def front_matter(text: Column) -> Column:
    """struct(fields map, body) of a text that begins with `---`, `key: value` lines and `---`; without it the fields are empty."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    fields = F.when(head != "", F.str_to_map(head, F.lit("\n"), F.lit(": "))).otherwise(F.create_map().cast("map<string,string>"))
    return F.struct(fields.alias("fields"), F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "").alias("body"))


def from_first_mention(text: Column, term: str, before: int, size: int) -> Column:
    """Up to `size` characters from `before` characters ahead of a term's first mention; null without one."""
    at = F.instr(F.lower(text), term)
    return F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - before), F.lit(size)))


def blocks(lines: DataFrame, doc: str, line_no: str, line: str, is_header: Column) -> DataFrame:
    """(doc, block, n_lines, body): lines grouped under their headers. Lines before a document's first header are block 0."""
    w = Window.partitionBy(doc).orderBy(line_no)
    numbered = lines.withColumn("block", F.sum(is_header.cast("long")).over(w))
    one = F.array_sort(F.collect_list(F.struct(line_no, line)))  # the lines of one block
    return numbered.groupBy(doc, "block").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(one, lambda x: x[line]), "\n").alias("body"))
