"""Queries of scans and sinks (inventory A, J5): a table is written in a notation to the shared folder and scanned back."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.plans.registering import Group, table
from marlstone.sources import readers, writers
from marlstone.sources.shared import new_path

group = Group()
query = group.add


#: Records of an XML file, some 60 MB.
XML_ROWS = 100_000


def fresh(spark, name):
    return new_path(spark, name)


@query("a1_source_fallback", "SELECT 'recent' AS source_mode, lang, count(*) AS n FROM documents GROUP BY ALL")
def a1(spark, sf):
    d = readers.first_readable(spark, [("full", f"{sf}/documents_full.parquet"), ("recent", f"{sf}/documents.parquet")])
    return d.groupBy("source_mode", "lang").agg(F.count("*").alias("n"))


@query("a2_wrapped_json", "SELECT event_id, user_id, event_type FROM events")
def a2(spark, sf):
    path = fresh(spark, "wrapped")
    body = F.to_json(F.struct("event_id", "user_id", "event_type"))
    table(spark, sf, "events").select(F.concat(F.lit("window.EVENT = "), body, F.lit(";"))).write.text(path)
    return readers.wrapped_json(spark, path, "EVENT", "event_id long, user_id long, event_type string")


@query("a3_sharded_scan", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang = 'fr' GROUP BY 1")
def a3(spark, sf):
    path = fresh(spark, "shards")
    writers.sharded(table(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang"), path, "lang", [F.asc("doc_id")], 4)
    return spark.read.parquet(path).where("lang = 'fr'").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("a4_sharded_sink", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS rn, max(o_orderdate) OVER () AS newest FROM orders)
 SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_totalprice >= 200000) AS large, count(*) FILTER (WHERE o_orderdate >= newest - INTERVAL 365 DAY) AS recent,
   string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 30) AS preview FROM o GROUP BY 1""")
def a4(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")
    order = [F.desc("o_orderdate"), F.asc("o_orderkey")]
    path, recent = fresh(spark, "shards"), fresh(spark, "recent")
    writers.sharded(o, path, "o_orderpriority", order, 4)
    writers.recent_slice(o, "o_orderdate", 365).write.parquet(recent)
    late = spark.read.parquet(recent).groupBy("o_orderpriority").agg(F.count("*").alias("recent"))
    index = writers.shard_index(spark.read.parquet(path), "o_orderpriority", "o_orderkey", order, {"open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") >= 200000})
    return index.join(late, "o_orderpriority", "left").fillna(0, ["recent"]).withColumn("preview", F.array_join("preview", ","))


@query("a5_json_lines", "SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)")
def a5(spark, sf):
    path = fresh(spark, "pack")
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    writers.json_lines(d, path)
    return spark.read.schema("doc_id long, source string, quality int").json(path)


@query("a6_header_discovery", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS priority FROM orders")
def a6(spark, sf):
    path, files = fresh(spark, "export"), 6
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderpriority").alias("b"), F.lit("x").alias("c"), F.pmod(F.xxhash64("o_orderkey"), F.lit(files)).alias("export"))
    top = spark.createDataFrame([("Export of the registry", None, None, 0), ("", None, None, 1), ("Reg. No.", "Priority Class", "Note", 2)], "a string, b string, c string, n int")
    tops = top.select("*", F.explode(F.sequence(F.lit(0), F.lit(files - 1))).alias("export"))
    line = F.to_csv(F.struct("a", "b", "c")).alias("value")
    # export files as registries give them: junk, header, rows
    rows = tops.select(line, "n", "export").unionByName(o.select(line, F.lit(3).alias("n"), "export"))
    rows.repartition(files, "export").sortWithinPartitions("export", "n").select("value", "export").write.partitionBy("export").text(path)
    return readers.headless_table(spark, path, {"regno": "id", "registrationnumber": "id", "priorityclass": "priority"}, "id", 3)


@query("a7_headed_export", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def a7(spark, sf):
    path = fresh(spark, "headed")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.csv(path, header=True)
    o = spark.read.csv(path, header=True, schema="o_orderkey long, o_orderstatus string, o_totalprice double")
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a8_html_tables", r"""WITH h AS (SELECT page_id, html, page_id % 3 AS r FROM pages) SELECT page_id, len(regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>', 1)) AS items,
   trim(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', '', 'g')) AS title, CAST(4 + r AS BIGINT) AS n_rows, CAST(page_id AS VARCHAR) AS id, 'size ' || length(html) AS size,
   CASE WHEN r > 0 THEN 'row 1' END AS listed FROM h""")
def a8(spark, sf):
    # below each page: the label and value rows of a record, one label twice, and a list of as many rows as the id's remainder by 3
    r = F.col("page_id") % 3
    detail = F.concat(F.lit('<TABLE class="d"><tr><th>Reg. No:</th><td>'), F.col("page_id").cast("string"), F.lit("</td></tr>\n<tr><th>Size</th><td><b>size</b> "), F.length("html").cast("string"), F.lit("</td></tr><tr><td>Reg. No</td><td>later</td></tr></TABLE>"))
    listed = F.concat(F.lit("<table><tr><th>List</th></tr>"), F.array_join(F.transform(F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), r.cast("int")), lambda x: F.concat(F.lit("<tr><td>List</td><td>row "), x.cast("string"), F.lit("</td></tr>"))), ""), F.lit("</table>"))
    p = table(spark, sf, "pages").select("page_id", "html", readers.html_rows(F.concat("html", detail, listed)).alias("rows")).withColumn("record", readers.first_values(F.col("rows")))
    f = lambda k: F.try_element_at("record", F.lit(k))
    return p.select(
        "page_id", F.size(readers.html_cells(F.col("html"), "li")).cast("long").alias("items"), F.coalesce(F.get(readers.html_cells(F.col("html"), "title"), F.lit(0)), F.lit("")).alias("title"),
        F.size("rows").cast("long").alias("n_rows"), f("regno").alias("id"), f("size").alias("size"), f("list").alias("listed"),
    )


@query("a9_spreadsheet_xml", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' & co ≥ &odd;' AS name, p_brand AS brand FROM part")
def a9(spark, sf):
    path, files = fresh(spark, "sheet"), 3
    cell = lambda c: F.concat(F.lit('<Cell ss:StyleID="s1"><Data ss:Type="String">'), c, F.lit("</Data></Cell>\n"))
    row = lambda *cells: F.concat(F.lit("<Row>"), *[cell(c) for c in cells], F.lit("</Row>\n"))
    name = F.concat(F.replace(F.col("p_name"), F.lit("&"), F.lit("&amp;")), F.lit("&nbsp;&amp;&nbsp;co &ge; &odd;"))
    part = table(spark, sf, "part").select(row(F.col("p_partkey").cast("string"), name, F.col("p_brand")).alias("value"), F.lit(3).alias("n"), F.pmod(F.xxhash64("p_partkey"), F.lit(files)).alias("export"))
    tops = spark.range(files).select(F.explode(F.array(
        F.struct(F.lit('<?xml version="1.0"?>\n<Workbook xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet ss:Name="a"><Table>').alias("value"), F.lit(0).alias("n")),
        F.struct(row(F.lit("Export of the registry")).alias("value"), F.lit(1).alias("n")), F.struct(row(F.lit("Reg. No."), F.lit("Product name"), F.lit("Brand")).alias("value"), F.lit(2).alias("n")),
        F.struct(F.lit("</Table></Worksheet></Workbook>").alias("value"), F.lit(4).alias("n")),
    )).alias("x"), F.col("id").alias("export")).select("x.value", "x.n", "export")
    tops.unionByName(part).repartition(files, "export").sortWithinPartitions("export", "n").select("value", "export").write.partitionBy("export").text(path)
    return readers.spreadsheet_table(spark, path, {"regno": "id", "productname": "name", "brand": "brand"}, "id")


@query("a10_xml_flatten", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'book' ELSE 'article' END AS kind, 'Order ' || o_orderkey AS title, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE 'RESULTS: ' || o_orderstatus || chr(10) || 'CONCLUSIONS: ' || o_orderpriority END AS abstract,
   CAST(count(l_orderkey) AS INT) AS n, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS parts, coalesce(string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag), '') AS keywords,
   '10.1/' || o_orderkey AS doi, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def a10(spark, sf):
    path = fresh(spark, "xml")
    k = F.col("o_orderkey")
    line = F.struct(F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("line"))  # the lines of one order
    title = F.concat(F.lit("Order "), k.cast("string"))
    text = lambda label, c: F.struct(label.alias("_Label"), c.alias("_VALUE"))
    none = F.lit(None).cast("string")
    abstract = F.when(k % 4 == 0, F.array(text(none, F.col("o_orderstatus")))).otherwise(F.array(text(F.lit("RESULTS"), F.col("o_orderstatus")), text(F.lit("CONCLUSIONS"), F.col("o_orderpriority"))))
    full = F.col("o_orderkey") % 3 != 0
    date = F.struct(F.date_format("o_orderdate", "yyyy").alias("Year"), F.when(full, F.date_format("o_orderdate", "MM")).alias("Month"), F.when(full, F.date_format("o_orderdate", "dd")).alias("Day"))
    ids = F.array(F.struct(F.lit("pii").alias("_IdType"), F.lit("x").alias("_VALUE")), F.struct(F.lit("doi").alias("_IdType"), F.concat(F.lit("10.1/"), k.cast("string")).alias("_VALUE")))
    record = table(spark, sf, "orders").join(li, "o_orderkey", "left").select(
        k.alias("Id"), F.when(k % 5 != 0, title).alias("ArticleTitle"), F.when(k % 5 == 0, title).alias("BookTitle"), abstract.alias("AbstractText"), date.alias("PubDate"), ids.alias("ArticleId"),
        F.transform("line", lambda x: x["part"]).alias("Part"), F.transform("line", lambda x: x["flag"]).alias("Keyword"),
    )
    # an XML file is read by one task
    record.write.format("xml").option("maxRecordsPerFile", XML_ROWS).option("rowTag", "Record").option("rootTag", "Records").save(path)
    x = readers.bibliographic_rows(spark, path, "Record", "Part array<long>")
    return x.select(F.col("id").alias("o_orderkey"), "kind", "title", "abstract", F.coalesce(F.size("Part"), F.lit(0)).alias("n"), F.coalesce(F.array_join("Part", ","), F.lit("")).alias("parts"), F.array_join("keywords", ";").alias("keywords"), "doi", "published")


@query("a11_author_flatten", """WITH a AS (SELECT l_orderkey AS paper, l_suppkey AS author, CAST(row_number() OVER w AS INT) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS last, l_suppkey % 3 = 0 AS equal, l_suppkey % 4 = 0 AS mail,
    first_value(l_suppkey % 3 = 0) OVER w AS lead FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey))
 SELECT paper, author, pos, pos = 1 OR (equal AND lead) AS is_first, pos = last AS is_last, CASE WHEN bool_or(mail) OVER p THEN mail ELSE pos = last END AS is_corresponding,
   CASE WHEN bool_or(mail) OVER p THEN 'email' ELSE 'last author' END AS corresponding_by, CASE WHEN mail THEN 's' || author || '@lab.example' ELSE '' END AS emails, CAST(CASE WHEN mail THEN 2 ELSE 1 END AS INT) AS n_affiliations FROM a WINDOW p AS (PARTITION BY paper)""")
def a11(spark, sf):
    one = F.struct("l_linenumber", F.col("l_suppkey").alias("author"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.array_sort(F.collect_list(one)).alias("lines"))  # the authors of one paper

    def detailed(x):
        s = x["author"]
        mail = F.concat(F.lit("s"), s.cast("string"), F.lit("@lab.example"))
        affiliations = F.when(s % 4 == 0, F.array(F.concat(F.lit("Unit 4, Town. Electronic address: "), mail, F.lit(".")), F.concat(F.lit("Second unit; "), mail))).otherwise(F.array(F.lit("Unit 1, Town")))
        return F.struct(s.alias("author"), affiliations.alias("affiliations"), (s % 3 == 0).alias("equal"))

    papers = lines.select("paper", F.transform("lines", detailed).alias("authors"))
    return readers.author_rows(papers, "paper", "authors").select("paper", "author", "pos", "is_first", "is_last", "is_corresponding", "corresponding_by", F.array_join("emails", " ").alias("emails"), F.size("affiliations").alias("n_affiliations"))


@query("a12_nested_json", """WITH i AS (SELECT l_orderkey, string_agg(DISTINCT CASE WHEN l_linenumber % 2 = 1 AND l_partkey % 5 <> 0 THEN 'part ' || l_partkey END, ';' ORDER BY CASE WHEN l_linenumber % 2 = 1 AND l_partkey % 5 <> 0 THEN 'part ' || l_partkey END) AS drugs,
    count(*) AS locations FROM lineitem GROUP BY 1)
 SELECT 'T' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS id, 'Trial of ' || o_orderpriority AS title, o_orderstatus AS status, coalesce(c_name, 'Unknown') AS sponsor, strftime(o_orderdate, '%Y-%m-%d') AS first_post, CASE WHEN o_orderkey % 2 = 0 THEN 'PHASE2/PHASE3' ELSE 'PHASE3' END AS phases,
   o_custkey AS enrollment, coalesce(drugs, '') AS drugs, 'condition ' || (o_custkey % 9) AS conditions, coalesce(locations, 0) AS locations, 'T' || lpad(CAST(o_custkey + 10000000 AS VARCHAR), 8, '0') AS cross_ids
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN i ON l_orderkey = o_orderkey""")
def a12(spark, sf):
    path = fresh(spark, "nested")
    drug = F.struct(F.when(F.col("l_linenumber") % 2 == 1, "DRUG").otherwise("DEVICE").alias("type"), F.when(F.col("l_partkey") % 5 == 0, "Placebo tablets").otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("name"))
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(drug).alias("interventions"), F.collect_list(F.struct(F.col("l_suppkey").alias("site"))).alias("sites"))  # the lines of one order
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    o = table(spark, sf, "orders").join(c, "o_custkey", "left").join(li, "o_orderkey", "left")
    number = lambda k: F.concat(F.lit("T"), F.lpad(k.cast("string"), 8, "0"))
    own, other = number(F.col("o_orderkey")), number(F.col("o_custkey") + 10000000)
    section = F.struct(
        F.struct(own.alias("id"), F.concat(F.lit("Trial of "), F.col("o_orderpriority")).alias("title")).alias("identification"),
        F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).alias("firstPost")).alias("status"),
        F.struct(F.struct(F.col("c_name").alias("name")).alias("lead")).alias("sponsors"),
        F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("PHASE2"), F.lit("PHASE3"))).otherwise(F.array(F.lit("PHASE3"))).alias("phases"), F.struct(F.col("o_custkey").alias("count")).alias("enrollment")).alias("design"),
        F.struct(F.array(F.concat(F.lit("condition "), (F.col("o_custkey") % 9).cast("string"))).alias("conditions")).alias("conditions"),
        F.struct("interventions").alias("arms"), F.struct(F.col("sites").alias("locations")).alias("contacts"),
        F.struct(F.concat(F.lit("Extends "), other, F.lit(" and "), own, F.lit(", see "), other).alias("text")).alias("description"),
    )
    writers.json_lines(o.select(section.alias("section")), path)
    return readers.trial_rows(spark, path, r"T\d{8}")


@query("a13_xml_aliases", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def a13(spark, sf):
    path = fresh(spark, "alias")
    s = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("reg_no"), F.when(F.col("s_suppkey") % 2 == 1, F.col("s_suppkey")).alias("number"), F.col("s_name").alias("title"))
    s.write.format("xml").option("rowTag", "trial").option("rootTag", "trials").save(path)
    x = readers.xml_rows(spark, path, "trial", "reg_no string, number string, title string")
    return x.select(S.first_filled(F.col("reg_no"), F.col("number")).cast("long").alias("id"), F.col("title").alias("name"))


@query("a14_feed_watch", "SELECT CAST(event_id AS VARCHAR) AS guid FROM events WHERE event_id % 3 <> 0")
def a14(spark, sf):
    path = fresh(spark, "feed")
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("guid"), F.col("event_type").alias("title"))
    e.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    cache = e.where("cast(guid as long) % 3 = 0").select("guid")
    return readers.xml_rows(spark, path, "item", "guid string, title string").join(cache, "guid", "left_anti").select("guid")


@query("a15_front_matter", r"""WITH b AS (SELECT *, '- Claim one [[Alpha|a]] PMID 12345' || chr(10) || '- Claim two [[Beta]]' || chr(10) || text AS body FROM documents WHERE doc_id % 7 <> 0)
 SELECT doc_id, source AS topic, lang, length(body) AS n, len(regexp_extract_all(body, '(^|\n)- ')) AS claims, array_to_string(list_sort(list_distinct(regexp_extract_all(body, '\[\[([^\]|]+)', 1))), ';') AS links, array_to_string(list_sort(list_distinct(regexp_extract_all(body, 'PMID:? *([0-9]{4,9})', 1))), ' ') AS pmids FROM b""")
def a15(spark, sf):
    d = table(spark, sf, "documents")
    status = F.when(F.col("doc_id") % 7 == 0, "archived").otherwise("live")
    page = F.concat(F.lit("---\ntitle: "), F.col("source"), F.lit("\nlang: "), F.col("lang"), F.lit("\nstatus: "), status, F.lit("\n---\n- Claim one [[Alpha|a]] PMID 12345\n- Claim two [[Beta]]\n"), F.col("text"))
    m = d.select("doc_id", readers.front_matter(page).alias("m"))
    f = lambda k: F.try_element_at(F.col("m.fields"), F.lit(k))
    body = F.col("m.body")
    claims = F.regexp_count(body, F.lit(r"(^|\n)- ")).cast("long").alias("claims")
    links, pmids = S.found_all(body, r"\[\[([^\]|]+)", 1), S.found_all(body, r"PMID:? *([0-9]{4,9})", 1)
    return m.where(f("status") != "archived").select("doc_id", f("title").alias("topic"), f("lang").alias("lang"), F.length(body).cast("long").alias("n"), claims, F.array_join(links, ";").alias("links"), F.array_join(pmids, " ").alias("pmids"))


@query("a16_text_corpus", r"""WITH f AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN CAST(1990 + doc_id % 40 AS INT) END AS year, regexp_replace(text, '\s+', ' ', 'g') AS flat FROM documents),
  s AS (SELECT *, CASE WHEN len(regexp_extract_all(text, '[À-ÿ]')) > 0.05 * len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]')) THEN 'accented' ELSE 'plain' END AS script FROM f)
 SELECT doc_id, script, CASE WHEN doc_id % 5 = 0 THEN 'home' WHEN script = 'accented' THEN 'abroad' ELSE 'world' END AS region, year, CASE WHEN strpos(lower(flat), 'tion') > 0 THEN substr(flat, greatest(1, strpos(lower(flat), 'tion') - 100), 500) END AS chapter FROM s""")
def a16(spark, sf):
    d = table(spark, sf, "documents").withColumn("file", F.concat(F.when(F.col("doc_id") % 5 == 0, "home-guide-").otherwise("guide-"), F.when(F.col("doc_id") % 2 == 0, (1990 + F.col("doc_id") % 40).cast("string")).otherwise("v12345"), F.lit(".txt")))
    t = F.col("text")
    script = F.when(F.regexp_count(t, F.lit("[À-ÿ]")) > 0.05 * F.regexp_count(t, F.lit("[A-Za-zÀ-ÿ]")), "accented").otherwise("plain")
    region = F.when(F.contains("file", F.lit("home")), "home").when(F.col("script") == "accented", "abroad").otherwise("world")
    flat = F.regexp_replace(t, r"\s+", " ")
    return d.withColumn("script", script).select("doc_id", "script", region.alias("region"), readers.year_in(F.col("file")).alias("year"), readers.from_first_mention(flat, "tion", 100, 500).alias("chapter"))


@query("a17_text_blocks", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), b AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(The|Les|Der|La|En) ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM l) SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS body FROM b GROUP BY ALL")
def a17(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return readers.blocks(lines, "doc_id", "pos", "line", F.col("line").rlike("^(The|Les|Der|La|En) "))


@query("a18_light_index", "SELECT doc_id, lang, array_to_string(list_filter(string_split(text, ' '), lambda x: x <> '')[1:3], ' ') AS words FROM documents")
def a18(spark, sf):
    d = table(spark, sf, "documents").withColumn("words", F.split("text", " "))
    return writers.light_index(d, ["doc_id", "lang"], {"words": 3}).withColumn("words", F.array_join("words", " "))


@query("j5_release_manifest", "SELECT 'differs' AS problem, 1 AS n UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'unlisted', 1 UNION ALL SELECT 'as listed', count(DISTINCT o_orderpriority) - 2 FROM orders")
def j5(spark, sf):
    path = fresh(spark, "release")
    writers.sharded(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), path, "o_orderpriority", [F.asc("o_orderkey")])
    listed = writers.file_manifest(spark, path).where(~F.col("path").contains("index"))
    # a release of which one file has changed, one is gone and one is new since the manifest was written
    nth = F.row_number().over(Window.orderBy("path"))  # a row for each file of the release
    now = listed.withColumn("i", nth).withColumn("sha256", F.when(F.col("i") == 1, F.lit("0")).otherwise(F.col("sha256"))).where("i <> 2")
    added = listed.limit(1).select(F.lit("stray").alias("path"), "bytes", "sha256")
    bad = writers.manifest_problems(now.drop("i").unionByName(added), listed)
    held = listed.join(bad, "path", "left_anti").select("path", F.lit("as listed").alias("problem"))
    return bad.unionByName(held).groupBy("problem").agg(F.count("*").alias("n"))
