"""Readers: comparables, gazetteer, registry, sectioned CSV, positional JSON, drop folder, workbooks, grids, cards of a web page.

Text and JSON are read and shaped by native expressions. A workbook or a quoted CSV is bytes of one file, opened by a small helper inside a
task, a file at a time; everything after that is columns."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank, number
from ..operators.names import lengths_of, pieces

CELLS = "path string, sheet string, row int, cells array<string>, money array<boolean>, links array<string>"
#: Registry columns that are never carried: logins and contacts.
REGISTRY = {"builder_name": 3, "states": 4, "contract_available": 5, "e_agent": 6, "portal_url": 7, "notes": 10}


#: Registries are searched whole, however long they are. A caller who takes a longer list for a mistake sets the most rows that one may have.
MAX_REGISTRY: int | None = None


def _table(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header, as text; a quote inside quotes is doubled, as spreadsheets write it."""
    return spark.read.csv(path, header=True, mode="PERMISSIVE", escape='"')


def comparables(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header; rows without a suburb or a positive price go. Unreadable numbers are null."""
    raw = _table(spark, path)
    have = {c.lower(): c for c in raw.columns}
    col = lambda c: blank(F.col(f"`{have[c]}`")) if c in have else F.lit(None).cast("string")
    out = raw.select(
        col("suburb").alias("suburb"), F.upper(col("state")).alias("state"), number(col("bedrooms")).cast("int").alias("bedrooms"), *[number(col(c)).alias(c) for c in ("price", "rent_weekly", "land_sqm")], col("source").alias("source"), col("date_checked").alias("date_checked")
    )
    return out.where("suburb IS NOT NULL AND price > 0")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    raw = _table(spark, path)
    return raw.select(blank(F.col("suburb")).alias("suburb"), F.upper(blank(F.col("state"))).alias("state"), number(F.col("lat")).alias("lat"), number(F.col("lng")).alias("lng")).where("suburb IS NOT NULL AND state IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL")


def positional_json(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``{"keys": [...], "rows": [[...]]}``, or a list of objects: the named columns as text."""
    doc = spark.read.text(path, wholetext=True)
    shaped = F.from_json("value", "struct<keys:array<string>,rows:array<array<string>>>")
    keyed = doc.select(shaped.alias("d")).where("d.keys IS NOT NULL AND d.rows IS NOT NULL").select("d.keys", F.posexplode("d.rows").alias("ord", "r"))
    at = lambda c: F.get("r", (F.array_position("keys", F.lit(c)) - 1).cast("int"))
    one = keyed.select("ord", *[F.when(F.array_contains("keys", F.lit(c)), at(c)).alias(c) for c in columns])
    objects = doc.where(F.trim("value").startswith("[")).select(F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("ord", "m"))
    return one.unionByName(objects.select("ord", *[F.col("m")[c].alias(c) for c in columns]))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value: a text file's lines in order."""
    doc = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return doc.where(F.trim("value") != "")


def _cells(line: Column, n: int = 12) -> Column:
    """The cells of one CSV line (quotes are honoured, a quoted line break isn't)."""
    s = F.from_csv(line, F.lit(", ".join(f"c{i} string" for i in range(n))), {"mode": "PERMISSIVE", "escape": '"'})
    return F.array(*[F.coalesce(F.trim(s[f"c{i}"]), F.lit("")) for i in range(n)])


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The first section of a registry file; what follows a marker row is another list. Contact and login columns are never read."""
    w = Window.partitionBy("file").orderBy("line")
    lines = numbered_lines(spark, path).withColumn("stop", F.max(F.col("value").rlike("LinkedIn Link|BUILDERS IN PERTH").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = lines.where("stop = 0 AND line > 0").withColumn("c", _cells(F.col("value")))
    r = r.select("line", *[F.get("c", F.lit(i)).alias(n) for n, i in REGISTRY.items()]).where("builder_name <> ''")
    listed = F.upper(F.col("e_agent")).contains("YES")
    channel = F.when(listed, "e_agent").when(F.col("portal_url") != "", "portal").when(F.lower("notes").rlike("email|pdf"), "email_pdf").otherwise("direct_contact")
    states = F.filter(F.transform(F.split(F.upper(F.regexp_replace("states", "/", ",")), ","), lambda s: F.trim(s)), lambda s: s != "")
    return r.select("builder_name", states.alias("states"), "contract_available", listed.alias("is_on_e_agent"), "portal_url", channel.alias("stock_channel"), "notes", F.col("line").alias("ord"))


def builders_in_state(reg: DataFrame, state: str) -> DataFrame:
    return reg.where(F.array_contains("states", state.upper()) | (F.size("states") == 0))


def find_builder(reg: DataFrame, names: DataFrame) -> DataFrame:
    """names (name) with the first registry row whose name holds it or is held by it; a blank name finds none. What one name holds of the other is one of its stretches,
    so both ways are equi-joins: stretches are cut only in the lengths that the other side has, and the first row of each is told before the join."""
    listed = reg.where(F.trim("builder_name") != "").select(F.lower("builder_name").alias("b"), F.struct("ord", "builder_name").alias("x"))
    if MAX_REGISTRY is not None and (n := listed.limit(MAX_REGISTRY + 1).count()) > MAX_REGISTRY:
        raise ValueError(f"a registry of {n} rows or more; at most {MAX_REGISTRY}")
    listed = listed.groupBy("b").agg(F.min("x").alias("x"))
    asked = names.select("name", F.lower("name").alias("a")).where(F.trim("name") != "").distinct()
    holds = pieces(listed, "b", lengths_of(asked, F.length("a"))).groupBy("piece").agg(F.min("x").alias("x"))
    held = pieces(asked, "a", lengths_of(listed, F.length("b"))).select("name", F.col("piece").alias("b"))
    hit = asked.join(holds, F.col("a") == F.col("piece")).select("name", "x").unionByName(held.join(listed, "b").select("name", "x"))
    best = hit.groupBy("name").agg(F.min("x").alias("x")).select("name", "x.builder_name")
    return names.join(best, "name", "left")


def vendor_sections(spark: SparkSession, path: str) -> DataFrame:
    """Stacked sections with layouts of their own, told apart by marker rows; rows of one name merge, the first non-empty value winning."""
    section = (
        F.when(F.col("value").contains("LinkedIn Link"), "linkedin").when(F.col("value").contains("BUILDERS IN PERTH"), "perth")
        .when(F.col("value").rlike(r"^\s*NAME\s*,") & F.col("value").contains("BUILDER"), "primary").when(F.col("value").rlike(r"^\s*Builders from Agents"), "agents")
    )
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered_lines(spark, path).withColumn("mark", section).withColumn("section", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit("primary"))).where("mark IS NULL").withColumn("c", _cells(F.col("value")))
    cell = lambda i: F.get("c", F.lit(i))
    s = F.col("section")
    url = lambda c: F.regexp_extract(c, r"(https?://[^\s,;]+|www\.[^\s,;]+)", 1)
    name = F.when(s == "perth", cell(0)).when(s == "agents", F.trim(F.get(F.split(cell(0), "[-,]"), F.lit(0)))).otherwise(F.coalesce(F.nullif(cell(3), F.lit("")), cell(0)))
    link = F.when(s == "perth", url(cell(3))).when(s == "primary", F.coalesce(F.nullif(url(cell(7)), F.lit("")), url(cell(5)))).otherwise("")
    made = rows.where("section <> 'linkedin'").select(
        "line", "section", F.trim(name).alias("builder_name"), F.when(s.isin("perth", "primary"), F.upper(cell(4))).otherwise("").alias("states"), link.alias("website"),
        F.when(s == "primary", F.lower(cell(6)).contains("yes")).otherwise(False).alias("is_on_e_agent"), F.when(s == "primary", cell(10)).otherwise("").alias("notes"),
    )
    made = made.where(~F.lower("builder_name").isin("", "n/a", "do not contact") & (F.length("builder_name") >= F.when(F.col("section") == "agents", 3).otherwise(1)))
    first = lambda c: F.coalesce(F.min(F.when(F.col(c) != "", F.struct("line", c)))[c], F.lit("")).alias(c)
    return made.groupBy(F.lower("builder_name").alias("key")).agg(F.min_by("builder_name", "line").alias("builder_name"), first("states"), first("website"), first("notes"), F.max("is_on_e_agent").alias("is_on_e_agent"), F.min_by("section", "line").alias("section"))


def file_kind(content: Column, name: Column) -> Column:
    """What a stocklist is, by its first bytes; markup is refused."""
    head = F.hex(F.substring(content, 1, 4))
    text = F.decode(F.substring(content, 1, 4000), "ISO-8859-1")
    return F.when(head.startswith("504B"), "xlsx").when(head == "25504446", "pdf").when(F.ltrim(text).startswith("<"), "refused").when(text.rlike("[,\t;]"), "csv").otherwise("unknown")


def drop_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their kind; files named comparables... are another source's."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("name"), F.col("length"), file_kind(F.col("content"), name).alias("kind"), "content").where(~F.lower("name").startswith("comparables"))


def drop_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV stocklists by header, with aliases. What a file doesn't state stays null."""
    raw = _table(spark, path)
    have = {c.strip().lower(): c for c in raw.columns}
    pick = lambda *names: F.coalesce(*[blank(F.col(f"`{have[n]}`")) for n in names if n in have], F.lit(None).cast("string"))
    num = lambda n: number(pick(n))
    return raw.select(
        pick("address", "lot", "lot_address").alias("lot_address"), pick("suburb").alias("suburb"), F.upper(pick("state")).alias("state"), pick("builder").alias("builder_name"), num("beds").cast("int").alias("bedrooms"), num("baths").alias("bathrooms"),
        num("cars").cast("int").alias("car_spaces"), num("landsqm").alias("land_sqm"), num("housesqm").alias("house_sqm"), num("landprice").alias("land_price"), num("buildprice").alias("build_price"), num("totalprice").alias("price"),
    ).where("lot_address IS NOT NULL")


def _xlsx_rows(data: bytes) -> Iterator[tuple]:
    """(sheet, row, cells, money, links) of a workbook."""
    main, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    book = zipfile.ZipFile(io.BytesIO(data))
    tree = lambda n: ElementTree.fromstring(book.read(n)) if n in book.namelist() else ElementTree.Element("x")
    shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in tree("xl/sharedStrings.xml").iter(f"{main}si")]
    styles = tree("xl/styles.xml")
    codes = {n.get("numFmtId"): n.get("formatCode", "") for n in styles.iter(f"{main}numFmt")}
    xfs = styles.find(f"{main}cellXfs")
    money_style = [("$" in codes.get(x.get("numFmtId"), "")) or x.get("numFmtId") in ("5", "6", "7", "8", "44") for x in (xfs if xfs is not None else ())]
    for name in sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        sheet = tree(name)
        targets = {r.get("Id"): r.get("Target", "") for r in tree(f"xl/worksheets/_rels/{name.rsplit('/', 1)[1]}.rels")}
        links = {h.get("ref"): targets.get(h.get(f"{rel}id"), "") for h in sheet.iter(f"{main}hyperlink")}
        for number_, row in enumerate(sheet.iter(f"{main}row")):
            cells, money, urls = [], [], []
            for c in row.iter(f"{main}c"):
                v, f = c.find(f"{main}v"), c.find(f"{main}f")
                text = v.text if v is not None and v.text else "".join(t.text or "" for t in c.iter(f"{main}t"))
                if c.get("t") == "s" and text:
                    text = shared[int(text)]
                style = int(c.get("s") or 0)
                formula = re.search(r'HYPERLINK\(\s*"([^"]+)"', f.text or "", re.I) if f is not None else None
                cells.append(text or "")
                money.append(style < len(money_style) and money_style[style])
                urls.append(links.get(c.get("r")) or (formula[1] if formula else ""))
            yield name.rsplit("/", 1)[1][:-4], number_, cells, money, urls


def _csv_rows(data: bytes) -> Iterator[tuple]:
    for encoding in ("utf-8-sig", "utf-16", "cp1252", "latin-1"):
        try:
            text = data.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    head = text[:4000]
    for n, cells in enumerate(csv.reader(io.StringIO(text), delimiter=max(",\t;|", key=head.count))):
        yield "", n, cells, [False] * len(cells), [""] * len(cells)


def stocklist_rows(files: DataFrame) -> DataFrame:
    """Rows of workbooks and CSV files (path, kind, content). A file that can't be read gives no rows."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"]):
                try:
                    got = list((_xlsx_rows if kind == "xlsx" else _csv_rows)(bytes(content)))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, csv.Error):
                    got = []
                yield pd.DataFrame([(path, *r) for r in got], columns=["path", "sheet", "row", "cells", "money", "links"])

    return files.where(F.col("kind").isin("xlsx", "csv")).select("path", "kind", "content").mapInPandas(each, CELLS)


def row_text(cells: Column, money: Column) -> Column:
    """A row as one line; a money cell that holds a bare number of 1,000 or more gets its sign back."""
    shown = F.zip_with(cells, money, lambda c, m: F.when(m & (c.try_cast("double") >= 1000), F.concat(F.lit("$"), F.format_number(c.try_cast("double"), 0))).otherwise(F.trim(c)))
    return F.trim(F.regexp_replace(F.array_join(F.filter(shown, lambda x: x != ""), " "), r"\s+", " "))


def html_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, tag, card: text blocks of a page that hold an amount and repeat under one tag; scripts and styles are left out."""
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>", " ")
    # a block ends where its own tag does
    blocks = F.transform(F.split(bare, r"(?i)(?=<(?:li|tr|article|section|div)\b)"), lambda b: F.regexp_replace(b, r"(?is)^(<(\w+)\b.*?)</\2\s*>.*$", "$1"))
    e = pages.select("page_id", F.explode(F.transform(blocks, lambda b: F.struct(F.lower(F.regexp_extract(b, r"^<(\w+)", 1)).alias("tag"), F.trim(F.regexp_replace(F.regexp_replace(b, r"<[^>]*>", " "), r"\s+", " ")).alias("card")))).alias("x")).select("page_id", "x.*")
    priced = e.where(F.col("card").rlike(r"\$\s*\d{1,3}(?:,\d{3})+"))
    n = F.count("*").over(Window.partitionBy("page_id", "tag"))
    return priced.withColumn("n", n).where("n >= 2").drop("n")


def grid_cells(bodies: DataFrame, title_pattern: str, cell_pattern: str) -> DataFrame:
    """row_id, title, value of a grid in wire format: column records (id, title) and cell records (row, column, text, number, format) by pattern. A cell
    with money in its format bits gets its sign."""
    titles = bodies.select("id", F.explode(F.arrays_zip(F.regexp_extract_all("body", F.lit(title_pattern), 1).alias("c"), F.regexp_extract_all("body", F.lit(title_pattern), 2).alias("t"))).alias("x")).select("id", "x.*")
    groups = [F.regexp_extract_all("body", F.lit(cell_pattern), i).alias(n) for i, n in enumerate(("r", "c", "s", "v", "f"), 1)]
    cells = bodies.select("id", F.explode(F.arrays_zip(*groups)).alias("x")).select("id", "x.*")
    value = F.col("v").try_cast("double")
    money = F.shiftright(F.col("f").cast("long"), 12).bitwiseAND(F.lit(0x3FFF)).between(4644, 4647) & (F.abs(value) >= 1000)
    text = F.coalesce(F.nullif(F.col("s"), F.lit("")), F.when(money, F.concat(F.lit("$"), F.format_number(value, 0))).otherwise(F.col("v")))
    return cells.join(titles, ["id", "c"]).select("id", F.col("r").alias("row_id"), F.col("t").alias("title"), text.alias("value"))


#: Titles whose bare numbers are money even if their format doesn't say so.
MONEY_TITLE = r"(?i)price|rent|cost|deposit|\$"


def grid_rows(bodies: DataFrame, title_pattern: str, cell_pattern: str) -> DataFrame:
    """id, row_no, cells: the rows of a grid in wire format, as its sheet would be exported: row 0 holds the titles in column order, the others follow as they first
    appear; a cell that is missing is empty. bodies: id, body. Title records give (column, title, order), cell records (row, column, text, number, format); of
    records on one place the last counts. A number of 1,000 or more with money in its format bits or its title gets its sign. A body is one row's text."""
    parts = lambda p, names: F.posexplode(F.arrays_zip(*[F.regexp_extract_all("body", F.lit(p), i).alias(n) for i, n in enumerate(names, 1)])).alias("at", "x")
    titles = bodies.select("id", parts(title_pattern, ("c", "t", "o"))).groupBy("id", "x.c").agg(F.max_by(F.struct(F.col("x.o").cast("int").alias("o"), F.col("x.t").alias("t")), "at").alias("y")).select("id", "c", "y.*")
    found = bodies.select("id", parts(cell_pattern, ("r", "c", "s", "v", "f"))).select("id", "at", "x.*").join(titles.hint("merge"), ["id", "c"], "left")
    value = F.col("v").try_cast("double")
    money = F.coalesce(F.shiftright(F.col("f").try_cast("long"), 12).bitwiseAND(F.lit(0x3FFF)).between(4644, 4647), F.lit(False)) | F.coalesce(F.col("t").rlike(MONEY_TITLE), F.lit(False))
    bare = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    shown = F.coalesce(F.nullif(F.col("s"), F.lit("")), F.when(money & (F.abs(value) >= 1000), F.concat(F.lit("$"), F.format_number(value, 0))).otherwise(bare))
    cell = found.select("id", "r", "c", "at", shown.alias("text")).groupBy("id", "r", "c").agg(F.min("at").alias("at"), F.max_by("text", F.when(F.col("text") != "", F.col("at"))).alias("text"))
    filled = F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("text") != "", F.struct("c", "text")))))  # a row's cells, one a column
    row = cell.groupBy("id", "r").agg(F.min("at").alias("at"), filled.alias("m"))
    heads = titles.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o", "c", "t"))).alias("h"))  # a grid's columns
    # merged, never broadcast: columns repeat, so they look small when written, and there are as many of them as grids
    sheet = row.join(heads.hint("merge"), "id").withColumn("row_no", F.row_number().over(Window.partitionBy("id").orderBy("at")))
    line = F.struct("row_no", F.transform("h", lambda h: F.coalesce(F.try_element_at(F.col("m"), h.c), F.lit(""))).alias("cells"))
    return sheet.select("id", F.explode(F.when(F.col("row_no") == 1, F.array(F.struct(F.lit(0).alias("row_no"), F.col("h.t").alias("cells")), line)).otherwise(F.array(line))).alias("x")).select("id", "x.*")


def mail_rows(messages: DataFrame, domains: DataFrame, wording: str = r"(?i)stock\s*list|price\s*list|house\s*(?:and|&)\s*land|availability|new\s*release") -> DataFrame:
    """Messages that bring stock, with the builder of a known sender: a known domain, or a data attachment and stock wording."""
    dom = F.lower(F.regexp_extract("from", r"@([\w.-]+)", 1))
    names = F.array_join(F.coalesce("attachments", F.array().cast("array<string>")), " ")
    data = names.rlike(r"(?i)\.(?:xlsx?|csv|pdf)\b")
    m = messages.withColumn("domain", dom).join(F.broadcast(domains.select("domain", "builder")), "domain", "left")
    return m.where(F.col("builder").isNotNull() | (data & F.concat_ws(" ", "subject", names).rlike(wording)))
