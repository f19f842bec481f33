"""Documents as Markdown, text, HTML and JSON from their elements.

elements(doc, page, element_no, type, kind, level, marker, ordered, indent, text,
rows, has_header, path, caption), one row for each block, table or image. Each
sink is one ordered aggregate by page and one by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tables as G

#: Page marks and limits.
OUTLINE = 60
PAGE_MARK, TEXT_MARK, EMPTY_PAGE = "<!-- pagina %d -->", "===== PAGINA %d =====", "*(Pagina sin texto reconocible.)*"


def _body() -> Column:
    """The text of a list item without its marker."""
    text, marker = T.strip(F.col("text")), F.col("marker")
    return F.when((marker != "") & F.startswith(text, marker), F.ltrim(F.substr(text, F.length(marker) + 1))).otherwise(text)


def _clamped() -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(6), F.when(F.col("level") == 0, 2).otherwise(F.col("level"))))


def chunk_md() -> Column:
    """One element as Markdown."""
    text = T.strip(F.col("text"))
    heading = F.concat(F.expr("repeat('#', cast(greatest(1, least(6, CASE WHEN level = 0 THEN 2 ELSE level END)) AS int))"), F.lit(" "), text)
    item = F.concat(F.expr("repeat('  ', cast(least(indent, 4) AS int))"), F.when(F.col("ordered"), "1.").otherwise("-"), F.lit(" "), _body())
    block = F.when(text == "", "").when(F.col("kind") == "heading", heading).when(F.col("kind") == "list_item", item).when(F.col("kind") == "caption", F.concat(F.lit("*"), text, F.lit("*"))).otherwise(text)
    image = F.when(F.col("path").isNull(), "").otherwise(F.concat(F.lit("!["), T.escape_md(F.coalesce(F.nullif("caption", F.lit("")), F.lit("Imagen"))), F.lit("]("), F.col("path"), F.lit(")")))
    return F.when(F.col("type") == "block", block).when(F.col("type") == "table", G.to_markdown(F.coalesce("rows", F.array().cast("array<array<string>>")), F.coalesce("has_header", F.lit(False)))).otherwise(image)


def pages_md(elements: DataFrame, page_marks: bool = True) -> DataFrame:
    """(doc, page, md): neighbouring list items stand on neighbouring lines, other elements apart."""
    order = Window.partitionBy("doc", "page").orderBy("element_no")
    is_list = F.coalesce((F.col("type") == "block") & (F.col("kind") == "list_item"), F.lit(False))
    rows = elements.withColumn("__list", is_list).withColumn("__close", F.col("__list") & F.coalesce(F.lag("__list").over(order), F.lit(False))).withColumn("__md", chunk_md()).where("__md <> ''")
    first = F.row_number().over(order) == 1
    glued = rows.withColumn("__md", F.concat(F.when(first & F.lit(not page_marks), "").when(F.col("__close") & ~first, "\n").otherwise("\n\n"), F.col("__md")))
    made = glued.groupBy("doc", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("element_no", "__md"))), lambda x: x["__md"]), "").alias("md"))
    return made.withColumn("md", F.concat(F.format_string(PAGE_MARK, F.col("page")), F.col("md"))) if page_marks else made


def documents_md(elements: DataFrame, titles: DataFrame | None = None, slides: bool = False) -> DataFrame:
    """(doc, md): pages in order, a rule between slides, under a title(doc, title) that the first heading doesn't repeat."""
    pages = F.transform(F.sort_array(F.collect_list(F.struct("page", "md"))), lambda x: x["md"])
    docs = pages_md(elements).groupBy("doc").agg(F.array_join(pages, "\n\n---\n\n" if slides else "\n\n").alias("md"))
    if titles is not None:
        first = elements.where(F.col("type") == "block").groupBy("doc").agg(F.min_by(F.struct("page", "kind", "text"), F.struct("page", "element_no")).alias("f")).where("f.kind = 'heading' AND f.page = 1").select("doc", T.fold(F.col("f.text")).alias("head"))
        own = T.fold(F.col("title"))
        told = F.coalesce((F.col("head") != "") & (F.startswith("head", own) | F.startswith(own, F.col("head"))), F.lit(False))
        docs = docs.join(titles, "doc", "left").join(first, "doc", "left").select("doc", F.when(told | F.col("title").isNull(), F.col("md")).otherwise(F.concat(F.lit("# "), "title", F.lit("\n\n"), "md")).alias("md"))
    return docs.withColumn("md", F.concat(F.rtrim("md"), F.lit("\n")))


def outline(elements: DataFrame, limit: int = OUTLINE) -> DataFrame:
    """(doc, outline, more): headings in reading order, the first ones, and how many follow."""
    text = T.strip(F.col("text"))
    heads = elements.where((F.col("kind") == "heading") & (text != "")).select("doc", F.struct("page", "element_no", F.concat(F.expr("repeat('#', cast(greatest(1, least(6, CASE WHEN level = 0 THEN 2 ELSE level END)) AS int))"), F.lit(" "), text).alias("h")).alias("x"))
    listed = heads.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["h"]).alias("all"))
    return listed.select("doc", F.slice("all", 1, limit).alias("outline"), F.greatest(F.size("all") - limit, F.lit(0)).cast("long").alias("more"))


def front_matter(docs: DataFrame, outlines: DataFrame) -> DataFrame:
    """(doc, front) for docs(doc, name, title, author, n_pages, n_tables, n_images, n_ocr, converted)."""
    row = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    heads = F.concat(F.lit("esquema:\n"), F.array_join(F.transform("outline", lambda h: F.concat(F.lit("  - "), T.escape_yaml(h))), "\n"), F.when(F.col("more") > 0, F.format_string('\n  - "(+%d encabezados mas)"', F.col("more"))).otherwise(""))
    ocr = F.when(F.col("n_ocr") > 0, F.format_string("si (%d de %d paginas)", F.col("n_ocr"), F.col("n_pages"))).otherwise("no")
    lines = F.array_compact(F.array(
        F.lit("---"), row("origen", T.escape_yaml(F.col("name"))), row("titulo", T.escape_yaml(F.col("title"))), F.when(F.coalesce("author", F.lit("")) != "", row("autor", T.escape_yaml(F.col("author")))),
        row("paginas", F.col("n_pages").cast("string")), row("tablas", F.col("n_tables").cast("string")), row("imagenes", F.col("n_images").cast("string")), row("ocr", ocr), row("convertido", F.col("converted")),
        F.when(F.col("outline").isNotNull(), heads), F.lit('resumen: ""'), F.lit("---"),
    ))
    return docs.join(outlines, "doc", "left").select("doc", F.array_join(lines, "\n").alias("front"))


def _documents(elements: DataFrame, piece: Column, mark: str, name: str) -> DataFrame:
    rows = elements.withColumn("__t", piece).where("__t IS NOT NULL")
    pages = rows.groupBy("doc", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("element_no", "__t"))), lambda x: x["__t"]), "\n\n").alias("__t"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", F.concat(F.format_string(mark, F.col("page")), F.lit("\n\n"), "__t").alias("t")))), lambda x: x["t"]), "\n\n")
    return pages.groupBy("doc").agg(F.concat(F.rtrim(whole), F.lit("\n")).alias(name))


def documents_txt(elements: DataFrame) -> DataFrame:
    """(doc, txt): page banners, blocks, tab-separated rows of tables, names of images."""
    rows = F.concat(F.array_join(F.transform(G.normalized(F.coalesce("rows", F.array().cast("array<array<string>>"))), lambda r: F.array_join(r, "\t")), "\n\n"), F.lit("\n\n"))
    piece = F.when(F.col("type") == "block", F.when(T.strip(F.col("text")) != "", F.col("text"))).when(F.col("type") == "table", rows).when(F.col("path").isNotNull(), F.concat(F.lit("[imagen: "), "path", F.lit("]")))
    return _documents(elements, piece, TEXT_MARK, "txt")


def documents_html(elements: DataFrame) -> DataFrame:
    """(doc, html): the body of a page; runs of list items of one kind share a list."""
    order = Window.partitionBy("doc").orderBy("page", "element_no")
    tag = F.when((F.col("type") == "block") & (F.col("kind") == "list_item"), F.when(F.col("ordered"), "ol").otherwise("ul"))
    text = T.strip(F.col("text"))
    rows = elements.where((F.col("type") != "block") | (text != "")).withColumn("__tag", tag)
    before, after = F.lag("__tag").over(order), F.lead("__tag").over(order)
    new_page, last = F.coalesce(F.lag("page").over(order) != F.col("page"), F.lit(True)), F.coalesce(F.lead("page").over(order) != F.col("page"), F.lit(True))
    rows = rows.withColumn("__open", F.col("__tag").isNotNull() & (new_page | F.coalesce(before != F.col("__tag"), F.lit(True)))).withColumn("__shut", F.col("__tag").isNotNull() & (last | F.coalesce(after != F.col("__tag"), F.lit(True)))).withColumn("__page", new_page)
    level = F.least(F.lit(6), _clamped() + 1).cast("string")
    wrap = lambda a, x, b: F.concat(F.lit(a), x, F.lit(b))
    block = F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, F.lit(">"), T.escape_html(text), F.lit("</h"), level, F.lit(">"))).when(F.col("__tag").isNotNull(), wrap("<li>", T.escape_html(_body()), "</li>")).when(F.col("kind") == "caption", wrap("<em class='caption'>", T.escape_html(text), "</em>")).otherwise(wrap("<p>", T.escape_html(text), "</p>"))
    piece = F.when(F.col("type") == "block", block).when(F.col("type") == "table", G.to_html(F.coalesce("rows", F.array().cast("array<array<string>>")), F.coalesce("has_header", F.lit(False)))).otherwise(F.coalesce(F.concat(F.lit("<img src='"), "path", F.lit("' alt='"), T.escape_html(F.col("caption")), F.lit("'>")), F.lit("")))
    piece = F.concat(F.when(F.col("__page"), F.format_string("<div class='pagemark'>PAGINA %d</div>", F.col("page"))).otherwise(""), F.when(F.col("__open"), F.concat(F.lit("<"), "__tag", F.lit(">"))).otherwise(""), piece, F.when(F.col("__shut"), F.concat(F.lit("</"), "__tag", F.lit(">"))).otherwise(""))
    return rows.select("doc", F.struct("page", "element_no", piece.alias("t")).alias("x")).groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "").alias("html"))


def documents_json(elements: DataFrame) -> DataFrame:
    """(doc, json): pages with their elements."""
    one = F.struct("element_no", F.col("kind").alias("tipo"), F.nullif("level", F.lit(0)).alias("nivel"), F.col("text").alias("texto"))
    pages = elements.groupBy("doc", "page").agg(F.sort_array(F.collect_list(one)).alias("elementos"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("page").alias("numero"), F.transform("elementos", lambda e: F.struct(e["tipo"].alias("tipo"), e["nivel"].alias("nivel"), e["texto"].alias("texto"))).alias("elementos"))))
    return pages.groupBy("doc").agg(listed.alias("paginas")).select("doc", F.to_json(F.struct("doc", "paginas"), {"ignoreNullFields": "false"}).alias("json"))


def embedded(sizes: Column, budget: int) -> Column:
    """For file sizes in order: which are embedded until the budget is used; a file that is too large is skipped, not the end."""
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<boolean>").alias("out"))
    step = lambda s, n: F.struct((s["left"] - F.when(n <= s["left"], n).otherwise(0)).alias("left"), F.concat(s["out"], F.array(n <= s["left"])).alias("out"))
    return F.aggregate(sizes, start, step, lambda s: s["out"])
