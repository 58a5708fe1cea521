"""Queries over landed pages: links, images, chapter lists and titles, encoded lists, urls."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.sources import html as H, landed as L, registry

_SITE, _READER = "https://example.org", "reader.example.org"


def _listings(spark, d, item):
    """A page for each nation, with one item for each of its suppliers in order of their keys."""
    k = F.col("s_suppkey")
    return L.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("item")))), lambda x: x["item"]), "").alias("items"))


def _page(head: str, tail: str):
    return F.concat(F.lit(f"<html><script>var a='<a href=1>';</script>{head}"), F.col("items"), F.lit(f"{tail}</html>")).alias("html")


def page_links(spark, d):
    return H.links(L.table(spark, d, "pages"))


def site_chapters(spark, d):
    """The chapters that landed pages list, read by the site of each url; the sites are found in their package."""
    pages = L.table(spark, d, "pages")
    sites = registry.discover("panelspark.sources.sites")
    return sites.read("chapter_list", pages.select("page_id", "url"), lambda urls: urls.join(pages.select("page_id", "html"), "page_id"))


def chapter_links(spark, d):
    """Listed links with and without target and span; a link deeper inside is not listed."""
    k, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    item = F.when(k % 5 == 0, F.lit("<a><span>none</span></a>")).when(k % 5 == 1, F.concat(F.lit("<a href='/c/"), k, F.lit("'>bare</a>"))).when(k % 5 == 2, F.concat(F.lit('<p><a href="/c/'), k, F.lit('"><span>deep</span></a></p>'))).otherwise(F.concat(F.lit('<a href="/c/'), k, F.lit('"><b>1</b><span> '), name, F.lit(" </span> new</a>")))
    return H.chapter_links(_listings(spark, d, item).select("page_id", F.lit(None).cast("string").alias("url"), _page("<ul><li><a href='/x'>x</a></ul><div class='top list-group'>", "</div>")), base=_SITE)


def chapter_table(spark, d):
    """Table rows with and without a link, a target, or a path that the reader's host has."""
    k, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    item = F.when(k % 4 == 0, F.lit("<tr><td>none</td></tr>")).when(k % 4 == 1, F.concat(F.lit('<tr><td><a class="chico" href="/chapter/'), k, F.lit('?x=1"> '), name, F.lit(" </a></td></tr>"))).when(k % 4 == 2, F.concat(F.lit('<tr><td><a class="chico" href="/manga/'), k, F.lit('">'), name, F.lit("</a></td></tr>"))).otherwise(F.concat(F.lit('<tr><td><a class="x chico">'), name, F.lit("</a></td></tr>")))
    pages = _listings(spark, d, item).select("page_id", F.concat(F.lit(f"{_SITE}/m/"), F.col("page_id").cast("string")).alias("url"), _page("<table><tbody><tr><td><a class='chico' href='/no'>no</a></tr></table><table class='wide uk-table'><tbody>", "</tbody></table>"))
    return H.chapter_table(pages, _READER)


def page_images(spark, d):
    """Page images with either source; one without leaves a gap, images of another class do not count."""
    k = F.col("s_suppkey").cast("string")
    item = F.concat(F.lit("<img class='logo' src='z.png'>"), F.when(k % 3 == 0, F.concat(F.lit('<img class="d-block w" src="s.gif" data-src="/i/'), k, F.lit('.jpg">'))).when(k % 3 == 1, F.concat(F.lit('<img class="d-block" data-src="" src="//cdn.example.net/'), k, F.lit('.png"/>'))).otherwise(F.lit("<img class='d-block' alt='x'>")))
    return H.images(_listings(spark, d, item).select("page_id", F.lit("").alias("url"), _page("<body>", "</body>")), base=_SITE)


def chapter_info(spark, d):
    """Titles from either kind of page, without a colon, and from neither."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    s = k.cast("string")
    html = F.when(k % 3 == 0, F.concat(F.lit('<div id="chapter-info"> <b> '), name, F.lit(" </b>: <i>Part "), s, F.lit(": end </i></div><p class='chapter'>no</p>"))).when(k % 3 == 1, F.concat(F.lit('<h1 id="series"> '), name, F.lit(' </h1><span class="a chapter"> c'), s, F.lit(" </span>"))).when(k % 2 == 0, F.concat(F.lit('<div id="chapter-info">'), name, F.lit("</div>"))).otherwise(F.lit("<span id='chapter-info'>no</span>"))
    return H.chapter_info(L.table(spark, d, "nation").select(k.alias("page_id"), html.alias("html")))


def encoded_pages(spark, d):
    """Lists of page images in landed pages: scrambled with a key that stands in the text, closed with NULs, encrypted, in base64;
    the key and the vector stand in an encoded script file. Some pages have no list, some a script that has not landed."""
    k = F.col("page_id").cast("string")
    rows = L.table(spark, d, "pages").where("page_id is not null").withColumn("list", F.concat(F.lit("https://a.example/"), k, F.lit("/1.jpg, ,"), F.coalesce(F.split("url", ",")[0], F.lit("")), F.lit("/3.jpg")))
    chars, n = F.split("list", ""), F.length("list")
    swapped = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(chars, F.when((i % 2 == 0) & (i + 3 < n), i + 3).when((i % 2 == 1) & (i >= 3), i - 3).otherwise(i))), "")
    plain = F.encode(F.concat(F.left(swapped, F.lit(2)), F.lit("3"), F.substr(swapped, F.lit(3))), "utf-8")
    size = F.octet_length(plain)
    plain = F.concat(plain, F.unhex(F.repeat(F.lit("00"), (16 - size % 16) % 16)))
    key, iv = F.unhex(F.left(F.sha2(F.concat(F.lit("k"), k), 256), F.lit(32))), F.unhex(F.left(F.sha2(F.concat(F.lit("v"), k), 256), F.lit(32)))
    sealed = F.aes_encrypt(plain, key, F.lit("CBC"), F.lit("PKCS"), iv)  # vector, text, one block of padding
    packed = F.replace(F.base64(F.substring(sealed, 17, F.octet_length(plain))), F.lit("\r\n"), F.lit(""))
    variable = lambda name, x: F.concat(F.lit(f'var {name} = CryptoJS.enc.Hex.parse("'), F.lower(F.hex(x)), F.lit('");'))
    source = F.concat(F.lit("k=str.charAt(2)+str.charAt( 2 );"), variable("key", key), variable("iv", iv))
    codes = F.array_join(F.transform(F.split(source, ""), lambda c: F.ascii(c).cast("string")), "q")
    head, tail = H.SCRIPT_MARGINS
    script = F.concat(F.lit(H.SCRIPT_HEAD + "x" * (head - len(H.SCRIPT_HEAD))), codes, F.lit("z" * tail))
    page = F.concat(F.coalesce("html", F.lit("")), F.lit("<script>var other='1'</script><script src='/js/x.js'></script><script src='/js/"), k, F.lit("/chapter.js?v=1'></script>"))
    html = F.when(F.col("page_id") % 7 == 0, page).otherwise(F.concat(page, F.lit("<p>t</p><script>var imgsrcs = '"), packed, F.lit("';</script>")))
    scripts = rows.where(F.col("page_id") % 5 != 1).select(F.concat(F.lit(f"{_SITE}/js/"), k, F.lit("/chapter.js?v=1")).alias("url"), script.alias("script"))
    return H.encoded_pages(rows.select("page_id", F.lit(f"{_SITE}/c/1").alias("url"), html.alias("html")), scripts)


def script_variables(spark, d):
    """A script's hexadecimal variable and its number of columns."""
    rows = L.table(spark, d, "benchmark")
    script = F.concat(F.lit('var key = CryptoJS.enc.Hex.parse("'), F.lower(F.hex(F.encode("text", "utf-8"))), F.lit('");var widthnum=heightnum = '), (F.col("item_id") % 9).cast("string"), F.lit(";"))
    return rows.select("item_id", F.decode(H.hex_variable(script, "key"), "utf-8").alias("key"), H.hex_variable(script, "iv").isNull().alias("no_iv"), F.regexp_extract(script, H.COLUMNS, 1).cast("int").alias("cols"))


def url_parts(spark, d):
    url = F.col("url")
    return L.table(spark, d, "pages").select("page_id", F.parse_url(url, F.lit("HOST")).alias("host"), F.parse_url(url, F.lit("PATH")).alias("path"), H.slug_of(F.parse_url(url, F.lit("PATH"))).alias("slug"), F.replace(F.url_encode(url), F.lit("+"), F.lit("%20")).alias("encoded"))


def chapter_list_json(spark, d):
    rows = L.table(spark, d, "nation")
    item = F.struct(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))).alias("chapter_slug"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("chapter_name"))
    payload = rows.groupBy("n_regionkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("data"))).alias("payload"))
    got = payload.select("n_regionkey", F.posexplode(H.chapter_list(F.col("payload"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "https://example.org")).alias("pos", "c"))
    return got.select("n_regionkey", "pos", F.col("c.url").alias("url"), F.col("c.name").alias("name"))


def codecs(spark, d):
    """Round trips of the codecs: base64 and hexadecimal text to bytes, character codes to text."""
    rows = L.table(spark, d, "benchmark")
    packed = F.replace(F.base64(F.encode("text", "utf-8")), F.lit("\r\n"), F.lit(""))
    return rows.select("item_id", F.length(packed).alias("base64_length"), F.decode(F.unbase64(packed), "utf-8").alias("decoded"), F.octet_length(F.unhex(F.hex("text"))).alias("n_bytes"), F.get(F.regexp_extract_all("text", F.lit(r"([A-Z]\w+)"), F.lit(1)), F.lit(0)).alias("first_name"))


QUERIES = {f.__name__: f for f in (page_links, site_chapters, chapter_links, chapter_table, page_images, chapter_info, encoded_pages, script_variables, url_parts, chapter_list_json, codecs)}
_PART = "SELECT s_nationkey AS page_id, s_suppkey AS k, trim(s_name) AS s_name"
_LINKS = """WITH h AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS href, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS name FROM pages),
l AS (SELECT page_id, url, unnest(href) AS href, unnest(name) AS name, CAST(generate_subscripts(href, 1) - 1 AS INT) AS pos FROM h)
SELECT page_id, pos, regexp_extract(url, '^[a-z]+://[^/?#]+') || replace(href, '&amp;', '&') AS url, coalesce(nullif(trim(replace(name, '&amp;', '&')), ''), 'Unknown_Chapter') AS name FROM l WHERE href <> ''"""
ORACLE = {
    "page_links": _LINKS,
    "site_chapters": f"SELECT l.* FROM ({_LINKS}) l JOIN pages p ON l.page_id = p.page_id WHERE contains(lower(p.url), 'example.net') OR contains(lower(p.url), 'example.org')",
    "chapter_links": f"""WITH s AS ({_PART}, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS pos FROM supplier WHERE s_suppkey % 5 <> 2)
SELECT page_id, pos, 'https://example.org/c/' || k AS url, CASE WHEN k % 5 = 1 THEN 'Unknown_Chapter' ELSE s_name END AS name FROM s WHERE k % 5 <> 0""",
    "chapter_table": f"""WITH s AS ({_PART}, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS pos FROM supplier)
SELECT page_id, pos, CASE k % 4 WHEN 1 THEN 'https://reader.example.org/chapter/' || k WHEN 2 THEN 'https://example.org/manga/' || k ELSE 'https://example.org/m/' || page_id END AS url, s_name AS name FROM s WHERE k % 4 <> 0""",
    "page_images": f"""WITH s AS ({_PART}, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS pos FROM supplier)
SELECT page_id, pos, CASE k % 3 WHEN 0 THEN 'https://example.org/i/' || k || '.jpg' ELSE 'https://cdn.example.net/' || k || '.png' END AS url FROM s WHERE k % 3 <> 2""",
    "chapter_info": """SELECT CAST(n_nationkey AS BIGINT) AS page_id, CASE WHEN n_nationkey % 3 <= 1 OR n_nationkey % 2 = 0 THEN n_name ELSE 'Unknown Title' END AS title,
       CASE n_nationkey % 3 WHEN 0 THEN 'Part ' || n_nationkey || ': end' WHEN 1 THEN 'c' || n_nationkey ELSE 'Unknown Chapter' END AS chapter_name FROM nation""",
    "encoded_pages": """SELECT page_id, CAST(0 AS INT) AS index, 'https://a.example/' || page_id || '/1.jpg' AS url FROM pages WHERE page_id % 7 <> 0 AND page_id % 5 <> 1
UNION ALL SELECT page_id, 2, trim(coalesce(split_part(url, ',', 1), '') || '/3.jpg') FROM pages WHERE page_id % 7 <> 0 AND page_id % 5 <> 1""",
    "script_variables": "SELECT item_id, text AS key, true AS no_iv, CAST(item_id % 9 AS INT) AS cols FROM benchmark",
    "url_parts": r"SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(trim(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/'), '([^/]*)$', 1) AS slug, url_encode(url) AS encoded FROM pages",
    "chapter_list_json": """WITH n AS (SELECT n_regionkey, lower(replace(n_name, ' ', '-')) AS slug, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS name FROM nation)
SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY slug, name NULLS FIRST) - 1 AS INT) AS pos, 'https://example.org/read/r' || n_regionkey || '/' || slug AS url, coalesce(name, 'Unknown_Chapter') AS name FROM n""",
    "codecs": r"SELECT item_id, length(to_base64(encode(text))) AS base64_length, text AS decoded, CAST(strlen(text) AS INT) AS n_bytes, regexp_extract_all(text, '([A-Z]\w+)', 1)[1] AS first_name FROM benchmark",
}
