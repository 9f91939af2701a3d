"""Crawl dumps: pages, robots.txt, sitemaps and stored document bodies."""

from __future__ import annotations

import io
import re
import sys
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitelens.functions import text as X
from sitelens.functions import urls as U
from sitelens.limits import NONE, Limits
from sitelens.operators.html_parse import parse_page

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGES_DDL = (
    "url string, final_url string, title string, status_code int, ok boolean, html string, visible_text string, "
    "links array<string>, script_srcs array<string>, iframe_srcs array<string>, external_resources array<string>, "
    "network_requests array<string>, cookies array<struct<name: string, value: string, domain: string>>, "
    "modal_htmls array<string>, content_type string, fetch_method string, errors array<string>, "
    "headers map<string, string>, has_screenshot boolean"
)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Stored pages, one row per URL. ``operators.domains.with_domain`` adds the registered domain."""
    reader = spark.read.format(fmt)
    if fmt != "parquet" or schema:
        reader = reader.schema(schema or PAGES_DDL)
    return reader.load(path)


# ---- robots ---------------------------------------------------------------------------
def parse_robots(df: DataFrame) -> DataFrame:
    """(site_id, base_url, status_code, body) to found flag, sitemap URLs and disallowed paths."""
    def directive(line):
        t = X.strip(F.split_part(X.strip(line), F.lit("#"), F.lit(1)))
        return F.struct(
            F.lower(X.strip(F.split_part(t, F.lit(":"), F.lit(1)))).alias("k"),
            X.strip(F.substr(t, F.instr(t, ":") + 1)).alias("v"), t.contains(":").alias("ok"))

    def values(key):
        return F.transform(F.filter(F.col("d"), lambda d: d["ok"] & (d["k"] == key) & (d["v"] != "")), lambda d: d["v"])

    def resolved(v):
        base = F.rtrim(F.col("base_url"), F.lit("/"))
        return (F.when(v.rlike("(?i)^https?://") | v.rlike(U.SCHEME), v)
                .when(v.startswith("//"), F.concat(F.split_part(base, F.lit("//"), F.lit(1)), v))
                .when(v.rlike("^(mailto:|tel:|javascript:|#|data:)"), v)
                .otherwise(F.concat(base, F.when(v.startswith("/"), "").otherwise("/"), v)))

    found = F.col("status_code").between(200, 399) & (F.coalesce("body", F.lit("")) != "")
    lines = F.split(F.when(found, F.col("body")).otherwise(""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return df.withColumn("d", F.transform(lines, directive)).select(
        "site_id", found.alias("robots_txt_found"),
        F.array_distinct(F.transform(values("sitemap"), resolved)).alias("sitemaps"),
        F.array_distinct(values("disallow")).alias("disallow"))


# ---- sitemaps -------------------------------------------------------------------------
def _read_map(xml: str):
    low = xml.lower()
    if "<!entity" in low or "<!doctype" in low:
        return None
    for text in (xml, xml[max(xml.find("<"), 0):]):
        try:
            root = ET.fromstring(text)
        except (ET.ParseError, ValueError):
            continue
        local = [(el.tag.rsplit("}", 1)[-1].lower(), (el.text or "").strip()) for el in root.iter()
                 if isinstance(el.tag, str)]
        return {"kind": local[0][0], "locs": [v for t, v in local if t == "loc" and v]}
    return None


def parse_sitemaps(df: DataFrame) -> DataFrame:
    """(url, body) to root tag and <loc> values in order; maps with a DTD and broken XML yield none."""
    out = pa.struct([("kind", pa.string()), ("locs", pa.list_(pa.string()))])

    @F.arrow_udf("struct<kind: string, locs: array<string>>")
    def read(body: pa.Array) -> pa.Array:
        return pa.array([_read_map(x) if x else None for x in body.to_pylist()], out)

    m = df.withColumn("m", read("body"))
    return m.select(*[c for c in df.columns if c != "body"], F.coalesce("m.kind", F.lit("")).alias("kind"),
                    F.coalesce("m.locs", F.array().cast("array<string>")).alias("locs"))


def sitemap_urls(sites: DataFrame, robots: DataFrame, maps: DataFrame, limits: Limits = NONE) -> DataFrame:
    """(site_id, pos, url): the distinct pages named by each map of a site, an index opened for its
    children; all of them unless ``limits`` says otherwise."""
    def first_of(column, n):
        return F.col(column) if n is None else F.slice(column, 1, n)

    listed = sites.join(robots.select("site_id", "sitemaps"), "site_id", "left").select(
        "site_id",
        F.posexplode(F.when(F.size("sitemaps") > 0, first_of("sitemaps", limits.maps)).otherwise(
            F.array(F.concat(F.rtrim("base_url", F.lit("/")), F.lit("/sitemap.xml"))))).alias("map_pos", "map_url"))
    bodies = maps.select(F.col("url").alias("map_url"), "kind", "locs").dropDuplicates(["map_url"])
    top = listed.join(bodies, "map_url")
    opened = top.select(
        "site_id", "map_pos", "kind", "locs", "map_url",
        F.posexplode_outer(F.when(F.col("kind") == "sitemapindex", first_of("locs", limits.children)))
        .alias("child_pos", "child_url"))
    children = bodies.select(F.col("map_url").alias("child_url"), F.col("locs").alias("child_locs"))
    each = opened.join(children, "child_url", "left").select(
        "site_id", "map_pos", F.coalesce("child_pos", F.lit(0)).alias("child_pos"),
        F.posexplode(F.when(F.col("kind") == "sitemapindex", F.col("child_locs")).otherwise(F.col("locs")))
        .alias("loc_pos", "url"))
    first = each.groupBy("site_id", "map_pos", "url").agg(F.min(F.struct("child_pos", "loc_pos")).alias("at"))
    if limits.map_urls is not None:
        rank = F.row_number().over(Window.partitionBy("site_id", "map_pos").orderBy("at"))
        first = first.withColumn("rank", rank).where(F.col("rank") <= limits.map_urls)
    pos = F.row_number().over(Window.partitionBy("site_id").orderBy("map_pos", "at", "url"))
    return first.select("site_id", pos.alias("pos"), "url")


# ---- document bodies ------------------------------------------------------------------
def read_documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Stored files as (url, content); the file path stands for the URL until a manifest is joined."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
            .select(F.col("path").alias("url"), "length", "content"))


_BINARY = ("pdf", "octet-stream", "msword", "officedocument", "zip")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


_CHARSET = r"charset=[\"']?([\w\-]+)"


def _decode(content: bytes, content_type: str) -> str:
    named = re.search(_CHARSET, content_type or "", re.I) or re.search(_CHARSET.encode(), content, re.I)
    name = named.group(1) if named else None
    for enc in ([name.decode() if isinstance(name, bytes) else name] if name else []) + ["utf-8", "windows-1251", "latin-1"]:
        try:
            return content.decode(enc)
        except (LookupError, UnicodeDecodeError):
            continue
    return ""


def _paragraph(p) -> str:
    marks = {_W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n"}
    return "".join((e.text or "") if e.tag == _W + "t" else marks.get(e.tag, "") for e in p.iter())


def _docx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(_W + "body")
    parts = [_paragraph(p) for p in body.findall(_W + "p")]
    for table in body.findall(_W + "tbl"):
        parts += ["\n".join(_paragraph(p) for p in cell.findall(_W + "p"))
                  for row in table.findall(_W + "tr") for cell in row.findall(_W + "tc")]
    return "\n".join(p for p in parts if p).strip()


def _body_text(content, content_type, fmt):
    if not content:
        return {"text": "", "error": "empty_content"}
    try:
        if fmt == "pdf":
            return {"text": "", "error": "text_extraction_failed"}
        if fmt == "docx":
            text = _docx(content)
        else:
            page = parse_page(_decode(content, content_type), "")
            text = page["text"] if page["doc_text"] is None else page["doc_text"]
    except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError):
        text = ""
    return {"text": text, "error": "" if text else "text_extraction_failed"}


def body_texts(bodies: DataFrame) -> DataFrame:
    """(url, content[, final_url, status_code, content_type, text]) to text, format and error. A text
    column, where the store has one (PDF extractors), wins over the bytes."""
    out = pa.struct([("text", pa.string()), ("error", pa.string())])

    @F.arrow_udf("struct<text: string, error: string>")
    def extract(content: pa.Array, ctype: pa.Array, fmt: pa.Array) -> pa.Array:
        rows = zip(content.to_pylist(), ctype.to_pylist(), fmt.to_pylist())
        return pa.array([_body_text(*r) for r in rows], out)

    have = set(bodies.columns)

    def opt(c, default) -> Column:
        return F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)

    final = F.when(opt("final_url", "") != "", opt("final_url", "")).otherwise(F.col("url"))
    df = bodies.withColumns({
        "final_url": final, "status_code": opt("status_code", 200), "content_type": opt("content_type", "")})
    df = df.withColumn("format", X.detect_format(F.col("final_url"), F.col("content_type")))
    df = df.withColumn("x", extract("content", "content_type", "format"))
    text = F.coalesce(F.when(F.col("text") != "", F.col("text")), F.col("x.text")) if "text" in have else F.col("x.text")
    return df.select("url", "final_url", "status_code", F.col("status_code").between(200, 399).alias("ok"),
                     "content_type", "format", text.alias("text"),
                     F.when(text != "", "").otherwise(F.col("x.error")).alias("error"))


def docx_text(df: DataFrame) -> DataFrame:
    return body_texts(df.withColumn("content_type", F.lit("msword"))).select("url", "text", "error")


#: one-byte charsets, with the names that bodies give them
ONE_BYTE = {"cp1251": ("windows-1251", "cp1251", "cp-1251", "win-1251"), "koi8-r": ("koi8-r", "koi8_r", "koi8r"), "cp866": ("cp866", "ibm866", "866"),
            "iso8859-5": ("iso-8859-5", "iso8859-5", "cyrillic"), "cp1252": ("windows-1252", "cp1252"), "latin-1": ("iso-8859-1", "latin-1", "latin1", "iso8859-1")}


def _high(charset: str) -> list[str | None]:
    """The characters of bytes 128 to 255; None where the charset has none."""
    def one(byte):
        try:
            return bytes([byte]).decode(charset)
        except UnicodeDecodeError:
            return None

    return [one(b) for b in range(128, 256)]


def _one_byte(latin: Column, charset: str) -> Column:
    """Text whose bytes were read as Latin-1, in its own charset; NULL if a byte has no character there."""
    high = _high(charset)
    pairs = [(chr(128 + i), ch) for i, ch in enumerate(high) if ch is not None and ch != chr(128 + i)]
    text = F.translate(latin, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)) if pairs else latin
    holes = "".join(f"\\x{128 + i:02x}" for i, ch in enumerate(high) if ch is None)
    return F.when(~latin.rlike(f"[{holes}]"), text) if holes else text


@F.arrow_udf(StringType())
def _decode_udf(content: pa.Array, ctype: pa.Array) -> pa.Array:
    return pa.array([_decode(c, t) if c else "" for c, t in zip(content.to_pylist(), ctype.to_pylist())], pa.string())


def decode_bodies(df: DataFrame, limits: Limits = NONE) -> DataFrame:
    """(url, content, content_type) to text by the declared charset, else UTF-8, windows-1251, Latin-1;
    binary content types stay empty. The charset is searched in the whole content, or in its first
    limits.charset_bytes. Decoding is a column expression: one-byte charsets are Latin-1, translated.
    Bodies in a charset that is not listed alone go to Python."""
    ct = F.lower(F.coalesce("content_type", F.lit("")))
    binary = ct.rlike("|".join(map(re.escape, _BINARY)))
    rows = df.select("url", ct.alias("ct"), F.when(~binary, F.col("content")).alias("content")).withColumn(
        "latin", F.decode(F.coalesce("content", F.lit(b"")), "ISO-8859-1"))
    head = F.col("latin") if limits.charset_bytes is None else F.substring("latin", 1, limits.charset_bytes)
    named = F.coalesce(F.nullif(F.regexp_extract("ct", f"(?i){_CHARSET}", 1), F.lit("")), F.regexp_extract(head, f"(?i){_CHARSET}", 1))
    rows = rows.withColumn("charset", F.lower(named))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    utf8 = F.when(valid, F.decode("content", "UTF-8"))
    cyrillic = _one_byte(F.col("latin"), "cp1251")
    own = F.when(F.col("charset").isin("utf-8", "utf8"), utf8)
    for charset, names in ONE_BYTE.items():
        own = own.when(F.col("charset").isin(*names), _one_byte(F.col("latin"), charset))
    listed = F.col("charset").isin("", "utf-8", "utf8", *(n for names in ONE_BYTE.values() for n in names))
    other = _decode_udf(F.when(~listed, F.col("content")), F.concat(F.lit("charset="), F.col("charset")))
    text = F.when(listed, F.coalesce(own, utf8, cyrillic, F.col("latin"))).otherwise(other)
    return rows.select("url", F.when(F.col("content").isNull(), "").otherwise(text).alias("text"))
