"""URL column expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.text import clean_text, let, strip

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"
# scheme, authority and path of a URL; none of them is required
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#@]*)"
_BASE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)"
IPV4 = r"^(\d{1,3}\.){3}\d{1,3}$"

# Href prefixes that never lead to a page, and asset suffixes.
NON_PAGE_PREFIXES = ("mailto:", "tel:", "javascript:", "#", "data:")
ASSET_SUFFIXES = (
    "jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "css", "js", "woff", "woff2",
    "ttf", "mp4", "mp3", "zip", "rar", "xml", "json",
)

def _fold_scheme(u: Column) -> Column:
    head = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    return F.concat(F.lower(head), F.substr(u, F.length(head) + 1))


def strip_fragment(u: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(u, r"(?s)#.*$", ""), r"\?$", "")


def normalize_url(u: Column) -> Column:
    t = strip(F.coalesce(u, F.lit("")))
    full = F.when(t.rlike(SCHEME), t).otherwise(F.concat(F.lit("https://"), t))
    return F.when(t == "", F.lit("")).otherwise(_fold_scheme(strip_fragment(full)))


def to_http(u: Column) -> Column:
    rest = F.regexp_replace(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://)?", "")
    return F.concat(F.lit("http://"), rest)


def get_host(u: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(u, F.lit("")), _HOST, 1))


def url_path(u: Column) -> Column:
    return F.regexp_extract(F.coalesce(u, F.lit("")), _PATH, 1)


def host_or_name(u: Column) -> Column:
    """Host of a URL, or of a bare name what stands before its first slash."""
    return let(get_host(u), lambda h: F.when(h != "", h).otherwise(F.substring_index(F.lower(F.coalesce(u, F.lit(""))), "/", 1)))


def last_two_labels(u: Column) -> Column:
    """The registered domain where no suffix list is at hand; ``operators.domains`` joins the list."""
    return let(host_or_name(u), lambda h: F.when(h.rlike(IPV4) | h.startswith("["), h).otherwise(F.substring_index(h, ".", -2)))


def _merged(base_path: Column, path: Column) -> Column:
    """A relative path resolved against the base's path: ``.`` and ``..`` are folded over the
    segments; empty ones in between fall out unless the path begins at the root."""
    parts = F.split(path, "/", -1)
    own = F.split(base_path, "/", -1)
    folder = F.when(F.element_at(own, -1) != "", F.slice(own, 1, F.size(own) - 1)).otherwise(own)

    def fold(segments):
        inner = F.filter(segments, lambda s, i: path.startswith("/") | (i == 0) | (i == F.size(segments) - 1) | (s != ""))
        out = F.aggregate(inner, F.array().cast("array<string>"), lambda acc, s: F.when(
            s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.array_append(acc, s)))
        last = F.element_at(segments, -1)
        return F.array_join(F.when(last.isin(".", ".."), F.array_append(out, F.lit(""))).otherwise(out), "/")

    return F.when(path.startswith("/") & ~path.rlike(r"/\.\.?(/|$)"), path).otherwise(let(
        F.when(path.startswith("/"), parts).otherwise(F.concat(folder, parts)), fold))


def resolve(base: Column, ref: Column) -> Column:
    """A reference resolved against a base URL (RFC 3986, segments as browsers and crawlers read them)."""
    def against(r):
        tail = F.regexp_replace(F.regexp_extract(r, r"([?#].*)$", 1), r"^\?(?=#|$)|#$", "")
        path = F.regexp_extract(r, r"^([^?#]*)", 1)
        query = F.regexp_replace(F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1), r"^\?$", "")
        merged = let(_merged(url_path(base), path), lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))
        return (F.when(base == "", r).when(r == "", base).when(r.rlike("^[a-zA-Z][a-zA-Z0-9+.\\-]*:"), F.when(r.rlike(SCHEME), _fold_scheme(F.concat(path, tail))).otherwise(r))
                .when(r.startswith("//"), F.concat(F.split_part(base_from_url(base), F.lit("//"), F.lit(1)), path, tail))
                .when((path == "") & tail.startswith("?"), F.concat(base_from_url(base), url_path(base), tail))
                .when(path == "", F.concat(base_from_url(base), url_path(base), query, tail))
                .otherwise(F.concat(base_from_url(base), merged, tail)))

    def checked(r):
        brackets = F.regexp_extract(r, "^[^/?#]*//([^/?#]*)", 1)
        return F.when(brackets.contains("[") != brackets.contains("]"), F.lit("")).otherwise(against(r))

    return let(F.translate(ref, "\t\r\n", ""), checked)


def _no_page(h: Column) -> Column:
    bad = h == ""
    for p in NON_PAGE_PREFIXES:
        bad = bad | h.startswith(p)
    return bad


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` resolved against ``base``; '' for mail, phone, script, data and bare anchors."""
    h = strip(F.coalesce(href, F.lit("")))
    return F.when(_no_page(h), F.lit("")).otherwise(resolve(base, h))


def root_relative_url(base: Column, href: Column) -> Column:
    """JVM-only variant for hrefs that are absolute or start with a single slash; NULL for
    forms that need real reference resolution."""
    h = strip(F.coalesce(href, F.lit("")))
    return (
        F.when(_no_page(h), F.lit(""))
        .when(h.rlike(SCHEME), h)
        .when(h.rlike("^/([^/]|$)") & ~h.contains("/."), F.concat(base_from_url(base), h))
    )


def is_probably_html_url(u: Column) -> Column:
    bare = F.split_part(F.lower(u), F.lit("?"), F.lit(1))
    return ~bare.rlike(r"\.(" + "|".join(ASSET_SUFFIXES) + r")$")


def url_extension(u: Column) -> Column:
    return F.regexp_extract(F.lower(url_path(u)), r"\.([a-z0-9]{1,5})$", 1)


def base_from_url(u: Column) -> Column:
    return _fold_scheme(F.regexp_extract(F.coalesce(u, F.lit("")), _BASE, 1))


def url_search_blob(u: Column) -> Column:
    path = url_path(u)
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.concat(u, F.lit(" "), plain, F.lit(" "), F.regexp_replace(plain, r"[/_\-.]+", " "))


def url_key(u: Column) -> Column:
    return F.rtrim(strip_fragment(u), F.lit("/"))


def ipv4_number(ip: Column) -> Column:
    """IPv4 text to a number; NULL for anything else."""
    part = F.split(ip, r"\.")
    n = F.lit(0).cast("long")
    for i in range(4):
        n = n * 256 + F.try_element_at(part, F.lit(i + 1)).try_cast("long")
    return F.when(ip.rlike(IPV4), n)


def ip_key(ip: Column) -> Column:
    """An address as text whose order is that of the numbers: ``4`` and 8 hexadecimal digits, or ``6`` and
    32. An IPv4 address inside an IPv6 one (``::ffff:1.2.3.4``) counts as IPv4; NULL for anything else."""
    def v4(n):
        return F.concat(F.lit("4"), F.lpad(F.lower(F.hex(n)), 8, "0"))

    def padded(groups):
        return F.transform(F.filter(groups, lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))

    def v6(t):
        tail = ipv4_number(F.regexp_extract(t, r"([^:]*)$", 1))
        dotted = t.contains(".")
        low = F.lpad(F.lower(F.hex(tail)), 8, "0")
        whole = F.when(dotted, F.concat(F.regexp_replace(t, r"[^:]*$", ""), F.substring(low, 1, 4), F.lit(":"), F.substring(low, 5, 4))).otherwise(t)

        def of(w):
            short = w.contains("::")
            left, right = padded(F.split(F.split_part(w, F.lit("::"), F.lit(1)), ":")), padded(F.split(F.when(short, F.substring_index(w, "::", -1)).otherwise(""), ":"))
            n = F.size(left) + F.size(right)
            good = w.rlike(r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?$") & F.when(short, n <= 7).otherwise(n == 8)
            digits = F.concat(F.array_join(left, ""), F.when(short, F.repeat(F.lit("0000"), F.lit(8) - n)).otherwise(""), F.array_join(right, ""))
            return F.when(good, let(digits, lambda d: F.when(d.startswith("0" * 20 + "ffff"), F.concat(F.lit("4"), F.substring(d, 25, 8))).otherwise(F.concat(F.lit("6"), d))))

        return F.when(t.contains(":") & (~dotted | tail.isNotNull()), let(whole, of))

    number = ipv4_number(ip)
    return F.when(number.isNotNull() & number.between(0, 2 ** 32 - 1), v4(number)).otherwise(let(F.lower(F.btrim(ip)), v6))


# Address blocks that are not globally reachable.
PRIVATE_BLOCKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
_PRIVATE_V6 = r"^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:0?db8:|100::)"


def is_private_ip(ip: Column) -> Column:
    n = ipv4_number(ip)
    hit = F.lit(False)
    for block in PRIVATE_BLOCKS:
        addr, bits = block.split("/")
        lo = 0
        for octet in addr.split("."):
            lo = lo * 256 + int(octet)
        hit = hit | n.between(lo, lo + 2 ** (32 - int(bits)) - 1)
    hit = hit & ~ip.isin("192.0.0.9", "192.0.0.10")
    return F.coalesce(hit, F.lower(ip).rlike(_PRIVATE_V6), F.lit(False))


# Brand endings that are split off a glued domain label.
BRAND_ENDINGS = ("life", "shop", "store", "group", "clinic", "school", "online", "studio", "legal")


def brand_from_url(u: Column) -> Column:
    full = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))
    host = F.regexp_replace(F.regexp_extract(full, r"://(?:[^/?#]*@)?([^:/?#]*)", 1), r"^www\.", "")
    label = strip(F.translate(F.split_part(host, F.lit("."), F.lit(1)), "-_", "  "))
    low = F.lower(label)
    glued = F.regexp_replace(low, "^(.{3,}?)(" + "|".join(BRAND_ENDINGS) + ")$", "$1 $2")
    spaced = F.when(glued != low, glued).otherwise(label)
    name = F.initcap(clean_text(spaced))
    return F.when(label == "", F.when(host == "", F.lit("Компания")).otherwise(host)).otherwise(name)


def page_title_name(title: Column) -> Column:
    """Usable name out of a page title, NULL when the title does not qualify."""
    t = strip(F.coalesce(title, F.lit("")))
    cut = strip(F.split_part(F.split_part(t, F.lit("|"), F.lit(1)), F.lit(" - "), F.lit(1)))
    ok = (t != "") & (F.length(t) <= 80) & ~F.lower(t).contains("404")
    return F.when(ok, F.when(cut != "", cut).otherwise(t))


def looks_like_url(c: Column) -> Column:
    t = F.lower(strip(c))
    return t.startswith("http://") | t.startswith("https://") | (t.contains(".") & ~t.contains(" "))


def display_name(sites, pages):
    """Client name per site: company name, else the first good page title, else the brand."""
    titled = pages.withColumn("name", page_title_name(F.col("title"))).where("name is not null")
    first = titled.groupBy("site_id").agg(F.min_by("name", "page_pos").alias("title_name"))
    company = strip(F.coalesce(F.col("company_name"), F.lit("")))
    return sites.join(first, "site_id", "left").select(
        "site_id",
        F.when((company != "") & ~looks_like_url(company), company)
        .otherwise(F.coalesce("title_name", brand_from_url(F.col("site_url"))))
        .alias("display_name"),
    )
