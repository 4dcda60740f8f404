"""URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.scratch import let

#: Query keys that only track visitors. Fixed values; keys that start with utm_ count as well.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")
#: Query keys that may be shown in public logs. Fixed values.
PUBLIC_KEYS = ("persistentid", "fileid", "version", "format", "id")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def host(url: Column) -> Column:
    """Lower-cased host name without user information and port."""
    return F.lower(F.regexp_extract(authority(url), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` segments folded away, however many there are."""
    def fold(parts: Column) -> Column:
        kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
        return F.array_join(F.concat(kept, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")

    up = lambda a: F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
    return let(let(F.split(path, "/"), fold), lambda out: F.when(F.startswith(out, F.lit("/")), out).otherwise(F.concat(F.lit("/"), out)))


def resolve(url: Column, base: Column) -> Column:
    """Absolute form of a reference, without dot segments."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    own, rest = F.regexp_extract(url, r"^[^?#]*", 0), F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    whole = F.when(F.startswith(url, F.lit("/")), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    joined = F.concat(root, let(whole, lambda p: F.when(p.rlike(r"/\.{1,2}(/|$)"), without_dots(p)).otherwise(p)), rest)
    plain = F.concat(root, path(base))
    return (F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(F.startswith(url, F.lit("//")), F.concat(scheme(base), F.lit(":"), url))
            .when(F.startswith(url, F.lit("?")), F.concat(plain, url))
            .when((url == "") | F.startswith(url, F.lit("#")), F.regexp_replace(base, "#.*$", "")).otherwise(joined))


def _recode(part: Column) -> Column:
    """Decode and encode again as a form field."""
    coded = F.url_encode(F.coalesce(F.try_url_decode(part), part))
    return F.replace(F.replace(coded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_query(query: Column, keep) -> Column:
    """Pairs whose lower-cased key passes ``keep``, in order, encoded again."""
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & keep(F.lower(F.split_part(p, F.lit("="), F.lit(1)))))
    return F.array_join(F.transform(pairs, lambda p: F.concat(_recode(F.split_part(p, F.lit("="), F.lit(1))), F.lit("="), _recode(F.regexp_replace(p, "^[^=]*=?", "")))), "&")


def _not_tracking(key: Column) -> Column:
    return ~key.isin(*TRACKING) & ~F.startswith(key, F.lit("utm_"))


def assemble(url: Column, query: Column) -> Column:
    p = path(url)
    return F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), F.when(p == "", "/").otherwise(p), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def canonical(url: Column, base: Column | None = None) -> Column:
    """Lower-case scheme and host, no tracking keys, no fragment, '/' for an empty path.

    Path case, default ports and trailing slashes are left as they are."""
    absolute = F.trim(url) if base is None else resolve(F.trim(url), base)
    return let(absolute, lambda u: assemble(u, clean_query(query_string(u), _not_tracking)))


def problem(url: Column) -> Column:
    """Why a URL cannot be used, or null."""
    u, a = F.trim(url), authority(F.trim(url))
    port = F.regexp_extract(a, r":([^:\]]*)$", 1)
    bad_port = a.rlike(r":[^:\]]*$") & (port != "") & (~port.rlike("^[0-9]{1,5}$") | (F.coalesce(F.expr("0") + port.try_cast("int"), F.lit(99999)) > 65535))
    return (F.when(u.isNull() | (u == ""), "blank").when(F.contains(u, F.lit("\\")), "backslash").when(u.rlike(r"[\s\x7f]"), "whitespace")
            .when(~scheme(u).isin("http", "https"), "not_http").when(F.contains(a, F.lit("@")), "userinfo").when(host(u) == "", "no_host").when(bad_port, "bad_port"))


def dataset_url(page: Column, declared: Column) -> Column:
    """The declared canonical link if it is usable and on the page's host, else the page itself."""
    said = F.coalesce(F.trim(declared), F.lit("")) != ""
    return let(canonical(declared, page), lambda d: F.when(said & problem(d).isNull() & (host(d) == host(page)), d).otherwise(canonical(page)))


def redacted(url: Column) -> Column:
    """Public form: no user information, only allow-listed query keys, no fragment."""
    safe = F.regexp_replace(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@?#]*@", "$1")
    return assemble(safe, clean_query(query_string(safe), lambda k: k.isin(*PUBLIC_KEYS)))


def dropped_keys(url: Column) -> Column:
    keys = F.transform(F.filter(F.split(query_string(url), "&"), lambda p: p != ""), lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1))))
    return F.filter(keys, lambda k: ~k.isin(*PUBLIC_KEYS))
