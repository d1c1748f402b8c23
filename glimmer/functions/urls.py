"""URLs and identifiers of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glimmer.functions import lexicon as L


def host(url: Column) -> Column:
    """Lower-case host without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    """As a form encodes: letters, digits and _.-~ stay, a space is +."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without www, no tracking parameters, fragment or trailing slash (the root keeps its own);
    a bare DOI becomes its doi.org address; hosts that only redirect, and what is no absolute URL, give NULL."""
    u = F.coalesce(url, F.lit(""))
    bare = F.regexp_replace(F.when(u.contains(":"), F.substr(u, F.instr(u, ":") + 1)).otherwise(u), "^/+", "")
    plain = F.regexp_replace(u, "#.*$", "")
    scheme = F.lower(F.regexp_extract(plain, r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://", 1))
    net = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: p != "")
    pair = lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.when(p.contains("="), F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit(""))).alias("v"))
    kept = F.filter(F.transform(asked, pair), lambda x: ~F.lower(x["k"]).rlike(L.TRACKING))
    query = F.array_join(F.transform(kept, lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")
    made = F.concat(scheme, F.lit("://"), net, F.when(path == "", F.lit("/")).otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.lower(u).rlike(r"^(10\.|doi:)"), F.concat(F.lit("https://doi.org/"), bare)).when((scheme != "") & (net != "") & ~net.isin(*L.REDIRECTS), made)


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host, three below a suffix of two labels."""
    labels = F.split(host(url), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return F.when(two.isin(*L.SUFFIXES), three).otherwise(two)


#: Where a DOI begins in an address or text.
_DOI = r"(?i)(?:doi\.org/|^doi:|\b)(10\.[0-9]{4,9}"


def doi(text: Column) -> Column:
    """The whole DOI in an address, lower case, without dots at its end; NULL if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), _DOI + r"/[^\s?#]+)", 1)), r"\.+$", ""), F.lit(""))


def doi_registrant(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), _DOI + ")/", 1), F.lit(""))


def code_origin(url: Column) -> Column:
    """host:owner of a repository on a code host, the host alone where no owner is named, else NULL."""
    owner = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://[^/?#]+/+([^/?#]+)", 1))
    return F.when(host(url).isin(*L.CODE_HOSTS), F.when(owner != "", F.concat(host(url), F.lit(":"), owner)).otherwise(host(url)))
