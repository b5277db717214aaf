"""Names, numbers and addresses as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: legal endings of names.
_SUFFIXES = "pvt ltd|private limited|pvt limited|ltd|limited|llc|inc|co|company|and sons|and co"


@lru_cache(maxsize=1)
def _letters() -> tuple[str, str, dict[str, str]]:
    """What each character becomes without accents and case, by Unicode's compatibility decomposition and case folding: characters that become
    one other or nothing, their images in the same order, and those that become several. Hangul syllables stay whole."""
    one, none, several = {}, [], {}
    for c in map(chr, range(0x110000)):
        if unicodedata.category(c) in ("Cn", "Co", "Cs") or "\uac00" <= c <= "\ud7a3":
            continue
        image = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        if image == c:
            continue
        if not image:
            none.append(c)
        elif len(image) == 1:
            one[c] = image
        else:
            several[c] = image
    return "".join([*one, *none]), "".join(one.values()), several


def folded(text: Column) -> Column:
    """Without accents and differences of case."""
    start, image, several = _letters()
    plain = F.translate(text, start, image)
    pairs = F.create_map(*(F.lit(x) for pair in (("\x01".join(several), "\x01".join(several.values())),) for x in pair))
    keys, values = F.split(F.map_keys(pairs)[0], "\x01"), F.split(F.map_values(pairs)[0], "\x01")
    spelled = F.transform(F.split(plain, ""), lambda c: F.when(c <= "\x7f", c).otherwise(F.coalesce(F.element_at(F.map_from_arrays(keys, values), c), c)))
    return F.when(plain.rlike("[^\\x00-\\x7f]"), F.array_join(spelled, "")).otherwise(plain)


def fold(text: Column) -> Column:
    """Lower case without accents, white space collapsed."""
    return F.trim(F.regexp_replace(folded(text), r"[\s\x1c-\x1f\x85\xa0]+", " "))


def normalise_name(name: Column) -> Column:
    """A name for comparison: folded, all but letters, digits and _ as blanks, legal endings dropped again and again."""
    plain = F.trim(F.regexp_replace(folded(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))
    return F.regexp_replace(plain, rf"( ({_SUFFIXES}))+$", "")


def registrable_domain(url: Column) -> Column:
    """Host in lower case without user, port and www; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^(?:[^/?#]*?//|)([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":.*$", ""), r"^www\.", "")
    return F.when(host != "", host)


def site_kind(url: Column) -> Column:
    domain = registrable_domain(url)
    return F.when(url.isNull() | (url == ""), None).when(domain.isin("instagram.com", "instagr.am"), "instagram").when(domain.isin("facebook.com", "fb.com", "fb.me", "m.facebook.com"), "facebook").otherwise("website")


def site_columns(url: Column) -> dict[str, Column]:
    """An address in the one column of three that its host belongs to."""
    return {name: F.when(site_kind(url) == kind, url) for name, kind in (("website", "website"), ("facebook_url", "facebook"), ("instagram_url", "instagram"))}


def canonical_website(url: Column) -> Column:
    """An address that can be fetched: https where no scheme is said, the root where there is no path, no fragment; null for another scheme
    or a host that is no name with a dot."""
    given = F.trim(url)
    bare = ~F.contains(given, F.lit("//"))
    other = bare & given.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~given.rlike("^(?i)https?:")
    whole = F.when(bare, F.concat(F.lit("https://"), given)).otherwise(given)
    part = lambda pattern: F.regexp_extract(whole, f"^[^:/?#]*://{pattern}", 1)
    scheme, host, path, query = F.lower(F.regexp_extract(whole, "^([^:/?#]*)://", 1)), part("([^/?#]*)"), part("[^/?#]*([^?#]*)"), part(r"[^?#]*(\?[^#]*)")
    sound = scheme.isin("http", "https") & host.rlike(r"^[A-Za-z0-9.-]+\.[A-Za-z]{2,}(:[0-9]{1,5})?$") & ~other
    return F.when(sound, F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query != "?", query).otherwise("")))


#: Fixed value: openings of parameters that only track.
_TRACKING = "utm_|fbclid|gclid|mc_|_ga"


def _decoded(text: Column) -> Column:
    """Percent signs that begin no byte stay."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalise_url(url: Column) -> Column:
    """One spelling of an address: scheme and host lower, no www, no port that is the scheme's own, parameters decoded, without those that
    track, sorted by key and value and encoded anew, no fragment, no closing slashes but that of the root."""
    given = F.regexp_replace(F.regexp_replace(F.trim(url), r"[\t\r\n]", ""), r"#.*$", "")
    scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(given, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit("")), F.lit("https"))
    rest = F.regexp_replace(given, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^//([^/?]*)", 1)), r"^www\.", "")
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(F.regexp_replace(rest, r"^//[^/?]*", ""), r"^([^?]*)", 1), r"/+$", "")
    path = F.when(path == "", "/").when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    pair = lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1))).otherwise("").alias("v"))
    pairs = F.transform(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: p != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p.k).rlike(f"^({_TRACKING})")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p.k), F.lit("="), _encoded(p.v))), "&")
    front = F.when(rest.startswith("//") | rest.startswith("/"), F.concat(F.lit("://"), host, path)).otherwise(F.concat(F.lit(":"), F.substring(path, 2, 1 << 20)))
    return F.concat(scheme, front, F.when(F.size(kept) > 0, F.concat(F.lit("?"), query)).otherwise(""))


def url_hash(url: Column) -> Column:
    return F.sha2(normalise_url(url), 256)


def crawl_key(url: Column) -> Column:
    """Host and path in lower case without closing slash, and the query."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    return F.concat(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^?]*)", 1)), r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def national_digits(number: Column) -> Column:
    digits = F.regexp_replace(number, "[^0-9]", "")
    return F.when(digits.startswith("92"), F.substring(digits, 3, 40)).when(digits.startswith("0"), F.substring(digits, 2, 40)).otherwise(digits)


#: Words that tell whom a place serves.
SEGMENTS = (
    ("men", "mens", "gents", "gent", "male", "males", "boys", "barber", "barbers"),
    ("women", "womens", "ladies", "lady", "female", "females", "girls"),
    ("kids", "kid", "children", "child", "baby"),
)


def segments(name: Column) -> Column:
    """Which groups of people a normalised name speaks of, as three bits."""
    words = F.split(name, " ")
    return sum((F.arrays_overlap(words, F.array(*map(F.lit, g))).cast("int") * (1 << i) for i, g in enumerate(SEGMENTS)), F.lit(0))


def conflicting(left: Column, right: Column) -> Column:
    """Both names speak of somebody, and not of the same."""
    a, b = segments(left), segments(right)
    return (a > 0) & (b > 0) & (a != b)
