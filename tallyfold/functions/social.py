"""What rendered profiles say: escapes and redirects undone, links of a bio, and where they lead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions.phones import extract_phones
from tallyfold.functions.text import registrable_domain
from tallyfold.functions.web import NEAR_WORD, parse_page

#: Hosts that only redirect, and hosts by what they are.
SHIMS = ("l.instagram.com", "l.facebook.com", "lm.facebook.com")
HUBS = ("linktr.ee", "beacons.ai", "bio.link", "taplink.cc", "campsite.bio", "linkin.bio", "milkshake.app", "lnk.bio", "solo.to", "carrd.co", "allmylinks.com", "linkpop.com", "shorby.com", "komi.io", "znap.link")
AGGREGATORS = ("foodpanda.pk", "foodpanda.com", "cheetay.pk", "daraz.pk", "airlift.pk", "eatmubarak.pk", "opentable.com", "zomato.com", "tripadvisor.com")
NETWORKS = ("instagram.com", "facebook.com", "youtube.com", "tiktok.com", "twitter.com", "x.com", "threads.net", "snapchat.com", "linkedin.com", "pinterest.com")


def unescaped(document: Column) -> Column:
    r"""A document with \/ as / and \u and four digits as the character that they name. Halves of characters beyond 16 bits are put together."""
    parts = F.split(F.replace(document, F.lit("\\/"), F.lit("/")), r"\\u(?=[0-9a-fA-F]{4})")
    halves = r"((?:\\u[0-9a-fA-F]{4})+)"
    return F.when(document.rlike(halves), F.aggregate(_runs(parts), F.lit(""), lambda a, x: F.concat(a, F.decode(F.unhex(x.hex), "UTF-16BE"), x.rest))).otherwise(F.replace(document, F.lit("\\/"), F.lit("/")))


def _runs(parts: Column) -> Column:
    """Escapes that follow each other directly as one run of hex digits, with the text behind it."""
    start = F.array(F.struct(F.lit("").alias("hex"), F.get(parts, F.lit(0)).alias("rest")))

    def add(runs: Column, part: Column) -> Column:
        last, own, rest = F.element_at(runs, -1), F.substring(part, 1, 4), F.substring(part, 5, 1 << 30)
        joined = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(F.concat(last.hex, own).alias("hex"), rest.alias("rest"))))
        return F.when((last.hex != "") & (last.rest == ""), joined).otherwise(F.concat(runs, F.array(F.struct(own.alias("hex"), rest.alias("rest")))))

    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, add)


def unshimmed(url: Column) -> Column:
    """Where a redirecting link leads, decoded once; other links as they are."""
    host = F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1))
    target = F.trim(F.url_decode(F.regexp_replace(F.regexp_extract(url, r"[?&]u=([^&#]*)", 1), "%(?![0-9A-Fa-f]{2})", "%25")))
    return F.when(host.isin(*SHIMS) & (target != ""), target).otherwise(url)


def _usable(url: Column) -> Column:
    domain = registrable_domain(url)
    return F.when(F.contains(domain, F.lit(".")) & ~domain.isin(*SHIMS), url)


def bio_link(document: Column, platform: Column) -> Column:
    """The link of an unescaped profile: what instagram names as external, else the first redirect; null if it leads to no host."""
    named = F.nullif(F.trim(F.regexp_extract(document, r'"external_url"\s*:\s*"([^"]+)"', 1)), F.lit(""))
    shims = "|".join(s.replace(".", r"\.") for s in SHIMS)
    shim = F.nullif(F.regexp_extract(document, rf"https?://(?:{shims})/[^\"'\s<>\\]+", 0), F.lit(""))
    return F.coalesce(F.when(platform == "instagram", _usable(unshimmed(named))), _usable(unshimmed(F.replace(shim, F.lit("&amp;"), F.lit("&")))))


def profile_url(url: Column, platform: Column) -> Column:
    """The address that serves a profile: instagram's share card is not it."""
    card = F.regexp_extract(url, r"(?i)^([^?#]*?)/profilecard/?(?:[?#].*)?$", 1)
    return F.when((platform == "instagram") & (card != ""), card).otherwise(url)


def render_key(url: Column) -> Column:
    """The archive's address of a rendered copy."""
    return F.concat(url, F.when(url.rlike(r"\?[^#]"), "&").otherwise("?"), F.lit("__render=1"))


def destination(url: Column) -> Column:
    """What a bio's link leads to."""
    host = F.coalesce(registrable_domain(url), F.lit(""))
    among = lambda names: host.rlike("|".join(n.replace(".", r"\.") for n in names))
    chat = F.lower(url).rlike(r"wa\.me|api\.whatsapp\.com") | host.endswith("whatsapp.com")
    return F.when(F.coalesce(url, F.lit("")) == "", "none").when(chat, "wa.me").when(among(HUBS), "bio_hub").when(among(AGGREGATORS), "aggregator").when(among(NETWORKS), "social").otherwise("store")


def read_profile(url: Column, html: Column, platform: Column) -> dict[str, Column]:
    """Columns of a rendered profile: page_name, bio, rendered, buttons (numbers of chat links), bio_phones, bio_link."""
    document = unescaped(html)
    page = parse_page(url, document)
    return {"page_name": page.title, "bio": page.bio, "rendered": page.title.isNotNull() & page.bio.isNotNull(), "buttons": page.chat, "bio_phones": extract_phones(page.bio), "bio_link": bio_link(document, platform)}


def near_whatsapp(text: Column, start: Column, end: Column, window: int = 50) -> Column:
    """Whether the word stands within `window` characters of a span; start and end count from 0."""
    first = F.greatest(start - window, F.lit(0))
    return F.substr(text, first + 1, end + window - first).rlike(f"(?iu){NEAR_WORD.pattern}")
