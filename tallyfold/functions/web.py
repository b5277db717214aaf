"""Contact evidence in landed pages: expressions over markup, and one parser where ancestry or JSON counts."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.phones import Phone, extract, numbers

#: Domains and endings that are no mailbox, share links, file endings that are no page, widget attributes and hints, words of
#: links to contact and about pages, kinds and keys of structured records.
MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
NOISE_DOMAINS = ("example.com", "example.org", "domain.com", "yourdomain.com", "email.com", "sentry.io", "sentry.wixpress.com", "wix.com", "wordpress.org", "wordpress.com", "godaddy.com", "squarespace.com", "schema.org", "w3.org", "googleapis.com", "gstatic.com")
NOISE_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".css", ".js")
NO_PAGE = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".zip", ".mp4", ".doc", ".docx", ".xls", ".xlsx", ".css", ".js", ".ico", ".xml")
SHARE = re.compile(r"/(?:sharer|share|share\.php|dialog|plugins|tr/?$|intent)", re.I)
CONTACT = re.compile(r"/(?:contact|contact-?us|get-?in-?touch|reach-?us|connect)(?:[-/._]|$)", re.I)
ABOUT = re.compile(r"/(?:about|about-?us|who-?we-?are|our-?story|our-?team|team)(?:[-/._]|$)", re.I)
CHAT = re.compile(r"(?:(?:https?:)?//(?:api\.whatsapp\.com|web\.whatsapp\.com)/send/?\?[^\"'\s]*?phone=|(?:https?:)?//wa\.me/|whatsapp://send/?\?[^\"'\s]*?phone=)(\+?\d{9,15})", re.I)
NEAR_WORD = re.compile(r"whats\s?app|واٹس\s?ایپ|wa\b", re.I)
WIDGET = ("data-phone", "data-number", "data-phone-number", "data-whatsapp", "data-wa-number", "data-wanumber", "data-telephone")
WIDGET_HINT = re.compile(r"whats\s?app|wa[-_](?:chat|widget|btn|button|link|number|float)|ht[-_]ctc|click[-_]?to[-_]?chat|floating[-_]?wa", re.I)
CONTACT_TEXT = re.compile(r"contact|get in touch|reach us|رابطہ", re.I)
ABOUT_TEXT = re.compile(r"\babout\b|our story|our team|who we are", re.I)
RECORDS = {"organization", "corporation", "store", "restaurant", "cafe", "bakery", "beautysalon", "hairsalon", "dayspa", "healthandbeautybusiness", "autorepair", "automotivebusiness", "realestateagent", "professionalservice", "foodestablishment", "sportsactivitylocation", "place", "medicalclinic"}
OWNERS = ("founder", "founders")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SIGNAL_SCORES = {"wa_me_link": 1.00, "chat_widget": 0.95, "platform_button": 0.90, "text_proximity": 0.75, "mobile_only": 0.60, "none": 0.00}


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    plain = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))


def emails(text: Column) -> Column:
    """Plausible addresses in order, each once, in lower case."""
    found = F.transform(F.regexp_extract_all(text, F.lit(MAIL), F.lit(0)), lambda x: F.lower(F.regexp_replace(x, r"^[.,;:<>()\[\]]+|[.,;:<>()\[\]]+$", "")))
    return F.array_distinct(F.filter(found, lambda x: ~F.substring_index(x, "@", -1).isin(*NOISE_DOMAINS) & ~x.rlike("(" + "|".join(map(re.escape, NOISE_ENDINGS)) + ")$")))


def decode_cfemail(text: Column) -> Column:
    """An address whose bytes are masked by the first one."""
    key = F.conv(F.substring(text, 1, 2), 16, 10).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(3), F.length(text) - 1, F.lit(2)), lambda i: F.char(F.conv(F.substr(text, i, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key))), "")


def _first(text: str) -> list[Phone]:
    return list(numbers(text))[:1]


def _strings(value) -> list[str]:
    return [str(x).strip() for x in (value if isinstance(value, list) else [value]) if isinstance(x, str | int) and str(x).strip()]


def records(node, depth: int = 0) -> list[dict]:
    """Structured records of a business anywhere in a JSON document, eight levels deep at the most."""
    if depth > 8 or not isinstance(node, dict | list):
        return []
    out = []
    if isinstance(node, dict):
        kinds = {k.lower() for k in _strings(node.get("@type") or node.get("type"))}
        if kinds & RECORDS or any("business" in k for k in kinds) or node.get("name") and node.get("telephone"):
            owners = [x for key in OWNERS for x in (node.get(key) if isinstance(node.get(key), list) else [node.get(key)])]
            owners = [x.get("name") if isinstance(x, dict) else x for x in owners]
            out.append({"phones": [p for t in _strings(node.get("telephone")) for p in _first(t)], "owner": next((x.strip() for x in owners if isinstance(x, str) and x.strip()), None), "same_as": _strings(node.get("sameAs"))})
    for x in node.values() if isinstance(node, dict) else node:
        out += records(x, depth + 1)
    return out


class _Tree(HTMLParser):
    """What a page says about how to reach a business, in one walk. Ancestors of an element are kept on a stack."""

    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.host, self.stack, self.skip, self.script, self.anchor = url, _host(url), [], 0, None, None
        self.text, self.tel, self.mail, self.widget, self.facebook, self.instagram, self.blocks, self.targets, self.meta = [], [], [], [], None, None, [], [], {}

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in attrs}
        blob = " ".join([tag, *(f"{k} {v}" for k, v in own.items())])
        hints = [blob, *(b for _, b in self.stack[-3:])]
        if tag not in VOID:
            self.stack.append((tag, blob))
        for a in WIDGET:
            if own.get(a) and any(WIDGET_HINT.search(h) for h in hints):
                self.widget += _first(own[a])
        if tag in ("script", "style", "noscript", "template"):
            self.skip += 1
            self.script = [] if own.get("type", "").lower() == "application/ld+json" else None
        if tag == "a":
            self._end_anchor()
            self._link(own.get("href", "").strip())
        if own.get("data-cfemail"):
            masked = bytes.fromhex(own["data-cfemail"]) if re.fullmatch("(?:[0-9a-fA-F]{2}){2,}", own["data-cfemail"]) else b""
            self.mail.append("".join(chr(b ^ masked[0]) for b in masked[1:]))
        if tag == "meta" and (name := own.get("property") or own.get("name")) and own.get("content", "").strip():
            self.meta.setdefault(name, own["content"].strip())

    def _link(self, href: str) -> None:
        kind, _, rest = href.partition(":")
        if kind.lower() in ("tel", "callto"):
            self.tel += _first(rest.split("?")[0])
        elif kind.lower() == "mailto":
            self.mail.append(rest.split("?")[0])
        elif href and href[0] != "#" and kind.lower() != "javascript":
            host = _host(href) if "//" in href else ""
            if host and not SHARE.search(href):
                if re.search(r"(^|\.)(facebook\.com|fb\.com|fb\.me)$", host):
                    self.facebook = self.facebook or href
                if re.search(r"(^|\.)(instagram\.com|instagr\.am)$", host):
                    self.instagram = self.instagram or href
            self.anchor = href, len(self.text)

    def _end_anchor(self) -> None:
        """What a link says is known when it ends."""
        if self.anchor is None:
            return
        (href, first), self.anchor = self.anchor, None
        try:
            at = urlsplit(urljoin(self.url, href))
        except ValueError:
            return
        if at.scheme not in ("http", "https") or _host(at.geturl()) != self.host or at.path.lower().endswith(NO_PAGE):
            return
        clean = at._replace(fragment="").geturl()
        label = "".join(self.text[first:]).strip()[:80]
        order = 0 if CONTACT.search(at.path) or CONTACT_TEXT.search(label) else 1 if ABOUT.search(at.path) or ABOUT_TEXT.search(label) else None
        if clean.rstrip("/") != self.url.rstrip("/") and clean not in (t for _, t in self.targets):
            self.targets.append((order, clean))  # also one that is neither: its first label counts

    def handle_endtag(self, tag):
        if tag == "a":
            self._end_anchor()
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass
        if tag in ("script", "style", "noscript", "template") and self.skip:
            self.skip -= 1
            if self.script is not None:
                try:
                    self.blocks += records(json.loads("".join(self.script)))
                except ValueError:
                    pass
                self.script = None

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif not self.skip and data.strip():
            self.text.append(data.strip())


def _host(url: str) -> str:
    return re.sub(r"^www\.", "", re.sub(r"[/?#:].*$", "", re.sub(r"^.*@", "", re.sub(r"[/?#].*$", "", re.sub(r"^[a-z][a-z0-9+.-]*:|^(?=//)", "", (url or "").lower()).removeprefix("//")))))


def read_page(url: str, html: str) -> dict:
    """Everything of a page at once: text, chat, widget and tel numbers, numbers in the text with their evidence, mails, profiles, owners, pages to go to.

    offers holds every number as often as a shape of the page gives it, in the order of those shapes; numbers each one once, with the
    strongest signal that the page has for it; owners the numbers that stand in one record with a founder's name.
    """
    tree = _Tree(url or "")
    tree.feed(html or "")
    tree.close()
    tree._end_anchor()
    text = "\n".join(tree.text)
    once = lambda xs: list(dict.fromkeys(xs))
    shapes = {
        "wa_link": [p for m in CHAT.finditer(html or "") for p in _first("+" + m.group(1).removeprefix("+"))], "widget": tree.widget,
        "jsonld": [p for b in tree.blocks for p in b["phones"]], "tel": tree.tel, "text": extract(text),
    }
    chat, widget = (once(p.e164 for p in shapes[k]) for k in ("wa_link", "widget"))
    best: dict[str, str] = {}
    for shape in ("text", "tel", "jsonld"):
        for p in shapes[shape]:
            near = shape == "text" and NEAR_WORD.search(text[max(0, p.start - 50) : p.end + 50])
            best.setdefault(p.e164, "text_proximity" if near else "mobile_only" if p.line_type == "mobile" else "none")
    best |= dict.fromkeys(widget, "chat_widget") | dict.fromkeys(chat, "wa_me_link")
    mails = [m.strip().strip(".,;:<>()[]").lower() for m in [*tree.mail, *re.findall(MAIL, text)]]
    mails = [m for m in mails if re.fullmatch(MAIL, m) and m.rpartition("@")[2] not in NOISE_DOMAINS and not m.endswith(NOISE_ENDINGS)]
    same = [s for b in tree.blocks for s in b["same_as"]]
    profile = lambda *hosts: next((s for s in same if _host(s).endswith(hosts) and not SHARE.search(s)), None)
    return {
        "text": text, "chat": chat, "widget": widget, "tel": once(p.e164 for p in tree.tel), "emails": once(mails),
        "facebook": tree.facebook or profile("facebook.com", "fb.com", "fb.me"), "instagram": tree.instagram or profile("instagram.com", "instagr.am"),
        "people": once(b["owner"] for b in tree.blocks if b["owner"]), "targets": [h for order in (0, 1) for o, h in tree.targets if o == order][:3],
        "title": tree.meta.get("og:title"), "og_description": tree.meta.get("og:description"), "bio": tree.meta.get("description"),
        "numbers": [{"e164": e, "signal": s, "score": SIGNAL_SCORES[s]} for e, s in best.items()],
        "offers": [{"e164": p.e164, "raw": p.raw, "line_type": p.line_type, "operator": p.operator, "origin": shape} for shape, found in shapes.items() for p in found],
        "owners": [{"e164": p.e164, "name": b["owner"]} for b in tree.blocks if b["owner"] for p in b["phones"]],
    }


_ONE = ("text", "facebook", "instagram", "title", "og_description", "bio")
_MANY = ("chat", "widget", "tel", "emails", "people", "targets")
_ROWS = {"numbers": ("e164", "signal", "score"), "offers": ("e164", "raw", "line_type", "operator", "origin"), "owners": ("e164", "name")}
PAGE = T.StructType(
    [*(T.StructField(n, T.StringType()) for n in _ONE), *(T.StructField(n, T.ArrayType(T.StringType())) for n in _MANY)]
    + [T.StructField(n, T.ArrayType(T.StructType([T.StructField(f, T.DoubleType() if f == "score" else T.StringType()) for f in fields]))) for n, fields in _ROWS.items()]
)


@F.arrow_udf(PAGE)
def parse_page(url: pa.Array, html: pa.Array) -> pa.Array:
    rows = [(n, pa.list_(pa.struct([(f, pa.float64() if f == "score" else pa.string()) for f in fields]))) for n, fields in _ROWS.items()]
    kind = pa.struct([*((n, pa.string()) for n in _ONE), *((n, pa.list_(pa.string())) for n in _MANY), *rows])
    return pa.array([read_page(u or "", h or "") for u, h in zip(url.to_pylist(), html.to_pylist(), strict=True)], kind)


def has_any_contact(page: Column) -> Column:
    """Whether a parsed page gives any number or mail."""
    return (F.size(page.offers) > 0) | (F.size(page.emails) > 0)
