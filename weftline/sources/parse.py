"""Tolerant HTML parsing to structure, in the one Python stage of the audit.

Deliberate choices where page authors are careless: an open link or heading ends at the next block; tables and
role=dialog count wherever they are; an svg counts as textless if it holds no text element.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Fixed values.
BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form header hr li main nav ol p pre section table tbody td tfoot th thead tr ul details summary dialog br".split())
SKIPPED = frozenset("script style noscript template svg".split())
CODE = frozenset("pre code kbd samp tt".split())
STATE_IDS = frozenset(["__NEXT_DATA__", "__NUXT_DATA__", "__APOLLO_STATE__", "initial-state", "app-state", "__INITIAL_STATE__"])
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_ACCORDION, _OVERLAY = re.compile(r"accordion|collapse|expander", re.I), re.compile(r"overlay|modal|popup|interstitial|paywall", re.I)
_COLUMN = re.compile(r"(?:^|[\s_-])(?:col|column)(?:$|[\s_-])", re.I)
ANCHOR = 200
HELD, MOST_HELD = 1 << 20, 256  # characters of HTML, and pages, that are parsed before their rows are passed on

SCHEMA = """page_id long, url string, title string, lang string, canonical string, robots_meta string,
 meta_description string, metas map<string,string>, hreflang array<struct<lang:string,href:string>>, visible_text string,
 claim_text string, blocks array<string>, headings array<struct<ord:int,level:int,text:string,id:string>>,
 sections array<struct<ord:int,heading:string,level:int,id:string,text:string,char_offset:int>>,
 links array<struct<ord:int,href:string,anchor_text:string,rel:string>>,
 images array<struct<src:string,alt:string,alt_empty:boolean,width:string,height:string>>,
 jsonld array<struct<raw:string,parse_ok:boolean>>, state_strings array<string>, microdata array<string>,
 structured_dates array<string>, details int, details_open int, dialogs int, accordions int, overlay boolean,
 grid_candidates int, tables int, canvases int, svg_without_text int, videos_uncaptioned int, images_unsized int,
 render_blocking int, has_viewport boolean, script_paths array<string>, noscript_js boolean, empty_root boolean"""


def folded(text: str) -> str:
    return " ".join(text.split())


class _Reader(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url = url
        self.blocks: list[str] = []
        self.claims: list[str] = []
        self.headings: list[dict] = []
        self.sections: list[dict] = [{"heading": None, "level": 0, "id": None, "parts": [], "at": 0}]
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.jsonld: list[str] = []
        self.states: list[str] = []
        self.metas: dict[str, str] = {}
        self.hreflang: list[dict] = []
        self.microdata: list[str] = []
        self.dates: list[str] = []
        self.paths: list[str] = []
        self.noscript: list[str] = []
        self.n = dict.fromkeys("details details_open dialogs accordions columns tables canvases svgs videos tracks unsized blocking roots".split(), 0)
        self.title, self.lang, self.canonical = [], None, None
        self.overlay = self.viewport = self.in_head = False
        self.line, self.claim, self.skipped, self.code = [], [], [], 0
        self.script = self.link = self.heading = self.titled = None
        self.svg_text: list[bool] = []
        self.length = 0
        self.root_open = False

    # ---- parts ----
    def end_block(self) -> None:
        text = folded("".join(self.line))
        if text:
            self.blocks.append(text)
            self.claims.append(folded("".join(self.claim)))
            self.sections[-1]["parts"].append(text)
            self.length += len(text) + 1
        self.line, self.claim = [], []

    def end_link(self) -> None:
        if self.link:
            href, rel, parts = self.link
            self.links.append({"href": href, "anchor_text": folded("".join(parts))[:ANCHOR] or None, "rel": rel})
            self.link = None

    def end_heading(self) -> None:
        if self.heading:
            level, id_, parts = self.heading
            text = folded("".join(parts))
            self.headings.append({"level": level, "text": text, "id": id_})
            self.sections.append({"heading": text, "level": level, "id": id_, "parts": [], "at": self.length})
            self.heading = None

    def absolute(self, href: str) -> str:
        try:
            return urljoin(self.url, href.strip())
        except ValueError:
            return href

    # ---- events ----
    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        named = f"{a.get('class', '')} {a.get('id', '')}"
        if tag in BLOCK or tag in HEADINGS:
            self.end_link() if self.link and tag != "br" else None
            self.end_heading() if tag != "br" else None
            self.end_block()
        n = self.n
        self.root_open = False
        if tag == "html":
            self.lang = a.get("lang") or self.lang
        elif tag == "head":
            self.in_head = True
        elif tag == "body":
            self.in_head = False
        elif tag == "title" and not self.svg_text:
            self.titled = []
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or "").lower()
            if name:
                self.metas[name] = a.get("content", "")
            self.viewport |= name == "viewport"
            if name == "article:modified_time":
                self.dates.append(a.get("content", ""))
        elif tag == "link":
            rel = a.get("rel", "").lower().split()
            if "canonical" in rel and a.get("href"):
                self.canonical = self.absolute(a["href"])
            if "alternate" in rel and a.get("hreflang"):
                self.hreflang.append({"lang": a["hreflang"], "href": self.absolute(a.get("href", ""))})
        elif tag == "a":
            self.end_link()
            if a.get("href"):
                self.link = (self.absolute(a["href"]), a.get("rel") or None, [])
        elif tag in HEADINGS:
            self.heading = (int(tag[1]), a.get("id") or None, [])
        elif tag == "img":
            self.images.append({"src": self.absolute(a.get("src", "")), "alt": a.get("alt"), "alt_empty": not a.get("alt", "").strip(), "width": a.get("width"), "height": a.get("height")})
            n["unsized"] += not (a.get("width") and a.get("height"))
        elif tag == "script":
            kind = a.get("type", "").lower()
            self.script = ("jsonld" if kind == "application/ld+json" else "state" if a.get("id") in STATE_IDS else "other", [])
            if a.get("src") and self.in_head and "async" not in a and "defer" not in a and kind != "module":
                n["blocking"] += 1
        elif tag == "svg":
            self.svg_text.append(False)
        elif tag == "text" and self.svg_text:
            self.svg_text[-1] = True
        elif tag == "canvas":
            n["canvases"] += 1
        elif tag == "video":
            n["videos"] += 1
        elif tag == "track" and a.get("kind", "subtitles") in ("captions", "subtitles"):
            n["tracks"] += 1
        elif tag == "details":
            n["details"] += 1
            n["details_open"] += "open" in a
        elif tag == "table":
            n["tables"] += 1
        elif tag == "time" and a.get("datetime"):
            self.dates.append(a["datetime"])
        if tag == "dialog" or a.get("role") == "dialog":
            n["dialogs"] += 1
        if tag == "div":
            n["columns"] += bool(_COLUMN.search(named))
            self.root_open = a.get("id") in ("root", "app", "__next", "__nuxt")
        n["accordions"] += bool(_ACCORDION.search(named))
        self.overlay |= bool(_OVERLAY.search(named))
        if "itemscope" in a and a.get("itemtype"):
            self.microdata.append(a["itemtype"].rstrip("/").rsplit("/", 1)[-1])
        for k, v in a.items():
            if k.startswith("on") or k in ("data-href", "data-url", "routerlink"):
                self.paths += re.findall(r"['\"](/[A-Za-z0-9][^'\"\s]*)['\"]|^(/[A-Za-z0-9]\S*)$", v) and [x or y for x, y in re.findall(r"['\"](/[A-Za-z0-9][^'\"\s]*)['\"]|^(/[A-Za-z0-9]\S*)$", v)]
        if tag in SKIPPED:
            self.skipped.append(tag)
        self.code += tag in CODE

    def handle_endtag(self, tag):
        if tag == "title" and self.titled is not None:
            self.title, self.titled = self.titled, None
        elif tag == "a":
            self.end_link()
        elif tag in HEADINGS:
            self.end_heading()
            self.end_block()
        elif tag == "script" and self.script:
            kind, parts = self.script
            if kind == "jsonld":
                self.jsonld.append("".join(parts))
            elif kind == "state":
                self.states.append("".join(parts))
            self.script = None
        elif tag == "svg" and self.svg_text:
            self.n["svgs"] += not self.svg_text.pop()
        elif tag == "head":
            self.in_head = False
        elif tag == "div" and self.root_open:
            self.n["roots"] += 1
        self.root_open = False
        if tag in self.skipped:
            while self.skipped.pop() != tag:
                pass
        self.code = max(0, self.code - (tag in CODE))
        if tag in BLOCK:
            self.end_link()
            self.end_heading()
            self.end_block()

    def handle_data(self, data):
        if data.strip():
            self.root_open = False
        if self.titled is not None:
            self.titled.append(data)
        elif self.script:
            self.script[1].append(data)
        elif "noscript" in self.skipped:
            self.noscript.append(data)
        elif not self.skipped:
            if self.heading:
                self.heading[2].append(data)
            elif self.link:
                self.link[2].append(data)
            else:
                self.line.append(data)
                self.claim.append("" if self.code else data)

    def finish(self) -> None:
        self.close()
        self.end_link()
        self.end_heading()
        self.end_block()


class _Deep(json.JSONDecoder):
    """Reads what is nested too deeply for the decoder in C."""

    def __init__(self):
        super().__init__()
        self.scan_once = json.scanner.py_make_scanner(self)


def _json(text: str):
    """The value of a JSON text, however deep it goes; a ValueError if the text is none."""
    try:
        return json.loads(text)
    except RecursionError:
        most = sys.getrecursionlimit()
        sys.setrecursionlimit(most + 2 * len(text))  # two calls for each level
        try:
            return _Deep().decode(text)
        finally:
            sys.setrecursionlimit(most)


def state_strings(payloads: list[str], visible: str) -> list[str]:
    """Sentences that only a script's state holds: strings of 10 to 300 characters, no links, that the page does not show. All
    of them, in order of first sight, at any depth."""
    found: dict[str, None] = {}
    for raw in payloads:
        span = raw[raw.find("{") : raw.rfind("}") + 1] if "{" in raw else ""
        for text in (raw, span):
            try:
                left = [_json(text)]
                break
            except ValueError:
                left = []
        while left:
            value = left.pop()
            if isinstance(value, (dict, list)):
                left += reversed(value.values() if isinstance(value, dict) else value)
            elif isinstance(value, str):
                text = folded(value)
                if 10 <= len(text) <= 300 and not re.match(r"https?:|[/#]", text):
                    found.setdefault(text)

    # One way through the page, not one for each string: at each place, the strings that could begin there by ten characters.
    sizes: dict[str, set[int]] = {}
    for s in found:
        sizes.setdefault(s[:10], set()).add(len(s))
    shown = {visible[i : i + n] for i in range(len(visible) if found else 0) for n in sizes.get(visible[i : i + 10], ())}
    return [s for s in found if s not in shown]


def parse_page(page_id, url: str, html: str | None) -> dict:
    """One parsed page; a page without HTML is a row with nothing found. All parts are whole, but for the texts of links."""
    reader = _Reader(url or "")
    try:
        reader.feed(html or "")
        reader.finish()
    except (AssertionError, ValueError):  # markup that the parser gives up on: what came before it counts
        pass
    visible = "\n".join(reader.blocks)
    dates = list(reader.dates)
    jsonld = []
    for raw in reader.jsonld:
        try:
            parsed = _json(raw)
            jsonld.append({"raw": raw, "parse_ok": True})
            if isinstance(parsed, dict):
                dates += [str(parsed[k]) for k in ("dateModified", "datePublished") if parsed.get(k)]
        except ValueError:
            jsonld.append({"raw": raw, "parse_ok": False})
    sections = [{"ord": i, "heading": s["heading"], "level": s["level"], "id": s["id"], "text": "\n".join(s["parts"]), "char_offset": s["at"]} for i, s in enumerate(reader.sections) if s["parts"] or s["heading"]]
    n = reader.n
    return {
        "page_id": page_id,
        "url": url,
        "title": folded("".join(reader.title)) or None,
        "lang": reader.lang,
        "canonical": reader.canonical,
        "robots_meta": reader.metas.get("robots"),
        "meta_description": reader.metas.get("og:description") or reader.metas.get("description"),
        "metas": reader.metas,
        "hreflang": reader.hreflang,
        "visible_text": visible,
        "claim_text": "\n".join(c for c in reader.claims if c),
        "blocks": reader.blocks,
        "headings": [{"ord": i + 1, **h} for i, h in enumerate(reader.headings)],
        "sections": sections,
        "links": [{"ord": i + 1, **x} for i, x in enumerate(reader.links)],
        "images": reader.images,
        "jsonld": jsonld,
        "state_strings": state_strings(reader.states, folded(visible)),
        "microdata": list(dict.fromkeys(reader.microdata)),
        "structured_dates": dates,
        "details": n["details"],
        "details_open": n["details_open"],
        "dialogs": n["dialogs"],
        "accordions": n["accordions"],
        "overlay": True if reader.overlay else None,
        "grid_candidates": n["columns"] // 3,
        "tables": n["tables"],
        "canvases": n["canvases"],
        "svg_without_text": n["svgs"],
        "videos_uncaptioned": max(0, n["videos"] - n["tracks"]),
        "images_unsized": n["unsized"],
        "render_blocking": n["blocking"],
        "has_viewport": reader.viewport if html else None,
        "script_paths": list(dict.fromkeys(p.split("?")[0].split("#")[0] for p in reader.paths)),
        "noscript_js": bool(re.search(r"enable javascript|requires javascript|turn on javascript", " ".join(reader.noscript), re.I)),
        "empty_root": n["roots"] > 0,
    }


def _few(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of pdf in turn, with HELD characters of HTML or one page at a time."""
    ends = np.cumsum([HELD // MOST_HELD + (len(h) if isinstance(h, str) else 0) for h in pdf["html"]])
    first = 0
    while first < len(pdf):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HELD, "right")))
        yield pdf.iloc[first:last]
        first = last


def parse_pages(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed rows of pages (page_id, url, html), with the columns in keep: one narrow stage. Every row of pages stays;
    null pages are blank. What is held parsed at a time is bounded by HELD, not by Spark's batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _few(batch):
                parsed = pd.DataFrame([parse_page(*row) for row in zip(pdf["page_id"], pdf["url"], pdf["html"])])
                yield parsed.assign(**{c: pdf[c].to_numpy() for c in keep})

    kinds = dict(pages.dtypes)
    columns = list(dict.fromkeys(("page_id", "url", "html", *keep)))
    # The key goes through pandas as text: a column of numbers with nulls would lose digits there.
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), *columns[1:])
    out = StructType.fromDDL(SCHEMA + "".join(f", {c} {kinds[c]}" for c in keep))
    kind = out["page_id"].dataType
    out["page_id"].dataType = StringType()
    parsed = rows.mapInPandas(run, out)
    return parsed.select(F.col("page_id").cast(kind).alias("page_id"), *[c for c in parsed.columns if c != "page_id"])


def inflate(body: bytes | None) -> bytes | None:
    """A gzip body inflated, as far as it goes if it is cut off; others as they are."""
    if body is None or body[:2] != b"\x1f\x8b":
        return body
    machine, out = zlib.decompressobj(16 + zlib.MAX_WBITS), []
    try:
        for i in range(0, len(body), 1024):
            out.append(machine.decompress(body[i : i + 1024]))
    except zlib.error:
        pass
    return b"".join(out) or body
