"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

Every page is turned into a token stream and folded: a run of equal shapes becomes a repeated group. Pages of a host
that fold to one shape make one signature, which keeps their equal strings. The first signature is the wrapper to begin
with; each further one is aligned with it, and every mismatch is resolved: different strings become a text slot, tags
on one side alone an optional group. The element whose slots hold most text is
where the host keeps its articles. Every page is then matched whole with its host's wrapper: of the host's element the
slots are text, and strings that unlike pages share go. The page's own article or main element is a hint that is taken
where the host's element isn't there or yields nothing, and the body comes last; menus, headers, footers, sidebars,
notices, adverts, forms and comments inside go.

Hosts differ in size without bound, so signatures are counted in partial aggregates, wrappers merged in a tree, and no
task gets a host's pages; pages meet what their host's wrapper says in a join that may split a host.

Edge cases: an empty table gives an empty table; a null or empty html gives an empty text; very long and unbalanced
pages are read whole, in time that grows with their length; a null url is a host of its own; a page without markup is one
block; repeated rows give repeated results; elements that are never closed end with what holds them; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, schema_of, table, text_slices, with_columns, written

#: Shapes that a wrapper is made of.
GROUP = 64
#: Share of the slots' text that an element has to hold.
NEARLY_ALL = 0.8
#: Characters of signatures that a task holds before it passes them on, and that a wrapper is made of.
HELD = 8_000_000
#: Bytes up to which the table of hosts is broadcast.
SMALL = 16_000_000

#: Fixed values of HTML: elements without an end, elements of raw text, elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
#: Elements and words of class, id or role that mark what isn't main text.
ASIDE = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea title head dialog menu object canvas".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer header masthead notice notices cookie cookies consent gdpr alert comment comments reply replies disqus respond share sharing social related recommended newsletter subscribe subscription signup login popup modal toolbar widget pagination pager complementary contentinfo search copyright".split())

#: Last parts of joined class words (main-nav, site-footer) that mark the same.
ASIDE_ENDS = frozenset("ad ads banner breadcrumb breadcrumbs comments footer header menu nav navbar navigation newsletter popup sidebar".split())

#: Comments and declarations; tags whose quoted values hold no "<"; any other tag, which a scanner reads.
TOKEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/><]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>|<(?=/?[a-zA-Z])")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
ENDS = {name: re.compile(rf"</{name}\s*>|\Z", re.I) for name in RAW}


class _Tags:
    """Ends of tags with quoted values, each stretch of a page read once whatever quotes stand open."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.lost: set[int] = set()

    def end(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes begin at ``at``; -1: none follows."""
        if at > self.last[">"]:
            return -1
        seen, k = [], at
        while k not in self.lost and (m := STOP.search(self.page, k)):
            if m[0] == ">":
                return m.start()
            # A quote that is never closed is a character like others.
            k = self.page.find(m[0], m.end()) + 1 if m.end() <= self.last[m[0]] else m.end()
            seen.append(k)
        # Every > further on lies in quotes, as seen from here: the tag ends at the first.
        self.lost.update(seen)
        return self.page.find(">", at)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): kind open, close or text; value is the attributes or the raw text."""
    at, begun, n, tags = 0, 0, len(page), None
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            break
        start, slash, name, value = m.start(), m[1], m[2], m[3]
        if name is None:
            if m[0] == "<!--":
                end = page.find("-->", start + 4)
                at = n if end < 0 else end + 3
            else:
                tags = tags or _Tags(page)
                head = NAME.match(page, start)
                end = tags.end(head.end()) if head else (page.find(">", start) if start < tags.last[">"] else -1)
                if end < 0:
                    break
                at = end + 1
                if head:
                    slash, name, value = head[1], head[2], page[head.end() : end]
        else:
            at = m.end()
        if start > begun:
            yield "text", "", page[begun:start]
        begun = at
        if name is None:
            continue
        name = name.lower()
        yield ("close", name, "") if slash else ("open", name, value)
        if not slash and name in RAW and not value.endswith("/"):
            begun = at = ENDS[name].search(page, at).end()
            yield "close", name, ""
    if begun < n:
        yield "text", "", page[begun:]


def labels(attributes: str) -> list[str]:
    """Words of class, id and role; joined ones (side-by-side) stay whole."""
    if "=" not in attributes:
        return []
    return [w for _, v in NAMED.findall(attributes) for w in re.split(r"[^a-z0-9_-]+", html.unescape(v.strip("\"'")).lower()) if w]


def marks_aside(words: Iterable[str]) -> bool:
    return any(w in ASIDE_WORDS or re.split("[-_]+", w)[-1] in ASIDE_ENDS for w in words)


def shape(page: str) -> list[str]:
    """A page's tokens for the alignment: tags with their class, and hashes of strings."""
    out = []
    for kind, name, value in tokens(page):
        if kind == "text":
            if text := " ".join(value.split()):
                out.append(_hashed(text))
        elif name not in VOID:
            out.append(("<" if kind == "open" else "</") + name + ("." + ".".join(labels(value)) if kind == "open" and labels(value) else ""))
    return out


def _key(item: object) -> str:
    if isinstance(item, str):
        return "#" if item[:1] == "#" else item
    return item[0] + "(" + " ".join(map(_key, item[1])) + ")"


#: A stretch of some length that follows itself.
REPEATS = [re.compile(r"(.{%d})\1+" % size, re.S) for size in range(1, 13)]


def fold(items: list, where: list) -> tuple[list, list]:
    """Adjacent equal shapes become one repeated group ('+', shape), the shortest repeats first.

    ``where`` has a list of places for each item; those of a group have the group's shape. Keys are letters of one
    string meanwhile, so repeats are found by a pattern.
    """
    letters: dict[str, str] = {}
    letter = lambda key: letters.setdefault(key, chr(0x10000 + len(letters)))
    begins = lambda key: key != "#" and key[:2] != "</"
    keys = [_key(x) for x in items]
    text, size = "".join(map(letter, keys)), 1
    while size <= len(REPEATS):
        out, at, names, last, pos, pattern = [], [], [], 0, 0, REPEATS[size - 1]
        while m := pattern.search(text, pos):
            i, j = m.span()
            if not begins(keys[i]):
                # A run looks the same from each ``size`` places on, so that many starts decide about all of it.
                pos = next((k for k in range(i + 1, min(i + size, j - 2 * size + 1)) if begins(keys[k])), max(i + 1, j - 2 * size + 1))
                continue
            body = [_joined([items[k + o] for k in range(i, j, size)]) for o in range(size)]
            places = [_merge_places([where[k + o] for k in range(i, j, size)]) for o in range(size)]
            one = size == 1 and not isinstance(items[i], str) and items[i][0] == "+"
            group = body[0] if one else ("+", body)
            out += [*items[last:i], group]
            at += [*where[last:i], places[0] if one else places]
            names += [*keys[last:i], _key(group)]
            last = pos = j
        if last:
            items, where, keys = out + items[last:], at + where[last:], names + keys[last:]
            text = "".join(map(letter, keys))
        size = 1 if last and size > 1 else size + 1
    return items, where


def _merge_places(trees: list) -> list:
    if isinstance(trees[0][0], int):
        return [k for t in trees for k in t]
    return [_merge_places(list(x)) for x in zip(*trees)]


def folded(page: str) -> tuple[list, list, list[str]]:
    """A page's folded tokens, the places of their strings in ``shape``, and the shape."""
    flat = shape(page)
    return *fold(flat, [[k] for k in range(len(flat))]), flat


def leaves(items: list, where: list, flat: list[str]) -> list[int]:
    """Of each string of a page, in order, the string of its folded tokens that stands for it."""
    of = {k: n for n, at in enumerate(_places(items, where)) for k in at}
    return [of[k] for k, x in enumerate(flat) if x[0] == "#"]


def _joined(items: list) -> object:
    """One item for the repeats of a group in a page: strings that differ are told by the hash of their sequence."""
    first = items[0]
    if isinstance(first, str):
        return first if all(x == first for x in items) else _hashed("".join(items))
    return (first[0], [_joined(list(x)) for x in zip(*(y[1] for y in items))])


def _hashed(text: str) -> str:
    return "#" + hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest() + "*1"


def merge_texts(items: list, count: Callable[[list[int]], int] = sum) -> object:
    """One item for several of equal shape: a string that differs becomes a slot; of others the pages are counted."""
    first = items[0]
    if isinstance(first, str):
        if first[:1] != "#":
            return first
        parts = [x.partition("*") for x in items]
        if any(x == "#" or x != parts[0][0] for x, _, _ in parts):
            return "#"
        return f"{parts[0][0]}*{count([int(n) for _, _, n in parts])}"
    return (first[0], [merge_texts(list(x), count) for x in zip(*(y[1] for y in items))])


def _strip(item: object) -> object:
    return item[1][0] if not isinstance(item, str) and item[0] == "?" else item


def matches(wrapper: list, page: list) -> list[tuple[str, int, int, int, int]]:
    """Stretches of the wrapper and of the page that match or don't, over the whole of both."""
    left, right = [_key(_strip(x)) for x in wrapper], [_key(_strip(x)) for x in page]
    n = min(len(left), len(right))
    head = next((k for k in range(n) if left[k] != right[k]), n)
    tail = next((k for k in range(n - head) if left[-1 - k] != right[-1 - k]), n - head)
    a, b = left[head : len(left) - tail], right[head : len(right) - tail]
    # Very long middles are held together by their rarer tags, so that time doesn't grow with the product.
    inner = SequenceMatcher(None, a, b, autojunk=len(a) * len(b) > 4_000_000).get_opcodes()
    out = [("equal", 0, head, 0, head)] + [(op, i + head, j + head, k + head, m + head) for op, i, j, k, m in inner]
    return out + [("equal", len(left) - tail, len(left), len(right) - tail, len(right))]


def align(wrapper: list, page: list) -> list:
    """The wrapper made to match the page, or another wrapper, as well."""
    optional = lambda x: not isinstance(x, str) and x[0] == "?"
    out = []
    for op, a, b, c, d in matches(wrapper, page):
        if op == "equal":
            for x, y in zip(wrapper[a:b], page[c:d]):
                both = merge_texts([_strip(x), _strip(y)])
                out.append(("?", [both]) if optional(x) or optional(y) else both)
        else:
            out += [x if optional(x) else ("?", [x]) for x in [*wrapper[a:b], *page[c:d]]]
    return out


def _leaves(items: list) -> Iterator[str]:
    """Tags and strings in order, groups once."""
    for x in items:
        if isinstance(x, str):
            yield x
        else:
            yield from _leaves(x[1])


def _places(items: list, where: list) -> Iterator[list[int]]:
    """Places of every string of a folded page."""
    for x, at in zip(items, where):
        if not isinstance(x, str):
            yield from _places(x[1], at)
        elif x[:1] == "#":
            yield at


class Signature:
    """What the pages of a host that fold to the same shape have in common: strings or slots, and how long they are."""

    def __init__(self, items: list, sizes: list[int], seen: list[int]):
        self.items, self.sizes, self.seen = items, sizes, seen

    @classmethod
    def of(cls, page: str) -> tuple[str, Signature]:
        items, where, flat = folded(page)
        size = [len(" ".join(v.split())) for k, _, v in tokens(page) if k == "text" and v.split()]
        total = [0] * sum(1 for _ in _places(items, where))
        for n, leaf in zip(size, leaves(items, where, flat)):
            total[leaf] += n
        key = " ".join(map(_key, items))
        seen = hashlib.blake2b(page.encode("utf-8", "replace"), digest_size=7).digest()
        return key, cls(items, total, [int.from_bytes(seen)])

    def add(self, other: Signature) -> None:
        self.items = [merge_texts([x, y], max) for x, y in zip(self.items, other.items)]
        self.sizes = [x + y for x, y in zip(self.sizes, other.sizes)]
        self.seen = sorted({*self.seen, *other.seen})[:2]

    def counted(self) -> list:
        """Items whose strings carry the number of unlike pages, two at most."""
        mark = lambda x: (x.partition("*")[0] + f"*{len(self.seen)}" if x[:1] == "#" and x != "#" else x) if isinstance(x, str) else (x[0], [*map(mark, x[1])])
        return [*map(mark, self.items)]

    def dump(self) -> str:
        return json.dumps([self.items, self.sizes, self.seen])

    @classmethod
    def load(cls, text: str) -> Signature:
        return cls(*json.loads(text))


def placed(signature: Signature, wrapper: list) -> tuple[list[str], list[int]]:
    """(named elements around it, or '' if put aside; unlike pages that have it there, or 0 for a slot) of every string."""
    mine = signature.counted()
    kept = list(mine)
    for op, a, b, c, d in matches(wrapper, mine):
        if op == "equal":
            kept[c:d] = [_strip(x) for x in wrapper[a:b]]
    # Of each open element: its name, whether it or one around it is put aside, the named ones around it.
    around, counts, stack, names = [], [], [("", False, "<body")], Counter()
    for token in _leaves(kept):
        if token[0] == "#":
            _, aside, path = stack[-1]
            counts.append(int(token.partition("*")[2] or 0))
            around.append("" if aside else path)
        elif token[1] != "/":
            name, *words = token[1:].split(".")
            _, aside, path = stack[-1]
            aside = aside or name in ASIDE or marks_aside(words)
            tells = name in ("article", "main") or words and name in ("section", "div", "td", "body")
            stack.append((name, aside, f"{path} {token}" if tells and f" {token} " not in f"{path} " else path))
            names[name] += 1
        else:
            _close(stack, names, token[2:])
    return around, counts


def _close(stack: list[tuple], names: Counter, name: str) -> None:
    """Take the innermost open element of a name off the stack, and what it holds."""
    if names[name]:
        while (top := stack.pop()[0]) != name:
            names[top] -= 1
        names[name] -= 1


def merged(wrappers: Iterable[list]) -> list:
    out: list | None = None
    for w in wrappers:
        out = w if out is None else align(out, w)
    return out or []


def vote(rows: Iterable[tuple[list[str], list[int], list[int]]]) -> dict[str, tuple[int, int]]:
    """For each element the text of slots within it, and that times its depth; '' has all."""
    held: dict[str, tuple[int, int]] = {}
    for around, counts, sizes in rows:
        for path, count, size in zip(around, counts, sizes):
            if path and count < 2:
                for depth, element in enumerate(["", *path.split(" ")]):
                    text, deep = held.get(element, (0, 0))
                    held[element] = text + size, deep + size * depth
    return held


def infer(pages: list[str]) -> tuple[str, str]:
    """(wrapper as JSON, start tag of the innermost element that holds nearly all of the slots' text in these pages)."""
    found: dict[str, Signature] = {}
    for key, one in map(Signature.of, pages):
        found[key].add(one) if key in found else found.update({key: one})
    wrapper = merged(s.counted() for s in found.values())
    held = vote((*placed(s, wrapper), s.sizes) for s in found.values())
    whole = held.pop("", (0, 0))[0]
    able = {e: (deep / text, text, e) for e, (text, deep) in held.items() if text and text >= NEARLY_ALL * whole}
    return json.dumps(wrapper), max(able, key=able.get, default="")


def main_text(page: str | None, main: str = "") -> str:
    """Blocks of a page's main text, joined by empty lines.

    ``main`` is the start tag of the host's element. The first of these that yields text decides: that element, the
    page's own article, its own main element, the body.
    """
    if not page:
        return ""
    found = [(k, n, v, labels(v) if k == "open" else []) for k, n, v in tokens(page)]
    name_, *words_ = (main[1:] or "?").split(".")
    order = [lambda name, words: name == name_ and words == words_] if name_ != "body" or words_ else []
    for inside in [*order, lambda name, words: name == "article", lambda name, words: name == "main" or "main" in words]:
        if any(k == "open" and inside(n, w) for k, n, _, w in found) and (text := _within(found, inside)):
            return text
    return _within(found, None)


def _within(found: list, inside: Callable[[str, list[str]], bool] | None) -> str:
    """Blocks of text in the elements that ``inside`` names, or in all, without what is put aside."""
    blocks: list[str] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, within the main element, put aside
    open_names: Counter = Counter()

    def end_block() -> None:
        if text := " ".join(html.unescape("".join(parts)).split()):
            blocks.append(text)
        parts.clear()

    for kind, name, value, words in found:
        within, aside = (stack[-1][1], stack[-1][2]) if stack else (inside is None, False)
        if kind == "text":
            if within and not aside:
                parts.append(value)
            continue
        if name in BLOCK:
            end_block()
        elif name == "br":
            parts.append(" ")
        if kind == "close":
            _close(stack, open_names, name)
        elif name not in VOID and not value.endswith("/"):
            if name in CLOSES_P and stack:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        _close(stack, open_names, "p")
                        break
                    if stack[k][0] in BLOCK:
                        break
                within, aside = (stack[-1][1], stack[-1][2]) if stack else (inside is None, False)
            put_aside = aside or name in ASIDE or (name not in ("html", "body", "article", "main") or "comment" in words) and marks_aside(words)
            stack.append((name, within or bool(inside and not put_aside and inside(name, words)), put_aside))
            open_names[name] += 1
    end_block()
    return "\n\n".join(blocks)


def signature_hash(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "replace"), digest_size=8).digest(), signed=True)


def host_signatures(pages: DataFrame) -> DataFrame:
    """host, sig, signature: one row for each shape among all pages of a host of ``pages`` (host, html)."""
    schema = "host string, sig long, signature string"

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        held: dict[tuple[str, int], Signature] = {}
        weight = 0
        for part in (part for batch in batches for part in text_slices(batch, "html")):
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                if not page:
                    continue
                key, one = Signature.of(page)
                at = (host, signature_hash(key))
                if at in held:
                    held[at].add(one)
                else:
                    held[at] = one
                    weight += len(key)
                if weight > HELD:
                    yield rows(held)
                    held, weight = {}, 0
        yield rows(held)

    def rows(held: dict) -> pa.RecordBatch:
        arrays = [pa.array([h for h, _ in held], pa.string()), pa.array([s for _, s in held], pa.int64()), pa.array([one.dump() for one in held.values()], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["host", "sig", "signature"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        one = Signature.load(pdf["signature"].iloc[0])
        for text in pdf["signature"].iloc[1:]:
            one.add(Signature.load(text))
        return pdf[["host", "sig"]].head(1).assign(signature=one.dump())

    return pages.mapInArrow(partial, schema).groupBy("host", "sig").applyInPandas(total, schema)


def host_votes(signatures: DataFrame) -> DataFrame:
    """host, element, text, deep: what the slots of each wrapper of a host say (element '': all of them)."""
    sized = signatures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("signature")).alias("size"))
    groups = F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("size") / HELD))
    dealt = signatures.join(sized, "host").select("host", "sig", "signature", F.pmod("sig", groups).alias("part"))

    def wrap(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [Signature.load(s) for s in pdf.sort_values("sig")["signature"]]
        wrapper = merged(one.counted() for one in held)
        found = vote((*placed(one, wrapper), one.sizes) for one in held)
        return pd.DataFrame([(pdf["host"].iloc[0], e, text, deep) for e, (text, deep) in found.items()], columns=["host", "element", "text", "deep"])

    return dealt.groupBy("host", "part").applyInPandas(wrap, "host string, element string, text long, deep long")


def host_elements(votes: DataFrame) -> DataFrame:
    """host, main: start tag of the innermost element that holds nearly all of the slots' text."""
    held = votes.groupBy("host", "element").agg(F.sum("text").alias("text"), F.sum("deep").alias("deep"))
    whole = held.where("element = ''").select(F.col("host").alias("_host"), F.col("text").alias("whole"))
    able = held.where("element <> '' AND text > 0").join(whole, F.col("host") == F.col("_host")).where(F.col("text") >= NEARLY_ALL * F.col("whole"))
    return able.groupBy("host").agg(F.max_by("element", F.struct(F.col("deep") / F.col("text"), "text", "element")).alias("main"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    signatures = written(host_signatures(pages.select("host", "html")), "html-signatures")
    hosts = written(host_elements(host_votes(signatures)), "html-hosts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                texts = [main_text(page, main or "") for page, main in zip(part.column("html").to_pylist(), part.column("main").to_pylist())]
                yield with_columns(part, ["page_id", "url"], text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    weight = hosts.agg(F.sum(F.octet_length("host") + F.octet_length("main") + 64)).first()[0] or 0
    joined = pages.join(F.broadcast(hosts) if weight <= SMALL else hosts, "host", "left").select("page_id", "url", "html", "main")
    return joined.mapInArrow(run, f"{schema_of(pages, 'page_id', 'url')}, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
