"""HTML extraction by wrappers: union-free regular expressions inferred from pages of one host.

The pages of each host are turned into token streams (tags with their class or id, and texts). Runs of one pattern in a
stream are folded to a repeated group; then the streams are aligned one after the other with the wrapper so far: where
texts differ a text slot arises, where one side has tags that the other lacks an optional group. The wrapper's slots show where
the text changes from page to page, and the deepest element that holds most of that text is the host's article element,
whatever it is called. Every page of the host is then read by it, whole: blocks of the article in page order, without the
elements inside that are not of the article (forms, adverts, comments and so on, by tag, role, class or id). A page on which the
host's element is missing is read by the wrapper of its own single stream, where every text is a slot; so is a host with a
single page.

Wrappers are inferred from all pages of a host: each task aligns those that it reads, and the tasks' wrappers are then aligned
with each other, as wrappers are streams too; the text at each place is summed over all pages. They are applied to all.

Defined results: null or empty html gives an empty text; a page without blocks gives an empty text; repeated rows get a
row each; a null url is a host of its own. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.llm.shared import ARROW_ROWS, Workspace

#: Hosts that a task remembers before it hands on what it has learned of them.
HOSTS = 1000
#: Streams of different tags that it holds until then.
SHAPES = 10_000
#: Alignments of more cells than this are halved first (Hirschberg), so that long streams need little memory.
CELLS = 1 << 18
BROADCAST_BYTES = 16 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|select|title)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("aside button dialog footer form head header input label nav".split())
#: Words of a class, id or role that name what is not the article.
FOREIGN = frozenset("ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs byline captcha comment comments complementary contentinfo cookie cookies consent disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar tooltip widget".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["td", "th", "tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
#: Elements that an unclosed one inside does not outlast.
STRONG = frozenset("article aside body div footer form header html main nav ol section table td tr ul".split())


def words_of(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(w for m in NAMES.finditer(attributes) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()) if w)


class Reader:
    """Walks a page as (kind, name or text, key, foreign): `open`, `close`, `text`; elements left open are closed."""

    def __init__(self):
        self.keys: dict[tuple[str, str], tuple[str, bool]] = {}

    def key(self, name: str, attributes: str) -> tuple[str, bool]:
        """An element's key (tag and class words) and whether it is none of the article's."""
        if (name, attributes) not in self.keys:
            if len(self.keys) > 20_000:
                self.keys.clear()
            w = words_of(attributes)
            self.keys[name, attributes] = (".".join([name, *(x for x in w if not x.isdigit())]), name in OUTSIDE or bool(FOREIGN.intersection(w)) and name not in ("html", "body") or "hidden" in attributes.split())
        return self.keys[name, attributes]

    def events(self, page: str) -> Iterator[tuple[str, str, str, bool]]:
        stack: list[tuple[str, str]] = []
        for m in TOKEN.finditer(page):
            name = m[3]
            if name is None:
                t = m[0]
                if m[1] is None and (t[0] != "<" or t == "<"):
                    yield "text", t, "", False
                continue
            name = name.lower()
            if m[2]:
                if name == "br":
                    yield "open", "br", "br", False
                    yield "close", "br", "br", False
                    continue
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        for n, key in reversed(stack[k:]):
                            yield "close", n, key, False
                        del stack[k:]
                        break
                    if stack[k][0] in STRONG and name not in STRONG:
                        break
                continue
            ends = CLOSES.get(name, frozenset(["p"]) if name in BLOCKS and name not in ("br", "body", "html") else frozenset())
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        for n, key in reversed(stack[k:]):
                            yield "close", n, key, False
                        del stack[k:]
                        break
                    if stack[k][0] in STRONG and stack[k][0] not in ends:
                        break
            key, foreign = self.key(name, m[4])
            yield "open", name, key, foreign
            if name in VOID or m[4].endswith("/"):
                yield "close", name, key, False
            else:
                stack.append((name, key))
        for n, key in reversed(stack):
            yield "close", n, key, False


def clean(parts: list[str]) -> str:
    text = "".join(parts)
    return " ".join((entities.unescape(text) if "&" in text else text).split())


# Wrappers: lists of ("tag", name), ("text", words or None for a slot), ("opt", items), ("rep", items) ----------------


def stream(reader: Reader, page: str) -> list[tuple]:
    """A page's items: tags by key, `/key` at the end, and texts."""
    out, held = [], []
    for kind, name, key, _ in reader.events(page):
        if kind == "text":
            held.append(name)
            continue
        if held and (t := clean(held)):
            out.append(("text", t))
        held = []
        if name != "br":
            out.append(("tag", key if kind == "open" else "/" + key))
    if held and (t := clean(held)):
        out.append(("text", t))
    return out


def shape(items: list[tuple]) -> tuple:
    return tuple(("text",) if i[0] == "text" else i if i[0] == "tag" else (i[0], shape(i[1])) for i in items)


def folded(items: list[tuple], longest: int = 8) -> list[tuple]:
    """Tandem runs of one pattern of tags made a repeated group, inner ones first."""
    for width in range(2, longest + 1):
        out, k = [], 0
        while k < len(items):
            part = items[k : k + width]
            balanced = len(part) == width and part[0][0] == "tag" and not part[0][1].startswith("/") and part[-1] == ("tag", "/" + part[0][1])
            pattern, n = shape(part) if balanced else (), 1
            while balanced and k + (n + 1) * width <= len(items) and shape(items[k + n * width : k + (n + 1) * width]) == pattern:
                n += 1
            if balanced and n > 1:
                merged = part
                for j in range(1, n):
                    merged = [a if a == b else merge_item(a, b) for a, b in zip(merged, items[k + j * width : k + (j + 1) * width], strict=True)]
                out.append(("rep", merged))
                k += n * width
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def merge_item(a: tuple, b: tuple) -> tuple:
    if a[0] == "text":
        return a if a == b else ("text", None)
    return (a[0], align(a[1], b[1])) if a[0] in ("rep", "opt") else a


def similar(a: tuple, b: tuple) -> int:
    """How well two items go together; 0: not at all."""
    if a[0] == b[0] == "text":
        return 2
    if a[0] == b[0] == "tag":
        return 3 * (a[1] == b[1])
    if a[0] == b[0] and a[1] and b[1] and a[1][0] == b[1][0]:
        return 4
    return 0


def weights(items: list[tuple], codes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(code, weight) of each item: similar(x, y) is the weight where codes are equal, else 0."""
    code, weight = np.empty(len(items), np.int64), np.empty(len(items), np.int64)
    for i, (kind, what) in enumerate(items):
        name, w = ("text", 2) if kind == "text" else (f"tag {what}", 3) if kind == "tag" else (f"{kind} {what[0]!r}", 4)
        code[i], weight[i] = codes.setdefault(name, len(codes)), w
    return code, weight


def last_row(a: tuple[np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    """The best alignment's weight of all of a with each beginning of b."""
    row = np.zeros(len(b) + 1, np.int64)
    for code, w in zip(*a, strict=True):
        row[1:] = np.maximum(row[1:], row[:-1] + np.where(b == code, w, 0))
        np.maximum.accumulate(row, out=row)
    return row


def halves(a: list[tuple], b: list[tuple]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """Parts of a and b of at most CELLS cells, in order, whose alignments together are the best one of a and b."""
    codes: dict[str, int] = {}
    (x, wx), (y, _) = weights(a, codes), weights(b, codes)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and x[i] == y[j] and (n - i) * (m - j) > CELLS:
            yield a[i : i + 1], b[j : j + 1]
            i, j = i + 1, j + 1
        if (n - i) * (m - j) <= CELLS or n - i < 2:
            yield a[i:n], b[j:m]
            continue
        mid = (i + n) // 2
        ahead = last_row((x[i:mid], wx[i:mid]), y[j:m])
        behind = last_row((x[mid:n][::-1], wx[mid:n][::-1]), y[j:m][::-1])[::-1]
        cut = j + int((ahead + behind).argmax())
        todo += [(mid, n, cut, m), (i, mid, j, cut)]


def align(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """The wrapper that both are instances of: common items in order, slots where texts differ, optional groups elsewhere."""
    if len(a) > 1 and len(a) * len(b) > CELLS:
        return [item for x, y in halves(a, b) for item in align(x, y)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            s = similar(a[i], b[j])
            row[j] = max(below[j], row[j + 1], below[j + 1] + s if s else 0)
    out, i, j, only = [], 0, 0, []

    def settle():
        if only:
            out.append(only[0] if len(only) == 1 and only[0][0] == "opt" else ("opt", list(only)))
            only.clear()

    while i < n or j < m:
        s = similar(a[i], b[j]) if i < n and j < m else 0
        if s and best[i][j] == best[i + 1][j + 1] + s:
            settle()
            out.append(merge_item(a[i], b[j]))
            i, j = i + 1, j + 1
        elif i < n and best[i][j] == best[i + 1][j]:
            only.append(a[i])
            i += 1
        else:
            only.append(b[j])
            j += 1
    settle()
    return out


def inside(path: tuple[str, ...], tag: str) -> tuple[str, ...]:
    """The open elements after a tag."""
    if not tag.startswith("/"):
        return (*path, tag)
    return path[: len(path) - 1 - path[::-1].index(tag[1:])] if tag[1:] in path else path


def slots(items: list[tuple], path: tuple[str, ...], found: set[tuple[str, ...]]) -> tuple[str, ...]:
    """Collects the open elements at each text slot."""
    for kind, what in items:
        if kind == "tag":
            path = inside(path, what)
        elif kind == "text":
            if what is None:
                found.add(path)
        else:
            slots(what, path, found)
    return path


def places(items: list[tuple]) -> list[tuple[str, ...]]:
    """The chain of open elements at each text of a stream."""
    out, path = [], ()
    for kind, what in items:
        if kind == "tag":
            path = inside(path, what)
        else:
            out.append(path)
    return out


def is_foreign(key: str) -> bool:
    name, *words = key.split(".")
    return name in OUTSIDE or bool(FOREIGN.intersection(words)) and name not in ("html", "body")


def article_key(wrapper: list[tuple], volume: dict[tuple[str, ...], int]) -> str:
    """The key of the element that holds the wrapper's article, whatever its name: the deepest with most of the text in the
    slots. Slots in what is foreign by its name don't count, nor those in links where there are others; a host without any
    slot that counts has none."""
    found: set[tuple[str, ...]] = set()
    slots(wrapper, (), found)
    text = {p: volume.get(p, 0) for p in found if p and not any(map(is_foreign, p))}
    prose = {p: n for p, n in text.items() if not any(k.split(".")[0] == "a" for k in p)}
    text = prose if sum(prose.values()) else text
    weight: dict[str, int] = {}
    depth: dict[str, int] = {}
    for p, n in text.items():
        for d, key in enumerate(dict.fromkeys(p)):
            weight[key] = weight.get(key, 0) + n
            depth[key] = max(depth.get(key, 0), d)
    total = sum(text.values())
    holders = [k for k in weight if k.split(".")[0] in STRONG and 10 * weight[k] >= 7 * total]
    return max(holders, key=lambda k: (depth[k], weight[k], k)) if holders else ""


def flat(items: list[tuple]) -> list[tuple]:
    """The items with those of optional groups in their places, so that a page that has them meets them, and its texts theirs."""
    return [x for kind, what in items for x in (flat(what) if kind == "opt" else [(kind, what)])]


def all_slots(items: list[tuple]) -> list[tuple]:
    """The wrapper of a single stream, where every text is a slot."""
    return [("text", None) if kind == "text" else (kind, what if kind == "tag" else all_slots(what)) for kind, what in items]


class Learned:
    """What some pages of a host say: their wrapper and the text at each place. Streams of the same tags are one, with slots
    where their texts differ, before they are folded and aligned. While all pages are equal, they count once."""

    def __init__(self):
        self.first, self.many, self.wrapper, self.volume = b"", False, [], {}
        self.one, self.held = None, {}

    def add(self, items: list[tuple]) -> None:
        if self.one is None:
            self.one = items
        elif not self.many:
            if items == self.one:
                return
            self.many = True
        key = tuple(what if kind == "tag" else None for kind, what in items)
        if key in self.held:
            merged, where = self.held[key]
            self.held[key] = [a if a == b else ("text", None) for a, b in zip(merged, items, strict=True)], where
        else:
            where = places(items)
            self.held[key] = items, where
        for path, (_, text) in zip(where, (i for i in items if i[0] == "text"), strict=True):
            self.volume[path] = self.volume.get(path, 0) + len(text)

    def settle(self) -> Learned:
        """Aligns the streams it still holds."""
        if self.one is not None and not self.first:
            first = hashlib.blake2b(repr(self.one).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            for merged, _ in self.held.values():
                self.join(first, self.many, folded(merged))
            self.one, self.held = None, {}
        return self

    def join(self, first: bytes, many: bool, wrapper: list[tuple]) -> None:
        self.many = self.many or many
        if not self.first:
            self.first, self.wrapper = first, wrapper
        elif shape(self.wrapper) == shape(wrapper):
            self.wrapper = [merge_item(a, b) for a, b in zip(self.wrapper, wrapper, strict=True)]
        else:
            self.wrapper = align(flat(self.wrapper), flat(wrapper))

    def merge(self, other: Learned) -> None:
        """Takes over what other pages of the host say."""
        self.settle()
        other.settle()
        if not other.first or self.first == other.first and not (self.many or other.many):
            return
        self.join(other.first, other.many or bool(self.first) and self.first != other.first, other.wrapper)
        for path, n in other.volume.items():
            self.volume[path] = self.volume.get(path, 0) + n

    def article(self) -> str:
        self.settle()
        return article_key(self.wrapper if self.many else all_slots(self.wrapper), self.volume)


def infer(reader: Reader, pages: list[str]) -> str:
    """The article key of a host's pages."""
    learned = Learned()
    for p in pages:
        learned.add(stream(reader, p))
    return learned.article()


def extract(reader: Reader, page: str, key: str) -> str | None:
    """The text of the elements of that key, block by block; None if there is none. An empty key stands for the whole page."""
    blocks, held, inside, away, found = [], [], 0, 0, not key
    for kind, name, k, foreign in reader.events(page):
        if kind == "text":
            if (inside or not key) and not away:
                held.append(name)
            continue
        if kind == "open" and k == key and not away:
            found, inside = True, inside + 1
        if (name in BLOCKS or k == key) and held:
            if t := clean(held):
                blocks.append(t)
            held = []
        if kind == "open":
            if away or (foreign and (inside or not key) and k != key):
                away += 1
        elif away:
            away -= 1
        elif k == key and inside:
            inside -= 1
    if held and (t := clean(held)):
        blocks.append(t)
    return "\n".join(blocks) if found else None


def read(reader: Reader, page: str | None, key: str | None) -> str:
    if not isinstance(page, str) or not page:
        return ""
    text = extract(reader, page, key) if key else None
    if text is None:
        own = infer(reader, [page])
        text = extract(reader, page, own)
    return text or ""


def host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, article) for every host, inferred from all its pages: where they are read, then from what the tasks learned."""
    rows = pages.where(F.length("html") > 0).select(host().alias("host"), "html")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, known, part, turn = Reader(), {}, TaskContext.get().partitionId(), 0

        def told() -> pd.DataFrame:
            return pd.DataFrame({"host": list(known), "part": part, "turn": turn, "learned": [pickle.dumps(x.settle()) for x in known.values()]})

        for f in frames:
            for name, page in zip(f["host"], f["html"], strict=True):
                known.setdefault(name, Learned()).add(stream(reader, page))
            if len(known) > HOSTS or sum(len(x.held) for x in known.values()) > SHAPES:
                yield told()
                known, turn = {}, turn + 1
        if known:
            yield told()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        learned = Learned()
        for x in f.sort_values(["part", "turn"])["learned"]:
            learned.merge(pickle.loads(x))
        return pd.DataFrame({"host": [f["host"].iat[0]], "article": [learned.article()]})

    found = rows.mapInPandas(learn, "host string, part int, turn int, learned binary")
    return found.groupBy("host").applyInPandas(run, "host string, article string")


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""
    ws = Workspace(spark, "wrappers")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    found = ws.write(host_wrappers(pages), "hosts")
    size = found.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("article") + 64), F.lit(0))).first()[0]
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    rows = pages.select("page_id", "url", "html", host().alias("host")).join(found, "host", "left").select("page_id", "url", "html", "article")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for f in frames:
            f["text"] = [read(reader, p, k) for p, k in zip(f["html"], f["article"], strict=True)]
            f["n_chars"] = f["text"].str.len().astype("int64")
            yield f[["page_id", "url", "text", "n_chars"]]

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars bigint")
