"""HTML pages to node arrays: the one step that leaves the JVM.

`shred` adds a column `dom`, the page's nodes in document order. A node's `id` is its index
in the array and `end` the id of its last descendant, so ancestors, subtrees and siblings
are plain comparisons and everything downstream is a column expression without a shuffle.
A second column, `dom_strings`, has every string of the page once: those of the text in document order, then those of
scripts and comments. A node holds the interval of its strings, so nested elements repeat nothing.

The tree follows the rules of the standard library's tokenizer with the simplest closing
policy: an end tag closes the nearest open element of that name, one without a match is
ignored, void elements never stay open.
"""

from __future__ import annotations

import html
import re
from collections.abc import Collection, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML's void elements, and elements whose strings are not page text.
VOID = frozenset((
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex",
    "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr"))
RAW_TEXT = frozenset("rp rt script style template".split())
KEEP_SPACE = frozenset(("pre", "textarea"))

# Tags written the plain way, as nearly all are: read at one match, the others are left to the library's tokenizer.
_ATTR = r'[a-zA-Z_:][-a-zA-Z0-9_:.]*="[^"]*"'
_PLAIN_START = re.compile(rf"<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+{_ATTR})*)[ \t\n\r\f]*>")
_PLAIN_ATTR = re.compile(r'([a-zA-Z_:][-a-zA-Z0-9_:.]*)="([^"]*)"')
_PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
# Tags without attributes are read once: those up to so many characters, up to so many of them.
_SHORT, _KNOWN = 24, 4096
# Elements after whose start tag a tokenizer may read on in another way.
_OWN_MODE = frozenset("script style title textarea plaintext xmp iframe noembed noframes noscript".split())

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

NODE = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),  # -1 at the top level
    T.StructField("end", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("kind", T.StringType()),  # element, text, raw, comment, other
    T.StructField("tag", T.StringType()),  # lower case; NULL unless an element
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("first", T.IntegerType()),  # strings of the subtree: [first, upto) of `dom_strings`
    T.StructField("upto", T.IntegerType()),
    T.StructField("lead", T.IntegerType()),  # first direct string child
    T.StructField("lo", T.IntegerType()),  # source span [lo, hi) in code points
    T.StructField("hi", T.IntegerType()),
])
DOM = T.ArrayType(NODE)
# The columns beside `dom`; the second only on request, and NULL where it would say the same.
STRINGS, STRINGS_TWICE = "dom_strings", "dom_strings_twice"

# Output is cut into record batches of about this many nodes or text characters.
_NODES_PER_BATCH = 50_000
_CHARS_PER_BATCH = 32_000_000


class _TreeReader(HTMLParser):
    """Appends the nodes of page after page to flat columns, ready for Arrow."""

    def __init__(self, want: dict):
        super().__init__(convert_charrefs=True)
        self.want = want
        self.known: dict[str, tuple[str, bool, bool, bool]] = {}  # plain tags by how they are written: name, starts, wanted, stays open
        self.new_batch()

    def new_batch(self) -> None:
        self.page_ends: list[int] = [0]
        self.absent: list[bool] = []
        self.parent, self.end, self.depth, self.lo, self.hi = [], [], [], [], []
        self.kind, self.tag, self.first, self.upto, self.lead = [], [], [], [], []
        self.strings, self.twice, self.string_ends = [], [], [0]
        self.attr_keys, self.attr_values, self.attr_ends = [], [], [0]
        self.weight = 0

    def updatepos(self, i: int, j: int) -> int:
        self.at = j + self.shift  # an absolute offset is all that is needed; lines are not counted
        return j

    def add_page(self, source: str | None) -> None:
        self.base = len(self.parent)
        self.open: list[int] = []
        self.wanted = 0  # open elements whose strings are asked for
        self.open_tags: dict[str, int] = {}
        self.pieces: list[str] = []
        self.raw_pieces: list[str] = []
        self.notes: list[str] = []
        # Nodes whose interval or lead counts the strings of scripts, or those of comments and declarations.
        self.raw_nodes: list[int] = []
        self.raw_leads: list[int] = []
        self.note_nodes: list[int] = []
        self.buffer: list[str] = []
        self.at = self.shift = self.buffer_at = self.raw_depth = self.pre_depth = 0
        if source is not None:
            self.reset()
            self.size = len(source)
            self.feed(source)
            self.shift = self.size - len(self.rawdata)
            self.close()
            self._flush()
            while self.open:
                self._pop(self.size)
            self._end_page()
        elif self.want["decode_twice"] == "both":
            self.twice.append(None)
        self.absent.append(source is None)
        self.page_ends.append(len(self.parent))
        self.string_ends.append(len(self.strings))

    def _end_page(self) -> None:
        plain = len(self.pieces)
        for nodes, behind in ((self.raw_nodes, plain), (self.note_nodes, plain + len(self.raw_pieces))):
            for node in nodes:
                self.first[node] += behind
                self.upto[node] += behind
        for node in self.raw_leads:
            self.lead[node] += plain
        strings = self.pieces + self.raw_pieces
        decoded = [html.unescape(s) if "&" in s else s for s in strings] if self.want["decode_twice"] else strings
        if self.want["decode_twice"] == "both":
            self.twice.append(decoded + self.notes if decoded != strings else None)
            decoded = strings
        self.strings += decoded
        self.strings += self.notes

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section the tokenizer refuses, such as `<![foo x]>`, is a comment, and reading goes on after it."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def parse_starttag(self, i: int) -> int:
        upto = i if self.cdata_elem is not None else self._plain(i)
        return upto if upto > i else super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        upto = i if self.cdata_elem is not None else self._plain(i)
        return upto if upto > i else super().parse_endtag(i)

    def _plain(self, i: int) -> int:
        """Read on from `i` through plain tags and the text between them; where the first thing stands that the library has to read."""
        raw, shift, base, want, known = self.rawdata, self.shift, self.base, self.want, self.known
        texts, keep, classes, parts_of = want["text_nodes"], want["attrs"], want["parts_of_class"], want["parts_of"]
        tags, open_nodes, open_tags, buffer = self.tag, self.open, self.open_tags, self.buffer
        keys, values = self.attr_keys, self.attr_values
        while True:
            upto, rest = raw.find(">", i, i + _SHORT) + 1, None
            tag = known.get(raw[i:upto])
            if tag is None:
                found = _PLAIN_START.match(raw, i) or _PLAIN_END.match(raw, i)
                if found is None or (name := found[1].lower()) in _OWN_MODE:
                    break
                upto, starts = found.end(), found.re is _PLAIN_START
                tag = (name, starts, starts and (parts_of is None or name in parts_of), name not in VOID)
                rest = found[2] if starts else None
                if not rest and upto - i <= _SHORT and len(known) < _KNOWN:
                    known[found[0]] = tag
            name, starts, wanted, opens = tag
            at = i + shift
            if buffer:
                self.at = at
                self._flush()
            if starts:
                self.lasttag = name
                node = len(tags)
                self.parent.append(open_nodes[-1] - base if open_nodes else -1)
                self.end.append(node - base)
                self.depth.append(len(open_nodes))
                self.kind.append("element")
                tags.append(name)
                self.first.append(None)
                self.upto.append(None)
                self.lead.append(None)
                self.lo.append(at)
                self.hi.append(upto + shift)
                if rest:
                    named = {k.lower(): html.unescape(v) if "&" in v else v for k, v in _PLAIN_ATTR.findall(rest)}
                    for key, value in named.items():
                        if keep is None or key in keep:
                            keys.append(key)
                            values.append(value)
                    if classes and not classes.isdisjoint(named.get("class", "").split()):
                        self._want(node)
                self.attr_ends.append(len(keys))
                if wanted and self.first[node] is None:
                    self._want(node)
                if opens:
                    open_nodes.append(node)
                    open_tags[name] = open_tags.get(name, 0) + 1
                    self.raw_depth += name in RAW_TEXT
                    self.pre_depth += name in KEEP_SPACE
            elif open_tags.get(name):
                while tags[open_nodes[-1]] != name:
                    self._pop(at)
                self._pop(upto + shift)
            i = raw.find("<", upto)
            if i < 0:  # what follows the last tag may end in half an entity
                i = upto
                break
            if i > upto and (texts or self.wanted):
                if not buffer:
                    self.buffer_at = upto + shift
                data = raw[upto:i]
                buffer.append(html.unescape(data) if "&" in data else data)
        self.at = i + shift
        return i

    # Tokenizer callbacks
    def handle_data(self, data: str) -> None:
        if not self.buffer:
            self.buffer_at = self.at
        self.buffer.append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        node = self._add("element", tag, self.at, self.at + len(self.get_starttag_text()))
        if attrs:
            keep, named = self.want["attrs"], dict(attrs)
            for key, value in named.items():
                if keep is None or key in keep:
                    self.attr_keys.append(key)
                    self.attr_values.append(value or "")
            self.attr_ends[-1] = len(self.attr_keys)
            classes = self.want["parts_of_class"]
            if classes and not classes.isdisjoint((named.get("class") or "").split()):
                self._want(node)
        if (self.want["parts_of"] is None or tag in self.want["parts_of"]) and self.first[node] is None:
            self._want(node)
        if tag not in VOID:
            self.open.append(node)
            self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
            self.raw_depth += tag in RAW_TEXT
            self.pre_depth += tag in KEEP_SPACE

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop(self.hi[-1])

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if not self.open_tags.get(tag):
            return
        while self.tag[self.open[-1]] != tag:
            self._pop(self.at)
        self._pop(self._after_gt(self.at))

    def handle_comment(self, data: str) -> None:
        self._markup("comment", data)

    def handle_decl(self, decl: str) -> None:
        self._markup("other", decl)

    handle_pi = unknown_decl = handle_decl

    # Tree
    def _want(self, node: int) -> None:
        raw = self.tag[node] in RAW_TEXT
        self.first[node] = self.upto[node] = len(self.raw_pieces if raw else self.pieces)
        if raw:
            self.raw_nodes.append(node)
        self.wanted += self.tag[node] not in VOID

    def _keep(self, node: int | None, pieces: list[str], among: list[int] | None, data: str) -> int:
        """Where `data` comes to stand among `pieces`; a string node's interval holds just that."""
        at = len(pieces)
        pieces.append(data)
        self.weight += len(data)
        if node is not None:
            self.first[node], self.upto[node] = at, at + 1
            if among is not None:
                among.append(node)
        return at

    def _markup(self, kind: str, data: str) -> None:
        self._flush()
        if self.want["text_nodes"]:
            node = self._add(kind, None, self.at, self._after_gt(self.at + len(data)))
            self._keep(node, self.notes, self.note_nodes, data)

    def _after_gt(self, start: int) -> int:
        found = self.rawdata.find(">", start - self.shift)
        return self.size if found < 0 else found + 1 + self.shift

    def _add(self, kind: str, tag: str | None, lo: int, hi: int) -> int:
        node = len(self.parent)
        self.parent.append(self.open[-1] - self.base if self.open else -1)
        self.end.append(node - self.base)
        self.depth.append(len(self.open))
        self.kind.append(kind)
        self.tag.append(tag)
        self.first.append(None)
        self.upto.append(None)
        self.lead.append(None)
        self.lo.append(lo)
        self.hi.append(hi)
        self.attr_ends.append(self.attr_ends[-1])
        return node

    def _flush(self) -> None:
        if not self.buffer:
            return
        data = "".join(self.buffer)
        self.buffer.clear()
        if not self.wanted and not self.want["text_nodes"]:
            return
        if not self.pre_depth and not data.strip(" \t\n\r\f\v"):
            data = "\n" if "\n" in data else " "
        node = self._add("raw" if self.raw_depth else "text", None, self.buffer_at, self.at) if self.want["text_nodes"] else None
        at = self._keep(node, self.raw_pieces, self.raw_nodes, data) if self.raw_depth else self._keep(node, self.pieces, None, data)
        holder = self.open[-1] if self.open else None
        if holder is not None and self.first[holder] is not None and self.lead[holder] is None:
            self.lead[holder] = at
            if self.raw_depth:
                self.raw_leads.append(holder)

    def _pop(self, hi: int) -> None:
        node = self.open.pop()
        tag = self.tag[node]
        self.open_tags[tag] -= 1
        self.raw_depth -= tag in RAW_TEXT
        self.pre_depth -= tag in KEEP_SPACE
        self.end[node] = len(self.parent) - 1 - self.base
        self.hi[node] = hi
        if self.first[node] is not None:
            self.upto[node] = len(self.raw_pieces if tag in RAW_TEXT else self.pieces)
            self.wanted -= 1

    def to_arrow(self) -> list[pa.Array]:
        """`dom`, the strings, and if asked for the strings decoded twice."""
        ids = [i for lo, hi in zip(self.page_ends, self.page_ends[1:]) for i in range(hi - lo)]
        int32, string = pa.int32(), pa.string()
        columns = {
            "id": pa.array(ids, int32), "parent": pa.array(self.parent, int32), "end": pa.array(self.end, int32),
            "depth": pa.array(self.depth, int32), "kind": pa.array(self.kind, string),
            "tag": pa.array(self.tag, string),
            "attrs": pa.MapArray.from_arrays(
                pa.array(self.attr_ends, int32), pa.array(self.attr_keys, string),
                pa.array(self.attr_values, string)),
            "first": pa.array(self.first, int32), "upto": pa.array(self.upto, int32), "lead": pa.array(self.lead, int32),
            "lo": pa.array(self.lo, int32), "hi": pa.array(self.hi, int32),
        }
        absent = pa.array(self.absent, pa.bool_())
        dom = pa.ListArray.from_arrays(
            pa.array(self.page_ends, int32), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)), mask=absent)
        out = [dom, pa.ListArray.from_arrays(pa.array(self.string_ends, int32), pa.array(self.strings, string), mask=absent)]
        if self.want["decode_twice"] == "both":
            out.append(pa.array(self.twice, pa.list_(string)))
        return out


def shred(
    pages: DataFrame,
    *,
    parts_of: Collection[str] | None = (),
    parts_of_class: Collection[str] = (),
    text_nodes: bool = False,
    attrs: Collection[str] | None = None,
    decode_twice: bool | str = False,
    keep_html: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Add `dom` and `dom_strings` to pages having `html`; other columns pass through, `html` only if `keep_html`.

    What crosses back from Python is chosen by the caller, as column pruning cannot reach in:

    * `parts_of`, `parts_of_class`: tags (None for all) and class names whose interval of strings and `lead` are filled.
    * `text_nodes`: whether strings and comments are nodes of their own.
    * `attrs`: attribute names to keep (None for all).
    * `decode_twice`: decode entities once more, for text that goes through a clean-up which does; with "both",
      the strings so decoded are a third column, `dom_strings_twice`, NULL where they are the same.

    Pages that have a `dom` already, as those of `sources.shredded` do, come back as they are. A page without html keeps its row with a NULL `dom`. Malformed declarations are comments; see
    `malformed`. Filter pages before this call: predicates do not move below it. With `partitions`
    the pages are first dealt out, for an input whose files are fewer than the cores.
    """
    if "dom" in pages.columns:
        return pages
    want = {
        "parts_of": None if parts_of is None else frozenset(parts_of), "parts_of_class": frozenset(parts_of_class),
        "text_nodes": text_nodes, "attrs": None if attrs is None else frozenset(attrs),
        "decode_twice": decode_twice,
    }
    kept = [c for c in pages.columns if c != "html" or keep_html]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("dom", DOM)] + [
        T.StructField(c, T.ArrayType(T.StringType())) for c in ((STRINGS, STRINGS_TWICE) if decode_twice == "both" else (STRINGS,))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _TreeReader(want)
        for batch in batches:
            sources, passed, start = batch.column("html"), batch.select(kept), 0
            for row in range(batch.num_rows):
                reader.add_page(sources[row].as_py())
                full = len(reader.parent) >= _NODES_PER_BATCH or reader.weight >= _CHARS_PER_BATCH
                if full or row == batch.num_rows - 1:
                    part = passed.slice(start, row + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, *reader.to_arrow()], names=schema.names)
                    start = row + 1
                    reader.new_batch()

    return (pages.repartition(partitions) if partitions else pages).mapInArrow(run, schema)


# The words that may open a marked section.
MARKED = ("temp", "cdata", "ignore", "include", "rcdata", "if", "else", "endif")


def malformed(pages: DataFrame) -> DataFrame:
    """(page_id, n_malformed): pages with marked sections that no word known opens, which are read as comments."""
    bad = rf"(?i)<!\[(?!\s*(?:{'|'.join(MARKED)})\b)"
    return pages.select("page_id", F.regexp_count("html", F.lit(bad)).cast("long").alias("n_malformed")).where("n_malformed > 0")
