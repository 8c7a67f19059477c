"""The main text of pages by wrapper induction.

Pages of one host are made by one program. Each page's tree is aligned with that of another page of its host by simple
tree matching: text that is the same in the same place is the program's (template), text that varies fills a slot. Over all pages
of the host the slots' characters are counted by the element that they stand in; the deepest element that holds nearly
all of them is where articles are put. A host's wrapper is the tree of one page with this element and the template's
texts; a second reading of the pages aligns each with its wrapper and takes its text. To learn, pages move as skeletons:
trees of labels with a hash in place of each text, some tenth of the page.

What no alignment can tell is told by the page itself: menus, adverts and footers whose words vary from page to page are
known by their elements, classes and links, and a template's words within the article stay, as nothing in it is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from vecloom.durable import materialize
from vecloom.llm.common import map_batches, read, texts, typed
from vecloom.llm.dom import Node, align, blocks, counterpart, from_skeleton, is_main, parse, skeleton

#: A host of more pages is learned in groups of about so many, or of a ten-thousandth of all pages if that is more.
GROUP, SHARE = 256, 10_000
#: The article's element holds this share of what varies.
MOST = 0.9
#: A text is the template's if it is the same in this share of a group's pages, of three different ones at least.
SAME, PAGES = 0.5, 3
#: Rows that Python holds as objects at a time, and wrappers that a worker keeps.
ROWS, HELD = 64, 256
#: Nodes of all wrappers that go to every executor at most (some 50 MB); beyond, pages are shuffled to them.
MAX_NODES = 2_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, number sign or the end; lower-cased A-Z; '' for none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grouped(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    """(page_id, url, html, host, part, order): a host's pages are dealt to as many parts as its rows ask for.

    Only hosts with more than one of SHARE pages have parts, so at most SHARE rows say how many.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    sizes = materialize(pages.select(host_of(F.col(url_col)).alias("big")).groupBy("big").agg(F.count(F.lit(1)).alias("n")), "hosts")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    each = max(GROUP, total // SHARE)
    big = sizes.filter(F.col("n") > each).select("big", F.ceil(F.col("n") / each).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("page_id", "html"), F.coalesce("parts", F.lit(1)))
    rows = rows.join(F.broadcast(big), F.col("host") == F.col("big"), "left").withColumn("part", part.cast("int"))  # SHARE rows at most
    return rows.select("page_id", "url", "html", "host", "part", F.xxhash64("html").alias("order"))


class Learner:
    """What is learned of a group while its pages pass: the first page is the one that others are aligned with."""

    def __init__(self, tree: Node):
        self.tree, self.pages = tree, 1
        self.mass, self.same = np.zeros(tree.end, np.int64), np.zeros(tree.end, np.int64)

    def add(self, page: Node) -> None:
        pairs = align(page, self.tree)
        for block in blocks(page):
            element = innermost(block.above, pairs)
            for n in block.nodes:
                if n.index in pairs and pairs[n.index].token == n.token:
                    self.same[pairs[n.index].index] += 1
                else:
                    self.mass[element] += n.chars
        self.pages += 1

    def rule(self) -> dict:
        """first, end: numbers of the article's element and of what follows it; whole: it says that it is one; template: numbers of constant texts."""
        total = int(self.mass.sum())
        template = np.flatnonzero(self.same >= max(1, SAME * (self.pages - 1))).tolist() if self.pages >= PAGES else []
        if not total:
            return {"first": 0, "end": 0, "whole": False, "template": template}
        sums = np.concatenate([[0], np.cumsum(self.mass)])
        path, node = [self.tree], self.tree
        while node is not None:
            node = next((c for c in node.children if sums[c.end] - sums[c.index] >= MOST * total), None)
            path += [node] if node is not None else []
        mains = [n for n in path if is_main(n)]
        chosen = mains[-1] if mains else path[-1]
        return {"first": chosen.index, "end": chosen.end, "whole": bool(mains), "template": template}


def innermost(above: list[int], pairs: dict[int, Node]) -> int:
    """The number, in the other tree, of the innermost of some elements that stands against one of it."""
    return next((pairs[i].index for i in reversed(above) if i in pairs), -1)


def main_text(page: Node, wrapper: tuple[Node, dict] | None) -> str:
    """The text of a page that a wrapper finds in it; of its own article, or body, if the wrapper has no place in the page."""
    found = blocks(page)
    if wrapper is not None and wrapper[1]["end"]:
        tree, rule = wrapper
        path, at = [tree], tree.index
        while at != rule["first"]:
            path.append(next(c for c in path[-1].said if c.index <= rule["first"] < c.end))
            at = path[-1].index
        place = counterpart(page, path)
        within = [b for b in found if place is not None and place.index in b.above]
        if within and rule["whole"]:
            return "\n".join(b.text for b in within)
        if within:
            pairs, template = align(page, tree), set(rule["template"])
            varies = lambda b: not all(n.index in pairs and pairs[n.index].index in template and pairs[n.index].token == n.token for n in b.nodes)
            return "\n".join(b.text for b in found if varies(b))
    return "\n".join(b.text for b in found if b.main)


SKELETON = "labels array<string>, ends array<int>, tokens array<long>, chars array<int>"
RULE = "first int, end int, whole boolean, template array<int>"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def learned(rows: DataFrame) -> DataFrame:
    """(host, part, SKELETON, RULE): the wrapper of each group of ``grouped`` rows.

    Skeletons of a group come sorted by a hash of the page, so the first is the same in every run, and copies teach once; what is held is
    one page, one tree and two numbers a node, whatever the group's size.
    """

    def reduced(batch: pa.RecordBatch) -> dict:
        made = [skeleton(parse(x)) for x in texts(batch, "html")]
        return {c: batch.column(c) for c in ("host", "part", "order")} | {c: [m[c] for m in made] for c in _names(SKELETON)}

    bare = map_batches(rows.filter("host <> ''").select("host", "part", "order", "html"), reduced, f"host string, part int, order long, {SKELETON}", rows=ROWS)
    names = ["host", "part", *_names(SKELETON), *_names(RULE)]
    target = f"host string, part int, {SKELETON}, {RULE}"
    kinds = to_arrow_schema(_parse_datatype_string(target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, order, first, learner, out = None, None, None, None, []

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], type=kinds.field(n).type) for n in names], schema=kinds)

        def done() -> None:
            if learner is not None:
                out.append({"host": key[0], "part": key[1], **first, **learner.rule()})

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for row in batch.slice(at, ROWS).to_pylist():
                    if (row["host"], row["part"]) != key:
                        done()
                        key, order, first = (row["host"], row["part"]), row["order"], {n: row[n] for n in _names(SKELETON)}
                        learner = Learner(from_skeleton(first))
                    elif row["order"] != order:
                        order = row["order"]
                        learner.add(from_skeleton(row))
            if len(out) >= ROWS:
                yield flushed()
                out = []
        done()
        yield flushed()

    return bare.repartition("host", "part").sortWithinPartitions("host", "part", "order").mapInArrow(run, target)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: a page's main text, blocks joined by a line feed.

    Within a block every run of white space (Unicode's) is one space; character references are decoded. Null and empty pages
    have no text. A page that no other page of its host stands beside (a host of one page or of copies of one, no host, a
    page unlike the others) gives what is in its own article or main element, or in its body if it has none. Repeated rows
    are rows; pages of any length are read whole, elements nested deeper than ``dom.DEPTH`` as siblings. An empty table gives
    an empty one, other columns are dropped.
    """
    rows = grouped(pages, id_col, url_col, body_col)
    wrappers = materialize(learned(rows), "wrappers")
    nodes = wrappers.agg(F.sum(F.size("ends"))).first()[0] or 0
    wrappers = wrappers.withColumnRenamed("host", "h").withColumnRenamed("part", "p")
    near = F.broadcast(wrappers) if nodes <= MAX_NODES else wrappers
    both = rows.join(near, (F.col("host") == F.col("h")) & (F.col("part") == F.col("p")), "left").select("page_id", "url", "html", "h", "p", *_names(SKELETON), *_names(RULE))
    held: dict[tuple, tuple[Node, dict]] = {}

    def made(batch: pa.RecordBatch) -> dict:
        keys = list(zip(batch.column("h").to_pylist(), batch.column("p").to_pylist()))
        out = []
        for i, (html, key) in enumerate(zip(texts(batch, "html"), keys)):
            if key[0] is not None and key not in held:
                if len(held) >= HELD:
                    held.clear()
                row = {n: batch.column(n)[i].as_py() for n in (*_names(SKELETON), *_names(RULE))}
                held[key] = (from_skeleton(row), row)
            out.append(main_text(parse(html), held.get(key)))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": out, "n_chars": [len(x) for x in out]}

    return map_batches(both, made, f"{typed(both, 'page_id')}, {typed(both, 'url')}, text string, n_chars long", rows=ROWS)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


#: For pages as the table has them: an article of h1, p, b and br elements, and the references that occur in them.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<br>', ' ', 'g'), '</?(h1|p)>', chr(1), 'g') AS x FROM a),
c AS (SELECT page_id, url, list_transform(string_split(x, chr(1)), lambda t: trim(regexp_replace(t, '[\s\x{A0}]+', ' ', 'g'))) AS parts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda t: t <> ''), chr(10)) AS x FROM c),
e AS (SELECT page_id, url, regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS text FROM d)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM e
"""
