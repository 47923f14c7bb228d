"""URL filters: a path-template tree for each host, rejected by smoothed labelled purity.

A URL's path becomes segments; digits, hexadecimal and date-like segments become typed wildcards ({num}, {hex}, {date},
with their file extension) at once. Then, level by level, where a node has more than LITERALS different children that are
more than SHARE of its URLs, or more than KINDS whatever their share, the segment varies and becomes {*}. Of what is left,
sibling branches are merged, from the root down, if they are alike: neither their bad shares nor how their URLs spread over the next
segments (or end) differ by G² at the 5 % level. Neighbours are compared, the most alike first: siblings with the same next
segments in order of bad share, then what is left of all siblings, in order of most frequent next segment and bad share. So
merging n siblings takes n log n steps. Merged branches' labels count together. A template is rejected if its labelled purity, smoothed
with STRENGTH pseudo-labels towards its host's, which is smoothed likewise towards that of all hosts, is below PURITY.

A page's label is that of the document whose number its path ends in: bad if its quality is 0 or it is toxic.

Counting goes over all URLs in Spark, and so do the levels while more than HOST_ROWS templates have a deeper one; what is
deeper is finished by host, by the same rule. The only step by host works on a host's distinct templates, never on its URLs.

Defined results: scheme, query, fragment, case of the host and a trailing slash don't count; null URLs have null host and
template and aren't rejected; a URL without scheme and host has the host ""; paths may have any number of segments of any
length; a segment that itself begins with "{" begins with %7B in the template; repeated rows count each; of equally alike
neighbours the first in order are merged; the name of a branch merged of more than NAMES siblings has the first and the last
of them; nothing is rejected on a host without any label, and without labels at all purities are 1; conflicting labels of a
document count as the worse; an empty table gives an empty table; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, small_or_shuffled

LITERALS, SHARE, KINDS = 20, 0.1, 2_000
SAME, STRENGTH, PURITY = 3.84, 10.0, 0.5
HOST_ROWS, NAMES = 200_000, 8
#: Rows of templates up to which they are broadcast: they are some hundred bytes each.
TEMPLATE_ROWS = 200_000


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#][\s\S]*$", ""), r"/+$", "")


def typed_segments(path: Column) -> Column:
    """Segments with typed wildcards, the first one after the leading slash."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def kind(s: Column) -> Column:
        stem = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", 1)
        ext = F.lower(F.regexp_extract(s, r"^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", 2))
        name = F.when(stem.rlike(r"^\d{4}-\d{2}-\d{2}$"), "{date}").when(stem.rlike(r"^\d+$"), "{num}").when(stem.rlike(r"^(?=.*\d)[0-9a-fA-F\-]{8,}$"), "{hex}")
        return F.when(name.isNotNull(), F.concat(name, ext)).otherwise(F.regexp_replace(s, r"^\{", "%7B"))

    return F.transform(parts, kind)


def varies(kinds: int, urls: int) -> bool:
    """Whether a segment with so many different literals in so many URLs is a variable one."""
    return kinds > LITERALS and (kinds > SHARE * urls or kinds > KINDS)


def generalised(templates: DataFrame, host_rows: int = HOST_ROWS) -> tuple[DataFrame, int]:
    """templates (host, raw, segs, n, labelled, bad) with segs in which varying segments are {*}, one row a raw template still; and
    the level to which that is done, beyond which few go."""
    now, k = templates, 0
    while now.where(F.size("segs") > k).count() > host_rows:
        prefix, seg = F.array_join(F.slice("segs", 1, k), "/"), F.get("segs", F.lit(k))
        children = now.where(F.size("segs") > k).groupBy("host", prefix.alias("prefix"), seg.alias("seg")).agg(F.sum("n").alias("n"))
        nodes = children.groupBy("host", "prefix").agg(F.count(F.when(~F.startswith("seg", F.lit("{")), 1)).alias("kinds"), F.sum("n").alias("all"))
        varying = nodes.where((F.col("kinds") > LITERALS) & ((F.col("kinds") > SHARE * F.col("all")) | (F.col("kinds") > KINDS))).select(F.col("host").alias("_host"), F.col("prefix").alias("_prefix"))
        joined = now.join(small_or_shuffled(varying, most=TEMPLATE_ROWS), (F.col("host") == F.col("_host")) & (prefix == F.col("_prefix")) & (F.size("segs") > k), "left")
        at = F.lit(k)
        new = F.when(F.col("_host").isNotNull() & ~F.startswith(seg, F.lit("{")), F.transform("segs", lambda s, i: F.when(i == at, F.lit("{*}")).otherwise(s))).otherwise(F.col("segs"))
        now, k = cut(joined.select("host", "raw", new.alias("segs"), "n", "labelled", "bad")), k + 1
    return now, k


def finished(segs: list[list[str]], n: list[int], level: int) -> list[list[str]]:
    """generalised() from a level on, for one host's templates."""
    out = [list(s) for s in segs]
    first: dict[tuple, list[int]] = {}
    for i, s in enumerate(out):
        first.setdefault(tuple(s[:level]), []).append(i)
    stack = [(rows, level) for rows in first.values()]
    while stack:
        rows, k = stack.pop()
        by: dict[str, list[int]] = {}
        for i in rows:
            if len(out[i]) > k:
                by.setdefault(out[i][k], []).append(i)
        literal = [x for x in by if not x.startswith("{")]
        if varies(len(literal), sum(n[i] for mine in by.values() for i in mine)):
            mine = [i for x in literal for i in by.pop(x)]
            for i in mine:
                out[i][k] = "{*}"
            by["{*}"] = by.get("{*}", []) + mine
        stack += [(mine, k + 1) for mine in by.values()]
    return out


class _Node:
    __slots__ = ("children", "n", "labelled", "bad", "leaves", "ends")

    def __init__(self) -> None:
        self.children: dict[str, _Node] = {}
        self.n = self.labelled = self.bad = self.ends = 0
        self.leaves: list[int] = []

    def spread(self) -> dict[str, int]:
        """URLs by next segment; "" for those that end here."""
        return {k: c.n for k, c in self.children.items()} | ({"": self.ends} if self.ends else {})

    def share(self) -> float:
        return (self.bad + 0.5) / (self.labelled + 1)


def joined(a: _Node, b: _Node) -> _Node:
    """Both as one; the larger one takes up the other."""
    if len(a.children) + len(a.leaves) < len(b.children) + len(b.leaves):
        a, b = b, a
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        x.n, x.labelled, x.bad, x.ends = x.n + y.n, x.labelled + y.labelled, x.bad + y.bad, x.ends + y.ends
        x.leaves += y.leaves
        for k, c in y.children.items():
            if k in x.children:
                stack.append((x.children[k], c))
            else:
                x.children[k] = c
    return a


def g_squared(a: dict, b: dict) -> float:
    """How much the counts of two branches differ from one distribution; nothing, if one of them has none."""
    na, nb, out = sum(a.values()), sum(b.values()), 0.0
    if not na or not nb:
        return 0.0
    for k in a.keys() | b.keys():
        x, y = a.get(k, 0), b.get(k, 0)
        for v, n in ((x, na), (y, nb)):
            if v:
                out += 2 * v * math.log(v * (na + nb) / (n * (x + y)))
    return max(out, 0.0)


def bound(kinds: int) -> float:
    """The G² of so many kinds that 5 % of equal branches exceed (Wilson and Hilferty's approximation)."""
    d = kinds - 1
    return SAME if d <= 1 else d * (1 - 2 / (9 * d) + 1.645 * math.sqrt(2 / (9 * d))) ** 3


def gap(a: _Node, b: _Node) -> float:
    """How much two siblings' bad shares differ; infinite if they aren't alike."""
    labels = g_squared({"bad": a.bad, "good": a.labelled - a.bad}, {"bad": b.bad, "good": b.labelled - b.bad})
    if labels >= SAME:
        return math.inf
    x, y = a.spread(), b.spread()
    return labels if g_squared(x, y) < bound(len(x.keys() | y.keys())) else math.inf


def _merge_neighbours(members: list[tuple[list[str], _Node]]) -> list[tuple[list[str], _Node]]:
    """members with alike neighbours as one, the most alike first."""
    before, after = [i - 1 for i in range(len(members))], [*range(1, len(members)), -1]
    age = [0] * len(members)
    heap = [(g, i, i + 1, 0, 0) for i in range(len(members) - 1) if (g := gap(members[i][1], members[i + 1][1])) < math.inf]
    heapq.heapify(heap)
    while heap:
        _, i, j, x, y = heapq.heappop(heap)
        if age[i] != x or age[j] != y:
            continue
        names = members[i][0] + members[j][0] if len(members[i][0]) >= len(members[j][0]) else members[j][0] + members[i][0]
        members[i] = (names, joined(members[i][1], members[j][1]))
        age[i], age[j] = x + 1, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for p, q in ((before[i], i), (i, after[i])):
            if p >= 0 and q >= 0 and (g := gap(members[p][1], members[q][1])) < math.inf:
                heapq.heappush(heap, (g, p, q, age[p], age[q]))
    return [m for m, a in zip(members, age) if a >= 0]


def _name(names: list[str]) -> str:
    names = sorted(names)
    if len(names) == 1:
        return names[0]
    return "(" + "|".join(names) + ")" if len(names) <= NAMES else f"({names[0]}|..{len(names)}..|{names[-1]})"


def _merge(root: _Node) -> None:
    """Merges alike siblings below root, then below what they have become."""
    stack = [root]
    while stack:
        node = stack.pop()
        kinds: dict[bool, list[tuple[list[str], _Node]]] = {}
        for k, c in sorted(node.children.items()):
            kinds.setdefault(k.startswith("{"), []).append(([k], c))
        merged: dict[str, _Node] = {}
        for members in kinds.values():
            alike: dict[tuple, list[tuple[list[str], _Node]]] = {}
            for m in members:
                alike.setdefault(tuple(sorted(m[1].spread())), []).append(m)
            left = [m for same in alike.values() for m in _merge_neighbours(sorted(same, key=lambda m: (m[1].share(), m[0])))]
            most = lambda m: max(m[1].spread().items(), key=lambda x: (x[1], x[0]), default=("", 0))[0]
            left = _merge_neighbours(sorted(left, key=lambda m: (most(m), m[1].share(), sorted(m[0])[0])))
            merged |= {_name(names): c for names, c in left}
        node.children = merged
        stack += merged.values()


def host_templates(rows: list[tuple[list[str], int, int, int]], level: int = 0) -> list[tuple[str, int, int]]:
    """For each (segments, URLs, labelled, bad) of a host, generalised up to a level, its final template and that one's labels."""
    root = _Node()
    segs = finished([r[0] for r in rows], [r[1] for r in rows], level)
    for i, (s, (_, n, labelled, bad)) in enumerate(zip(segs, rows)):
        node = root
        for x in [None, *s]:
            node = node if x is None else node.children.setdefault(x, _Node())
            node.n, node.labelled, node.bad = node.n + n, node.labelled + labelled, node.bad + bad
        node.leaves.append(i)
        node.ends += n
    _merge(root)
    out: list[tuple[str, int, int]] = [("", 0, 0)] * len(rows)
    stack = [("", root)]
    while stack:
        path, node = stack.pop()
        labelled, bad = sum(rows[i][2] for i in node.leaves), sum(rows[i][3] for i in node.leaves)
        for i in node.leaves:
            out[i] = (path or "/", labelled, bad)
        stack += [(f"{path}/{k}", c) for k, c in node.children.items()]
    return out


def filter_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url, host, template, labelled, purity, rejected of every page."""
    url = F.col("url")
    doc = F.regexp_extract(path_of(url), r"/(\d{1,18})(\.[A-Za-z]+)?$", 1)
    rows = pages.select(F.col("page_id").try_cast("long").alias("page_id"), "url", host_of(url).alias("host"), typed_segments(path_of(url)).alias("segs"), F.when(doc != "", doc.try_cast("long")).alias("_doc"))
    rows = rows.withColumn("raw", F.array_join("segs", "/"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("_id")).agg(F.max(bad.cast("int")).alias("_bad"))
    labelled = rows.where("url is not null").join(small_or_shuffled(known), F.col("_doc") == F.col("_id"), "left")
    templates = labelled.groupBy("host", "raw").agg(F.first("segs").alias("segs"), F.count("*").alias("n"), F.count("_bad").alias("labelled"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    few, level = generalised(cut(templates))
    few = few.withColumn("segments", F.array_join("segs", "/"))
    by_host = few.groupBy("host", "segments").agg(F.first("segs").alias("segs"), *(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segments", ignore_index=True)
        done = host_templates(list(zip(map(list, pdf.segs), pdf.n.tolist(), pdf.labelled.tolist(), pdf.bad.tolist())), level)
        return pd.DataFrame({"host": pdf.host, "segments": pdf.segments, "template": [d[0] for d in done], "labelled": [d[1] for d in done], "bad": [d[2] for d in done], "host_labelled": int(pdf.labelled.sum()), "host_bad": int(pdf.bad.sum())})

    made = cut(by_host.groupBy("host").applyInPandas(tree, "host string, segments string, template string, labelled long, bad long, host_labelled long, host_bad long"))
    every = few.agg(F.sum("labelled"), F.sum("bad")).first()
    overall = (every[1] or 0) / every[0] if every[0] else 0.0
    host_bad = (F.col("host_bad") + STRENGTH * overall) / (F.col("host_labelled") + STRENGTH)
    purity = 1 - (F.col("bad") + STRENGTH * host_bad) / (F.col("labelled") + STRENGTH)
    found = few.select("host", "raw", "segments").join(small_or_shuffled(made, most=TEMPLATE_ROWS), ["host", "segments"])
    side = found.select(F.col("host").alias("_h"), F.col("raw").alias("_r"), "template", "labelled", F.round(purity, 6).alias("purity"), (F.col("host_labelled") > 0).alias("_known"))
    out = rows.join(small_or_shuffled(side, most=TEMPLATE_ROWS), (F.col("host") == F.col("_h")) & (F.col("raw") == F.col("_r")), "left")
    return out.select("page_id", "url", "host", "template", "labelled", "purity", F.coalesce((F.col("purity") < PURITY) & F.col("_known"), F.lit(False)).alias("rejected"))
