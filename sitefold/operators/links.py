"""Link edges of a page store."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.domains import SuffixRules, registered_domain
from ..functions import html as H
from ..functions.urls import resolve_link, strip_query_and_fragment


def hrefs(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """src_url, pos, href of every anchor, in document order, and columns to keep. A page that can't be read has none; the others
    go on."""
    schema = T.StructType([T.StructField("src_url", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("href", T.StringType()), *(pages.schema[c] for c in keep)])

    def of(h):
        try:
            return H.hrefs(h)
        except Exception:  # one bad page mustn't end the job
            return []

    def run(batches):
        for b in batches:
            for a in range(0, max(b.num_rows, 1), 512):
                part = b.slice(a, 512)
                row, src, pos, href = [], [], [], []
                for k, (u, h) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    found = of(h)
                    row += [k] * len(found)
                    src += [u] * len(found)
                    pos += range(len(found))
                    href += found
                more = part.select(list(range(2, part.num_columns))).take(pa.array(row, pa.int64())).columns if keep else []
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(pos, pa.int32()), pa.array(href, pa.string()), *more], names=schema.names)

    return pages.select(url, html, *keep).mapInArrow(run, schema)


def edges(pages: DataFrame, base: str = "site") -> DataFrame:
    """src_url, pos, href, dst_url."""
    return hrefs(pages).withColumn("dst_url", resolve_link("src_url", "href", base))


def within_domain(links: DataFrame, domain: str | None = None, rules: SuffixRules | None = None, strict_host: bool = False) -> DataFrame:
    """Edges that stay in the registered domain of their source (or in the column `domain`), without query and fragment.
    strict_host compares with the source's host instead, as crawls of subdomains once did: they then keep no links."""
    from ..functions.domains import host_of

    own = F.col(domain) if domain else F.regexp_replace(host_of("src_url"), r"www\.", "") if strict_host else registered_domain("src_url", rules)
    return links.where(registered_domain("dst_url", rules) == own).withColumn("dst_url", strip_query_and_fragment("dst_url"))
