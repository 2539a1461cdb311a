"""Crawled pages: one Arrow-batched pass from HTML to sanitised columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wayfold import rules
from wayfold.session import spread
from wayfold.sources import markup

# executors need not have this package installed: the reader travels with the task
cloudpickle.register_pickle_by_value(rules)
cloudpickle.register_pickle_by_value(markup)

LINK = "array<struct<href:string,raw_href:string,text:string>>"
SANITISED = (
    "title string, meta_description string, visible_text string, hidden_text string, "
    f"links {LINK}, forms array<struct<action:string,method:string>>, "
    "emails array<struct<value:string,origin:string,text:string>>, hidden_emails array<string>, "
    "last_modified_hint string"
)


def read_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Add the sanitised page columns.

    Pages are independent rows, so no shuffle is involved and
    a page is never cut: one too large is refused by the admission rule instead.
    However many rows a batch has, the columns of one slice of it are held at a time.
    """
    kept = [f.name for f in pages.schema.fields if f.name != html]
    extra = T._parse_datatype_string(SANITISED)
    kind = to_arrow_type(extra)

    @F.arrow_udf(extra)
    def page_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, addresses in batches:
            for part in markup.slices(pc.fill_null(pc.utf8_length(bodies), 0).to_pylist()):
                rows = zip(bodies[part].to_pylist(), addresses[part].to_pylist())
                yield pa.array([markup.read(h, u) for h, u in rows], type=kind)

    # as one that may differ from call to call, no filter on its columns reads a page a second time
    read = spread(pages).withColumn("__page", page_of.asNondeterministic()(F.col(html), F.col(url)))
    return read.select(*kept, *[F.col("__page")[f.name].alias(f.name) for f in extra.fields])
