"""Sources: fetched pages under the crawl's rules, replayed from tables or read over HTTP.

`replayed` applies type, size and status rules to a table of responses. `HttpSource` is a Python data
source that reads live addresses under the same rules; offline tests inject its opener.
"""

from __future__ import annotations

from urllib.request import Request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_BYTES, ROBOTS_BYTES, SITEMAP_BYTES = 5_242_880, 512_000, 2_000_000
TYPES = ("application/xhtml+xml", "text/html", "text/markdown", "text/x-markdown")


def replayed(responses: DataFrame, cap: int = PAGE_BYTES) -> DataFrame:
    """`responses` (url, status, content_type, content) with `fault`: null, not_found, http_error,
    unsupported_type or too_large; the content of a faulty response is null."""
    fault = (
        F.when(F.col("status") == 404, F.lit("not_found"))
        .when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.lit("http_error"))
        .when(~F.coalesce(F.lower(F.trim(F.split("content_type", ";")[0])).isin(*TYPES), F.lit(False)), F.lit("unsupported_type"))
        .when(F.octet_length("content") > cap, F.lit("too_large"))
    )
    return responses.withColumn("fault", fault).withColumn("content", F.when(F.col("fault").isNull(), F.col("content")))


class _Address(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class HttpSource(DataSource):
    """`spark.read.format("siltstone_http").option("urls", "a b").load()`: one partition an address."""

    opener = None

    @classmethod
    def name(cls) -> str:
        return "siltstone_http"

    def schema(self) -> str:
        return "url string, status int, content_type string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(self.options, type(self).opener)


class _HttpReader(DataSourceReader):
    def __init__(self, options, opener) -> None:
        self.urls = options.get("urls", "").split()
        self.agent = options.get("agent", "siltstone/1.0")
        self.cap = int(options.get("cap", PAGE_BYTES))
        self.timeout = float(options.get("timeout", 10))
        self.opener = opener

    def partitions(self):
        return [_Address(u) for u in self.urls]

    def read(self, partition):
        from urllib.error import HTTPError, URLError
        from urllib.request import build_opener

        request = Request(partition.url, headers={"User-Agent": self.agent, "Accept": ", ".join(TYPES), "Accept-Encoding": "identity"})
        open_ = self.opener or (lambda r, t: build_opener().open(r, timeout=t))
        try:
            with open_(request, self.timeout) as response:
                # One byte over the cap tells a body that is too large.
                yield (partition.url, response.status, response.headers.get("Content-Type"), response.read(self.cap + 1))
        except HTTPError as error:
            yield (partition.url, error.code, None, None)
        except (URLError, OSError):
            yield (partition.url, None, None, None)
