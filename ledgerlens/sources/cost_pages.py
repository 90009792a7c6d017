"""Paged daily cost results (JSON) from a landing folder -> cost lines.

Each file is one page: ``ResultsByTime[]`` with ``TimePeriod.Start`` and
``Groups[]`` of ``Keys[]`` and ``Metrics.UnblendedCost.Amount`` (text). One
row per day x group: the service is the first key, the amount is parsed.
The account is given, or read from an ``account=<name>`` path segment.

A request whose result does not fit into one page is answered by a chain: each
page but the last names the next one (``NextPageToken``), and each but the
first says by which token it was asked for (``PageToken``). The pages of a
request lie under a ``request=<id>`` segment; without one, the tokens of a
folder make one request and a page without tokens is a request of its own.
``chain_faults`` finds requests that do not hold together, as a lost page is
lost cost; ``in_chain_order`` gives each page its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("PageToken", T.StringType()),
        T.StructField("NextPageToken", T.StringType()),
        T.StructField(
            "ResultsByTime",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "TimePeriod",
                            T.StructType([T.StructField("Start", T.StringType()), T.StructField("End", T.StringType())]),
                        ),
                        T.StructField(
                            "Groups",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("Keys", T.ArrayType(T.StringType())),
                                        T.StructField(
                                            "Metrics",
                                            T.StructType(
                                                [
                                                    T.StructField(
                                                        "UnblendedCost",
                                                        T.StructType([T.StructField("Amount", T.StringType())]),
                                                    )
                                                ]
                                            ),
                                        ),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)

ACCOUNT_IN_PATH = r"(?:^|/)account=([^/]+)(?:/|$)"
REQUEST_IN_PATH = r"^(.*/request=[^/]+)/"


SEQ = "seq"


def page_columns() -> list[Column]:
    """What ``flatten_pages`` and the chains read of a page."""
    # The path's text is that of a URI; a plus sign is one there.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    tokens = [F.when(F.col(c) != "", F.col(c)).alias(n) for c, n in (("PageToken", "_token"), ("NextPageToken", "_next"))]
    return [F.col("ResultsByTime"), *tokens, path.alias("_path"), F.col("_metadata.file_modification_time").alias("_time")]


def page_reader(reader):
    """A batch or stream reader of pages that fails on a file it can't parse."""
    return reader.schema(PAGE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of a landing folder, one row each."""
    return page_reader(spark.read).json(path).select(*page_columns())


def _account(account: str | None) -> Column:
    if account is not None:
        return F.lit(account)
    found = F.regexp_extract(F.col("_path"), ACCOUNT_IN_PATH, 1)
    return F.when(found != "", found)


def _request() -> Column:
    named = F.regexp_extract(F.col("_path"), REQUEST_IN_PATH, 1)
    folder = F.regexp_extract(F.col("_path"), "^(.*)/[^/]*$", 1)
    alone = F.col("_token").isNull() & F.col("_next").isNull()
    return F.when(named != "", named).when(alone, F.col("_path")).otherwise(folder)


def chain_faults(pages: DataFrame) -> DataFrame:
    """(request, fault, detail) of requests whose pages are no single whole chain.

    Fixed values: ``no_first`` and ``two_firsts`` (pages asked for without a
    token), ``no_end`` and ``two_ends`` (pages that name no other),
    ``doubled_page`` (a token asked for twice) with the token,
    ``missing_page`` (named, but not there) and ``unasked_page`` (there, but
    not named), each with the token, and ``cycle`` with the number of pages
    that the first page does not lead to.
    """
    p = pages.select(_request().alias("request"), "_token", "_next")
    none = F.lit(None).cast("string")
    firsts, ends = F.count_if(F.col("_token").isNull()), F.count_if(F.col("_next").isNull())
    shape = p.groupBy("request").agg(firsts.alias("f"), ends.alias("e"))
    names = F.array(
        F.when(F.col("f") == 0, "no_first").when(F.col("f") > 1, "two_firsts"),
        F.when(F.col("e") == 0, "no_end").when(F.col("e") > 1, "two_ends"),
    )
    out = shape.select("request", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("fault"), none.alias("detail"))
    asked = p.where("_token IS NOT NULL").groupBy("request", "_token").count()
    named = p.where("_next IS NOT NULL").select("request", F.col("_next").alias("_token")).distinct()
    by = ["request", "_token"]
    out = out.unionByName(asked.where("count > 1").select("request", F.lit("doubled_page").alias("fault"), F.col("_token").alias("detail")))
    out = out.unionByName(named.join(asked, by, "left_anti").select("request", F.lit("missing_page").alias("fault"), F.col("_token").alias("detail")))
    out = out.unionByName(asked.join(named, by, "left_anti").select("request", F.lit("unasked_page").alias("fault"), F.col("_token").alias("detail")))
    # Only pages that all else says nothing against can go round in a circle.
    placed = _places(p.join(out.select("request").distinct(), "request", "left_anti"))
    lost = placed.where("_before IS NOT NULL").groupBy("request").count()
    return out.unionByName(lost.select("request", F.lit("cycle").alias("fault"), F.col("count").cast("string").alias("detail")))


def _places(pages: DataFrame) -> DataFrame:
    """(request, _node, _place, _before): the places of the pages by pointer jumping.

    Every page points to the one before it and knows the number of steps to
    where it points; a round replaces the pointer by the pointer's pointer, so
    a chain of n pages takes log2(n) rounds of an equi-join. A page that still
    points somewhere then is on a circle, or behind one.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    node = F.coalesce("_token", F.lit(""))
    named = pages.where("_next IS NOT NULL").select("request", F.col("_next").alias("_node"), node.alias("_before"))
    state = pages.select("request", node.alias("_node")).join(named, ["request", "_node"], "left")
    state = state.select("request", "_node", "_before", F.col("_before").isNotNull().cast("bigint").alias("_place")).checkpoint()
    longest = state.groupBy("request").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(0, longest - 1).bit_length()):  # each round's rows are written, so that a plan never holds two rounds
        to = state.select("request", F.col("_node").alias("_before"), F.col("_before").alias("_further"), F.col("_place").alias("_more"))
        state = state.join(to, ["request", "_before"], "left").select(
            "request", "_node", F.col("_further").alias("_before"), (F.col("_place") + F.coalesce("_more", F.lit(0))).alias("_place")
        ).checkpoint()
    return state


def in_chain_order(pages: DataFrame) -> DataFrame:
    """``pages`` with ``_request``, its time (the first page's) and ``_place``; the chains must be whole."""
    p = pages.withColumn("_request", _request())
    places = _places(p.select(F.col("_request").alias("request"), "_token", "_next"))
    times = p.groupBy(F.col("_request").alias("request")).agg(F.min("_time").alias("_request_time"))
    found = places.select(F.col("request").alias("_request"), F.col("_node"), "_place").join(times.withColumnRenamed("request", "_request"), "_request")
    return p.withColumn("_node", F.coalesce("_token", F.lit(""))).join(found, ["_request", "_node"]).drop("_node")


def _must(value: Column, kind: T.DataType, what: str) -> Column:
    """The value, or an error that names the page."""
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"page with {what}: "), F.col("_path"))).cast(kind))


def flatten_pages(pages: DataFrame, account: str | None = None) -> DataFrame:
    """Pages (``page_columns``) -> (date, account, service, amount, seq).

    ``seq`` is the arrival order: the file's time, its path, then the places
    of the day and the group in the page; of pages ``in_chain_order``, the
    request's time and the page's place in it. A page without
    ``ResultsByTime``, a day without its start or ``Groups``, and a group
    without a key or an amount are errors, as costs would be missing without a
    trace. An empty list of groups is a day without costs.
    """
    order = ["_request_time", "_request", "_place"] if "_place" in pages.columns else ["_time", "_path"]
    carried = list(dict.fromkeys(["_path", *order]))
    results = PAGE_SCHEMA["ResultsByTime"].dataType
    text, groups_type = T.StringType(), results.elementType["Groups"].dataType
    days = pages.select(
        _account(account).alias("account"), *carried,
        F.posexplode(_must(F.col("ResultsByTime"), results, "no ResultsByTime")).alias("_day", "d"),
    )
    start = F.col("d.TimePeriod.Start")
    # The start is asked for here, as a day without groups has no row below.
    dated = F.when(_must(start, text, "a day that has no start").isNotNull(), _must(F.col("d.Groups"), groups_type, "a day that has no Groups"))
    groups = days.select("account", *carried, "_day", start.alias("start"), F.posexplode(dated).alias("_group", "g"))
    keys = F.col("g.Keys")
    return groups.select(
        F.to_date("start").alias("date"),
        "account",
        _must(F.when(F.size(keys) > 0, F.element_at(keys, 1)), text, "a group that has no key").alias("service"),
        _must(F.col("g.Metrics.UnblendedCost.Amount"), text, "a group that has no amount").cast("double").alias("amount"),
        F.struct(*order, "_day", "_group").alias(SEQ),
    )


def read_cost_pages(spark: SparkSession, path: str, account: str | None = None) -> DataFrame:
    """The cost lines of a landing folder, each request's pages in their order.

    Fails if a request's pages are no whole chain."""
    pages = read_pages(spark, path)
    broken = chain_faults(pages).orderBy("request", "fault", "detail").limit(5).collect()
    if broken:
        raise ValueError("cost pages incomplete: " + "; ".join(f"{r['fault']} {r['detail'] or ''} in {r['request']}" for r in broken))
    return flatten_pages(in_chain_order(pages), account)
