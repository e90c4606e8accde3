"""The searches: a table of free-text queries in, ranked products out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import query_text as q
from shelfmark.operators import blocks, filters
from shelfmark.operators.categories import filter_category, with_category_keywords
from shelfmark.operators.filtered import STORE_RULE, MatchRule, nearest_matching
from shelfmark.operators.ivf import search_cells
from shelfmark.operators.knn import ITEM, PROBE, QUERY, VECTOR, attach_products, nearest
from shelfmark.operators.ranking import rank
from shelfmark.operators.results import result_lines, result_rows, with_labels
from shelfmark.options import (
    LINES_TOP_K,
    HybridWeights,
    IvfOptions,
    RankedSearchOptions,
    StoreSearchOptions,
)
from shelfmark.sources.workspace import new_folder

TextEncoder = Callable[[DataFrame, str], DataFrame]
Searcher = Callable[[DataFrame, int], DataFrame]

FILTERED = ("price", "stars", "isBestSeller")  # what the storefront's filters ask for
NARROW_ROWS = 2_000_000  # of these columns or of the searches' conditions, that may go to every task


def flat_index(vectors: DataFrame, metric: str = "l2") -> Searcher:
    """Exact search over all vectors, with the index's probe part if it has one."""
    probe = vectors.where(F.col(PROBE) == 1) if PROBE in vectors.columns else None
    return lambda queries, k: nearest(queries, vectors, k, metric, probe=probe)


def ivf_index(
    cell_vectors: DataFrame,
    centroids: DataFrame,
    probes: int = IvfOptions.probes,
    metric: str = "l2",
) -> Searcher:
    """Search in the ``probes`` nearest cells of every query.

    ``sources.indexes.stored_probes`` gives the number an index was saved with.
    """
    return lambda queries, k: search_cells(queries, cell_vectors, centroids, k, probes, metric)


def matching_index(vectors: DataFrame, metric: str = "l2", rule: MatchRule = STORE_RULE) -> Searcher:
    """Exact search among the products that pass a search's filters (``sources.indexes.write_matching``).

    Give it to a search with ``filter_first``.
    """
    return lambda queries, k: nearest_matching(queries, vectors, k, metric, rule)


def parsed_prices(searches: DataFrame) -> DataFrame:
    """Add price bounds and the remaining text of every search."""
    low, high, rest = q.price_bounds(F.col("query_text"))
    return searches.withColumns({"min_price": low, "max_price": high, "cleaned_query": rest})


def with_defaults(parsed: DataFrame, options: StoreSearchOptions) -> DataFrame:
    """Bounds from the text win over the caller's, each side on its own.

    The caller's values are the columns ``price_min``, ``price_max``,
    ``min_rating`` and ``bestsellers_only`` where the table has them, else the
    options.
    """

    def given(name: str, value: object, kind: str):
        default = F.lit(value).cast(kind)
        return F.coalesce(F.col(name), default) if name in parsed.columns else default

    return parsed.withColumns(
        {
            "min_price": F.coalesce("min_price", given("price_min", options.price_min, "double")),
            "max_price": F.coalesce("max_price", given("price_max", options.price_max, "double")),
            "min_rating": given("min_rating", options.min_rating, "double"),
            "bestsellers_only": given("bestsellers_only", options.bestsellers_only, "boolean"),
        }
    )


def extracted_filters(searches: DataFrame) -> DataFrame:
    """Add the normalised text and the filters named in it, NULL if absent."""
    text = F.col("query_text")
    low, high = q.range_bounds(text)
    return searches.withColumns(
        {
            "processed_query": q.normalize_query(text),
            "min_price": low,
            "max_price": high,
            "brand_hint": q.brand_hint(text),
            "min_rating": q.rating_hint(text),
        }
    )


def _vectors_of(asked: DataFrame, text: str, encode: TextEncoder | None) -> DataFrame:
    if encode is not None:
        # written once: a search reads its queries several times
        spark = asked.sparkSession
        path = new_folder(spark, "encoded-searches")
        # very many may lie in one narrow file: all cores encode them, and scan what each has written
        texts = asked.select(QUERY, text).repartition(spark.sparkContext.defaultParallelism)
        encode(texts, text).select(QUERY, VECTOR).write.parquet(path)
        return spark.read.parquet(path)
    if VECTOR not in asked.columns:
        raise ValueError("searches need an embedding column or an encoder")
    return asked.select(QUERY, VECTOR)


def candidates(
    asked: DataFrame,
    searches: int,
    text: str,
    products: DataFrame,
    index: Searcher,
    fetch: int,
    encode: TextEncoder | None,
    conditions: Sequence[str] = (),
) -> DataFrame:
    """The ``fetch`` nearest products of all ``searches``, with their attributes.

    ``conditions`` are columns of the searches that the index is given, too.
    """
    queries = _vectors_of(asked, text, encode)
    if conditions:
        queries = queries.join(asked.select(QUERY, *conditions), QUERY)
    few = searches <= min(blocks.HINTED_PAIRS // fetch, blocks.SIDE_ROWS)
    return attach_products(index(queries, fetch), products, few)


def join_searches(found: DataFrame, asked: DataFrame, few: bool, *columns: str) -> DataFrame:
    """Add columns of the search to its candidates; ``few`` searches are broadcast."""
    side = asked.select(QUERY, *columns)
    return found.join(F.broadcast(side) if few else side, QUERY)


def count_searches(searches: DataFrame) -> int:
    """How many searches there are, counted up to the size of a broadcast side."""
    return blocks.rows_up_to(searches, QUERY, blocks.SIDE_ROWS)


def store_search(
    searches: DataFrame,
    products: DataFrame,
    index: Searcher,
    taxonomy: DataFrame,
    options: StoreSearchOptions = StoreSearchOptions(),
    encode: TextEncoder | None = None,
    filter_first: bool = False,
) -> DataFrame:
    """Storefront search.

    Read prices from the text, fetch many candidates, filter by attributes,
    keep a few times ``top_k``, prefer products of the category named in the
    text, and return the first ``top_k`` with display columns.

    With ``filter_first`` the index filters (``matching_index``): the candidates
    are the nearest products that pass, and none is lost behind a cut.
    """
    asked = with_defaults(parsed_prices(searches), options)
    count = count_searches(searches)
    few = count <= blocks.SIDE_ROWS
    kept = options.category_multiplier * options.top_k
    conditions = ("min_price", "max_price", "min_rating", "bestsellers_only")
    if filter_first:
        found = candidates(asked, count, "cleaned_query", products, index, kept, encode, conditions)
    else:

        lean = blocks.fits(asked, QUERY, NARROW_ROWS)

        def closest(found: DataFrame) -> DataFrame:
            found = join_searches(found, asked, lean, *conditions)
            found = filters.valid_price(found, options.min_valid_price)
            found = filters.price_between(found)
            found = filters.rating_at_least(found)
            found = filters.bestsellers(found)
            return rank(found, "distance", kept).drop("rank")

        fetch = options.fetch_multiplier * options.top_k
        found = index(_vectors_of(asked, "cleaned_query", encode), fetch)
        # of many candidates few are left: they meet just what filters ask for, and the survivors all attributes
        narrow = products.select(ITEM, *[name for name in FILTERED if name in products.columns])
        names = found.columns
        if blocks.fits(narrow, ITEM, NARROW_ROWS):
            narrow = F.broadcast(narrow)
        left = closest(found.join(narrow, ITEM)).select(*names).dropDuplicates([QUERY, ITEM])
        small = count <= min(blocks.HINTED_PAIRS // kept, blocks.SIDE_ROWS)
        found = closest(attach_products(left, products, small))
    named = with_category_keywords(searches.select(QUERY, "query_text"), taxonomy)
    found = join_searches(found, named, few, "primary_keywords", "secondary_keywords")
    found = rank(filter_category(found), "category", options.top_k)
    return result_rows(found, options.min_valid_price, "rank")


def ranked_search(
    searches: DataFrame,
    products: DataFrame,
    index: Searcher,
    options: RankedSearchOptions = RankedSearchOptions(),
    encode: TextEncoder | None = None,
    given_filters: bool = False,
    filter_first: bool = False,
) -> DataFrame:
    """Re-ranked search: nearest products, filtered, then ordered by ``method``.

    Filters come from the text, unless ``given_filters`` says that the table
    carries them: ``min_price, max_price, min_rating, brand_hint``. With
    ``filter_first`` the index filters, by the ``RANKED_RULE``.
    """
    asked = extracted_filters(searches)
    names = ["min_price", "max_price", "brand_hint", "min_rating"]
    if given_filters:
        text = F.col("query_text")
        asked = searches.withColumn("processed_query", q.normalize_query(text))
        names = [name for name in names if name in searches.columns]
    count = count_searches(searches)
    fetch = options.fetch_multiplier * options.top_k
    if filter_first:
        found = candidates(asked, count, "processed_query", products, index, fetch, encode, names)
        return with_labels(rank(found, options.method, options.top_k, options.weights))
    found = candidates(asked, count, "processed_query", products, index, fetch, encode)
    found = join_searches(found, asked, count <= blocks.SIDE_ROWS, *names)
    if {"min_price", "max_price"} <= set(names):
        found = filters.price_between(found)
    if "brand_hint" in names:
        found = filters.brand_contains(found)
    if "min_rating" in names:
        found = filters.rating_at_least(found, zero_is_off=False)
    found = rank(found.drop(*names), options.method, options.top_k, options.weights)
    return with_labels(found)


def search_lines(
    searches: DataFrame,
    products: DataFrame,
    index: Searcher,
    top_k: int = LINES_TOP_K,
    include_details: bool = True,
    weights: HybridWeights = HybridWeights(),
    encode: TextEncoder | None = None,
) -> DataFrame:
    """Results as lines of text.

    Filters are only those the caller gives in ``price_min``, ``price_max`` and
    ``min_rating``; prices count when both bounds are there. The text is not
    searched for filters.
    """

    def given(name: str):
        return F.col(name) if name in searches.columns else F.lit(None)

    both = given("price_min").isNotNull() & given("price_max").isNotNull()
    asked = searches.withColumns(
        {
            "min_price": F.when(both, given("price_min")).cast("double"),
            "max_price": F.when(both, given("price_max")).cast("double"),
            "min_rating": given("min_rating").cast("double"),
        }
    )
    options = RankedSearchOptions(top_k=top_k, weights=weights)
    found = ranked_search(asked, products, index, options, encode, given_filters=True)
    return result_lines(found, include_details)
