"""Default settings. The numbers are fixed values: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass

REQUIRED_COLUMNS = ("asin", "title", "price")
MIN_VALID_PRICE = 1.0


@dataclass(frozen=True)
class CleaningOptions:
    """Switches of the cleaning job; every step can be turned off on its own."""

    columns_to_clean: tuple[str, ...] = ("title",)
    remove_duplicates: bool = True
    handle_missing: bool = True
    normalize_text: bool = True
    remove_special_chars: bool = True


@dataclass(frozen=True)
class EmbeddingTextOptions:
    text_column: str = "title"
    max_tokens: int = 512
    add_category: bool = True


@dataclass(frozen=True)
class StoreSearchOptions:
    """Settings of the storefront search (over-fetch, filter, category match)."""

    top_k: int = 10
    fetch_multiplier: int = 200
    category_multiplier: int = 5
    price_min: float = 0.0
    price_max: float = 10000.0
    min_rating: float | None = None
    bestsellers_only: bool = False
    min_valid_price: float = MIN_VALID_PRICE


@dataclass(frozen=True)
class HybridWeights:
    relevance: float = 0.5
    rating: float = 0.3
    price: float = 0.2


@dataclass(frozen=True)
class RankedSearchOptions:
    """Settings of the re-ranked search."""

    top_k: int = 50
    fetch_multiplier: int = 3
    method: str = "hybrid"
    weights: HybridWeights = HybridWeights()


@dataclass(frozen=True)
class IvfOptions:
    cells: int = 100
    probes: int = 10
    metric: str = "l2"
    iterations: int = 20
    train_rows: int | None = None
    seed: int = 42


@dataclass(frozen=True)
class IvfTreeOptions:
    """A tree of cells; ``branches`` are the centroids of the first level and those under each of the next."""

    branches: tuple[int, ...] = (100, 100)
    probes: int = 32
    beam: int = 8
    metric: str = "l2"
    iterations: int = 10
    train_rows: int | None = None
    rows_per_centre: int = 64
    seed: int = 42

    def flat(self, cells: int) -> IvfOptions:
        return IvfOptions(cells, self.probes, self.metric, self.iterations, self.train_rows, self.seed)


@dataclass(frozen=True)
class PqOptions:
    subspaces: int = 8
    bits: int = 8
    iterations: int = 10
    train_rows: int | None = None
    seed: int = 42


@dataclass(frozen=True)
class LshOptions:
    tables: int = 8
    bucket_length: float = 0.5
    seed: int = 42


LINES_TOP_K = 5
ENCODER_BATCH = 32
EMBEDDING_COLUMN = "embedding_text"
