"""All queries of this package; importing it registers them."""

from rowwarden.llm import (  # noqa: F401
    attribution,
    centroids,
    decontaminate,
    html,
    language,
    lattice,
    packing,
    pieces,
    quality,
    resampling,
    simhash,
    toxicity,
    urls,
)
from rowwarden.llm.base import ORACLES, QUERIES  # noqa: F401
