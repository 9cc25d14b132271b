"""Deployment settings: which stores exist and what their brand words are.

The names of a business (store ids, display labels, brand search words) are
data of a deployment, not of this library.  They come from here, usually out of
a JSON file, and every model and metric name that contains a store id is
derived from them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Store:
    store_id: str
    label: str


@dataclass(frozen=True)
class Settings:
    """Stores in union order; the first one is the primary store.

    ``refund_stores`` and ``web_stores`` name the stores for which refund and
    web-analytics exports exist; stores left out simply have none (their net
    sales then carry no returns).  ``labels`` adds display names for store ids
    that are not loaded yet.
    """

    stores: tuple[Store, ...] = (Store("alpha", "Alpha Store"), Store("beta", "Beta Store"))
    refund_stores: tuple[str, ...] = ("alpha",)
    web_stores: tuple[str, ...] = ("alpha",)
    search_store: str = "alpha"
    brand_terms: tuple[str, ...] = ()
    labels: dict[str, str] = field(default_factory=dict)
    demo_ledger: str = "CRMPRODTOUR"

    @property
    def primary(self) -> Store:
        return self.stores[0]

    @property
    def store_ids(self) -> tuple[str, ...]:
        return tuple(s.store_id for s in self.stores)

    def display_labels(self) -> dict[str, str]:
        return {**{s.store_id: s.label for s in self.stores}, **self.labels}

    @classmethod
    def from_json(cls, path: str) -> "Settings":
        with open(path, encoding="utf-8") as fh:
            raw = json.load(fh)
        stores = tuple(Store(**s) for s in raw.pop("stores"))
        for key in ("refund_stores", "web_stores", "brand_terms"):
            if key in raw:
                raw[key] = tuple(raw[key])
        return cls(stores=stores, **raw)
