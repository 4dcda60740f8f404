"""User-supplied classifiers, connectors and providers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from lodestack.scratch import ship


def score_votes(items: DataFrame, text_col: str, voters: dict[str, Callable[[list], list]], batch: int = 64) -> DataFrame:
    """(item_id, voter_id, status, label): every voter on every item, in batches inside tasks.

    A voter that raises fails the items of that batch only; the failure becomes a vote.
    """
    ship(items.sparkSession)

    def run(frames):
        for pdf in frames:
            for voter, f in voters.items():
                for at in range(0, len(pdf), batch):
                    part = pdf.iloc[at : at + batch]
                    try:
                        labels, status = list(f(part["text"].tolist())), "succeeded"
                    except Exception:
                        labels, status = [None] * len(part), "error"
                    yield pd.DataFrame({"item_id": part["item_id"], "voter_id": voter, "status": status, "label": pd.Series(labels, index=part.index, dtype=object)})

    return items.selectExpr("item_id", f"`{text_col}` AS text").mapInPandas(run, "item_id long, voter_id string, status string, label string")


class Registry:
    """Named plug-ins; a name is taken once."""

    def __init__(self, kind: str):
        self.kind, self.entries = kind, {}

    def register(self, name: str, f: Callable) -> None:
        if not name or name in self.entries:
            raise ValueError(f"{self.kind} name {name!r} is blank or taken")
        self.entries[name] = f

    def apply(self, name: str, *args):
        return self.entries[name](*args)


#: name -> reader returning candidate rows; name -> payload normaliser returning record rows.
providers, connectors = Registry("provider"), Registry("connector")
