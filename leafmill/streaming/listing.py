"""Listings as a stream: what each scroll step of a paged list shows becomes the cards seen for the first time.

A step is a row (STEP_DDL); steps of one listing are numbered without gaps and may arrive in any order, in any batch, and again. State is
kept for each listing: the ids seen and the steps that wait for an earlier one, each under its own key in the state store, and a few
counters. A listing is followed in order, so it is one key's work; listings run side by side.

Rules: ids seen before are passed over. A page is left when STAGNANT steps in a row brought nothing new and the last was at the bottom,
or after MOST_STEPS; its later steps are ignored. A listing stops (a row with the event `all_seen`, `exhausted` or `limit`) when the
first step of a further page shows only ids seen before, when two pages in a row brought nothing, or when `limit` cards were given out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STAGNANT, MOST_STEPS = 3, 18
_CARDS = "cards array<struct<covidence_id: string, label: string>>"
STEP_DDL = f"listing string, seq long, page int, at_bottom boolean, {_CARDS}"
FOUND_DDL = "listing string, seq long, page int, event string, covidence_id string, label string"
#: What a session needs for state under many keys.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class ListingLoop(StatefulProcessor):
    def __init__(self, only: Sequence[str] = (), limit: int = 0) -> None:
        self.only, self.limit = frozenset(i.strip() for i in only if i.strip()), limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "seq long")
        self.waiting = handle.getMapState("waiting", "seq long", f"page int, at_bottom boolean, {_CARDS}")
        # next step; current page, its steps, its new cards, steps in a row without any; pages in a row without any; cards given out; whether the page and the listing are left
        self.loop = handle.getValueState("loop", "next long, page int, steps int, fresh int, stagnant int, barren int, given long, left boolean, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of Spark's interface
        at = dict(zip(("next", "page", "steps", "fresh", "stagnant", "barren", "given", "left", "stopped"), self.loop.get() if self.loop.exists() else (0, -1, 0, 0, 0, 0, 0, False, False), strict=True))
        for pdf in rows:
            for r in pdf.itertuples():
                if r.seq >= at["next"] and not at["stopped"]:
                    cards = [(c["covidence_id"], c["label"]) for c in (r.cards if r.cards is not None else [])]
                    self.waiting.updateValue((int(r.seq),), (int(r.page), bool(r.at_bottom), cards))
        out: list[tuple] = []
        while not at["stopped"] and self.waiting.containsKey((at["next"],)):
            page, bottom, cards = self.waiting.getValue((at["next"],))
            self.waiting.removeKey((at["next"],))
            out += [(key[0], at["next"], page, *x) for x in self.step(at, page, bottom, [tuple(c) for c in cards])]
            at["next"] += 1
        if at["stopped"]:
            self.waiting.clear()
        self.loop.update(tuple(at.values()))
        yield pd.DataFrame(out, columns=["listing", "seq", "page", "event", "covidence_id", "label"])

    def step(self, at: dict, page: int, bottom: bool, cards: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
        """(event, id, label) of one step; changes the counters in `at`."""

        def stop(why: str) -> tuple[str, str, str]:
            at["stopped"] = True
            return why, "", ""

        if page != at["page"]:
            if at["page"] >= 0:
                at["barren"] = 0 if at["fresh"] else at["barren"] + 1
                if at["barren"] >= 2:
                    yield stop("exhausted")
                    return
                if cards and all(self.seen.containsKey((i,)) for i, _ in cards):
                    yield stop("all_seen")
                    return
            at |= {"page": page, "steps": 0, "fresh": 0, "stagnant": 0, "left": False}
        if at["left"]:
            return
        new = 0
        for i, label in cards:
            if self.seen.containsKey((i,)):
                continue
            new += 1
            if not self.only or i in self.only:
                if self.limit and at["given"] >= self.limit:
                    yield stop("limit")
                    return
                at["given"] += 1
                yield "card", i, label
            self.seen.updateValue((i,), (at["next"],))
        at["steps"] += 1
        at["fresh"] += new
        at["stagnant"] = 0 if new else at["stagnant"] + 1
        at["left"] = (at["stagnant"] >= STAGNANT and bottom) or at["steps"] >= MOST_STEPS

    def close(self) -> None:
        pass


def follow(steps: DataFrame, only: Sequence[str] = (), limit: int = 0) -> DataFrame:
    """Cards seen for the first time, and stops, of a stream of steps; the session has STATE_CONF set."""
    return steps.groupBy("listing").transformWithStateInPandas(ListingLoop(only, limit), FOUND_DDL, "Append", "None")
