"""Discovery runs under several limits at once: one ordered pass over each run's searches and hits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outing.functions import text
from outing.model import SETTINGS

_DECISIONS = "run_id long, n int, search int, url string, title string, decision string, reason string, event_id long"
_RUNS = "run_id long, searches int, pages int, events int, stop_reason string"


@dataclass
class _Run:
    """What a run has used so far; bounded by its limits, whatever the hits."""

    run_id: int
    settings: object
    searches: int = 0
    pages: int = 0
    events: int = 0
    seconds: float = 0.0
    n: int = 0
    over: bool = False
    search: int | None = None
    seen: set = field(default_factory=set)
    opened: dict = field(default_factory=dict)
    refused: set = field(default_factory=set)

    def stop(self) -> str | None:
        s = self.settings
        if self.events >= s.most_events:
            return f"saved {self.events} events (limit {s.most_events})"
        if self.pages >= s.most_pages:
            return f"opened {self.pages} pages (limit {s.most_pages})"
        if self.seconds >= s.most_seconds:
            return f"ran for {s.most_seconds // 60} minutes (time limit)"
        return None

    def begins(self, search: int) -> bool:
        """Count a search as its first hit arrives; False if the run is over."""
        if not self.over and search != self.search:
            self.over = self.searches >= self.settings.most_searches or self.stop() is not None
            if not self.over:
                self.searches, self.search = self.searches + 1, search
        return not self.over

    def reason(self) -> str:
        stop = self.stop()
        if stop is None and self.searches >= self.settings.most_searches:
            return f"used {self.searches} searches (limit {self.settings.most_searches})"
        return stop or "no more queries"

    def decide(self, hit) -> Iterator[tuple]:
        """(url, title, decision, reason, event_id) of a hit and the events on its page."""
        host, limit = hit.host or "", self.settings.per_domain
        told = lambda decision, reason, event=None: (hit.address, hit.title, decision, reason, event)
        if hit.blocked is not None:
            yield told("skipped", f"{host}: {hit.blocked}")
        elif host in self.refused:
            yield told("skipped", "this site refused automated access earlier in the run")
        elif self.opened.get(host, 0) >= limit:
            yield told("skipped", f"already opened {limit} pages from {host} this run")
        elif not pd.isna(hit.known_event):
            yield told("known", "already listed", int(hit.known_event))
        else:
            self.pages += 1
            self.opened[host] = self.opened.get(host, 0) + 1
            if hit.refused:
                self.refused.add(host)
            if hit.failed is not None:
                yield told("error" if hit.fault else "skipped", hit.failed)
                return
            for e in hit.events if hit.events is not None else ():
                if self.stop() is not None:
                    return
                known = e["known_event"]
                if not e["accept"]:
                    yield e["url"], e["title"], "skipped", e["reason"], None
                elif known is not None and not pd.isna(known):
                    yield e["url"], e["title"], "known", "already listed", int(known)
                else:
                    self.events += 1
                    decision = "merged" if e["merged"] else "saved"
                    more = "; merged with an existing listing" if e["merged"] else ""
                    saved = e["event_id"]
                    yield e["url"], e["title"], decision, e["reason"] + more, None if saved is None or pd.isna(saved) else int(saved)

    def take(self, hit) -> Iterator[tuple]:
        if not self.begins(hit.search) or hit.address is None:
            return
        self.seconds = max(self.seconds, hit.seconds)
        if self.stop() is not None or hit.address in self.seen:
            return
        self.seen.add(hit.address)
        for row in self.decide(hit):
            self.n += 1
            yield (self.run_id, self.n, hit.search, *row)


def discovery_runs(hits: DataFrame, settings=SETTINGS) -> tuple[DataFrame, DataFrame]:
    """(decisions, runs) of discovery runs under limits of searches, pages, events, pages of a host and seconds; the
    first limit that is reached ends a run.

    `hits` has a row for each result: run_id, search (the place of its query in the run), place (among the query's
    results), url, title, seconds (since the run began, when the hit is reached), known_event (of the URL), refused and
    failed (what opening the page gives: whether its site forbids it, and why there is nothing, null if there is),
    fault (whether that is an error), and events: array of structs url, title, accept, reason, known_event, merged,
    event_id, in the order of the page. A search without results has one row with a null url. A URL counts once in a
    run, whatever its fragment. Null flags are false, null times 0.

    Hits are dealt by run and sorted outside of Python; a task keeps one run's limits at a time, so a run may have any
    number of hits.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    address = F.substring_index("url", "#", 1).alias("address")
    rows = hits.select(
        "run_id", "search", "place", address, "title", F.coalesce(F.col("seconds").cast("double"), F.lit(0.0)).alias("seconds"), "known_event", flag("refused"), "failed",
        flag("fault"), "events", F.coalesce(text.host_of(F.col("url")), F.lit("")).alias("host"), text.blocked_reason(F.col("url")).alias("blocked"),
    )
    # the same order for both results; ties by URL
    dealt = rows.repartition("run_id").sortWithinPartitions("run_id", "search", "place", "address")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[_Run | None, list[tuple]]]:
        run, out = None, []
        for pdf in frames:
            for hit in pdf.itertuples(index=False):
                if run is None or hit.run_id != run.run_id:
                    if run is not None:
                        yield run, out
                    run, out = _Run(int(hit.run_id), settings), []
                out += run.take(hit)
                if len(out) > 1000:
                    yield None, out
                    out = []
        if run is not None:
            yield run, out

    def decisions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _DECISIONS.split(", ")]
        for _, out in each(_plain(frames)):
            yield pd.DataFrame(out, columns=names).astype({"event_id": "Int64"})

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _RUNS.split(", ")]
        for run, _ in each(_plain(frames)):
            if run is not None:
                yield pd.DataFrame([(run.run_id, run.searches, run.pages, run.events, run.reason())], columns=names)

    return dealt.mapInPandas(decisions, _DECISIONS), dealt.mapInPandas(runs, _RUNS)


def _plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames whose missing texts are None."""
    for pdf in frames:
        for c in ("address", "title", "failed", "blocked", "events"):
            pdf[c] = pdf[c].astype(object).where(pdf[c].notna(), None)
        yield pdf
