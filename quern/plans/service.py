"""Request validation, completeness and verdicts around result frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.names import leaf, normal_path
from quern.operators import gramindex, rank, text, traverse
from quern.sources.staging import stage

#: Public operations and the filters each takes.
OPERATIONS = {"search": {"pattern", "file", "kind", "limit"}, "trace": {"symbol", "to_symbol", "relation", "kind"}, "source": {"file", "line", "line_end"}}
#: Fixed value: how many hops a trace to another symbol takes at most.
TRACE_DEPTH = 5


@dataclass
class Request:
    operation: str
    filters: dict = field(default_factory=dict)
    limit: int = 20
    cursor: str | None = None

    def checked(self) -> Request:
        """Drop unknown filters where a known one is left; otherwise refuse."""
        if self.operation not in OPERATIONS:
            raise ValueError(f"INVALID_QUERY: operations are {', '.join(OPERATIONS)}")
        known = {k: v for k, v in self.filters.items() if k in OPERATIONS[self.operation] and v not in (None, "")}
        if not known:
            raise ValueError(f"INVALID_QUERY: filters are {', '.join(sorted(OPERATIONS[self.operation]))}")
        return Request(self.operation, known, max(1, min(32, self.limit)), self.cursor)

    def fingerprint(self) -> str:
        return rank.fingerprint({"operation": self.operation, "filters": self.filters, "limit": self.limit})


def planned(tables: dict[str, DataFrame], request: Request) -> DataFrame:
    """The frame that answers a request over ``lines``, ``symbols`` and ``edges``.

    A search is over lines, or over symbols where it names their kind; a trace is over
    symbols, and a source request over the lines of one file.
    """
    asked = request.checked()
    return {"search": _search, "trace": _trace, "source": _source}[asked.operation](tables, asked.filters, asked.limit)


def _need(filters: dict, *keys: str) -> None:
    missing = [k for k in keys if k not in filters]
    if missing:
        raise ValueError(f"INVALID_QUERY: {', '.join(missing)} not given")


def _search(tables: dict[str, DataFrame], filters: dict, limit: int) -> DataFrame:
    _need(filters, "pattern")
    if "kind" not in filters:
        found = gramindex.search(tables["lines"], tables.get("grams"), filters["pattern"], filters.get("file"))
        return text.search(found, filters["pattern"], limit)
    tier = rank.match_tier(F.col("name"), F.col("id"), F.col("kind"), filters["pattern"])
    return tables["symbols"].where(F.col("kind") == filters["kind"]).withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", "id").limit(limit)


def _named(symbols: DataFrame, name: str, kind: str | None) -> DataFrame:
    same = (F.col("name") == name) | (leaf(F.col("name")) == name)
    return symbols.where(same & (F.col("kind") == kind) if kind else same).select("id")


def _trace(tables: dict[str, DataFrame], filters: dict, limit: int) -> DataFrame:
    """Edges of the named symbols with their direction, or the first shortest path from them to each symbol of the other name."""
    _need(filters, "symbol")
    edges = tables["edges"].where(F.col("kind") == filters["relation"]) if "relation" in filters else tables["edges"]
    # Staged, so that the few symbols of a name meet the edges where these lie.
    seeds = stage(_named(tables["symbols"], filters["symbol"], filters.get("kind")), "seeds")
    if "to_symbol" in filters:
        return traverse.shortest_paths(seeds, edges, TRACE_DEPTH).join(_named(tables["symbols"], filters["to_symbol"], None), "id", "left_semi")
    out = edges.join(seeds.withColumnRenamed("id", "src"), "src", "left_semi").withColumns({"id": F.col("dst"), "direction": F.lit("out")})
    into = edges.join(seeds.withColumnRenamed("id", "dst"), "dst", "left_semi").withColumns({"id": F.col("src"), "direction": F.lit("in")})
    return out.unionByName(into)


def _source(tables: dict[str, DataFrame], filters: dict, limit: int) -> DataFrame:
    _need(filters, "file", "line")
    first = int(filters["line"])
    inside = F.col("line").between(first, int(filters.get("line_end", first)))
    return tables["lines"].where((F.col("path") == normal_path(F.lit(filters["file"]))) & inside)


@dataclass
class Answer:
    rows: list
    total: int
    next_cursor: str | None
    verdict: str


def verdict(operation: str, completeness: str, truncated: bool) -> str:
    if operation in ("search", "find"):
        return "ANSWERED"
    if completeness == "UNKNOWN":
        return "UNKNOWN"
    if completeness in ("INCOMPLETE", "AMBIGUOUS") or truncated:
        return "PARTIAL"
    return "ANSWERED"


def completeness(seeds: int, producers: int, located: int, transport: str | None, consumers: int, sinks: int, control: bool, same_arch: bool = True) -> tuple[str, list[str]]:
    """The state and its reasons in the order of the checks."""
    if not seeds:
        return "UNKNOWN", ["NO_SEED"]
    if seeds > 1:
        return "AMBIGUOUS", ["MANY_SEEDS"]
    checks = [(producers > 0, "NO_PRODUCER"), (located > 0, "PRODUCER_NOT_LOCATED"), (bool(transport), "NO_TRANSPORT"), ((sinks if control else consumers + sinks) > 0, "NO_SINK"), (same_arch, "OTHER_ARCH")]
    reasons = [reason for ok, reason in checks if not ok]
    return ("INCOMPLETE" if reasons else "COMPLETE"), reasons


def answer(request: Request, frame: DataFrame, order: list, snapshot: str) -> Answer:
    """One page of a totally ordered frame, with the exact total and the next cursor."""
    request = request.checked()
    query = request.fingerprint()
    offset = rank.Cursor.read(request.cursor, snapshot, query).offset if request.cursor else 0
    total = frame.count()
    rows = rank.page(frame, order, request.limit, offset).collect()
    more = offset + len(rows) < total
    return Answer(rows, total, rank.Cursor(offset + len(rows), snapshot, query).token() if more else None, verdict(request.operation, "COMPLETE", more))
