"""State tables as a log in a folder: whole versions, and between them the records that changed."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as S


@dataclass
class Snapshot:
    states: DataFrame
    evaluated: DataFrame
    last_run: float | None = None
    last_completed_run: float | None = None


#: Replaced commits that stay for readers that began before; older ones are deleted.
KEPT = 48
#: Deltas that are read one by one before they are merged.
MOST_DELTAS = 32
#: Letters in a commit's name: it holds states, it holds pairs, pairs before it are void, and it holds
#: all deltas since the last whole version.
STATES, PAIRS, CLEARS, MERGED = "spcm"


class Store:
    """A log below a folder that the driver and all executors reach, for one writer at a time.

    A commit is a file in commits/ that names tables: a whole version of the state, or a delta with the
    records and pairs that changed since the commit before. Tables are written before the commit is named
    in one rename, so an interrupted commit is never seen; commits come in the order of their names. A
    reader takes the last whole version and the deltas after it, of each note the newest record. After
    MOST_DELTAS deltas they are merged into one, and into a new whole version as soon as they hold as many
    records as the last one: what is written stays in proportion to what changes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _commits(self) -> list[str]:
        """Names of the commits, in order."""
        fs, where = self._fs(f"{self.folder}/commits")
        if not fs.exists(where):
            return []
        names = (x.getPath().getName() for x in fs.listStatus(where))
        return sorted(x.removesuffix(".json") for x in names if x.endswith(".json") and not x.startswith("."))

    @staticmethod
    def _holds(commit: str) -> str | None:
        """What a delta holds, by its letters; None for a whole version."""
        return commit.partition(".delta-")[2] if ".delta-" in commit else None

    def _chain(self, commits: list[str]) -> list[str]:
        """The last whole version and what is read after it."""
        whole = max((k for k, x in enumerate(commits) if self._holds(x) is None), default=0)
        start = max((k for k, x in enumerate(commits) if k > whole and MERGED in (self._holds(x) or "")), default=whole + 1)
        return commits[whole : whole + 1] + commits[start:]

    def _runs(self, commits: list[str]) -> dict:
        if not commits:
            return {"last_run": None, "last_completed_run": None}
        text = self.spark.read.format("text").option("wholetext", True).load(f"{self.folder}/commits/{commits[-1]}.json").first()["value"]
        return json.loads(text)

    def _table(self, kind: str, commits: list[str], more: str = "") -> DataFrame:
        schema = {"state": S.STATE, "pairs": S.PAIRS}[kind] + more
        if not commits:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{x.partition('.')[0]}/{kind}" for x in commits))

    def _deltas(self, chain: list[str]) -> tuple[DataFrame, DataFrame, bool]:
        """The records and pairs of a chain's deltas, and whether older pairs are void."""
        rest = chain[1:]
        clears = max((k for k, x in enumerate(rest) if CLEARS in self._holds(x)), default=-1)
        states = self._table("state", [x for x in rest if STATES in self._holds(x)], ", version long")
        return states, self._table("pairs", [x for x in rest[max(clears, 0) :] if PAIRS in self._holds(x)]), clears >= 0

    def load(self) -> Snapshot:
        commits = self._commits()
        chain, runs = self._chain(commits), self._runs(commits)
        base = [x for x in chain if self._holds(x) is None]
        states, evaluated = self._table("state", base), self._table("pairs", base)
        if len(chain) > 1:
            deltas, pairs, void = self._deltas(chain)
            if any(STATES in self._holds(x) for x in chain[1:]):
                states = S.merged_log(states, deltas)
            if void or any(PAIRS in self._holds(x) for x in chain[1:]):
                evaluated = (pairs if void else evaluated.unionByName(pairs)).distinct()
        return Snapshot(states, evaluated, runs["last_run"], runs["last_completed_run"])

    def _put(self, tables: dict[str, DataFrame], runs: dict, letters: str | None) -> None:
        version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        for kind, table in tables.items():
            table.write.parquet(f"{self.folder}/{version}/{kind}")
        name = version if letters is None else f"{version}.delta-{letters}"
        fs, part = self._fs(f"{self.folder}/commits/.{name}.part")
        out = fs.create(part)
        out.write(json.dumps({"last_run": runs["last_run"], "last_completed_run": runs["last_completed_run"]}).encode())
        out.close()
        fs.rename(part, self._fs(f"{self.folder}/commits/{name}.json")[1])

    def _clean(self) -> None:
        commits = self._commits()
        chain = set(self._chain(commits))
        fs, _ = self._fs(self.folder)
        for old in [x for x in commits if x not in chain][:-KEPT]:
            fs.delete(self._fs(f"{self.folder}/commits/{old}.json")[1], False)
            fs.delete(self._fs(f"{self.folder}/{old.partition('.')[0]}")[1], True)

    def commit(self, snapshot: Snapshot) -> Snapshot:
        """A whole version."""
        runs = {"last_run": snapshot.last_run, "last_completed_run": snapshot.last_completed_run}
        self._put({"state": snapshot.states, "pairs": snapshot.evaluated}, runs, None)
        self._clean()
        return self.load()

    def append(self, states: DataFrame | None = None, pairs: DataFrame | None = None, clear_pairs: bool = False, **runs: float | None) -> None:
        """A delta: records that replace those of the same path or are new, pairs that were evaluated, and
        last_run or last_completed_run. Without any commit before it, a whole version."""
        commits = self._commits()
        runs = self._runs(commits) | runs
        if not commits:
            found = Snapshot(self._table("state", []) if states is None else states, self._table("pairs", []) if pairs is None else pairs, runs["last_run"], runs["last_completed_run"])
            self.commit(found)
            return
        tables, letters = {}, ""
        if states is not None:
            tables["state"], letters = states.withColumn("version", F.lit(time.time_ns())), STATES
        if pairs is not None:
            tables["pairs"], letters = pairs, letters + PAIRS
        self._put(tables, runs, letters + (CLEARS if clear_pairs else ""))
        if len(self._chain(commits)) >= MOST_DELTAS:
            self.compact()

    def compact(self) -> None:
        """Merges the deltas: into a whole version where they hold as many records as the last one, else
        into one delta."""
        commits = self._commits()
        chain, runs = self._chain(commits), self._runs(commits)
        base = [x for x in chain if self._holds(x) is None]
        states, pairs, void = self._deltas(chain)
        size = lambda kind: self._table(kind, base).count()
        if states.count() + pairs.count() >= size("state") + size("pairs"):
            whole = self.load()
            self._put({"state": whole.states, "pairs": whole.evaluated}, runs, None)
        else:
            self._put({"state": S.newest_records(states, keep=True), "pairs": pairs.distinct()}, runs, STATES + PAIRS + MERGED + (CLEARS if void else ""))
        self._clean()

