"""The commands: enrich, discover, normalise, validate, clean and apply, and all of them daily."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sort_key
from ..operators import enrich as E
from ..operators import links as L
from ..operators import rewrite as R
from ..operators import state as S
from ..operators import tags as T
from ..operators.edit_log import failures, replayed
from ..session import drop_paths, shared_dir, stash, unstash
from ..sources.vault import read_vault, write_edits
from .store import Snapshot, Store
from .tools import read_edits

#: Fixed: the command's default cap on a tag's notes; the operator's own default is none.
COMMAND_MAX_FREQUENCY = 10

#: Batches in a partition of the work to do.
SHARD_BATCHES = 64


@dataclass
class Notebook:
    """A vault folder, its state store and the model clients; each command commits what it changed, a
    batch at a time: small batches lose little where a model is slow."""

    spark: SparkSession
    vault: str
    store: Store
    enricher: E.Enricher = field(default_factory=E.FrequentWords)
    verifier: E.Verifier = field(default_factory=E.SharedTags)
    batch_notes: int = 10_000
    batch_pairs: int = 100_000
    report: Callable[[str], None] = print
    now: Callable[[], float] = time.time

    def notes(self) -> DataFrame:
        return read_vault(self.spark, self.vault)

    def run(self, force: bool = False) -> dict[str, int]:
        """Enriches new and changed notes in path order, a committed batch at a time, so that an
        interrupted run goes on where it stopped. Replies that are no JSON object count as errors and
        are tried again next time."""
        self.store.append(last_run=self.now())
        states = self.store.load().states
        todo = S.changed(self.notes(), states, force)
        todo = stash(todo, "todo")
        places = S.placed(S.numbered(todo.select("path"), sort_key(F.col("path"))), states)
        todo = self.dealt(todo.join(places, "path"), self.batch_notes, "todo-batches")
        total, processed, errors = todo.count(), 0, 0
        began = self.now()
        for start in range(0, total, self.batch_notes):
            some = self.batch(todo, start, self.batch_notes)
            replies = stash(E.enriched(some, self.enricher), "replies")
            parsed = E.parsed_replies(replies).join(some.select("path", "ord"), "path")
            self.store.append(S.processed(parsed.where("ok"), F.lit(self.now())))
            counts = parsed.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("bad")).first()
            if counts["bad"]:
                self.failures(replies)
            unstash(replies)
            processed, errors = processed + counts["ok"], errors + counts["bad"]
            self.progress("notes", min(start + self.batch_notes, total), total, began, errors)
        if total:
            self.store.append(last_completed_run=self.now())
        return {"processed": processed, "skipped": total - processed - errors, "errors": errors}

    def dealt(self, rows: DataFrame, size: int, name: str) -> DataFrame:
        """Numbered rows as a written table whose partitions hold SHARD_BATCHES batches each: a batch reads
        its own partition, however many there are."""
        shard = F.floor(F.col("seq") / (size * SHARD_BATCHES)).cast("long")
        return stash(rows.withColumn("shard", shard).repartition("shard"), name, by="shard")

    def batch(self, rows: DataFrame, start: int, size: int) -> DataFrame:
        some = rows.where(F.col("shard") == start // (size * SHARD_BATCHES)).drop("shard")
        return some.where((F.col("seq") >= start) & (F.col("seq") < start + size))

    def failures(self, replies: DataFrame) -> None:
        """Reports why answers were lost, the most frequent reasons first: a wrong client does not look like a
        busy one."""
        found = replies.where("failure IS NOT NULL").groupBy("failure").count().orderBy(F.desc("count"), "failure").limit(3)
        for row in found.collect():
            self.report(f"no answer ({row['count']}): {row['failure']}")

    def progress(self, what: str, done: int, total: int, began: float, errors: int) -> None:
        """How far a command is, its average and what is left at this pace."""
        each = (self.now() - began) / max(done, 1)
        self.report(f"{done} of {total} {what}, {errors} errors, {each:.2f} s each, about {each * (total - done):.0f} s left")

    def candidates(self, now: Snapshot, min_tags: int, max_frequency: int) -> DataFrame:
        return T.shared_tag_pairs(T.tag_index(now.states), min_tags, max_frequency)

    def discover(self, min_tags: int = 2, max_frequency: int = COMMAND_MAX_FREQUENCY, force: bool = False) -> dict[str, int]:
        """Asks for a verdict on each unevaluated pair of notes with shared tags that are not linked yet,
        and adds confirmed links, a committed batch at a time. All pairs looked at are marked, whatever
        the verdict; where asking fails, the pair is asked for again next time."""
        now = self.store.load()
        if force:
            self.store.append(clear_pairs=True)
            now = self.store.load()
        for row in T.skipped_tags(T.tag_index(now.states), max_frequency).toLocalIterator():
            self.report(f"tag left out: {row['tag']} (on {row['n']} notes)")
        notes = stash(self.notes(), "notes")
        pairs = stash(self.candidates(now, min_tags, max_frequency), "candidates")
        left = T.unevaluated(pairs, now.evaluated)
        linked = stash(L.already_linked(left, L.edges(notes)).select("note_a", "note_b"), "linked")
        todo = left.join(linked, ["note_a", "note_b"], "left_anti")
        todo = S.numbered(todo, F.desc("n_shared"), F.col("note_a"), F.col("note_b"))
        todo = self.dealt(todo, self.batch_pairs, "to-verify")
        total, n_linked, began = todo.count(), linked.count(), self.now()
        confirmed, errors = 0, 0
        self.store.append(pairs=S.ordered_pairs(linked))
        for start in range(0, total, self.batch_pairs):
            some = self.batch(todo, start, self.batch_pairs)
            replies = stash(E.verified(some, notes, now.states, self.verifier), "verdicts")
            yes = E.parsed_verdicts(replies).where("confirmed").select("note_a", "note_b", "link_from", "link_to", "reason", "seq")
            counts = E.parsed_verdicts(replies).agg(F.count_if("confirmed").alias("yes"), F.count_if("failed").alias("failed")).first()
            states = self.store.load().states
            named = states.join(yes.select(F.coalesce("link_from", "note_a").alias("path")), "path", "left_semi")
            linked_now = L.with_verdicts(named, yes, S.next_place(states))
            self.store.append(S.changed_records(named, linked_now), S.ordered_pairs(replies.where("NOT failed")))
            if counts["failed"]:
                self.failures(replies)
            unstash(replies)
            confirmed, errors = confirmed + counts["yes"], errors + counts["failed"]
            self.progress("pairs", min(start + self.batch_pairs, total), total, began, errors)
        return {"candidates": pairs.count(), "confirmed": confirmed, "skipped": n_linked + total - confirmed}

    def normalize(self, apply: bool = False, threshold: int = 2) -> DataFrame:
        """(canonical, n, variants) of what would be merged; with apply it is."""
        now = self.store.load()
        counts = stash(T.tag_counts(now.states), "tag-counts")
        mapping = stash(T.normalization_map(counts, threshold), "tag-map")
        after = counts.join(mapping.withColumnRenamed("variant", "tag"), "tag", "left")
        unique = after.select(F.count("*").alias("before"), F.count_distinct(F.coalesce("canonical", "tag")).alias("after")).first()
        self.report(f"{unique['before']} different tags, {unique['after']} after merging")
        if apply:
            self.store.append(S.changed_records(now.states, T.normalized(now.states, mapping).drop("replaced")))
        return T.merge_preview(counts, mapping).orderBy("canonical")

    def validate(self, fix: bool = False, details: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """(valid, invalid, fixed, removed). details sees (path, target, status, correction) of the links
        that are not valid as they are, in order."""
        now, files = self.store.load(), self.notes().select("path")
        checked = stash(L.validated(now.states, files, fix), "validation")
        if details:
            found = checked.where("status <> 'valid' OR correction IS NOT NULL").orderBy("ord", "pos")
            details(found.select("path", "target", "status", "correction"))
        if fix:
            self.store.append(S.changed_records(now.states, L.fixed_links(now.states, files)))
        return L.validation_counts(checked)

    def clean(self) -> dict[str, int]:
        now = self.store.load()
        single = L.deduplicated(now.states)
        clean = L.without_self_links(single)
        found = {
            "duplicates": L.removed_links(now.states, single).first()["removed"],
            "self_links": L.removed_links(single, clean).first()["removed"],
        }
        if any(found.values()):
            self.store.append(S.changed_records(now.states, clean))
            found |= L.validation_counts(L.validated(clean, self.notes().select("path"))).first().asDict()
        return found

    def _apply(self, plan: Callable, pending: Callable, flag: str, confirm: Callable[[DataFrame], bool] | None) -> int:
        now = self.store.load()
        notes = stash(self.notes(), "notes")
        edits = plan(notes, pending(now.states))
        edits = stash(edits.join(notes.select("path", F.col("content_hash").alias("base_hash")), "path"), "edits")
        before = notes.select("path", F.col("content").alias("old_content"))
        if confirm and not confirm(edits.join(before, "path").orderBy(sort_key(F.col("path")))):
            return 0
        done = write_edits(edits, self.vault).where("written")
        self.store.append(S.changed_records(now.states, S.mark_applied(now.states, done, flag)))
        return done.count()

    def apply_tags(self, confirm: Callable[[DataFrame], bool] | None = None) -> int:
        """Writes pending tags into notes; confirm sees (path, new_content, old_content) of the plan first.
        Returns the notes written."""
        return self._apply(R.plan_tags, S.pending_tags, "tags_applied", confirm)

    def apply_links(self, confirm: Callable[[DataFrame], bool] | None = None) -> int:
        return self._apply(R.plan_links, S.pending_links, "links_applied", confirm)

    @property
    def edits_folder(self) -> str:
        """Where a model's tools leave the edits that they plan."""
        return f"{self.store.folder}/edits"

    def apply_edits(self, confirm: Callable[[DataFrame], bool] | None = None) -> dict[str, int]:
        """Writes the edits that a model planned into the notes, in order, each on the text that it was planned
        on; confirm sees (path, new_content, old_content) first. Edits that cannot be done are reported. All
        are done with afterwards, unless confirm refuses."""
        edits = stash(read_edits(self.spark, self.edits_folder), "planned")
        notes = stash(self.notes(), "notes")
        replays = stash(replayed(notes, edits), "replays")
        plan = replays.where("n_applied > 0").select("path", "new_content", "base_hash", "n_applied")
        before = notes.select("path", F.col("content").alias("old_content"))
        if confirm and not confirm(plan.join(before, "path").orderBy(sort_key(F.col("path")))):
            return {"written": 0, "applied": 0, "failed": 0}
        done = write_edits(plan, self.vault).where("written")
        lost = failures(replays)
        for row in lost.orderBy("path", "seq").toLocalIterator():
            self.report(f"edit not done: {row['path']}: {row['error']}")
        applied = plan.join(done, "path").agg(F.coalesce(F.sum("n_applied"), F.lit(0))).first()[0]
        found = {"written": done.count(), "applied": applied, "failed": lost.count()}
        drop_paths(self.spark, [self.edits_folder])
        unstash(edits, notes, replays)
        return found

    def status(self) -> dict:
        now = self.store.load()
        todo = S.changed(self.notes(), now.states)
        first = [row["path"] for row in S.first_notes(todo.select("path")).collect()]
        return S.summary(now.states).first().asDict() | {"last_completed_run": now.last_completed_run, "to_process": todo.count(), "first": first}

    def proposals(self) -> tuple[DataFrame, DataFrame]:
        now = self.store.load()
        return S.pending_tags(now.states).orderBy("ord"), S.pending_links(now.states).orderBy("ord")

    def export_json(self, path: str) -> None:
        """The state as one JSON file: its parts are written by many tasks and copied one after the other."""
        now = self.store.load()
        parts = f"{shared_dir(self.spark)}/tables/state-json-{uuid.uuid4().hex[:12]}"
        S.write_json(S.json_lines(now.states, now.evaluated, now.last_run, now.last_completed_run), parts)
        hadoop, conf = self.spark._jvm.org.apache.hadoop, self.spark._jsc.hadoopConfiguration()
        source, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
        files, out = source.getFileSystem(conf), target.getFileSystem(conf).create(target, True)
        try:
            for name in sorted(x.getPath().getName() for x in files.listStatus(source)):
                if name.startswith("part-"):
                    part = files.open(hadoop.fs.Path(f"{parts}/{name}"))
                    hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                    part.close()
        finally:
            out.close()
        drop_paths(self.spark, [parts])

    def import_json(self, path: str) -> dict[str, int]:
        """Takes over a state file; what the store held is replaced."""
        states, pairs, runs = S.read_json(self.spark, path)
        runs = runs.first()
        states = states.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in S.schema_of("state").fields))
        now = self.store.commit(Snapshot(states, pairs, runs["last_run"], runs["last_completed_run"]))
        return {"notes": now.states.count(), "pairs": now.evaluated.count()}

    def daily(self) -> dict:
        """Everything once, in the order of the daily job; the first error stops it."""
        return {
            "run": self.run(),
            "normalized": self.normalize(apply=True).count(),
            "validated": self.validate(fix=True).first().asDict(),
            "cleaned": self.clean(),
            "discovered": self.discover(max_frequency=COMMAND_MAX_FREQUENCY),
            "tags": self.apply_tags(),
            "links": self.apply_links(),
            "status": self.status(),
        }
