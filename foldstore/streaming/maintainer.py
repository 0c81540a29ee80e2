"""Keeping live cells current from the log as a stream.

A micro-batch is folded onto the newest image and published as the next one. Images hold the horizons of deletes, so that
any event may come again, after a lost checkpoint or from a rival, and changes nothing. An image names what it holds: all
commits up to one, and files of later ones. A batch that brings no file that the image lacks is done; what it brings is
never judged by its number. Readers add the events above the image's offsets, see ``Store.state``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from foldstore.operators.validation import split
from foldstore.plans.fold import fold, horizons
from foldstore.sources.event_log import EventLog
from foldstore.sources.snapshots import Image, Snapshots


class Maintainer:
    def __init__(self, log: EventLog, images: Snapshots, *, keep: int = 3, dead_letters: str | None = None):
        self.log, self.images, self.keep, self.dead_letters = log, images, keep, dead_letters
        self.pk = log.config.primary_key

    def _held(self, image: Image | None, brought: list[tuple[int, str]]) -> tuple[int, dict[int, list[str]]] | None:
        """What an image holds once the files ``brought`` (commit, name) are in it; None if it has them all."""
        through = image.through if image else -1
        above = {c: set(n) for c, n in image.files.items()} if image else {}
        new = [(c, n) for c, n in brought if c > through and n not in above.get(c, ())]
        if not new:
            return None
        for c, n in new:
            above.setdefault(c, set()).add(n)
        commits = {int(c) for c in self.log.commits()}
        while through + 1 in commits and set(self.log.files_of(through + 1)) <= above.get(through + 1, set()):
            through += 1
            above.pop(through, None)
        return through, {c: sorted(n) for c, n in above.items()}

    def _merge(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            paths = [r[0].rstrip("/").split("/")[-2:] for r in batch.select("log_file").distinct().toLocalIterator()]
            brought = [(int(commit), name) for commit, name in paths]
            good, bad = split(batch.drop("log_file"), self.pk)
            if self.dead_letters:
                bad.write.mode("overwrite").parquet(f"{self.dead_letters}/batch={batch_id:020d}")
            while held := self._held(image := self.images.latest(), brought):
                through, above = held
                before = self.images.deleted(image)
                live = fold(good, self.pk, self.images.cells(image), before)
                # None: a rival has published this epoch; what it left out is folded onto its image.
                if self.images.publish(live, image.epoch + 1 if image else 0, self.log.end_of(through), deleted=horizons(good, before), through=through, files_above=above):
                    break
            self.images.retire(self.keep)
        finally:
            batch.unpersist()

    def _start(self, checkpoint: str, trigger: dict, max_files: int | None) -> StreamingQuery:
        writer = self.log.stream(max_files).writeStream.foreachBatch(self._merge).option("checkpointLocation", checkpoint)
        return writer.trigger(**trigger).start()

    def catch_up(self, checkpoint: str, max_files: int | None = None) -> None:
        """Fold what the log has now, and return."""
        self._start(checkpoint, {"availableNow": True}, max_files).awaitTermination()

    def follow(self, checkpoint: str, every: str = "10 seconds", max_files: int | None = None) -> StreamingQuery:
        """Catch up, then keep folding on the same checkpoint until the query is stopped."""
        self.catch_up(checkpoint, max_files)
        return self._start(checkpoint, {"processingTime": every}, max_files)

