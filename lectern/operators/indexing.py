"""Keyword indexes on disk, kept up to date by segments.

A segment holds the postings, lengths and words of some documents, and the ids
whose rows in older segments it makes void. An index is a list of segments in a
manifest; a change of the catalog adds one segment with the documents that are
new or differ, and a new manifest. Readers take each segment without the ids
that later ones void: an anti-join that a filter on terms goes through, so it
meets only the postings of a query. When segments or void rows pile up they
are merged into one. Nothing is overwritten: a lost job leaves a segment that
no manifest names, and readers of an older manifest keep what they had.

Equal ids in one table of documents are all indexed; a document whose id is
null is not, since nothing could name it again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from . import search as S

#: Segments of an index, and the share of void or late rows, before a merge.
SEGMENTS, SHARE = 8, 0.25
#: Void ids, some 16 bytes each, that are broadcast at most.
VOIDS = 2_000_000


def _print(fields: tuple[str, ...]) -> Column:
    """A digest of what is indexed of a document."""
    parts = [F.concat(F.length(x).cast("string"), F.lit(":"), x) for f in fields for x in [F.coalesce(F.col(f), F.lit(""))]]
    return F.md5(F.concat(*parts).cast("binary"))


@dataclass(frozen=True)
class Segment:
    name: str
    documents: int
    void: int


@dataclass(frozen=True)
class StoredIndex:
    spark: SparkSession
    folder: str
    fields: tuple[str, ...]
    stemmed: bool = False

    # ------------------------------------------------------------- manifests

    def _path(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def numbers(self) -> list[int]:
        """Of the manifests that are whole."""
        fs, where = self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._path("manifests", n, "_SUCCESS")[1]))

    def manifest(self, number: int | None = None) -> tuple[list[Segment], str | None]:
        """Segments, oldest first, and the mark of the catalog they hold."""
        found = self.numbers()
        if not found:
            return [], None
        row = self.spark.read.schema("said string").text(f"{self.folder}/manifests/{number or found[-1]}").first()
        said = json.loads(row[0])
        return [Segment(**s) for s in said["segments"]], said["mark"]

    def _commit(self, segments: list[Segment], mark: str | None) -> None:
        number = (self.numbers() or [0])[-1] + 1
        said = json.dumps({"segments": [vars(s) for s in segments], "mark": mark})
        # a number that is taken fails: of two writers one wins
        self.spark.createDataFrame([(said,)], "said string").coalesce(1).write.text(f"{self.folder}/manifests/{number}")

    # -------------------------------------------------------------- segments

    def _read(self, segment: Segment, part: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/segments/{segment.name}/{part}")
        return S.unblocked(rows) if part == "postings" else rows

    def _live(self, segments: list[Segment], part: str) -> DataFrame:
        """The rows of a part that no later segment makes void. The ids go to
        the rows up to VOIDS of them, so that a merge shuffles no postings."""
        out = []
        for k, segment in enumerate(segments):
            later = [self._read(s, "void") for s in segments[k + 1 :] if s.void]
            rows = self._read(segment, part)
            if later:
                ids = storage.maybe_broadcast(reduce(DataFrame.union, later).distinct(), sum(s.void for s in segments[k + 1 :]), VOIDS)
                rows = rows.join(ids, "id", "left_anti").select(*rows.columns)
            out.append(rows)
        return reduce(DataFrame.unionByName, out)

    def _write(self, index: S.Index, void: DataFrame) -> Segment:
        name = uuid.uuid4().hex
        base = f"{self.folder}/segments/{name}"
        index.save(base)
        void.write.parquet(f"{base}/void")
        segment = Segment(name, 0, 0)
        return Segment(name, self._read(segment, "lengths").count(), self._read(segment, "void").count())

    def _segment(self, docs: DataFrame, void: DataFrame) -> Segment:
        docs = docs.where("id IS NOT NULL")
        lengths = S.text_lengths(docs, self.fields, self.stemmed, _print(self.fields).alias("print"))
        return self._write(replace(S.Index.build(docs, self.fields, self.stemmed), lengths=lengths), void)

    # --------------------------------------------------------------- changes

    def rebuild(self, docs: DataFrame, mark: str | None = None) -> S.Index:
        """From docs(id, *fields), whatever was there."""
        self._commit([self._segment(docs, self._no_ids())], mark)
        return self.open()

    def _no_ids(self) -> DataFrame:
        return self.spark.range(0).select("id")

    def update(self, docs: DataFrame, mark: str | None = None, ids: DataFrame | None = None) -> S.Index:
        """Bring the index to docs; with ids(id), only those documents. Texts
        of documents that did not change are digested, never tokenised."""
        segments, _ = self.manifest()
        if not segments:
            return self.rebuild(docs if ids is None else docs.join(ids.select("id"), "id", "left_semi"), mark)
        docs = docs.select("id", *self.fields).where("id IS NOT NULL")
        held = self._live(segments, "lengths").groupBy("id").agg(F.sort_array(F.collect_list("print")).alias("held"))
        if ids is not None:
            docs, held = (df.join(ids.select("id"), "id", "left_semi") for df in (docs, held))
        now = docs.select("id", _print(self.fields).alias("print")).groupBy("id").agg(F.sort_array(F.collect_list("print")).alias("now"))
        differ = now.join(held, "id", "full").where(~F.col("now").eqNullSafe(F.col("held")))
        # a small table, read three times, that must be the same each time
        name = f"{self.folder}/changes/{uuid.uuid4().hex}"
        differ.select("id", F.col("now").isNotNull().alias("there"), F.col("held").isNotNull().alias("void")).write.parquet(name)
        changed = self.spark.read.parquet(name)
        if changed.limit(1).count():
            new = docs.join(changed.where("there").select("id"), "id", "left_semi")
            segments = [*segments, self._segment(new, changed.where("void").select("id"))]
        fs, where = self._path("changes")
        fs.delete(where, True)
        self._commit(segments, mark)
        late, void = sum(s.documents for s in segments[1:]), sum(s.void for s in segments)
        if len(segments) > SEGMENTS or late + void > SHARE * max(segments[0].documents, 1):
            return self.compact()
        return self.open()

    def compact(self) -> S.Index:
        """All segments as one, without what is void. No text is read."""
        segments, mark = self.manifest()
        if len(segments) > 1:
            self._commit([self._write(S.Index(self._live(segments, "postings"), self._live(segments, "lengths"), self.fields, self.stemmed), self._no_ids())], mark)
        return self.open()

    def at(self, docs: DataFrame, mark: str) -> S.Index:
        """The index of the catalog with this mark: as it is, or updated."""
        segments, now = self.manifest()
        return self.open() if segments and now == mark else self.update(docs, mark)

    def vacuum(self, keep: int = 1) -> None:
        """Delete manifests but the last ones, and segments none of those
        names. Not while others read or write older ones."""
        numbers = self.numbers()
        named = {s.name for n in numbers[-keep:] for s in self.manifest(n)[0]}
        for n in numbers[:-keep]:
            fs, where = self._path("manifests", str(n))
            fs.delete(where, True)
        fs, where = self._path("segments")
        for status in fs.listStatus(where) if fs.exists(where) else ():
            if status.getPath().getName() not in named:
                fs.delete(status.getPath(), True)

    def open(self, number: int | None = None) -> S.Index:
        segments, _ = self.manifest(number)
        if not segments:
            raise ValueError(f"no index in {self.folder}")
        words = reduce(DataFrame.union, [self._read(s, "words") for s in segments]) if self.stemmed else None
        return S.Index(self._live(segments, "postings"), self._live(segments, "lengths").select("id", "length"), self.fields, self.stemmed, words)
