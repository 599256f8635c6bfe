"""A versioned store of Parquet tables: every publish writes new parts and one marker file.

Layout under `root` (any path Spark reads): parts/<table>-<unique name>, CURRENT-<n> markers (the greatest counts), FREEZE-<n> and THAW-<n> for leases of
an index that is built anew. A marker lists the parts of each table and their sizes; an appended part leaves the others as they are. No two writers
share a folder, and the marker, which can be made once only, decides between them. Files go through Hadoop's file system, so the store may live anywhere.

Rows of the tables in KEYED carry a chunk_id. They leave by a part of the table `removed`, which names their ids and is applied at every read; what a removal writes
is in proportion to what leaves. Ids are never given twice: a marker holds the highest one given (`top`), and no version, rolled back to or restored, lowers it. So a
removed id stays removed whatever part holds it. `tidy` merges parts of like size, so that their number grows with the logarithm of
the rows, and drops removed rows from what it rewrites; `fold` rewrites all.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrag.functions.text import md5_hex

#: Tables whose rows leave by their chunk_id.
KEYED = ("chunks", "vectors", "postings", "lengths")
#: Parts of a size class that are merged into one; a class spans sizes within this factor.
FAN = 8
#: Removed rows from which on, if they are a quarter of all, `tidy` folds them in.
MANY_REMOVED = 10_000


class Conflict(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self, prefix: str) -> list[str]:
        """What follows the prefix in the names of the root's files."""
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        return [n[len(prefix) :] for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith(prefix)]

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.names("CURRENT-"))

    @property
    def version(self) -> int:
        return (self.versions() or [0])[-1]

    def text(self, name: str) -> str:
        """The content of a small file of the root."""
        fs, p = self._fs(f"{self.root}/{name}")
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """tables: parts by table; sizes: rows by part; top: the highest id given; counts: chunks and their tokens, where known; meta: what publishers keep."""
        v = self.version if version is None else version
        return {"version": v, "tables": {}, "sizes": {}, "top": None, "counts": None, "meta": {}} | (json.loads(self.text(f"CURRENT-{v}")) if v else {})

    def table(self, name: str, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self.live(name, self.read(m["tables"][name]), m)

    def live(self, name: str, rows: DataFrame, manifest: dict) -> DataFrame:
        """Without the removed rows. Ids of a removal list are broadcast only where Spark finds them small enough."""
        gone = manifest["tables"].get("removed")
        return rows.join(self.read(gone), "chunk_id", "left_anti") if gone and name in KEYED else rows

    def read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(*parts)

    def write(self, name: str, df: DataFrame) -> str:
        """Write a part that no marker names yet."""
        path = f"{self.root}/parts/{name.replace('/', '_')}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def publish(
        self,
        tables: dict[str, DataFrame] | None = None,
        expect: int | None = None,
        append: dict[str, DataFrame] | None = None,
        parts: dict[str, list[str]] | None = None,
        sizes: dict[str, int] | None = None,
        top: int | None = None,
        counts: dict[str, int] | None = None,
        lease: int | None = None,
        **meta,
    ) -> int:
        """The next version: tables replaced by rows or by written parts, or appended to; others carry over, as do sizes, the highest id and meta. Fails if
        another version appeared since `expect`, or while another lease freezes the store. Counts are known only where they are given or no keyed table changes."""
        start = self.version if expect is None else expect
        old = self.manifest(start)
        held = {k: list(v) for k, v in old["tables"].items()}
        self._writable(start, lease)
        for name, df in (tables or {}).items():
            held[name] = [self.write(name, df)]
        for name, df in (append or {}).items():
            held[name] = [*held.get(name, []), self.write(name, df)]
        held |= parts or {}
        if set(KEYED) & {*(tables or {}), *(append or {})} and counts is None:
            old["counts"] = None
        named = {p for ps in held.values() for p in ps}
        new = {"version": start + 1, "tables": held, "sizes": {p: n for p, n in (old["sizes"] | (sizes or {})).items() if p in named}}
        new |= {"top": max((x for x in (old["top"], top) if x is not None), default=None), "counts": counts or old["counts"], "meta": old["meta"] | meta}
        self._writable(start, lease)
        return self._mark(new, start + 1)

    def _writable(self, start: int, lease: int | None = None) -> None:
        if self.lease() not in (0, lease):
            raise Conflict("the index is being rebuilt")
        if lease and self.lease() != lease:
            raise Conflict("the lease has ended")
        if self.version != start:
            raise Conflict("revision_conflict")

    def compact(self, name: str) -> int:
        """The table's parts as one, without removed rows."""
        start = self.version
        part = self.write(name, self.table(name, start))
        return self.publish(parts={name: [part]}, sizes={part: sum(self.manifest(start)["sizes"].get(p, 0) for p in self.manifest(start)["tables"][name])}, expect=start)

    def fold(self) -> int:
        """All keyed tables as one part each and no removal list."""
        start = self.version
        m = self.manifest(start)
        made = {k: self.write(k, in_order(k, self.table(k, start))) for k in KEYED if m["tables"].get(k)}
        n = (m["counts"] or {}).get("chunks", sum(m["sizes"].get(p, 0) for p in m["tables"].get("chunks", ())))
        return self.publish(parts={k: [p] for k, p in made.items()} | {"removed": []}, sizes={p: n for p in made.values()}, expect=start)

    def tidy(self, merge: dict[str, Callable[[DataFrame, bool], DataFrame]] | None = None) -> int | None:
        """Merge each size class of FAN parts or more, class by class, until none is left; fold where too much is removed. The new version, None where there
        was nothing to do or another writer came first, who will find the same to do. `merge`: how rows of other tables come together, given whether they are all."""
        try:
            m, done = self.manifest(), None
            gone, rows = (sum(m["sizes"].get(p, 0) for p in m["tables"].get(k, ())) for k in ("removed", "chunks"))
            if gone >= MANY_REMOVED and 4 * gone >= rows:
                return self.fold()
            while groups := {k: g for k in m["tables"] if (k in KEYED or k == "removed" or k in (merge or {})) and (g := crowded(m["tables"][k], m["sizes"]))}:
                parts, sizes = {}, {}
                for k, g in groups.items():
                    kept = [p for p in m["tables"][k] if p not in g]
                    rows = self.live(k, self.read(g), m)
                    rows = (merge or {})[k](rows, not kept) if k in (merge or {}) else in_order(k, rows)
                    parts[k] = [*kept, new := self.write(k, rows)]
                    sizes[new] = sum(m["sizes"][p] for p in g)
                done = self.publish(parts=parts, sizes=sizes, expect=m["version"])
                m = self.manifest(done)
            return done
        except Conflict:
            return None

    def clear_staging(self, seconds: float, now: float | None = None) -> int:
        """Delete staged parts older than this that no version names; the number of them. What a running writer staged is younger."""
        fs, p = self._fs(f"{self.root}/parts")
        if not fs.exists(p):
            return 0
        named = {path.rpartition("/")[2] for v in self.versions() for ps in self.manifest(v)["tables"].values() for path in ps}
        n = 0
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith(("staging-", "snapshot-")) and name not in named and s.getModificationTime() / 1000 <= (time.time() if now is None else now) - seconds:
                n += bool(fs.delete(s.getPath(), True))
        return n

    # ---- freezing

    def lease(self, now: float | None = None) -> int:
        """The number of the lease that freezes the store, 0 where none does: the latest one, unless it was given back or has run out."""
        taken = max((int(n) for n in self.names("FREEZE-")), default=0)
        if not taken or str(taken) in self.names("THAW-"):
            return 0
        return taken if json.loads(self.text(f"FREEZE-{taken}"))["until"] > (time.time() if now is None else now) else 0

    @property
    def frozen(self) -> bool:
        return self.lease() > 0

    def freeze(self, owner: str = "", seconds: float = 3600.0) -> int:
        """From now on every writer of this root, on any driver, is refused, but for who names the lease, until it is given back or runs out. Of two who
        take an expired lease over, one gets the next number; the former owner's number is no longer good for anything."""
        if self.frozen:
            raise Conflict("the index is being rebuilt")
        number = max((int(n) for n in self.names("FREEZE-")), default=0) + 1
        self.create(f"FREEZE-{number}", json.dumps({"owner": owner, "until": time.time() + seconds}))
        return number

    def thaw(self, lease: int | None = None) -> None:
        lease = self.lease() if lease is None else lease
        if lease and str(lease) not in self.names("THAW-"):
            self.create(f"THAW-{lease}", "{}")

    def create(self, name: str, text: str) -> None:
        """A file that must not exist yet: the compare-and-set of this store."""
        fs, p = self._fs(f"{self.root}/{name}")
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise Conflict("revision_conflict") from e
            raise
        out.write(bytearray(text.encode()))
        out.close()

    def _mark(self, manifest: dict, version: int) -> int:
        self.create(f"CURRENT-{version}", json.dumps(manifest))
        return version

    def _again(self, manifest: dict, start: int) -> int:
        """An earlier manifest as the version after `start`; the highest id given and meta stay the latest."""
        now = self.manifest(start)
        return self._mark(manifest | {"version": start + 1, "top": now["top"], "meta": now["meta"]}, start + 1)

    def rollback(self) -> int:
        """Publish the tables of the version before the current one."""
        vs = self.versions()
        if len(vs) < 2:
            raise Conflict("nothing to roll back to")
        self._writable(vs[-1])
        return self._again(self.manifest(vs[-2]), vs[-1])

    def backup(self, name: str) -> dict:
        """Record the current version under a name; its parts are never rewritten, so nothing is copied."""
        m = self.manifest()
        self.create(f"BACKUP-{name}", json.dumps(m))
        return m

    def backups(self) -> dict[str, int]:
        """Versions by backup name."""
        return {n: self._backup(n)["version"] for n in sorted(self.names("BACKUP-"))}

    def _backup(self, name: str) -> dict:
        return json.loads(self.text(f"BACKUP-{name}"))

    def restore(self, name: str) -> int:
        """Publish a backup's tables as the next version."""
        start = self.version
        self._writable(start)
        return self._again(self._backup(name), start)


def crowded(parts: list[str], sizes: dict[str, int]) -> list[str]:
    """The parts of the smallest size class that has FAN of them or more, none if no class has. Parts of unknown size stay."""
    classes: dict[int, list[str]] = {}
    for p in parts:
        if p in sizes:
            n, c = sizes[p], 0
            while n >= FAN * 128:
                n, c = n // FAN, c + 1
            classes.setdefault(c, []).append(p)
    return next((g for _, g in sorted(classes.items()) if len(g) >= FAN), [])


def in_order(name: str, rows: DataFrame) -> DataFrame:
    """Merged rows in the order that queries look them up in: postings by term, others by id."""
    keys = ["term", "chunk_id"] if name == "postings" else ["chunk_id"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def first_of_each(rows: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def deduplicated(new: DataFrame, existing: DataFrame | None, order: list[str]) -> DataFrame:
    """New chunks whose MD5 is neither in the store nor earlier in the batch."""
    rows = first_of_each(new, "md5", order)
    return rows.join(existing.select("md5"), "md5", "left_anti") if existing is not None else rows


def numbered(rows: DataFrame, order: list[str], after: int = 0, buckets: int = 4096) -> DataFrame:
    """chunk_id from after + 1 without gaps, without one large sort: rows are ranked in hash buckets, which are offset by running totals."""
    rows = rows.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    own = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    before = F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))  # of `buckets` rows at most
    offs = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__c")).select("__b", F.coalesce(before, F.lit(0)).alias("__o"))
    return rows.withColumn("__i", own).join(offs, "__b").withColumn("chunk_id", F.col("__i") + F.col("__o") + after).drop("__b", "__i", "__o")


def of_source(source: str) -> Column:
    """The source itself or its parts `source#...`."""
    return (F.col("source") == source) | F.col("source").startswith(source + "#")


def without_source(rows: DataFrame, source: str) -> DataFrame:
    return rows.where(~of_source(source))


def sources(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("chunks")).orderBy("source")


def ingested(pieces: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Chunk rows of documents' pieces (source, title, uri, location, ord, text) with provenance defaults, deduplicated."""
    return deduplicated(chunk_rows(pieces, "ord"), existing, ["source", "ord"])


def chunk_rows(rows: DataFrame, *more: str) -> DataFrame:
    """The store's columns, with provenance defaults, of pieces (source, ord, text, title, uri, location and perhaps chunk_id), and `more`."""
    uri = F.coalesce(F.when(F.col("uri") != "", F.col("uri")), F.col("source")).alias("document_uri")
    location = F.coalesce(F.when(F.col("location") != "", F.col("location")), F.concat(F.lit("chunk:"), F.col("ord").cast("string"))).alias("location")
    own = ["chunk_id"] if "chunk_id" in rows.columns else []
    return rows.select("source", *more, "text", md5_hex(F.col("text")).alias("md5"), F.col("title").alias("document_title"), uri, location, *own)


def index_problems(chunks: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """problem, n: chunks without vector, vectors without chunk, wrong dimensions, repeated ids."""
    ids, vids = chunks.select("chunk_id"), vectors.select("chunk_id")
    parts = {
        "missing_vector": ids.join(vids, "chunk_id", "left_anti"),
        "orphan_vector": vids.join(ids, "chunk_id", "left_anti"),
        "wrong_dimension": vectors.where(F.size("embedding") != dims).select("chunk_id"),
        "duplicate_id": ids.groupBy("chunk_id").count().where("count > 1").select("chunk_id"),
    }
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
        out = row if out is None else out.unionByName(row)
    return out


ARCHIVE_ENTRIES = ("manifest.json", "data.jsonl")


def export_archive(chunks: DataFrame, path: str, embedding: dict, most: int = 1_000_000) -> dict:
    """A zip of rows as JSON lines with a manifest of counts and digest. Bounded: a larger table goes by `Store.publish` to another root."""
    n = chunks.count()
    if n > most:
        raise ValueError("too many rows for an archive; publish a version instead")
    h, lines = hashlib.sha256(), []
    for r in chunks.select(F.to_json(F.struct(*chunks.columns)).alias("j")).orderBy("j").toLocalIterator():
        lines.append(r.j)
        h.update(r.j.encode() + b"\n")
    manifest = {"format": 1, "rows": n, "sha256": h.hexdigest(), "embedding": embedding}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps(manifest, indent=2, sort_keys=True))
        z.writestr("data.jsonl", "".join(x + "\n" for x in lines))
    return manifest


def read_archive(spark: SparkSession, path: str, schema, packed: int = 256 << 20, unpacked: int = 512 << 20) -> DataFrame:
    """Rows of an archive that passes all checks: two known entries, size caps, counts and digest."""
    import os

    if os.path.getsize(path) > packed:
        raise ValueError("archive too large")
    with zipfile.ZipFile(path) as z:
        infos = z.infolist()
        if sorted(i.filename for i in infos) != sorted(ARCHIVE_ENTRIES):
            raise ValueError("unexpected entries")
        if sum(i.file_size for i in infos) > unpacked:
            raise ValueError("archive extracts too large")
        manifest, data = json.loads(z.read("manifest.json")), z.read("data.jsonl")
    if manifest.get("format") != 1 or hashlib.sha256(data).hexdigest() != manifest.get("sha256"):
        raise ValueError("archive digest mismatch")
    lines = data.decode().splitlines()
    if len(lines) != manifest["rows"]:
        raise ValueError("archive row count mismatch")
    raw = spark.createDataFrame([(x,) for x in lines], "j string")
    return raw.select(F.from_json("j", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
