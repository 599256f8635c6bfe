"""Archives of an index as folders of sorted parts under a tree of digests, written, checked and restored by Spark tasks.

<path>/<table>/part files hold the live rows of each keyed table in the order of their ids; <path>/parts lists every file with its bytes and SHA-256; <path>/MANIFEST holds
the format, the embedding's identity, rows by table, the highest id and the root of the tree: files are grouped by the first two digits of
their digest, a group's digest is that of its files' in order, the root's is that of the groups'. No row of data comes to the driver, only 256 groups' digests.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrag.operators.store import KEYED, Store, in_order, index_problems

FORMAT = 1


class ArchiveError(ValueError):
    pass


def _files(spark: SparkSession, path: str, tables: tuple[str, ...]) -> DataFrame:
    """part (table/file), bytes, sha256 of the data files as they lie there; one that cannot be read has no row. A file is read whole by one task, so it must
    stay under 2 GB."""
    out = None
    for t in tables:
        f = spark.read.format("binaryFile").options(pathGlobFilter="*.parquet", ignoreCorruptFiles="true").load(f"{path}/{t}")
        f = f.select(F.concat(F.lit(f"{t}/"), F.element_at(F.split("path", "/"), -1)).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        out = f if out is None else out.unionByName(f)
    return out


def root(parts: DataFrame) -> str:
    """The root of the tree over the parts' names and digests."""
    leaf = F.sha2(F.concat_ws(":", "part", "sha256"), 256)
    groups = parts.select(leaf.alias("d")).groupBy(F.substring("d", 1, 2).alias("g")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("d"))), 256).alias("d"))
    return hashlib.sha256(",".join(f"{r.g}:{r.d}" for r in groups.orderBy("g").collect()).encode()).hexdigest()  # 256 rows at most


def export(store: Store, path: str, embedding: dict, rows_a_file: int = 1_000_000) -> dict:
    """Write the present version to an empty folder; its manifest."""
    spark, path = store.spark, path.rstrip("/")
    fs, p = store._fs(path)
    if fs.exists(p):
        raise ArchiveError("the archive exists")
    version = store.version
    m, counts = store.manifest(version), {}
    for t in KEYED:
        if not m["tables"].get(t):
            raise ArchiveError(f"no table {t}")
        in_order(t, store.table(t, version)).write.option("maxRecordsPerFile", rows_a_file).parquet(f"{path}/{t}")
        counts[t] = spark.read.parquet(f"{path}/{t}").count()
    _files(spark, path, KEYED).write.parquet(f"{path}/parts")
    parts = spark.read.parquet(f"{path}/parts")
    tokens = spark.read.parquet(f"{path}/lengths").agg(F.sum("len")).first()[0] or 0
    manifest = {"format": FORMAT, "embedding": embedding, "rows": counts, "tokens": tokens, "top": m["top"] or 0, "root": root(parts)}
    Store(spark, path).create("MANIFEST", json.dumps(manifest, sort_keys=True))
    return manifest


def problems(spark: SparkSession, path: str, embedding: dict | None = None, most_bytes: int | None = None) -> list[str]:
    """What is wrong with an archive, parts by name; empty if it may be restored. Files are digested anew in parallel and rows of data are never parsed before that."""
    path = path.rstrip("/")
    try:
        manifest = json.loads(Store(spark, path).text("MANIFEST"))
    except Exception as e:  # noqa: BLE001 - absent, unreadable or no JSON
        return [f"manifest: {type(e).__name__}"]
    if manifest.get("format") != FORMAT:
        return [f"format {manifest.get('format')}"]
    out = []
    if embedding is not None and manifest.get("embedding") != embedding:
        out.append("another embedding")
    if not isinstance(manifest.get("rows"), dict) or set(manifest["rows"]) != set(KEYED):
        return [*out, "other tables"]
    said = spark.read.parquet(f"{path}/parts")
    if root(said) != manifest.get("root"):
        return [*out, "the list of parts is not the manifest's"]
    if most_bytes is not None and (said.agg(F.sum("bytes")).first()[0] or 0) > most_bytes:
        return [*out, "too large"]
    found = _files(spark, path, KEYED)
    both = said.select("part", F.col("sha256").alias("said")).join(found.select("part", F.col("sha256").alias("found")), "part", "full_outer")
    kind = F.when(F.col("found").isNull(), "missing or unreadable").when(F.col("said").isNull(), "unknown").otherwise("changed")
    bad = both.where(~F.col("said").eqNullSafe(F.col("found"))).select("part", kind.alias("kind")).orderBy("part").limit(1000).collect()  # a report
    return out + [f"{r.part}: {r.kind}" for r in bad]


def restore(store: Store, path: str, embedding: dict, dims: int) -> int:
    """Publish an archive that passes all checks as the next version. It replaces the index; baselines of sources are dropped, ids go on above both."""
    spark, path = store.spark, path.rstrip("/")
    start = store.version
    bad = problems(spark, path, embedding)
    if bad:
        raise ArchiveError("; ".join(bad))
    manifest = json.loads(Store(spark, path).text("MANIFEST"))
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in KEYED}
    wrong = [f"{t}: {n} rows" for t, df in tables.items() if (n := df.count()) != manifest["rows"][t]]
    wrong += [f"{r.problem}: {r.n}" for r in index_problems(tables["chunks"], tables["vectors"], dims).collect() if r.n]
    if wrong:
        raise ArchiveError("; ".join(wrong))
    parts = {t: store.write(t, df) for t, df in tables.items()}
    n = manifest["rows"]["chunks"]
    old = {k: [] for k in store.manifest(start)["tables"]}
    return store.publish(parts=old | {t: [p] for t, p in parts.items()}, sizes=dict.fromkeys(parts.values(), n), top=manifest["top"], counts={"chunks": n, "tokens": manifest["tokens"]}, expect=start)
