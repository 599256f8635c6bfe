"""Ranked-retrieval evaluation: suites, their run through hybrid retrieval, metrics (recall, reciprocal rank, nDCG, source hits), macro means,
comparison with a baseline, artifacts."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrag.config import Retrieve
from sparkrag.operators import fts, retrieval

SCHEMA_VERSION = "retrieval-evaluation/v1"  # fixed value of the file formats


class DatasetError(ValueError):
    pass


@dataclass(frozen=True)
class Dataset:
    """corpus: n, id, text, source, embedding; cases: n, id, query, embedding, targets."""

    corpus: DataFrame
    cases: DataFrame
    version: str
    digests: dict


_VECTOR, _TEXT = T.ArrayType(T.FloatType()), T.StringType()
_TARGET = T.StructType().add("chunk_id", _TEXT).add("source", _TEXT).add("grade", T.IntegerType())
_CORPUS = T.StructType().add("id", _TEXT).add("text", _TEXT).add("source", _TEXT).add("embedding", _VECTOR)
_CASES = T.StructType().add("id", _TEXT).add("query", _TEXT).add("embedding", _VECTOR).add("targets", T.ArrayType(_TARGET)).add("labels", T.ArrayType(_TEXT))


def _strict(raw: str, names: set, what: str) -> dict:
    try:
        found = json.loads(raw)
    except ValueError as e:
        raise DatasetError(f"{what}: {e}") from None
    if not isinstance(found, dict) or set(found) - names:
        raise DatasetError(f"{what}: unknown fields")
    return found


def _lines(spark: SparkSession, path: str, schema: T.StructType, what: str) -> tuple[DataFrame, str]:
    """Records with their line's number, and the file's digest. Suites are small files: one is read whole."""
    row = spark.read.format("binaryFile").load(path).first()  # none for an empty file
    raw = bytes(row.content) if row else b""
    lines = raw.decode().split("\n")
    lines = lines[:-1] if lines and not lines[-1] else lines
    if not lines:
        raise DatasetError(f"{what}: must contain at least one record")
    names = set(schema.fieldNames())
    for i, line in enumerate(lines, 1):
        if not line.strip():
            raise DatasetError(f"{what}: line {i}: blank lines are not allowed")
        row = _strict(line, names, f"{what}: line {i}")
        for t in row.get("targets", []):
            if set(t) - {"chunk_id", "source", "grade"}:
                raise DatasetError(f"{what}: line {i}: unknown fields")
    rows = spark.createDataFrame(list(enumerate(lines)), "n long, j string")
    return rows.select("n", F.from_json("j", schema, {"mode": "FAILFAST"}).alias("r")).select("n", "r.*"), hashlib.sha256(raw).hexdigest()


def load(spark: SparkSession, folder: str) -> Dataset:
    """A suite (manifest.json, corpus and cases as strict JSON lines), checked as a whole."""
    m = _strict(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0], {"schema_version", "version", "corpus", "cases"}, "manifest")
    if m.get("schema_version") != SCHEMA_VERSION or not all(str(m.get(k, "")).strip() for k in ("version", "corpus", "cases")):
        raise DatasetError("manifest: require schema_version, version, corpus and cases")
    corpus, one = _lines(spark, f"{folder}/{m['corpus']}", _CORPUS, "corpus")
    cases, two = _lines(spark, f"{folder}/{m['cases']}", _CASES, "cases")
    found = Dataset(corpus, cases, m["version"], {"corpus_digest": one, "cases_digest": two})
    bad = defects(found).collect()
    if bad:
        raise DatasetError(f"{bad[0].place}: {bad[0].problem}")
    return found


def defects(data: Dataset) -> DataFrame:
    """place, problem of records that make a suite invalid."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    dims = data.corpus.agg(F.first(F.size("embedding")).alias("dims"))
    c = data.corpus.crossJoin(F.broadcast(dims))  # one row
    k = data.cases.crossJoin(F.broadcast(dims))
    named = lambda df, problem: df.select(F.col("id").alias("place"), F.lit(problem).alias("problem"))
    t = data.cases.select("id", F.explode("targets").alias("t")).select("id", "t.*")
    parts = [
        named(c.where(empty("id") | empty("text") | empty("source") | (size <= 0)), "require id, text, source and embedding"),
        named(c.where(size != F.col("dims")), "embedding dimensions differ"),
        named(data.corpus.groupBy("id").count().where("count > 1"), "duplicate id"),
        named(k.where(empty("id") | empty("query") | (size != F.col("dims")) | (F.coalesce(F.size("targets"), F.lit(-1)) <= 0)), "require id, query, matching embedding and a target"),
        named(data.cases.groupBy("id").count().where("count > 1"), "duplicate id"),
        named(t.where(empty("chunk_id") & empty("source")), "a target needs chunk_id or source"),
        named(t.where(~empty("chunk_id")).join(data.corpus.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti"), "target chunk does not resolve"),
        named(t.where(~empty("source")).join(data.corpus.select("source"), "source", "left_anti"), "target source does not resolve"),
        named(t.where("grade < 0"), "relevance grade cannot be negative"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run(data: Dataset, cfg: Retrieve = Retrieve()) -> tuple[DataFrame, DataFrame]:
    """(metrics by case, ranked evidence) of a suite's cases through the batch form of hybrid retrieval."""
    chunks = data.corpus.select((F.col("n") + 1).alias("chunk_id"), F.col("id").alias("name"), "text", "source", "embedding")
    index = fts.indexed(chunks, "chunk_id", "text")
    queries = data.cases.select(F.col("n").alias("query_id"), "query", F.col("embedding").alias("qv"))
    found = retrieval.hybrid_batch(chunks.select("chunk_id", "embedding"), index, queries, cfg)
    names = data.cases.select(F.col("n").alias("query_id"), F.col("id").alias("case_id"))
    evidence = found.join(names, "query_id").join(chunks.select("chunk_id", "name", "source", "text"), "chunk_id").select("case_id", "pos", F.col("name").alias("chunk_id"), "source", "text", "vec_score", "bm25_score", "final_score")
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    t = data.cases.select(F.col("id").alias("case_id"), F.posexplode("targets").alias("i", "t")).select("case_id", F.col("i").cast("string").alias("target"), F.col("t.chunk_id").alias("chunk_id"), F.col("t.source").alias("source"), F.coalesce("t.grade", F.lit(0)).alias("grade"))
    t = t.withColumns({"chunk_id": blank("chunk_id"), "source": blank("source")})
    return case_metrics(names.select("case_id"), evidence, t), evidence


def artifact(data: Dataset, cfg: Retrieve, per_case: DataFrame, evidence: DataFrame) -> str:
    """The run as indented JSON without wall-clock fields: equal inputs give equal bytes. Suites are small; the rows come to the driver."""
    shown = {}
    for r in evidence.orderBy("case_id", "pos").collect():
        shown.setdefault(r.case_id, []).append({k: v for k, v in r.asDict().items() if k != "case_id"})
    cases = [r.asDict() | {"evidence": shown.get(r.case_id, [])} for r in per_case.orderBy("case_id").collect()]
    head = {"schema_version": SCHEMA_VERSION, "dataset": {"version": data.version, **data.digests}, "configuration": asdict(cfg)}
    return json.dumps(head | {"metrics": macro(per_case).first().asDict(), "cases": cases}, indent=2) + "\n"


def load_baseline(spark: SparkSession, path: str) -> dict:
    b = _strict(spark.read.text(path, wholetext=True).first()[0], {"schema_version", "dataset", "configuration", "metrics"}, "baseline")
    d = b.get("dataset") or {}
    if b.get("schema_version") != SCHEMA_VERSION or not all(d.get(k) for k in ("version", "corpus_digest", "cases_digest")):
        raise DatasetError("baseline: require schema version, dataset version and digests")
    return b


def load_tolerances(spark: SparkSession, path: str) -> dict:
    t = _strict(spark.read.text(path, wholetext=True).first()[0], {"schema_version", "max_drop"}, "tolerances")
    if t.get("schema_version") != SCHEMA_VERSION or not t.get("max_drop"):
        raise DatasetError("tolerances: require schema version and a max_drop")
    if any(v < 0 for v in t["max_drop"].values()):
        raise DatasetError("tolerances: max_drop cannot be negative")
    return t


def gate(data: Dataset, metrics: dict, baseline: dict, tolerances: dict) -> list[str]:
    """Why a run must not pass: another dataset than the baseline's, or metrics that fell by more than allowed."""
    d = baseline["dataset"]
    if {k: d[k] for k in data.digests} != data.digests or d["version"] != data.version:
        raise DatasetError("the baseline is of another dataset")
    return failures(metrics, baseline["metrics"], tolerances["max_drop"])


def case_metrics(cases: DataFrame, results: DataFrame, targets: DataFrame, by: str = "case_id") -> DataFrame:
    """case_id, recall, rr, ndcg, source_hit of every case.

    cases: case_id; results: case_id, pos (from 1), chunk_id, source; targets: case_id, target (id), chunk_id, source, grade.
    A target is met by its chunk id or, where it names one, its source. Grade 0 counts as 1. Cases that share their targets name them by another column,
    which cases and targets have (by): each target is then one row, not one for each of the cases.
    """
    cases = cases.select(*dict.fromkeys(("case_id", by)))
    results = results if by == "case_id" else results.drop(by).join(cases, "case_id")
    t = targets.withColumn("grade", F.when(F.col("grade") == 0, 1).otherwise(F.col("grade")).cast("double"))
    t = t.select(F.col(by).alias("t_by"), "target", F.col("chunk_id").alias("t_chunk"), F.col("source").alias("t_source"), "grade")
    by_chunk = results.join(t.where("t_chunk is not null"), (results[by] == t.t_by) & (results.chunk_id == t.t_chunk)).select(results.case_id, "pos", "target", "grade", F.lit(False).alias("by_source"))
    by_source = results.join(t.where("t_source is not null"), (results[by] == t.t_by) & (results.source == t.t_source)).select(results.case_id, "pos", "target", "grade", F.lit(True).alias("by_source"))
    hits = by_chunk.unionByName(by_source)
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    best = hits.groupBy("case_id", "pos").agg(F.max("grade").alias("g"))
    dcg = best.groupBy("case_id").agg(F.sum(gain(F.col("g")) / F.log2(F.col("pos") + 1)).alias("dcg"), F.min("pos").alias("first"))
    got = results.groupBy("case_id").agg(F.count(F.lit(1)).alias("k"))
    # the best grades first, by how many targets have each: no target is ranked
    above = F.sum("many").over(Window.partitionBy("t_by").orderBy(F.col("grade").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("many")
    grades = t.groupBy("t_by", "grade").agg(F.count(F.lit(1)).alias("many")).withColumn("above", above)
    grades = cases.join(got, "case_id").join(grades, F.col(by) == F.col("t_by")).where("above < k")
    ranks = grades.select("case_id", "grade", F.explode(F.sequence(F.col("above") + 1, F.least(F.col("above") + F.col("many"), F.col("k")))).alias("i"))
    ideal = ranks.groupBy("case_id").agg(F.sum(gain(F.col("grade")) / F.log2(F.col("i") + 1)).alias("ideal"))
    per = t.groupBy(F.col("t_by").alias(by)).agg(F.countDistinct("target").alias("n"))
    met = hits.groupBy("case_id").agg(F.countDistinct("target").alias("met"), F.max("by_source").alias("source_hit"))
    rows = cases.join(per, by, "left")
    for part in (met, dcg, ideal):
        rows = rows.join(part, "case_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "case_id",
        zero(F.col("met") / F.col("n")).alias("recall"),
        zero(1 / F.col("first")).alias("rr"),
        F.when(F.col("ideal") > 0, zero(F.col("dcg") / F.col("ideal"))).otherwise(0.0).alias("ndcg"),
        F.coalesce("source_hit", F.lit(False)).alias("source_hit"),
    )


def macro(per_case: DataFrame) -> DataFrame:
    return per_case.agg(F.avg("recall").alias("recall_at_k"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.avg(F.col("source_hit").cast("double")).alias("source_hit_rate"))


def failures(now: dict, baseline: dict, max_drop: dict) -> list[str]:
    """Metrics that fell by more than allowed."""
    return [k for k in sorted(baseline) if now[k] < baseline[k] - max_drop.get(k, 0.0)]


def compared(macros: DataFrame, baseline: dict, max_drop: dict) -> DataFrame:
    """metric, baseline, observed, threshold, failed for the metrics of one row of means."""
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), F.lit(float(v)).alias("baseline"), F.col(k).alias("observed"), F.lit(float(v) - max_drop.get(k, 0.0)).alias("threshold")) for k, v in sorted(baseline.items())))
    return macros.select(F.explode(rows).alias("x")).select("x.*").withColumn("failed", F.col("observed") < F.col("threshold"))


def unresolved(targets: DataFrame, corpus: DataFrame) -> DataFrame:
    """Targets that name no chunk or source of the corpus."""
    c = targets.where("chunk_id is not null").join(corpus.select("chunk_id"), "chunk_id", "left_anti").select("case_id", "target")
    s = targets.where("chunk_id is null and source is not null").join(corpus.select("source").distinct(), "source", "left_anti").select("case_id", "target")
    return c.unionByName(s)
