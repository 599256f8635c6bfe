"""Evidence with [n] labels, its rendering, and validation of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.functions.text import trim_ws


def evidence(results: DataFrame, by: str, order: Column) -> DataFrame:
    """Adds n (label by rank), excerpt and uri."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    w = Window.partitionBy(by).orderBy(order)
    return results.withColumn("n", F.row_number().over(w)).withColumn("excerpt", trim_ws(F.coalesce(blank("parent_text"), F.col("text")))).withColumn("uri", F.coalesce(blank("document_uri"), F.col("source")))


def rendered(n: Column, source: Column, excerpt: Column) -> Column:
    return F.concat(F.lit("["), n.cast("string"), F.lit("] [来源: "), source, F.lit("]\n"), excerpt)


def prompt(rows: DataFrame, by: str) -> DataFrame:
    """by, context: the rendered evidence in order."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", rendered(F.col("n"), F.col("source"), F.col("excerpt")).alias("r")))), lambda x: x["r"]), "\n\n").alias("context"))


# The rule of grounded answers, and what is said where there is no evidence.
RULE = "[RAG evidence]\nUse only the supplied citation labels for factual claims. Attach a label such as [1] to each supported claim. Do not invent, change, or reuse labels from another request. If the evidence does not establish a claim, say that the available evidence is insufficient.\n"
NO_EVIDENCE = "No retrieval evidence is available for this request. State uncertainty rather than citing a source.\n"


def instructions(requests: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """by, instructions: the rule and each piece of evidence (n, source, document_title, uri, location, excerpt) in order, for every request."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f" {name}="), c)).otherwise("")
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] source="), "source", part("title", F.col("document_title")), part("uri", F.col("uri")), part("location", F.col("location")), F.lit("\n"), "excerpt", F.lit("\n"))
    found = rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("r")))), lambda x: x["r"]), "").alias("__e"))
    return requests.select(by).distinct().join(found, by, "left").select(by, F.concat(F.lit(RULE), F.coalesce("__e", F.lit(NO_EVIDENCE))).alias("instructions"))


def renumbered(calls: DataFrame, by: str, call: str, rank: str) -> DataFrame:
    """Adds label: the evidence of all calls of a request numbered on from 1, by call and rank."""
    return calls.withColumn("label", F.row_number().over(Window.partitionBy(by).orderBy(call, rank)))


def labels(answer: Column) -> Column:
    """Distinct [n] labels in order of first appearance."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.greatest(F.lit("0"), F.ltrim(x, F.lit("0"))))
    # numbers beyond an int stand for no evidence: -1 keeps them among the invalid ones
    return F.array_distinct(F.transform(found, lambda x: F.when(F.length(x) > 9, F.lit(-1)).otherwise(x.cast("int"))))


def validated(answer: Column, known: Column) -> dict[str, Column]:
    """valid and invalid labels, and missing: the answer cites nothing valid though there is evidence."""
    found = labels(answer)
    valid = F.array_intersect(found, known)
    return {"valid": valid, "invalid": F.array_except(found, known), "missing": (F.size(valid) == 0) & (F.size(known) > 0)}


def unexpired(manifests: DataFrame, now: Column) -> DataFrame:
    return manifests.where(F.col("expires_at") > now)
