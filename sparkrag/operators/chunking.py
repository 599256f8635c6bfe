"""Chunkers: a document's text becomes ordered chunks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrag.config import Chunk
from sparkrag.functions.text import cosine, md5_hex, sentences, strip_fence, token_estimate

def _fold(parts: Column, most: int, glue: str) -> Column:
    """Greedy packing of strings: a part that would exceed `most` tokens begins a new chunk.

    The fold runs over lengths and keeps where chunks begin; each chunk's text is made once, by one slice of the parts.
    """

    def step(a, n):
        both = a["n"] + len(glue) + n
        new = (a["i"] == 0) | (F.floor(both / 3) > most)
        return F.struct(F.when(new, F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"]).alias("at"), F.when(new, n).otherwise(both).alias("n"), (a["i"] + 1).alias("i"))

    zero = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def cut(ps):
        at = F.aggregate(F.transform(ps, lambda x: F.length(x)), zero, step, lambda a: a["at"])
        ends = lambda starts, k: F.coalesce(F.get(starts, k + 1), F.size(ps))
        return _bind(at, lambda starts: F.transform(starts, lambda x, k: F.array_join(F.slice(ps, x + 1, ends(starts, k) - x), glue)))

    return _bind(parts, cut)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _merge_tail(chunks: Column, least: int, glue: str) -> Column:
    n = F.size(chunks)
    short = (n >= 2) & (F.floor(F.length(F.element_at(chunks, -1)) / 3) < least)
    return F.when(short, F.concat(F.slice(chunks, 1, n - 2), F.array(F.concat(F.element_at(chunks, -2), F.lit(glue), F.element_at(chunks, -1))))).otherwise(chunks)


def fixed(text: Column, cfg: Chunk = Chunk()) -> Column:
    """Array of chunks: sentences packed to at most max_tokens; a short last chunk joins the one before."""
    return _bind(_fold(sentences(text), cfg.max_tokens, " "), lambda chunks: _merge_tail(chunks, cfg.min_tokens, " "))


def exploded(docs: DataFrame, chunks: Column, *keys: str) -> DataFrame:
    """keys, ordinal, text, md5, tokens of each chunk."""
    return docs.select(*keys, F.posexplode(chunks).alias("ordinal", "text")).select(*keys, F.col("ordinal").cast("long").alias("ordinal"), "text", md5_hex(F.col("text")).alias("md5"), token_estimate(F.col("text")).alias("tokens"))


# ---- structure

_HEADING = re.compile(r"^(#{1,6})(?: (.*))?$")
_LIST = re.compile(r"^[ \t]*(?:[-*+]|[0-9]+\.) ")


@dataclass
class Block:
    text: str
    level: int = 0
    title: str = ""
    atomic: bool = False


def markdown_blocks(text: str) -> list[Block]:
    """Fences, headings, tables, list groups and paragraphs in order."""
    lines, out, i = text.split("\n"), [], 0

    def special(line):
        return line.startswith(("```", "~~~")) or _HEADING.match(line) or "|" in line or _LIST.match(line)

    while i < len(lines):
        line = lines[i]
        j = i + 1
        if line.startswith(("```", "~~~")):
            mark = line[:3]
            while j < len(lines) and not lines[j].startswith(mark):
                j += 1
            j = min(len(lines), j + 1)
            out.append(Block("\n".join(lines[i:j]), atomic=True))
        elif m := _HEADING.match(line):
            out.append(Block(line, len(m[1]), (m[2] or "").strip()))
        elif "|" in line:
            while j < len(lines) and "|" in lines[j]:
                j += 1
            out.append(Block("\n".join(lines[i:j]), atomic=True))
        elif _LIST.match(line):
            while j < len(lines) and lines[j] and (_LIST.match(lines[j]) or lines[j][0] in " \t"):
                j += 1
            out.append(Block("\n".join(lines[i:j]), atomic=True))
        else:
            while j < len(lines) and lines[j] and not special(lines[j]):
                j += 1
            out.append(Block("\n".join(lines[i:j])))
            while j < len(lines) and not lines[j]:
                j += 1
        i = j
    return out


def _tokens(s: str) -> int:
    return len(s) // 3


def is_markdown(text: str) -> bool:
    return any(_HEADING.match(x) or x.startswith(("```", "~~~")) for x in text.split("\n"))


def breadcrumb(stack: list[str], depth: int) -> str:
    parts = stack[:depth]
    return f"[{' > '.join(parts)}]\n" if parts else ""


def structure_chunks(text: str, cfg: Chunk) -> list[str]:
    """Markdown-aware chunks; fences, tables and lists are never split."""
    chunks: list[str] = []
    buf, stack = "", []

    def flush():
        nonlocal buf
        if buf.strip():
            chunks.append((breadcrumb(stack, cfg.breadcrumb_depth) if cfg.breadcrumb else "") + buf.strip())
        buf = ""

    for b in markdown_blocks(text):
        if b.level:
            if _tokens(buf) >= cfg.max_tokens:
                flush()
            # a heading's place in the stack is its level, as far as the stack reaches: levels that are left out do not count
            stack[b.level - 1 :] = [b.title]
            buf = f"{buf}\n{b.text}" if buf else b.text
            continue
        if buf and _tokens(buf) + _tokens(b.text) > cfg.max_tokens:
            flush()
        if _tokens(b.text) > cfg.max_tokens:
            flush()
            chunks.append((breadcrumb(stack, cfg.breadcrumb_depth) if cfg.breadcrumb else "") + b.text)
            continue
        buf = f"{buf}\n{b.text}" if buf else b.text
        if _tokens(buf) >= cfg.max_tokens:
            flush()
    flush()
    if len(chunks) >= 2 and _tokens(chunks[-1]) < cfg.min_tokens:
        chunks[-2:] = [chunks[-2] + "\n" + chunks[-1]]
    return chunks


#: Bytes of text whose Python strings a task holds at once; a longer text is held alone.
HELD = 1 << 20


def _strings(fn: Callable[[str], list[str]]):
    """Arrow: a batch becomes Python strings and chunks by pieces of some `HELD` bytes."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(s: pa.Array) -> pa.Array:
        ends, out, at = pc.cumulative_sum(pc.fill_null(pc.binary_length(s).cast(pa.int64()), 0)).to_numpy(), [], 0
        while at < len(s):
            end = max(at + 1, int(ends.searchsorted((ends[at - 1] if at else 0) + HELD, side="right")))
            out.append(pa.array([fn(t or "") for t in s.slice(at, end - at).to_pylist()], pa.list_(pa.string())))
            at = end
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return run


def structure(text: Column, cfg: Chunk = Chunk()) -> Column:
    """Structure chunks for Markdown, fixed chunks for other texts (Arrow only for the former)."""
    marked = text.rlike(r"(?m)^(#{1,6}( |$)|```|~~~)")
    run = _strings(lambda t: structure_chunks(t, cfg) if t else [])
    return F.when(marked, run(F.when(marked, text))).otherwise(fixed(text, cfg))


# ---- agentic

LLM = Callable[[str], str]


def boundary_prompt(part: str, cfg: Chunk) -> str:
    """What the model is asked for a segment of numbered lines."""
    return f'Cut the text below into parts that each treat one subject, of {cfg.min_tokens} to {cfg.max_tokens} tokens. Answer in JSON only: {{"chunks": [{{"start_line": 1, "end_line": 15, "summary": "..."}}]}}\n\nText:\n{part}'


def fixed_chunks(text: str, cfg: Chunk) -> list[str]:
    """What `fixed` makes of a text, for callers in Python."""
    out: list[str] = []
    for s in (x.strip() for x in re.sub(r"([。！？.!?][\t\n\f\r ]*|\n+)", "\\1\x01", text).split("\x01")):
        if not s:
            continue
        if out and _tokens(f"{out[-1]} {s}") <= cfg.max_tokens:
            out[-1] += f" {s}"
        else:
            out.append(s)
    if len(out) >= 2 and _tokens(out[-1]) < cfg.min_tokens:
        out[-2:] = [f"{out[-2]} {out[-1]}"]
    return out


def by_form(text: str, cfg: Chunk) -> list[str]:
    """Structure chunks of Markdown, fixed chunks of other texts."""
    return structure_chunks(text, cfg) if is_markdown(text) else fixed_chunks(text, cfg)


def boundaries(answer: str) -> list[dict]:
    """The model's line ranges; ValueError where the answer has none."""
    raw = re.sub(r"^```(?:json|JSON)?", "", answer.strip())
    raw = raw.rpartition("```")[0] if "```" in raw else raw
    found = json.loads(raw.strip())
    chunks = found.get("chunks") if isinstance(found, dict) else None
    if not chunks:
        raise ValueError("no chunks")
    return [{"start_line": int(c.get("start_line", 0)), "end_line": int(c.get("end_line", 0)), "summary": str(c.get("summary") or "")} for c in chunks]


def agentic(text: Column, llm: LLM, cfg: Chunk = Chunk()) -> Column:
    """Chunks by line ranges that a model returns as JSON {"chunks": [{"start_line", "end_line", "summary"}]}; a segment without a usable answer is
    cut by its form. Ranges without text give no chunk."""

    def cut(t: str) -> list[str]:
        if not t:
            return []
        lines, out, at = t.split("\n"), [], 0
        most = cfg.segment_tokens if cfg.segment_tokens > 0 else 4000
        while at < len(lines):
            end, size = at, 0
            while end < len(lines) and (end == at or size + _tokens(lines[end]) <= most):
                size += _tokens(lines[end])
                end += 1
            part = "".join(f"{k + 1}: {lines[k]}\n" for k in range(at, end))
            try:
                for c in boundaries(llm(boundary_prompt(part, cfg))):
                    body = "\n".join(lines[max(0, c["start_line"] - 1) : max(0, c["end_line"])]).strip()
                    if body:
                        out.append((f"[摘要] {c['summary']}\n" if cfg.summaries and c["summary"] else "") + body)
            except Exception:  # noqa: BLE001  any failure of the model falls back
                out += by_form("\n".join(lines[at:end]), cfg)
            at = end
        return out

    return _strings(cut)(text)


# ---- semantic

def adjacent_cosine(rows: DataFrame, doc: str, order: str, vector: str) -> DataFrame:
    """doc, order, sim: cosine with the next row of the document."""
    w = Window.partitionBy(doc).orderBy(order)
    return rows.withColumn("nxt", F.lead(vector).over(w)).where("nxt is not null").select(doc, order, cosine(F.col(vector), F.col("nxt")).alias("sim"))


def semantic_breaks(sims: DataFrame, doc: str, percentile: float = 90.0) -> DataFrame:
    """Adds cutoff (linear percentile 100 - p of the document) and brk (sim below it)."""
    p = min(max(100 - percentile, 0.0), 100.0) / 100
    cut = sims.groupBy(doc).agg(F.percentile("sim", F.lit(p)).alias("cutoff"))
    return sims.join(cut, doc).withColumn("brk", F.col("sim") < F.col("cutoff"))


def semantic(rows: DataFrame, doc: str, order: str, text: str, vector: str, cfg: Chunk = Chunk()) -> DataFrame:
    """doc, ordinal, text of chunks from embedded sentences: breaks, short groups merged, long groups split, then token packing."""
    sims = semantic_breaks(adjacent_cosine(rows, doc, order, vector), doc, cfg.percentile).select(doc, order, "brk")
    marked = rows.join(sims, [doc, order], "left").withColumn("brk", F.coalesce("brk", F.lit(False)))
    lists = marked.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("s"), F.col("brk").alias("b")))).alias("xs"))
    least, most = cfg.min_sentences, cfg.max_sentences
    empty = F.array().cast("array<string>")

    def step(a, x):
        buf = F.concat(a["buf"], F.array(x["s"]))
        close = x["b"] & (F.size(buf) >= least)
        return F.when(close, F.struct(F.concat(a["done"], F.array(buf)).alias("done"), empty.alias("buf"))).otherwise(F.struct(a["done"].alias("done"), buf.alias("buf")))

    def finish(a):
        n = F.size(a["done"])
        joined = F.concat(F.slice(a["done"], 1, n - 1), F.array(F.concat(F.element_at(a["done"], -1), a["buf"])))
        return F.when(F.size(a["buf"]) == 0, a["done"]).when((F.size(a["buf"]) < least) & (n > 0), joined).otherwise(F.concat(a["done"], F.array(a["buf"])))

    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("buf"))
    groups = F.aggregate("xs", zero, step, finish)
    split = F.flatten(F.transform(groups, lambda g: F.transform(F.sequence(F.lit(0), F.floor((F.size(g) - 1) / most).cast("int")), lambda k: F.slice(g, k * most + 1, F.lit(most)))))
    packed = F.flatten(F.transform(split, lambda g: _fold(g, cfg.max_tokens, " ")))
    return lists.select(doc, F.posexplode(packed).alias("ordinal", "text"))


# ---- hierarchical

def hierarchical(chunks: DataFrame, doc: str, cfg: Chunk = Chunk()) -> DataFrame:
    """Adds parent_id and parent_text: consecutive chunks of a document up to parent_tokens (0 or less: 800). chunks: doc, ordinal, text."""
    lists = chunks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("xs"))
    most = cfg.parent_tokens if cfg.parent_tokens > 0 else 800

    def step(a, x):
        size = F.floor(F.length(x["text"]) / 3)
        new = (a["n"] > 0) & (a["n"] + size > most)
        g = a["g"] + F.when(new, 1).otherwise(0)
        return F.struct(g.alias("g"), F.when(new, size).otherwise(a["n"] + size).cast("long").alias("n"), F.concat(a["out"], F.array(F.struct(x["ordinal"].alias("ordinal"), x["text"].alias("text"), g.alias("g")))).alias("out"))

    zero = F.struct(F.lit(0).alias("g"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<ordinal: bigint, text: string, g: int>>").alias("out"))
    rows = lists.select(doc, F.explode(F.aggregate("xs", zero, step, lambda a: a["out"])).alias("x")).select(doc, "x.ordinal", "x.text", "x.g")
    parents = rows.groupBy(doc, "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), "\n").alias("parent_text"))
    parents = parents.withColumn("parent_id", F.concat(F.lit("parent-"), F.substring(md5_hex(F.col("parent_text")), 1, 8)))
    return rows.join(parents, [doc, "g"]).select(doc, "ordinal", "text", "parent_id", "parent_text")


def chunk_column(text: Column, cfg: Chunk = Chunk(), llm: LLM | None = None) -> Column:
    """Chunks by the strategy's name; unknown names mean fixed. Semantic chunks need vectors of sentences: see `pieces`."""
    if cfg.strategy == "semantic":
        raise ValueError("semantic chunks are made by `pieces`")
    if cfg.strategy == "structure":
        return structure(text, cfg)
    if cfg.strategy == "agentic":
        return agentic(text, llm, cfg) if llm is not None else structure(text, cfg)
    return fixed(text, cfg)


def pieces(docs: DataFrame, cfg: Chunk = Chunk(), embed: Callable[[Column], Column] | None = None, llm: LLM | None = None) -> DataFrame:
    """ord, text of the chunks of every document (text), by the strategy, beside the documents' other columns. Semantic: `embed` gives the vectors of
    sentences; documents that are alike in every column are cut once."""
    rest = [c for c in docs.columns if c != "text"]
    if cfg.strategy != "semantic":
        return docs.select(*rest, F.posexplode(chunk_column(F.col("text"), cfg, llm)).alias("ord", "text"))
    if embed is None:
        raise ValueError("semantic chunks need a model")
    rows = docs.select(F.struct(*rest, F.sha2(F.coalesce("text", F.lit("")), 256).alias("__digest")).alias("__doc"), "text").distinct()
    rows = rows.select("__doc", F.posexplode(sentences(F.col("text"))).alias("__o", "__s")).withColumn("__v", embed(F.col("__s")))
    return semantic(rows, "__doc", "__o", "__s", "__v", cfg).select(*(F.col("__doc")[c].alias(c) for c in rest), F.col("ordinal").cast("int").alias("ord"), "text")


__all__ = ["fixed", "exploded", "structure", "structure_chunks", "agentic", "semantic", "semantic_breaks", "adjacent_cosine", "hierarchical", "chunk_column", "pieces", "strip_fence"]
